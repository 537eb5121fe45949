"""Token budgets: which memories are shown, at which detail, and how."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text as X
from cairn.functions import values as C


def effective(call: int | None, override: int, default: int) -> int:
    """The call's budget, else a set override, else the default."""
    return call if call is not None else override if override > 0 else default


def detail_level(name: str | None) -> str:
    """Anything else than headline or full is summary."""
    low = (name or "").lower()
    return low if low in ("headline", "full") else "summary"


def stars() -> Column:
    return F.repeat(F.lit("★"), F.least(F.greatest(F.round(F.col("confidence") * 5).cast("int"), F.lit(1)), F.lit(5)))


def topic() -> Column:
    return X.trimmed(F.get(F.split("headline", ":"), F.lit(0)))


def render(level: str) -> Column:
    date = X.short_date("created_at")
    if level == "full":
        return F.col("content")
    if level == "headline":
        return F.concat(F.lit("["), stars(), F.lit("] "), F.col("headline"), F.lit(" @"), F.col("author"), F.lit(" | "), date)
    marks = F.when(F.size("tags") > 0, F.concat(F.lit(" #"), F.array_join("tags", " #"))).otherwise("")
    return F.concat(F.lit("["), stars(), F.lit("] "), topic(), F.lit(": "), F.col("summary"), F.lit(" @"), F.col("author"), marks, F.lit(" | "), date)


def allocate(ranked: DataFrame, budget: int, detail: str = "summary", query_id: str = "query_id", top: int = C.TOP_SUMMARIES) -> DataFrame:
    """Of each query's ranked memories the prefix that fits, with ``line``, ``cost`` and ``used``.

    The first that does not fit is tried as a headline, and ends the list.
    """
    wanted = render("full") if detail_level(detail) == "full" else F.when(F.col("rank") <= top, render("summary")).otherwise(render("headline"))
    rows = ranked.withColumn("_want", wanted).withColumn("_short", render("headline"))
    rows = rows.withColumn("_cost", X.count_tokens("_want")).withColumn("_short_cost", X.count_tokens("_short"))
    upto = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_after", F.sum("_cost").over(upto)).withColumn("_before", F.col("_after") - F.col("_cost"))
    over = (F.col("_after") > budget) | (budget - F.col("_before") < C.LEAST_BUDGET)
    rows = rows.withColumn("_first", F.min(F.when(over, F.col("rank"))).over(Window.partitionBy(query_id)))
    fits = F.col("_first").isNull() | (F.col("rank") < F.col("_first"))
    short = (F.col("rank") == F.col("_first")) & (budget - F.col("_before") >= C.LEAST_BUDGET) & (F.col("_before") + F.col("_short_cost") <= budget)
    rows = rows.filter(fits | short)
    rows = rows.withColumn("line", F.when(fits, F.col("_want")).otherwise(F.col("_short"))).withColumn("cost", F.when(fits, F.col("_cost")).otherwise(F.col("_short_cost")))
    return rows.withColumn("used", F.col("_before") + F.col("cost")).drop("_want", "_short", "_cost", "_short_cost", "_after", "_before", "_first")


def condense(query: Column | str, text: Column | str, most: Column) -> Column:
    """The sentences of a text that overlap the query most, within so many tokens, in their order."""
    q, whole = X.terms(query), X.col(text)
    none = F.array().cast("array<struct<i:int,s:string>>")

    def take(a: Column, x: Column) -> Column:
        fits = (a["used"] < most) & (a["used"] + x["cost"] <= most)
        more = F.concat(a["kept"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        return F.when(fits, F.struct((a["used"] + x["cost"]).alias("used"), more.alias("kept"))).otherwise(a)

    start = F.struct(F.lit(0).alias("used"), none.alias("kept"))
    chosen = lambda parts: F.aggregate(F.array_sort(F.transform(parts, lambda s, i: _scored(s, i, q))), start, take, lambda a: F.array_sort(a["kept"]))
    joined = lambda kept: F.when(F.size(kept) == 0, F.substring(whole, F.lit(1), (most * 4).cast("int"))).otherwise(F.array_join(F.transform(kept, lambda k: k["s"]), " "))
    cut = lambda parts: F.when(F.size(parts) <= 1, whole).otherwise(X.once(chosen(parts), joined))
    return F.when((most == 0) | (X.count_tokens(whole) <= most), whole).otherwise(X.once(X.sentences(text), cut))


def _scored(s: Column, i: Column, q: Column) -> Column:
    """A sentence with its score by the query's terms, the best being the least, its place and its cost; its terms are found once."""
    share = lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.filter(t, lambda w: F.array_contains(q, w))) / F.size(t))
    return F.struct((-(X.once(X.terms(s), share) + C.LEAD_BIAS / (1 + i))).alias("score"), i.alias("i"), s.alias("s"), X.count_tokens(s).alias("cost"))


def _tokens(text: str) -> int:
    return max(len(text) // 4, len(text.split()))


def allocate_dynamic(ranked: DataFrame, queries: DataFrame, budget: int, query_id: str = "query_id") -> DataFrame:
    """Like ``allocate``, each memory condensed to a fair share of what is left; one that does not fit is skipped.

    Shares depend on what was taken before, so the fold runs for each query over its
    few ranked memories; what it needs of each sentence is computed beforehand.
    """
    rows = ranked.join(queries.select(query_id, X.terms("query").alias("_q")), query_id)
    scored = lambda s, i: _scored(s, i, F.col("_q"))
    few = rows.select(query_id, "id", "rank", "content", F.concat(F.lit("["), stars(), F.lit("] "), topic(), F.lit(": ")).alias("head"), X.count_tokens("content").alias("size"), F.array_sort(F.transform(X.sentences("content"), scored)).alias("parts"))
    schema = T.StructType([ranked.schema[query_id], ranked.schema["id"], T.StructField("rank", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("cost", T.IntegerType()), T.StructField("used", T.IntegerType())])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, used, out = group.sort_values("rank"), 0, []
        for i, r in enumerate(group.itertuples()):
            left = budget - used
            if left < C.LEAST_BUDGET:
                break
            most = min(max(left // max(len(group) - i, 1), C.LEAST_SHARE), left)
            text = r.content
            if r.size > most and len(r.parts) > 1:
                chosen, total = [], 0
                for p in r.parts:
                    if total < most and total + p["cost"] <= most:
                        chosen.append((p["i"], p["s"]))
                        total += p["cost"]
                text = " ".join(s for _, s in sorted(chosen)) if chosen else text[: 4 * most]
            line = r.head + text
            cost = _tokens(line)
            if used + cost <= budget:
                used += cost
                out.append((getattr(r, query_id), r.id, r.rank, line, cost, used))
        return pd.DataFrame(out, columns=schema.names)

    return few.groupBy(query_id).applyInPandas(fold, schema)
