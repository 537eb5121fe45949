"""Checks of answers against evidence, and the semantic cache in three tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators.search import nearest

SUPPORT = 0.35
HIT, ANSWER, GROUND = 0.85, 0.80, 0.50


def check_claims(answers: DataFrame, evidence: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """One row for each claim of answers (answer_id, answer) with its best share of terms in evidence (answer_id, rank, id, content).

    Evidence without answer_id counts for all answers. Claims and evidence meet on terms, so pairs that share none are never built.
    """
    own = [c for c in ("answer_id",) if c in evidence.columns]
    claims = answers.select("answer_id", F.posexplode(X.claims("answer")).alias("claim_no", "claim"))
    claims = claims.withColumn("terms", X.content_terms("claim"))
    wanted = claims.select("answer_id", "claim_no", F.size("terms").alias("m"), F.explode("terms").alias("term"))
    held = evidence.select(*own, "id", F.col("rank").alias("place"), F.explode(X.content_terms("content")).alias("term"))
    share = wanted.join(held, [*own, "term"]).groupBy("answer_id", "claim_no", "id", "place").agg((F.count("*") / F.first("m")).alias("share"))
    best = share.groupBy("answer_id", "claim_no").agg(F.min_by(F.struct("id", "share"), F.struct(-F.col("share"), F.col("place"), F.col("id"))).alias("best"))
    rows = claims.join(best, ["answer_id", "claim_no"], "left")
    score = F.when(F.size("terms") == 0, F.lit(1.0)).otherwise(F.coalesce("best.share", F.lit(0.0)))
    rows = rows.select("answer_id", "claim_no", "claim", score.alias("score"), F.col("best.id").alias("evidence_id"))
    return rows.withColumn("supported", F.col("score") >= threshold)


def report(answers: DataFrame, checks: DataFrame) -> DataFrame:
    """One row for each answer: grounding_score, grounded, n_claims, unsupported."""
    lost = F.transform(F.array_sort(F.collect_list(F.when(~F.col("supported"), F.struct("claim_no", "claim")))), lambda x: x["claim"])
    per = checks.groupBy("answer_id").agg(F.avg("score").alias("grounding_score"), F.bool_and("supported").alias("grounded"), F.count("*").alias("n_claims"), lost.alias("unsupported"))
    none = F.array().cast("array<string>")
    return answers.select("answer_id").join(per, "answer_id", "left").select(
        "answer_id", F.coalesce("grounding_score", F.lit(0.0)).alias("grounding_score"), F.coalesce("grounded", F.lit(False)).alias("grounded"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("unsupported", none).alias("unsupported")
    )


def live(cache: DataFrame, as_of: str, room: str | None = None) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    rows = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return rows if room is None else rows.filter(F.col("room") == room)


def cached(queries: DataFrame, cache: DataFrame, as_of: str, room: str | None = None, threshold: float = HIT) -> DataFrame:
    """The most similar live entry of each query, the newest of equals, if it is similar enough."""
    entries = live(cache, as_of, room).filter(F.size("query_embedding") > 0)
    tie = F.format_string("%020d:%s", F.lit(10**18) - F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id"))  # newest first
    keyed = entries.select(tie.alias("id"), F.col("query_embedding").alias("embedding"), F.struct("id", "answer", "source_ids", "hits").alias("entry"))
    near = nearest(queries.select("query_id", "embedding"), keyed.select("id", "embedding"), 1).filter(F.col("sim") >= threshold)
    return near.join(keyed.select("id", "entry"), "id").select("query_id", F.col("entry.id").alias("cache_id"), F.col("entry.answer").alias("answer"), "sim")


def from_memories(queries: DataFrame, memories: DataFrame, k: int = 5, least: float = 0.3, room: str | None = None) -> DataFrame:
    """The k nearest memories of each query that may be shown; filters come after the k."""
    near = nearest(queries.select("query_id", "embedding"), memories.filter("in_index").select("id", "embedding"), k)
    rows = near.join(memories.select("id", "content", "state", "confidence", "room"), "id")
    rows = rows.filter(~F.col("state").isin("archived", "superseded") & (F.col("confidence") >= least))
    return rows if room is None else rows.filter(F.col("room") == room)


def lookup(queries: DataFrame, cache: DataFrame, memories: DataFrame, as_of: str, room: str | None = None, hit: float = HIT, answer: float = ANSWER, ground: float = GROUND, use_kb: bool = True) -> DataFrame:
    """tier (hit, answer, grounding, miss), answer, ids and similarity (of the nearest) for each query."""
    first = cached(queries, cache, as_of, room, hit).select("query_id", F.col("answer").alias("a1"), F.array("cache_id").alias("i1"), F.col("sim").alias("s1"))
    rows = queries.select("query_id").join(first, "query_id", "left")
    if use_kb:
        near = from_memories(queries, memories, room=room)
        in_order = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("rank", c)))), lambda x: x[c])
        strong, weak = F.col("sim") >= answer, F.col("sim") >= ground
        per = near.groupBy("query_id").agg(F.array_join(in_order(strong, "content"), "\n\n").alias("a2"), in_order(strong, "id").alias("i2"), F.array_join(in_order(weak, "content"), "\n\n").alias("a3"), in_order(weak, "id").alias("i3"), F.max("sim").alias("s2"))
        rows = rows.join(per, "query_id", "left")
    else:
        rows = rows.selectExpr("*", "'' AS a2", "cast(array() AS array<string>) AS i2", "'' AS a3", "cast(array() AS array<string>) AS i3", "cast(null AS double) AS s2")
    tier = F.when(F.col("a1").isNotNull(), "hit").when(F.size("i2") > 0, "answer").when(F.size("i3") > 0, "grounding").otherwise("miss")
    rows = rows.withColumn("tier", tier)
    pick = lambda a, b, c, none: F.when(F.col("tier") == "hit", F.col(a)).when(F.col("tier") == "answer", F.col(b)).when(F.col("tier") == "grounding", F.col(c)).otherwise(none)
    return rows.select("query_id", "tier", pick("a1", "a2", "a3", F.lit(None).cast("string")).alias("answer"), pick("i1", "i2", "i3", F.array().cast("array<string>")).alias("ids"), pick("s1", "s2", "s2", F.lit(None).cast("double")).alias("sim"))


def evict(cache: DataFrame, most: int = 500) -> DataFrame:
    """The newest entries; the ranks come from a top-n, so no task sorts the whole cache."""
    return cache.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """The entries that cite none of the changed memories (id)."""
    cited = cache.select(F.col("id").alias("entry"), F.explode("source_ids").alias("source")).join(changed.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    return cache.join(cited.select("entry").distinct(), F.col("id") == F.col("entry"), "left_anti")


def touched(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Adds to a counter how often each id was returned."""
    counts = ids.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"))
    return rows.join(counts, F.col("id") == F.col("_id"), "left").withColumn(column, F.col(column) + F.coalesce("_n", F.lit(0))).drop("_id", "_n")


def with_rank(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
