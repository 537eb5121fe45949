"""Memories, conflicts, events, statistics, reports and lookups as lines of text and as JSON: columns, so that a whole table is rendered at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X


def percent(share: Column | str) -> Column:
    """A share in whole percent, halves to the even one."""
    return F.bround(X.col(share) * 100, 0).cast("bigint").cast("string")


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def list_lines(memories: DataFrame) -> DataFrame:
    """One line for each memory: id, type, headline, author."""
    return memories.select("id", F.format_string("%s [%s] %s @%s", "id", "memory_type", "headline", "author").alias("line"))


def records(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """id and text of whole memories, with the edges that begin or end at them."""
    told = F.format_string("  %s --%s--> %s", "source_id", "edge_type", "target_id")
    ends = edges.select("id", told.alias("told"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("_of"))
    per = ends.groupBy("_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "told"))), lambda e: e["told"]), "\n").alias("relations"))
    named = lambda name, value: F.concat(F.rpad(F.lit(f"{name}:"), 12, " "), F.coalesce(value, F.lit("")))
    text = _lines(
        named("id", F.col("id")), named("type", F.col("memory_type")), named("state", F.col("state")), named("scope", F.col("scope")), named("author", F.col("author")), named("room", F.col("room")),
        named("tags", F.array_join("tags", ", ")), named("confidence", F.format_string("%.2f", "confidence")), named("created", X.timestamp_text("created_at")), F.concat(F.lit("\ncontent:\n"), "content"), F.concat(F.lit("\nrelations:\n"), "relations"),
    )
    return memories.join(per, F.col("id") == F.col("_of"), "left").select("id", text.alias("text"))


def conflict_lines(conflicts: DataFrame) -> DataFrame:
    return conflicts.select("id", F.concat("id", F.lit(" ["), "analysis.relation", F.lit("] "), percent("analysis.confidence"), F.lit("% — "), "new_memory.headline").alias("line"))


def timeline_lines(events: DataFrame) -> DataFrame:
    more = F.coalesce(F.concat(F.lit(" — "), "detail"), F.lit(""))
    return events.select("memory_id", F.concat(X.timestamp_text("created_at"), F.lit(" · "), "event_type", F.lit(" by "), F.coalesce("actor", F.lit("")), more).alias("line"))


def stats_text(stats: DataFrame, model: str, dim: int) -> DataFrame:
    """The counts of ``Store.stats`` as a block."""
    names = {"total memories": "total", "active": "active", "superseded": "superseded", "archived": "archived", "disputed": "disputed", "pending conflicts": "pending_conflicts"}
    lines = [F.concat(F.rpad(F.lit(f"  {name}:"), 21, " "), F.col(c).cast("string")) for name, c in names.items()]
    return stats.select(_lines(F.lit("statistics"), *lines, F.lit(f"  embedding model:   {model} ({dim}d)")).alias("text"))


def validation_text(report: DataFrame, checks: DataFrame) -> DataFrame:
    """answer_id and text of each report with its claims."""
    mark = F.when(F.col("supported"), "ok ").otherwise("!! ")
    line = F.concat(F.lit("  ["), mark, F.lit("] "), percent("score"), F.lit("%  "), "claim")
    per = checks.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("claims"))
    head = F.concat(F.lit("Grounding: "), percent("grounding_score"), F.lit("%  ("), F.when(F.col("grounded"), "grounded").otherwise("UNSUPPORTED CLAIMS FOUND"), F.lit(")"))
    lost = F.when(F.size("unsupported") > 0, F.concat(F.lit("\nUnsupported claims (revise or verify against the knowledge base):\n"), F.array_join(F.transform("unsupported", lambda u: F.concat(F.lit("  - "), u)), "\n")))
    return report.join(per, "answer_id", "left").select("answer_id", _lines(head, F.col("claims"), lost).alias("text"))


def validation_json(report: DataFrame, checks: DataFrame) -> DataFrame:
    """answer_id and the report as JSON, claims in their order."""
    claim = F.struct("claim_no", F.col("claim").alias("text"), "supported", "score", "evidence_id")
    per = checks.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(claim)), lambda c: c.dropFields("claim_no")).alias("claims"))
    whole = F.struct("grounded", "grounding_score", F.col("unsupported").alias("unsupported_claims"), F.coalesce("claims", F.array()).alias("claims"))
    return report.join(per, "answer_id", "left").select("answer_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def outcome_json(outcomes: DataFrame) -> DataFrame:
    """id and JSON of what became of new memories (id, outcome, resolution, relation, confidence, reasoning, existing_id, candidate_ids)."""
    stored = F.to_json(F.struct(F.lit("stored").alias("status"), "id"))
    auto = F.to_json(F.struct(F.lit("auto_resolved").alias("status"), "relation", F.col("resolution").alias("action"), F.when(F.col("resolution") == "discard_new", F.col("existing_id")).otherwise(F.col("id")).alias("id")))
    conflict = F.to_json(F.struct(F.lit("conflict").alias("status"), "id", "relation", "confidence", "reasoning", F.col("candidate_ids").alias("existing")))
    return outcomes.select("id", F.when(F.col("outcome") == "stored", stored).when(F.col("outcome") == "auto_resolved", auto).otherwise(conflict).alias("json"))


def lookup_text(found: DataFrame) -> DataFrame:
    """query_id and text of cache lookups (tier, sim, answer, ids)."""
    ids = F.when(F.size("ids") > 0, F.concat(F.lit("source memories: "), F.array_join("ids", ", ")))
    hit = _lines(F.concat(F.lit("HIT [cache] ("), percent("sim"), F.lit("% match)")), ids, F.concat(F.lit("\n"), "answer"))
    answer = _lines(F.concat(F.lit("HIT [memory] ("), percent("sim"), F.lit("% match)")), ids, F.concat(F.lit("\n"), "answer"))
    ground = _lines(F.concat(F.lit("GROUNDING ("), percent("sim"), F.lit("% match) — "), F.size("ids").cast("string"), F.lit(" memory(ies):")), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("  ["), i, F.lit("]"))), "\n"))
    return found.select("query_id", F.when(F.col("tier") == "hit", hit).when(F.col("tier") == "answer", answer).when(F.col("tier") == "grounding", ground).otherwise("MISS").alias("text"))


def lookup_json(found: DataFrame) -> DataFrame:
    """query_id and the lookup as JSON."""
    hit = F.to_json(F.struct(F.lit("hit").alias("status"), F.when(F.col("tier") == "hit", "cache").otherwise("memory").alias("source"), F.col("sim").alias("similarity"), "answer", F.col("ids").alias("source_ids")))
    ground = F.to_json(F.struct(F.lit("grounding").alias("status"), F.col("sim").alias("similarity"), F.col("ids").alias("memories"), "answer"))
    return found.select("query_id", F.when(F.col("tier").isin("hit", "answer"), hit).when(F.col("tier") == "grounding", ground).otherwise(F.to_json(F.struct(F.lit("miss").alias("status")))).alias("json"))
