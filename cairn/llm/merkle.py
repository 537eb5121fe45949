"""A Merkle manifest of a table: a root over all rows, and a proof for each.

Rows are leaves; those of one group hang together under a subroot, and the subroots
under the root. A level is one window: partitioned by group and parent, ordered, its
full frame collects the at most FAN digests of a run, which are the preimage of the
parent and the siblings of each row. Of each run the first row stands for the parent
on the next level. Then the levels are read from the top down, and each row gets what
is beside and above it: a list of (left, right), the digests before and after its own.

No group is numbered in one task: rows are sorted by group and order over all tasks,
and a row's number follows from the counts of the tasks before. So a group that holds a
third of the table is spread like the others, and windows hold FAN rows.

Cases: null is another value than empty text; an id or group that is null counts as
one, before all others; rows that share an id are leaves in the order of their digests,
like rows then differ by their places; a lone leaf is the subroot of its group, and
that of a lone group is the root, with nothing beside it; texts are taken whole; an
empty table gives no rows. Columns that are not there count as null; others are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._spark import prepare, settle

#: Nodes of one run.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:string,right:string>"


def sealed(value: Column) -> Column:
    """A value with its length, so that neighbours cannot run into each other; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    """The digest of a row's values in their order."""
    return F.sha2(F.concat(*(sealed(v) for v in values.values())), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with their number in the group (``idx``, from 0) and how many it has (``n``); the sorted rows are settled."""
    placed = settle(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), free=True)
    placed = placed.withColumn("_task", F.shiftright("_at", 33))
    runs = placed.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_task")) - F.col("_rows")
    runs = runs.select(group, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return placed.join(runs, [group, "_task"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, digest, n) with their parent and the digests of its run."""
    nodes = nodes.withColumn("parent", F.floor(F.col("idx") / FAN).cast("long"))
    frame = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("digest").over(frame))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """All levels of nodes (grp, idx, digest, n) from the given one up, until each group has one left; a group that is done is on no further level."""
    levels, most = [nodes], nodes.agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    while most > 1:
        first = _runs(levels[-1].select("grp", "idx", "digest", "n").filter("n > 1")).filter(F.col("idx") % FAN == 0)
        parents = first.select("grp", F.col("parent").alias("idx"), F.sha2(F.array_join("run", ""), 256).alias("digest"), F.ceil(F.col("n") / FAN).cast("long").alias("n"))
        levels.append(settle(parents, free=True))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """grp, digest and level of the last node of each group."""
    return reduce(DataFrame.unionByName, (rows.filter("n = 1").select("grp", "digest", F.lit(k).alias("level")) for k, rows in enumerate(levels)))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first level with ``path``, the (left, right) of each level up to the last, and with what ``above`` (grp, level, path and more) says of the last node of each group, whose path follows."""
    more = [c for c in above.columns if c not in ("grp", "level", "path")]
    known = None
    for k in reversed(range(len(levels))):
        ends = above.filter(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("parent"), F.col("path").alias("rest"), *more)
        known = ends if known is None else known.select("grp", F.col("idx").alias("parent"), F.col("path").alias("rest"), *more).unionByName(ends)
        own = (F.col("idx") % FAN).cast("int")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), own), "").alias("left"), F.array_join(F.slice("run", own + 2, F.lit(FAN)), "").alias("right"))
        joined = _runs(levels[k]).join(known, ["grp", "parent"])
        known = joined.withColumn("path", F.when(F.col("n") > 1, F.concat(F.array(step), "rest")).otherwise(F.col("rest"))).drop("rest", "run", "parent")
    return known


def manifest(rows: DataFrame, group: str = "grp", order: str = "ord", digest: str = "digest") -> DataFrame:
    """The rows with ``path``, ``subroot`` and ``root``; leaves (their ``digest``) ascend by ``order`` and digest in each ``group``, which is not null. Names of columns that are added must be free."""
    prepare(rows.sparkSession)
    named = rows.withColumnsRenamed({group: "grp", order: "ord", digest: "digest"})
    levels = climb(numbered(named, "grp", "ord", "digest"))
    last = tops(levels).withColumnsRenamed({"grp": "member", "level": "_level"}).withColumn("grp", F.lit(""))
    over = climb(numbered(last, "grp", "member"))
    root = tops(over).select("grp", "level", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("digest").alias("root"))
    above = descend(over, root).select(F.col("member").alias("grp"), F.col("_level").alias("level"), "path", F.col("digest").alias("subroot"), "root")
    return descend(levels, above).drop("idx", "n").withColumnsRenamed({"grp": group, "ord": order, "digest": digest})


def siblings(path: Column) -> Column:
    """All digests beside and above a row, from its own level to the root's."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and what is beside and above it."""
    return F.aggregate(path, digest, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: a fifth of the texts by the checksum of their ids lose their capitals after the tree is made; those that had some are not verified."""
    have = {f: F.col(f) if f in df.columns else F.lit(None).cast("string") for f in FIELDS}
    tampered = F.crc32(have["doc_id"].cast("string")) % 5 == 0
    changed = have | {"text": F.translate(have["text"].cast("string"), _UPPER, _LOWER)}
    rows = df.select(F.coalesce(F.concat(F.lit("1"), have["source"]), F.lit("0")).alias("grp"), have["doc_id"].alias("ord"), leaf(**have).alias("digest"), F.when(tampered, leaf(**changed)).alias("other"))
    proved = manifest(settle(rows))
    out = proved.select(F.col("ord").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
