"""Files in and out: JSON lines of memories, packed vectors, settings, and memories made of other tables."""

from __future__ import annotations

import struct
import tomllib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values as C
from cairn.functions.schema import EXPORTED, MEMORY_FIELDS
from cairn.functions.vectors import embed
from cairn.sources.packed import PackedVectors
from cairn.sources.shared import sound

#: Settings and their defaults.
DEFAULTS = {
    "author": {"id": "me", "default_scope": "personal"},
    "embedding": {"provider": "local", "dim": C.DIM},
    "recall": {"limit": 5, "min_confidence": 0.3, "rrf_k": 60, "max_tokens": 200},
    "conflict": {"similarity": 0.45, "supersede": 0.92, "duplicate": 0.95, "complement": 0.80, "expiry_secs": 300, "top_k": 5},
    "rerank": {"enabled": True, "pool_factor": 4, "weight": 0.5},
    "token_budget": {"dynamic": False, "max_tokens": 0},
    "guardrail": {"support_threshold": 0.35, "evidence_limit": 5},
    "cache": {"enabled": True, "hit_threshold": 0.85, "answer_threshold": 0.80, "ground_threshold": 0.50, "use_kb": True, "ttl_secs": 3600, "max_entries": 500},
    "privacy": {"exclude_patterns": []},
    "compress": {"intensity": "full"},
}


def settings(toml: str = "", **overrides) -> dict:
    """Defaults, then the TOML text, then ``section__key`` arguments that are not None."""
    out = {name: dict(section) for name, section in DEFAULTS.items()}
    for name, section in tomllib.loads(toml).items():
        if isinstance(section, dict):
            out.setdefault(name, {}).update(section)
    for key, value in overrides.items():
        section, _, name = key.partition("__")
        if value is not None:
            out[section][name] = value
    return out


def export_memories(memories: DataFrame, path: str, scope: str | None = None) -> None:
    """One JSON object a line, newest first, without embeddings."""
    rows = memories if scope is None else memories.filter(F.col("scope") == scope)
    rows.select(*MEMORY_FIELDS).orderBy(F.desc("created_at"), "id").write.option("ignoreNullFields", "false").json(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """Memories of JSON lines; a broken line is an error, blank lines and missing lists are not."""
    rows = spark.read.schema(EXPORTED).option("mode", "FAILFAST").json(path)
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("tags", "entities", "endorsed_by", "disputed_by")})


def new_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Those whose id is not stored yet, each once."""
    return incoming.dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def encode_vector(v) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(v, "<f4").tobytes()


def decode_vectors(column: Column | str) -> Column:
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode(X.col(column))


def pack_vectors(rows: list[tuple[str, list[float]]], dim: int) -> bytes:
    """The packed form: magic, dim (u32), count (u64), and for each: length of id (u16), id, dim floats."""
    return C.VECTOR_MAGIC + struct.pack("<IQ", dim, len(rows)) + _packed(rows)


def _packed(rows: Iterable[tuple[str, list[float]]]) -> bytes:
    return b"".join(struct.pack("<H", len(k := i.encode())) + k + encode_vector(v) for i, v in rows)


def write_vectors(vectors: DataFrame, path: str, dim: int, **options) -> int:
    """A folder of packed files of (id, embedding), one or more for each task; vectors of another width are left out. Returns how many rows."""
    spark = vectors.sparkSession
    spark.dataSource.register(PackedVectors)
    rows = vectors.filter(F.size("embedding") == dim).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows.write.format(PackedVectors.name()).options(dim=dim, **options).mode("overwrite").save(path)
    return read_vectors(spark, path).count()


def read_vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    """id and embedding of a packed vector file or a folder of them, in parts; another magic is an error."""
    spark.dataSource.register(PackedVectors)
    return spark.read.format(PackedVectors.name()).options(**options).load(path)


def as_memories(rows: DataFrame, intensity: str = "full", with_embedding: bool = False, derived=None) -> DataFrame:
    """Full memory rows of (id, content, author, room, created_at): classified, compressed, with the defaults of a new memory; with ``derived`` what has been derived of the texts is taken from there."""
    if derived is not None:
        made = derived.of(rows, "memory_type", "tags", "entities", "compressed", "summary", "headline", *["embedding"] * with_embedding)
        return _whole(made.withColumn("_l", F.struct("compressed", "summary", "headline")), with_embedding, F.col("embedding") if with_embedding else None)
    level = X.levels("content", intensity)
    out = rows.withColumns({"memory_type": X.detect_type("content"), "tags": X.tags("content"), "entities": X.entities("content"), "_l": level})
    return _whole(out, with_embedding, embed("content"))


def _whole(rows: DataFrame, with_embedding: bool, embedding: Column | None) -> DataFrame:
    empty = F.array().cast("array<string>")
    none = lambda t: F.lit(None).cast(t)
    out = rows.select(
        "id", "content", "_l.compressed", "_l.summary", "_l.headline", "memory_type", F.lit("active").alias("state"), F.lit("personal").alias("scope"), "author", "room", "tags", "entities",
        F.lit("manual").alias("source_type"), none("string").alias("source_detail"), F.lit(C.NEW_CONFIDENCE).alias("confidence"), F.lit(C.NEW_IMPORTANCE).alias("importance"), F.lit(0).cast("bigint").alias("access_count"), none("timestamp").alias("last_accessed"),
        "created_at", F.col("created_at").alias("updated_at"), none("timestamp").alias("verified_at"), empty.alias("endorsed_by"), empty.alias("disputed_by"), *([embedding.alias("embedding")] if with_embedding else []),
    )
    return out.withColumn("in_index", F.lit(True)) if with_embedding else out


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, dealt out evenly if its files give fewer tasks than there are cores."""
    df = sound(spark).read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def as_searched(rows: DataFrame, intensity: str = "full", derived=None) -> DataFrame:
    """What searches need of memories of (id, content): the searched fields and the embedding, without the levels that they do not show; with ``derived`` from there."""
    if derived is not None:
        return derived.of(rows.select("id", "content"), "summary", "tags", "entities", "embedding").withColumn("in_index", F.lit(True))
    return rows.select("id", "content", X.summary_of("content", intensity).alias("summary"), X.tags("content").alias("tags"), X.entities("content").alias("entities"), embed("content").alias("embedding"), F.lit(True).alias("in_index"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as what memories are made of: the source writes, the language is the room, one an hour from 2024 on."""
    docs = read_table(spark, sf_dir, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("author"), F.col("lang").alias("room"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("doc_id") * 3600).alias("created_at"))


def document_memories(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """documents as whole memories."""
    return as_memories(document_rows(spark, sf_dir), **options)
