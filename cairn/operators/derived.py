"""What is derived of texts, kept by content: each distinct text is derived once.

A row is named by the digest of its text, and holds type, tags, entities, the three levels and the
embedding. ``fill`` derives the texts that are not there yet and commits them as one more
segment; only digests are compared, and only texts that are missing move. The folder's name holds
a digest of the rules' own sources, so that other rules never meet rows of these.

Cases: a null text counts as empty; texts that are alike in bytes are one; an empty table fills nothing.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions import values, vectors
from cairn.operators.kept import Kept

_ROW = "digest string, compressed string, summary string, headline string, memory_type string, tags array<string>, entities array<string>, embedding array<float>"
COLUMNS = [f.split()[0] for f in _ROW.split(", ")][1:]
_EMPTY = {"segments": [], "rows": 0}


def rules() -> str:
    """A digest of the sources of the rules."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in (X, values, vectors)).encode()).hexdigest()[:16]


def _fold(state: dict[str, Any], version: int, entry: dict[str, Any]) -> dict[str, Any]:
    return {"segments": state["segments"] + [entry["segment"]], "rows": state["rows"] + entry["rows"]}


class Derived(Kept):
    """The rows below one folder, for one intensity of compression."""

    def __init__(self, spark: SparkSession, path: str, intensity: str = "full"):
        super().__init__(spark, f"{path.rstrip('/')}/{intensity}-{rules()}", _fold, _EMPTY)
        self.intensity = intensity

    @staticmethod
    def _digest() -> Any:
        return F.sha2(F.coalesce("content", F.lit("")), 256)

    def _known(self, state: dict[str, Any]) -> DataFrame:
        return self.rows("rows", state["segments"], _ROW)

    def fill(self, texts: DataFrame) -> int:
        """Derives those of the texts (content) that are not there yet; returns how many."""
        made = 0

        def make(state: dict[str, Any]) -> dict[str, Any] | None:
            nonlocal made
            named = texts.select(F.coalesce("content", F.lit("")).alias("content")).withColumn("digest", self._digest())
            missing = named.select("digest").distinct().join(self._known(state).select("digest"), "digest", "left_anti")
            fresh = named.join(missing, "digest", "left_semi").dropDuplicates(["digest"])
            level = X.levels("content", self.intensity)
            rows = fresh.select("digest", level.alias("_l"), X.detect_type("content").alias("memory_type"), X.tags("content").alias("tags"), X.entities("content").alias("entities"), vectors.embed("content").alias("embedding"))
            name = uuid.uuid4().hex
            rows.select("digest", "_l.compressed", "_l.summary", "_l.headline", "memory_type", "tags", "entities", "embedding").write.parquet(f"{self.path}/rows/of={name}")
            made = self.rows("rows", [name], _ROW).count()
            if not made:
                self.files.delete(f"rows/of={name}")
            return {"segment": name, "rows": made} if made else None

        self.commit(make)
        return made

    def of(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows with a content, and what has been derived of it; those that have not been filled in are left out."""
        known = self._known(self.state).select(F.col("digest").alias("_d"), *columns)
        return rows.withColumn("_d", self._digest()).join(known, "_d").drop("_d")
