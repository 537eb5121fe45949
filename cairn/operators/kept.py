"""What kept indexes share: a folder with a commit log, and keeping in step with a store's table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.commits import CommitLog, Files
from cairn.sources.shared import forget, settle, sound


class Kept:
    """An index below one folder; ``upsert``, ``delete`` and ``ids`` are its own."""

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[dict[str, Any], int, dict[str, Any]], dict[str, Any]], empty: dict[str, Any]):
        self.spark, self.path = sound(spark), path.rstrip("/")
        self.log = CommitLog(Files(spark, f"{self.path}/_commits"), fold, empty)
        self.files = Files(spark, self.path)

    @property
    def state(self) -> dict[str, Any]:
        self.log.refresh()
        return self.log.state

    def commit(self, make: Callable[[dict[str, Any]], dict[str, Any] | None]) -> bool:
        """Commits what ``make`` gives for the present state, made anew if another commit comes first."""
        while True:
            entry = make(self.state)
            if entry is None:
                return False
            if self.log.put(entry):
                return True

    def rows(self, folder: str, names: list[str], schema: str) -> DataFrame:
        """Rows of the folders that commits name, with that name in ``of``."""
        if not names:
            return self.spark.createDataFrame([], f"{schema}, of string")
        return self.spark.read.schema(f"{schema}, of string").option("basePath", f"{self.path}/{folder}").parquet(*(f"{self.path}/{folder}/of={n}" for n in names))

    def ids(self) -> DataFrame:
        raise NotImplementedError

    def upsert(self, rows: DataFrame, synced: int = 0) -> None:
        raise NotImplementedError

    def delete(self, ids: DataFrame) -> int:
        raise NotImplementedError

    def sync(self, store, name: str = "memories", member: str = "true") -> int:
        """Takes in what has changed in a store's table since the last time; returns how many rows. Rows for which ``member`` does not hold are out."""
        version = store.version()
        changed = store.changes(name, self.state["synced"], version)
        if changed is None:  # compacted since: all rows, and those that are gone
            rows = store.table(name)
            self.delete(self.ids().join(rows.select("id"), "id", "left_anti"))
            changed = rows.withColumn("_deleted", F.lit(False))
        changed = settle(changed)
        n = changed.count()
        if n:
            inside = ~F.col("_deleted") & F.coalesce(F.expr(member), F.lit(False))
            self.delete(changed.filter(~inside).select("id"))
            self.upsert(changed.filter(inside), synced=version)
        forget(changed)
        return n
