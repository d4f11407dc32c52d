"""The latest value of every node after each batch, kept as runs that merge by powers.

A batch writes what it brings: the latest value of each node that it holds, ``run=0-N``. After every
``FAN`` batches their runs are merged to one of the next level, after every ``FAN`` of those
again, and so on. Which runs make up the state after a batch follows from the
batch's number alone: written in base ``FAN``, each digit d of N + 1 stands for d runs of its level.
So a batch writes its own nodes once, and each is merged once per level; what a batch
writes follows the batch, whatever the number of nodes, and what is read is a few runs a level.

The state after batch N is never changed by batch N + 1, so the last batch can be run again: it
overwrites its own runs. Runs that a merge has taken up are removed two batches later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework import schemas
from gaugework.sources.results import read_if_present, remove

#: Runs of a level that are merged to one of the next.
FAN = 8


def runs_after(batch_id: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, last batch) of each run that the state after ``batch_id`` consists of."""
    count, level, last, found = batch_id + 1, 0, batch_id, []
    while count > 0:
        for _ in range(count % fan):
            found.append((level, last))
            last -= fan**level
        count, level = count // fan, level + 1
    return found


def merged_at(batch_id: int, fan: int = FAN) -> int:
    """The level of the highest run that batch ``batch_id`` completes; 0 is its own."""
    level = 0
    while (batch_id + 1) % fan ** (level + 1) == 0:
        level += 1
    return level


def newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node_id").agg(F.max("id").alias("id"), F.max_by("value", "id").alias("value"))


class LatestRuns:
    """The runs below ``path``."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path, fan

    def _run(self, level: int, last: int) -> str:
        return f"{self.path}/run={level}-{last}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        rows = read_if_present(self.spark, f"{self.path}/start", schemas.LATEST)
        for run in runs:
            rows = rows.unionByName(read_if_present(self.spark, self._run(*run), schemas.LATEST))
        return rows

    def start(self, rows: DataFrame) -> None:
        """The state before the first batch."""
        rows.write.mode("overwrite").parquet(f"{self.path}/start")

    def after(self, batch_id: int) -> DataFrame:
        """(node_id, id, value) of every node after ``batch_id``; -1 is the start."""
        return newest(self._read(runs_after(batch_id, self.fan)))

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """The latest values that a batch brings, and the merges that it completes."""
        rows.write.mode("overwrite").parquet(self._run(0, batch_id))
        for level in range(1, merged_at(batch_id, self.fan) + 1):
            parts = [(level - 1, batch_id - k * self.fan ** (level - 1)) for k in range(self.fan)]
            whole = None
            for part in parts:
                read = read_if_present(self.spark, self._run(*part), schemas.LATEST)
                whole = read if whole is None else whole.unionByName(read)
            newest(whole).write.mode("overwrite").parquet(self._run(level, batch_id))
        # What the batch before the last one merged: no state that may be asked for reads it.
        old = batch_id - 2
        for level in range(1, merged_at(old, self.fan) + 1 if old >= 0 else 1):
            for k in range(self.fan):
                remove(self.spark, self._run(level - 1, old - k * self.fan ** (level - 1)))
