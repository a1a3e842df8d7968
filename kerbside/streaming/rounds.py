"""Versioned ingest of rounds (L1): every round is a snapshot, committed by one pointer written last.

A round writes its new rows, then the list of their tokens, then its pointer.  Folders of a round never change once the pointer
stands, so the state before a round is its backup without any copy, and any earlier state can be read.  A round without
a pointer is not there: the next attempt writes its folders anew.  A round with one is not run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "round int, version string, parent int, added long, total long"


@dataclass
class Rounds:
    """Rounds of a table under ``root``; ``key`` names a row, ``version`` is what every row is normalised to."""

    spark: SparkSession
    root: str
    schema: str
    key: str = "token"
    version: str = "v1"

    def _path(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}/round={number:04d}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def pointers(self) -> list:
        """Pointers of the committed rounds in their order; there is one small row for each round."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commit")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # a pointer stands when Spark has marked its folder as whole
        done = [s.getPath().toString() for s in fs.listStatus(at) if self._exists(f"{s.getPath().toString()}/_SUCCESS")] if fs.exists(at) else []
        return sorted((self.spark.read.schema(POINTER).json(p).first() for p in done), key=lambda r: r["round"])

    def committed(self, number: int) -> bool:
        return self._exists(f"{self._path('commit', number)}/_SUCCESS")

    def read(self, as_of: int | None = None) -> DataFrame:
        """All rows of the rounds up to ``as_of`` (all by default), with their round and version."""
        rounds = [p["round"] for p in self.pointers() if as_of is None or p["round"] <= as_of]
        schema = f"{self.schema}, version string, round int"
        if not rounds:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path("new", r) for r in rounds])

    def new(self, number: int) -> DataFrame:
        """Only what a round has added."""
        return self.spark.read.schema(f"{self.schema}, version string, round int").parquet(self._path("new", number))

    def tokens(self, number: int) -> DataFrame:
        return self.spark.read.schema(f"{self.key} string").json(self._path("tokens", number))

    def ingest(self, number: int, rows: DataFrame) -> bool:
        """Add a round; False when it is there already.  Keys known before stay as they are; of several rows of a new key the
        smallest stays, so that a second attempt writes the same."""
        if self.committed(number):
            return False
        before = self.pointers()
        if before and before[-1]["round"] > number:
            raise ValueError(f"round {number} comes after round {before[-1]['round']} was committed")
        names = self.spark.createDataFrame([], self.schema).columns
        known = self.read().select(self.key)
        fresh = rows.select(*names).join(known, self.key, "left_anti").groupBy(self.key).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
        self._write_new(number, fresh.select(*names).withColumns({"version": F.lit(self.version), "round": F.lit(number)}))
        self._write_tokens(number)
        self._commit(number, before[-1] if before else None)
        return True

    def _write_new(self, number: int, fresh: DataFrame) -> None:
        fresh.write.mode("overwrite").parquet(self._path("new", number))

    def _write_tokens(self, number: int) -> None:
        self.new(number).select(self.key).write.mode("overwrite").json(self._path("tokens", number))

    def _commit(self, number: int, parent) -> None:
        added = self.tokens(number).count()
        row = (number, self.version, parent["round"] if parent else None, added, added + (parent["total"] if parent else 0))
        self.spark.createDataFrame([row], POINTER).coalesce(1).write.mode("overwrite").json(self._path("commit", number))
