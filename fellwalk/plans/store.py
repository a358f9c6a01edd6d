"""Finished steps by content: what a step makes depends on its inputs and settings alone, so its digest names the result.

A step's tables are written first, then a marker of one row. A run that finds the marker does not do the step again; what
a lost driver left without a marker is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of every digest; raised when a step's meaning changes.
VERSION = 1


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps([VERSION, *parts], sort_keys=True).encode()).hexdigest()[:32]


def content(df: DataFrame) -> str:
    """Digest of columns, types and rows, in any order: one pass, one row to the driver."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    seen = df.agg(F.count("*"), F.bit_xor(F.xxhash64(F.lit(1), *columns)), F.sum(F.pmod(F.xxhash64(F.lit(2), *columns), F.lit(1 << 31)))).first()
    return digest(df.dtypes, list(seen))


class Store:
    """Steps below a folder: tables at name/key, markers at done/key. One driver at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str, key: str) -> str:
        return f"{self.folder}/{name}/{key}"

    def rows(self, key: str) -> int | None:
        """Rows of a finished step; None for one that is not."""
        try:
            found = self.spark.read.schema("rows long").parquet(self.path("done", key)).first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found.rows if found else None

    def made(self, key: str, tables: dict[str, Callable[[], DataFrame]]) -> tuple[int, bool]:
        """Rows of the step's tables, and whether they were there before; makes them if not."""
        held = self.rows(key)
        if held is not None:
            return held, True
        total = 0
        for name, make in tables.items():
            make().write.mode("overwrite").parquet(self.path(name, key))
            total += self.spark.read.parquet(self.path(name, key)).count()
        self.spark.createDataFrame([(total,)], "rows long").coalesce(1).write.mode("overwrite").parquet(self.path("done", key))
        return total, False
