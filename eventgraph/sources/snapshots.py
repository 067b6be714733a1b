"""Parquet tables whose state changes all at once.

A store is a folder with parts, written once and never changed, and versions: one line of JSON each, which
names the parts that make up each table. A commit writes its parts first and its version last, as a single file, so
a failure at any point leaves the version before it, and readers of a version keep their rows. Several
tables can change in one commit. One writer at a time; a writer whose version was overtaken fails.

Parts that no version names, left by a failed commit, are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

_VERSION = "parts map<string,array<string>>, info map<string,string>, counts map<string,long>"


class Snapshots:
    """The tables of a folder that all executors share; schemas are DDL by table, partitions the columns that a table's files are split by."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], partitions: dict[str, list[str]] | None = None):
        self.spark, self.folder, self.schemas, self.partitions = spark, folder.rstrip("/"), schemas, partitions or {}
        self._write_version(0, {}, {}, {}, "ignore")

    def _write_version(self, number: int, parts: dict[str, list[str]], info: dict[str, str], counts: dict[str, int], mode: str = "error") -> None:
        row = self.spark.createDataFrame([(parts, info, counts)], _VERSION).coalesce(1)
        row.write.mode(mode).json(f"{self.folder}/versions/version={number}")

    def versions(self) -> DataFrame:
        """(version, parts, info, counts) of all commits; counts are the rows that a commit wrote, by table."""
        return self.spark.read.schema(f"{_VERSION}, version long").json(f"{self.folder}/versions")

    def latest(self, at: int | None = None) -> Row:
        """The newest version, or a given one."""
        rows = self.versions() if at is None else self.versions().where(F.col("version") == at)
        found = rows.orderBy(F.desc("version")).first()
        if found is None:
            raise ValueError(f"there is no version {at}")
        return found

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """A table's rows as of a version; rows of later commits never show in them."""
        parts = (self.latest(at)["parts"] or {}).get(name, [])
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{p}" for p in parts])
        return rows.drop("part")

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, info: dict[str, str] | None = None) -> int:
        """Add rows to tables, exchange others' rows, and keep info (what is not named in it stays): all of it or nothing."""
        now = self.latest()
        parts, told, counts = {k: list(v) for k, v in (now["parts"] or {}).items()}, dict(now["info"] or {}) | (info or {}), {}
        for changes, keep in ((append or {}, True), (replace or {}, False)):
            for name, rows in changes.items():
                part = f"{name}/part={uuid.uuid4().hex}"
                seen = Observation()  # counted as they are written, not in a pass of its own
                rows.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*self.partitions.get(name, [])).parquet(f"{self.folder}/{part}")
                parts[name] = [*(parts.get(name, []) if keep else []), part]
                counts[name] = counts.get(name, 0) + seen.get["n"]
        number = now["version"] + 1
        if self.latest()["version"] != now["version"]:
            raise RuntimeError("another commit came first")
        self._write_version(number, parts, told, counts)
        return number

    def upsert(self, name: str, rows: DataFrame, keys: list[str], info: dict[str, str] | None = None) -> int:
        """Rows by key, the new ones in place of the old; of new rows with equal keys one stays, the greatest."""
        others = [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*")
        kept = self.read(name).join(one.select(*keys), keys, "left_anti")
        return self.commit(replace={name: kept.unionByName(one.select(*kept.columns))}, info=info)
