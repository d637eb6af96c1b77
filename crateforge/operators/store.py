"""The relational store: tables with keys and references in a shared folder, loaded idempotently, cleared in safe order.

A load is a folder of its own in its table's folder, written in one job, so that a load that is run again after a failure
replaces its own rows and none else. Rows whose key is there are left out; rows that point nowhere are refused before
anything is written. Clearing goes from the tables that point to those that are pointed to, and numbering starts anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateforge.operators.loader import insert_unseen, orphans
from crateforge.sources.staging import discard, stage


@dataclass(frozen=True)
class Table:
    """``schema`` as DDL, the columns of the ``keys``, and ``references``: column -> (table, its column); null points to nothing and is allowed."""

    schema: str
    keys: tuple[str, ...]
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


class Store:
    """Tables by name under ``root``; a table must be listed after those that it points to."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        listed: set[str] = set()
        for name, table in tables.items():
            late = [t for t, _ in table.references.values() if t not in listed and t != name]
            if late:
                raise ValueError(f"{name} points to {late[0]}, which is not listed before it")
            listed.add(name)
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _loads(self, name: str) -> list[int]:
        """Numbers of the loads that ended."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [s.getPath() for s in files.listStatus(folder)]
        return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """All rows of a table; none where nothing was loaded."""
        loads = self._loads(name)
        if not loads:
            return self.spark.createDataFrame([], self.tables[name].schema)
        return self.spark.read.schema(self.tables[name].schema).parquet(*[f"{self.root}/{name}/load={k}" for k in loads])

    def insert(self, name: str, rows: DataFrame) -> int:
        """Adds the rows whose key is new, of several with one key the first in the order of all columns; returns how many."""
        table, there = self.tables[name], self.read(name)
        columns = there.columns
        fresh, held = insert_unseen(rows.select(*columns), there, list(table.keys), columns).select(*columns), None
        try:
            if table.references:  # they and the load read the new rows, which are worked out once
                fresh, held = stage(fresh)
            for column, (parent, key) in table.references.items():
                known = self.read(parent) if parent != name else there.unionByName(fresh)
                lost = orphans(fresh.select(column).distinct(), known, column, key).limit(1).collect()
                if lost:
                    raise ValueError(f"{name}.{column} {lost[0][0]!r} is not in {parent}.{key}")
            loads = self._loads(name)
            path = f"{self.root}/{name}/load={loads[-1] + 1 if loads else 0}"
            fresh.write.mode("overwrite").parquet(path)
        finally:
            if held:
                discard(self.spark, held)
        return self.spark.read.schema(table.schema).parquet(path).count()

    def clear(self, *names: str) -> None:
        """Empties the named tables, or all, those that point first; refused if a table that stays still points to one."""
        gone = set(names) or set(self.tables)
        for name, table in self.tables.items():
            for parent, _ in table.references.values():
                if parent in gone and name not in gone and not self.read(name).isEmpty():
                    raise ValueError(f"{name} points to {parent}")
        for name in reversed(list(self.tables)):
            if name in gone:
                discard(self.spark, f"{self.root}/{name}")

    def replace(self, loads: dict[str, DataFrame]) -> dict[str, int]:
        """Clears the named tables and loads them anew, those that are pointed to first; the new rows must not read the old ones."""
        self.clear(*loads)
        return {name: self.insert(name, loads[name]) for name in self.tables if name in loads}


MUSIC = {
    "artist": Table("artist_id long, name string", ("artist_id",)),
    "album": Table("album_id long, title string, artist_id long, uri string", ("album_id",), {"artist_id": ("artist", "artist_id")}),
    "descriptor": Table("descriptor_id long, name string", ("descriptor_id",)),
    "album_descriptor": Table("album_id long, descriptor_id long, weighting double", ("album_id", "descriptor_id"), {"album_id": ("album", "album_id"), "descriptor_id": ("descriptor", "descriptor_id")}),
}


def summary(store: Store) -> DataFrame:
    """(name, rows, keys) of every table."""
    parts = [store.read(n).agg(F.count("*").alias("rows"), F.count_distinct(*t.keys).alias("keys")).select(F.lit(n).alias("name"), "rows", "keys") for n, t in store.tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
