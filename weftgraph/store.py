"""Keeping projects: Parquet tables behind a pointer that changes in one step.

A store is a folder on any file system that Hadoop knows:

  snapshots/<n>/nodes, edges, boundaries, diagnostics, findings, meta
  CURRENT                                       the name of the snapshot that counts

``save`` writes a whole new snapshot and then replaces the pointer, so readers see the old project or
the new one, never a mixture; a writer that dies leaves the old one.  Older layouts are brought up to
date when they are loaded, one step a version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import __version__
from weftgraph.operators.integrity import SCHEMA as FINDING_SCHEMA
from weftgraph.plans.materialize import read_text, replace_text
from weftgraph.project import BOUNDARY_SCHEMA, DIAGNOSTIC_SCHEMA, EDGE_SCHEMA, NODE_SCHEMA, Project

SCHEMA_VERSION = 2
TABLES = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "boundaries": BOUNDARY_SCHEMA, "diagnostics": DIAGNOSTIC_SCHEMA, "findings": FINDING_SCHEMA}
_META = "key string, value string"
KEPT = 2  # snapshots that stay: the current one, and the one that a reader may still be in


class StoreError(Exception):
    """No project is stored here, or it was written by a newer version."""


def _confident(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """1 to 2: edges without a confidence are certain."""
    edges = tables["edges"]
    if "confidence" not in edges.columns:
        edges = edges.withColumn("confidence", F.lit(1.0))
    return tables | {"edges": edges.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))}


#: Steps by the version that they start from.
MIGRATIONS: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {1: _confident}


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Tables of an older version as those of this one; columns that are missing are null."""
    if version > SCHEMA_VERSION:
        raise StoreError(f"the store has version {version}, known are those up to {SCHEMA_VERSION}")
    for v in sorted(m for m in MIGRATIONS if m >= version):
        tables = MIGRATIONS[v](tables)
    out = {}
    for name, df in tables.items():
        fields = [x.strip().split(" ") for x in TABLES[name].split(",")]
        out[name] = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])
    return out


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = (path if "://" in path else Path(path).absolute().as_uri()).rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _current(self) -> str | None:
        return read_text(self.spark, f"{self.path}/CURRENT")

    def save(self, p: Project, findings: DataFrame | None = None) -> None:
        """Replace what is stored by ``p``; rows are laid out in the order of their ids."""
        name = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        tables = {"nodes": p.nodes, "edges": p.edges, "boundaries": p.boundaries, "diagnostics": p.diagnostics, "findings": findings}
        for table, df in tables.items():
            if df is None:
                df = self.spark.createDataFrame([], TABLES[table])
            key = df.columns[0]
            df.sortWithinPartitions(key).write.parquet(f"{self.path}/snapshots/{name}/{table}")
        own = {"schema_version": str(SCHEMA_VERSION), "tool_version": __version__, "analyzed_at": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"}
        meta = {r["key"]: r["value"] for r in p.meta.collect()} if p.meta is not None else {}  # a handful of rows
        self.spark.createDataFrame(sorted((meta | own).items()), "key string, value string").coalesce(1).write.parquet(f"{self.path}/snapshots/{name}/meta")
        replace_text(self.spark, f"{self.path}/CURRENT", name)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("snapshots")))
        for old in [n for n in names if n < name][: -(KEPT - 1) or None]:
            self._fs.delete(self._at(f"snapshots/{old}"), True)

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        current = self._current()
        if current is None:
            raise StoreError(f"no project is stored in {self.path}")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/snapshots/{current}/{name}")

    def meta(self, key: str) -> str | None:
        """One value; null if the key is unknown."""
        row = self._table("meta", _META).where(F.col("key") == key).first()
        return row["value"] if row else None

    def load(self) -> Project:
        version = int(self.meta("schema_version") or 1)
        names = [n for n in TABLES if n != "findings"]
        if version == SCHEMA_VERSION:  # the layout is known: no file is opened for its schema
            t = {n: self._table(n, TABLES[n]) for n in names}
        else:
            t = migrate({n: self._table(n) for n in names}, version)
        return Project(t["nodes"], t["edges"], t["boundaries"], t["diagnostics"], self._table("meta", _META))

    def findings(self) -> DataFrame:
        return migrate({"edges": self._table("edges"), "findings": self._table("findings")}, int(self.meta("schema_version") or 1))["findings"]
