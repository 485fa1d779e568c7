"""The engine's tables as versioned Parquet folders: appends, keyed updates and replacements, point lookups, ordered scans.

A table is a folder of snapshots; the name of the current one is in a pointer file that is written last, so that a
reader, or a writer that dies, never meets half a snapshot. Appends and updates are one job over the table; they are meant
for batches of rows, not for rows one by one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Spec:
    """A table's key, further unique column sets, and the order of its scans."""

    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    order: tuple[str, ...] = ("created_at",)


#: The tables, by name.
TABLES = {
    "documents": Spec(("document_id",), (("checksum_sha256",),)),
    "entries": Spec(("label",), order=("label",)),
    "edges": Spec(("parent_label", "child_label"), order=("parent_label", "child_label")),
    "decisions": Spec(("decision_log_id",)),
    "exchanges": Spec(order=("decision_log_id", "iteration")),
    "undecided": Spec(("decision_log_id",), order=("escalation_level", "created_at")),
    "proposals": Spec(("proposal_id",)),
    "reviews": Spec(("review_id",)),
    "contexts": Spec(("context_id",), (("name",),)),
    "mappings": Spec(("mapping_id",), (("source_label", "target_label"),)),
    "embeddings": Spec(("label",), order=("label",)),
    "document_links": Spec(("link_id",)),
    "correspondences": Spec(("correspondence_id",)),
    "operator_decisions": Spec(),
    "grounding": Spec(("grounding_id",), (("decision_log_id",),)),
    "migrations": Spec(("number",), order=("number",)),
}


class DuplicateKey(ValueError):
    """Rows that a key or a unique set of columns already has."""


class Table:
    def __init__(self, spark: SparkSession, folder: str, name: str, schema: T.StructType | str, spec: Spec | None = None):
        self.spark, self.name, self.spec = spark, name, spec or TABLES[name]
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.path = f"{folder.rstrip('/')}/{name}"

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _current(self) -> str | None:
        fs, target = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(target):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def read(self) -> DataFrame:
        at = self._current()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], self.schema)

    def _replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.parquet(f"{self.path}/{version}")
        fs, pointer = self._fs(f"{self.path}/CURRENT")
        _, fresh = self._fs(f"{self.path}/CURRENT-{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        fs.delete(pointer, False)
        if not fs.rename(fresh, pointer):
            raise OSError(f"{pointer} could not be written")

    def _checked(self, rows: DataFrame) -> DataFrame:
        for columns in (self.spec.key, *self.spec.unique):
            if columns and not rows.groupBy(*columns).count().where("count > 1").isEmpty():
                raise DuplicateKey(f"{self.name}: {', '.join(columns)} must be unique")
        return rows

    def insert(self, rows: DataFrame) -> None:
        """Append rows; columns that they lack are null. A repeated key is an error, and nothing is written."""
        lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in rows.columns]
        self._replace(self._checked(self.read().unionByName(rows.select("*", *lacking).select(*self.schema.names))))

    def upsert(self, rows: DataFrame, by: tuple[str, ...] | None = None) -> None:
        """Replace the rows that have the same columns by (the key by default), and append the others."""
        by = by or self.spec.key
        kept = self.read().join(rows.select(*by).distinct(), list(by), "left_anti")
        self._replace(self._checked(kept.select(*self.schema.names).unionByName(rows.select(*self.schema.names))))

    def update(self, where: Column, **values: Column) -> int:
        """Set columns of the rows that hold where; how many did."""
        now, hit = self.read(), F.coalesce(where, F.lit(False))
        changed = now.where(hit).count()
        if changed:
            self._replace(self._checked(now.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in now.columns))))
        return changed

    def delete(self, where: Column) -> int:
        now, hit = self.read(), F.coalesce(where, F.lit(False))
        gone = now.where(hit).count()
        if gone:
            self._replace(now.where(~hit))
        return gone

    def get(self, *key) -> DataFrame:
        """The row of a key, or none."""
        return self.find(**dict(zip(self.spec.key, key, strict=True)))

    def find(self, **equal) -> DataFrame:
        """Rows by equality (None finds nulls), in the table's order."""
        rows = self.read()
        for column, value in equal.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows.orderBy(*(c for c in self.spec.order if c in self.schema.names))

    def find_either(self, columns: tuple[str, ...], value) -> DataFrame:
        """Rows with the value in any of the columns, in the table's order."""
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.col(c).eqNullSafe(F.lit(value))
        return self.read().where(hit).orderBy(*(c for c in self.spec.order if c in self.schema.names))

    def count(self) -> int:
        return self.read().count()


def pending(undecided: Table, limit: int = 100) -> DataFrame:
    """The first of the queue: least escalated, then oldest."""
    return undecided.find().limit(limit)


def labels_under(entries: Table, parent: str | None) -> DataFrame:
    return entries.find(parent_label=parent).select("label")


def children(edges: Table, parent: str) -> DataFrame:
    return edges.find(parent_label=parent).select("child_label")


def contexts(table: Table, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Contexts, oldest first, of a kind or a name, where given."""
    return table.find(**{k: v for k, v in (("kind", kind), ("name", name)) if v is not None})
