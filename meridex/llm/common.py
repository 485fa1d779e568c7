"""What the operators share: the shared folder, written tables, and joins that survive hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A key counts as heavy from this share of all rows on; so there are at most HEAVY_SHARE heavy keys, whatever the input.
HEAVY_SHARE = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores in front of it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/meridex/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table written to the shared folder: it cuts lineage, and lost executors can't lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing lazy reads them any more."""
    for df in tables:
        if path := getattr(df, "_written_path", None):
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks, and share the executor's memory with the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def give_back_on_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM return freed native memory to the system; whether it could. Planning uses hundreds of short-lived
    threads, whose allocator pools keep what was freed. Only HotSpot on glibc can; elsewhere nothing happens."""
    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(invoke.invoke(server, args)).startswith("Trim native heap")
    except Exception:  # another JVM, or one before 17.0.9
        return False


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives its memory back when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key; size: how many of the total rows have it), safe for hot keys.

    Keys with at least total / HEAVY_SHARE rows are at most HEAVY_SHARE many, whatever the data: only those are
    broadcast. All other keys meet in an ordinary shuffled join, in which no key is large. rows is read twice, so it
    should be a written table. how: inner or left.
    """
    least = max(2, -(-total // HEAVY_SHARE))
    heavy = F.broadcast(groups.where(F.col(size) >= least))
    hot = rows.join(heavy, keys, "inner")
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(groups.where(F.col(size) < least), keys, how)
    return hot.unionByName(rest)
