"""Tables kept in versions: every change is written beside what is there and counts once its commit mark lies in the folder.

A folder holds `table/version=N/...` for each table and `commits/N` (or `commits/N.base`: nothing older
counts). What a failed or running write has left has no mark, so readers pass over it and the next
write overwrites it. Versions are partitions, so readers open no files of others. There is one
writer at a time; readers that began before a compaction are safe until vacuum().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """The file system that a path is on, and the path; works on any storage that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def committed(spark: SparkSession, path: str) -> list[int]:
    """Versions that count, oldest first; the first one is the base."""
    marks = sorted((int(x.split(".")[0]), x.endswith(".base")) for x in _names(spark, f"{path}/commits"))
    base = max((n for n, is_base in marks if is_base), default=0)
    return [n for n, _ in marks if n >= base]


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame | Callable[[int], DataFrame]], base: bool = False, partition_by: dict[str, str] | None = None) -> int:
    """Writes the next version of each table and then its mark; base: it stands for all before. A table may be made from what was written before it, by its version. Returns the version."""
    versions = committed(spark, path)
    version = (versions[-1] if versions else 0) + 1
    for name, rows in tables.items():
        rows = rows(version) if callable(rows) else rows
        writer = rows.write.mode("overwrite")
        writer = writer.partitionBy(partition_by[name]) if partition_by and name in partition_by else writer
        writer.parquet(f"{path}/{name}/version={version}")
    fs, mark = _at(spark, f"{path}/commits/{version}{'.base' if base or not versions else ''}")
    fs.create(mark).close()
    return version


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table's rows of all versions that count; schema ends with its partition columns, version first."""
    fs, where = _at(spark, f"{path}/{name}")
    if not fs.exists(where):
        fs.mkdirs(where)
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("version").isin(committed(spark, path)))


def newest(rows: DataFrame, versions: list[int], id_col: str) -> DataFrame | None:
    """(id, newest): for ids that were written after the base, the version that holds; nothing has changed: None."""
    if len(versions) < 2:
        return None
    return rows.where(F.col("version") > versions[0]).groupBy(id_col).agg(F.max("version").alias("newest"))


def living(rows: DataFrame, changed: DataFrame | None, id_col: str) -> DataFrame:
    """Rows that no later version has replaced or deleted; changed: of newest(), broadcast by the caller if it is small."""
    if changed is None:
        return rows
    return rows.join(changed, id_col, "left").where(F.col("newest").isNull() | (F.col("newest") == F.col("version"))).drop("newest")


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes the files of versions that don't count any more, and of writes that were never committed."""
    keep = {f"version={n}" for n in committed(spark, path)}
    for name in _names(spark, path):
        for version in _names(spark, f"{path}/{name}") if name != "commits" else []:
            if version.startswith("version=") and version not in keep:
                fs, where = _at(spark, f"{path}/{name}/{version}")
                fs.delete(where, True)
