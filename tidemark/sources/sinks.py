"""Boards as files and versions of tables with a pointer to the current one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .commits import _files

BOM = "﻿"


def shown(board: DataFrame, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The board's rows as text: (column, header, format); nulls are empty."""
    return board.select(*(F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))) if form else F.col(c).cast("string"), F.lit("")).alias(header) for c, header, form in columns))


def write_csv(board: DataFrame, path: str, order: Sequence[Column]) -> None:
    """One CSV file with a header that spreadsheets read as UTF-8. A board is a bounded top list, so one task writes it."""
    first = board.columns[0]
    board.orderBy(*order).coalesce(1).withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def tsv(columns: Sequence[str]) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def publish(tables: dict[str, DataFrame | None], root: str, version: int) -> None:
    """Writes a new version of every table given, then flips the pointer. None keeps the version before, an empty
    frame publishes an empty table; nothing but None leaves all as it is. Readers see the old versions until the
    pointer is written."""
    spark = next((t.sparkSession for t in tables.values() if t is not None), None)
    if spark is None:
        return
    before = current(spark, root)
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{root}/{name}/v={version}")
            before[name] = version
    pointer = spark.createDataFrame(list(before.items()), "name string, version long")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/_pointers/p={version}")


def current(spark: SparkSession, root: str) -> dict[str, int]:
    """The version of each table that the newest complete pointer names."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    files = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(fs):
        return {}
    done = sorted((int(s.getPath().getName()[2:]) for s in files.listStatus(fs) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), reverse=True)
    return {r.name: r.version for r in spark.read.parquet(f"{root}/_pointers/p={done[0]}").collect()} if done else {}


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/v={current(spark, root)[name]}")


def write_days(rows: DataFrame, day: Column, path: str, name: str = "day") -> None:
    """Appends rows to a table with a folder for each day, so that whole days can go without rewriting others."""
    rows.withColumn(name, day.cast("date")).repartition(name).write.mode("append").partitionBy(name).parquet(path)


def days(spark: SparkSession, path: str, name: str = "day") -> list[date]:
    """The days that a table has folders for."""
    files, place = _files(spark, path)
    found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(date.fromisoformat(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}=") and not f.endswith("__HIVE_DEFAULT_PARTITION__"))


def drop_days(spark: SparkSession, path: str, before: date, name: str = "day") -> list[date]:
    """Removes the days before one, and returns them. Rows without a day stay. No row is read or written."""
    files, _ = _files(spark, path)
    gone = [d for d in days(spark, path, name) if d < before]
    for d in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={d.isoformat()}"), True)
    return gone


def read_days(spark: SparkSession, path: str, since: date, name: str = "day") -> DataFrame:
    """The rows from a day on: only the folders of those days are read."""
    return spark.read.parquet(path).where(F.col(name) >= F.lit(since))
