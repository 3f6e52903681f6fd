"""A sink fenced by batch number: the tables of a batch count together, and once, or not at all.

Each table's rows of a batch lie in a folder of their own, and a batch counts from when its marker is there. A batch
that failed before its marker is written again into the same folders; one that has its marker is left alone. So a page
of documents and the cursor behind it can't part, and a batch sent twice is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARKERS = "_batches"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that count, in order."""
    files, place = _files(spark, f"{root}/{MARKERS}")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(place)) if files.exists(place) else []


def stage(root: str, batch: int, tables: dict[str, DataFrame]) -> None:
    """Writes a batch's rows, instead of those of an attempt before. They don't count yet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def seal(spark: SparkSession, root: str, batch: int) -> None:
    """Makes a batch count. Creating a file that isn't there is one step, so of two writers one fails."""
    files, place = _files(spark, f"{root}/{MARKERS}/{batch}")
    files.create(place, False).close()


def commit(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Stages and seals a batch; False if it counts already."""
    if batch in batches(spark, root):
        return False
    stage(root, batch, tables)
    seal(spark, root, batch)
    return True


def rows(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that count, with the column batch."""
    known = batches(spark, root)
    paths = [p for b in known if _files(spark, p := f"{root}/{name}/batch={b}")[0].exists(_files(spark, p)[1])]
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*schema.fields]).add("batch", "long")
    return spark.read.schema(whole).option("basePath", f"{root}/{name}").parquet(*paths) if paths else spark.createDataFrame([], whole)


def newest(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """A table of which each batch writes all rows, as of the newest batch that counts."""
    known = batches(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{name}/batch={known[-1]}") if known else spark.createDataFrame([], schema)
