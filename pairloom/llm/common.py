"""Scratch tables, readers and skew helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot when it holds more than this share of all rows, so at most HOT_KEYS keys can be hot.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may lack the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths and catalog tables that each application has made here, in order.
_MADE: dict[str, list[tuple[str, str]]] = {}


def _made(spark: SparkSession) -> list[tuple[str, str]]:
    return _MADE.setdefault(spark.sparkContext.applicationId, [])


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    _made(spark).append(("path", path))
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A name of a catalog table over a scratch path, to be dropped with it."""
    _made(spark).append(("table", name))
    return name


def store(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write df to path and read it back: lineage ends there, and lost executors cost only their own tasks."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """store() under a scratch path in the shared folder."""
    return store(df, scratch_path(df.sparkSession, tag), codec)


def mark(spark: SparkSession) -> int:
    """Stands for what has been made so far; see release()."""
    return len(_made(spark))


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch tables made after ``since`` but for the paths in ``keep``; call it once what reads them is written."""
    made = _made(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for kind, name in made[since:]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif name not in keep:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    made[since:] = [x for x in made[since:] if x[1] in keep]


def join_groups(members: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of members to one row per group, safe when a few groups hold most members.

    Groups of more than total / HOT_KEYS rows number at most HOT_KEYS, so they are broadcast and their members never
    move; all others meet in a shuffled join whose largest group is that small. ``groups`` must be cheap to read twice.
    """
    limit = max(1, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > limit).select(key, F.lit(True).alias("_hot")))
    marked = members.join(hot, key, "left")
    cold_rows = marked.where("_hot is null").drop("_hot").join(groups.where(F.col(size) <= limit), key)
    hot_rows = marked.where("_hot").drop("_hot").join(F.broadcast(groups.where(F.col(size) > limit)), key)
    return cold_rows.unionByName(hot_rows)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_row_each(rows: DataFrame, twice: DataFrame, same: Column, keys: list[str], schema: T.StructType) -> DataFrame:
    """rows (keys and the struct ``row`` of ``schema``) with one row of those that occur more than once, the least of them.

    ``twice`` names the repeated keys, ``same`` is its join condition. They are rare; only they pass through a grouping
    that carries whole rows, one row of each task at most, and only if there are any.
    """
    if twice.isEmpty():
        return rows
    again = rows.join(twice, same, "left_semi").groupBy(*keys).agg((F.min if _orderable(schema) else F.any_value)("row").alias("row"))
    return rows.join(twice, same, "left_anti").unionByName(again.select(rows.columns))
