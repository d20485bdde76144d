"""Helpers shared by the corpus operators: tables, scratch tables, payload packing."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcover.session import ensure_checkpoint_dir
from sparkcover.session import ship_package as ship_code


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """``session.ship_package``; also lowers the rows per Arrow batch, unless the session has a setting of its own."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkcover_batched", False):
        return
    # rows are whole texts here: Spark's default of 10,000 would make batches of 50 MB and more
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    sc._sparkcover_batched = True
    ship_code(spark)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with workers that can import this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps columns compressed and prunable.
    ``options`` are the writer's.
    The folder is the session's own subfolder of ``spark.checkpoint.dir``.
    """
    spark, schema = df.sparkSession, df.schema
    gc.collect()
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def let_go_of_shuffles(spark: SparkSession) -> None:
    """Have Spark's context cleaner delete the shuffle files of plans nothing refers to.

    It works on what the driver's collector finds, which else may run once in half an hour.
    Python's handles go first, the plans behind them with the next collection.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of ``written`` from which nothing is read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` in one struct, so extra columns can't clash with working ones.

    Columns named like an output column (``drop``, any case) are left out: the output wins.
    """
    out = {c.lower() for c in drop}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out])


def free_prefix(df: DataFrame) -> str:
    """A prefix for working columns that no column of ``df`` starts with (any case)."""
    k = 0
    while any(c.lower().startswith(f"w{k}_") for c in df.columns):
        k += 1
    return f"w{k}_"


def kept_columns(df: DataFrame, outputs: tuple[str, ...]) -> list[Column]:
    """The columns of ``df`` that don't give way to an output column of the same name."""
    out = {c.lower() for c in outputs}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]


def word_class_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
