"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a temporary folder of this machine is set in local
    mode; elsewhere that is an error, since other hosts could not read it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        path = tempfile.mkdtemp(prefix="sheafline-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def bounded_sample(df: DataFrame, key: str, rows: int) -> list[Row]:
    """About ``rows`` rows (all, if there are fewer), the same ones each time: those whose hash of ``key`` is low.

    A threshold, not a sort: what reaches the driver does not grow with the number of partitions.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if n > rows:
        df = df.where(h < int((1 << 40) * min(1.0, rows / n)))
    got = df.withColumn("_h", h).collect()
    return sorted(got, key=lambda r: (r["_h"], str(r[key])))[: 2 * rows]


def top_and_rest(counts: DataFrame, by: str, rows: int) -> tuple[list[Row], DataFrame | None]:
    """(the rows with the highest ``by``, at most ``rows`` of them; all other rows as a table, None if there are none).

    Rows that tie at the bound go to the table together. Nothing is lost: the first part may be broadcast, the second
    is met by a join.
    """
    counts = cut(counts)
    if counts.count() <= rows:
        return counts.collect(), None
    upto: Column = F.sum("_m").over(Window.orderBy(F.desc(by)))
    least = counts.groupBy(by).agg(F.count("*").alias("_m")).withColumn("_u", upto).where(F.col("_u") <= rows).agg(F.min(by)).head()[0]
    if least is None:
        return [], counts
    return counts.where(F.col(by) >= least).collect(), counts.where(F.col(by) < least)
