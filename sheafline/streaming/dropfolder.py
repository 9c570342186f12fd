"""A folder that files are dropped into, as a stream: the batch transformation, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafline.operators.detect import detect
from sheafline.operators.record import documents_of, extract_records, wide
from sheafline.sources.readers import SUFFIXES, read_content


def drop_folder(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """A stream of path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    both = ",".join(x for s in SUFFIXES for x in (s, s.upper()))
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{" + both + "}").option("maxFilesPerTrigger", files_per_batch).load(path)


def process(files: DataFrame, catalog: DataFrame, providers: list[dict] | None = None, fuzzy: bool = True) -> DataFrame:
    """Wide records of files; the same code for a batch and for a micro-batch; each file is read once. Unreadable files give records without values and their error."""
    docs = read_content(files)
    keyed = detect(docs.withColumn("plain_text", F.coalesce("plain_text", F.lit(""))), catalog)
    ready = documents_of(keyed).withColumnRenamed("source_path", "doc_id")
    return wide(extract_records(ready, providers, fuzzy=fuzzy, key="doc_id", carry=("reader_error",)), "doc_id", ("reader_error",))


def run(spark: SparkSession, folder: str, catalog: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, providers: list[dict] | None = None, once: bool = True, fuzzy: bool = True) -> StreamingQuery:
    """Starts the job; ``sink(records, batch_id)`` is called for each micro-batch and must be idempotent by batch_id for exactly-once results."""

    def batch(files: DataFrame, n: int) -> None:
        held = files.persist()
        sink(process(held, catalog, providers, fuzzy), n)
        held.unpersist()

    w = drop_folder(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def pair_reports(cases: DataFrame, reports: DataFrame, key: str, delay: str = "7 days") -> DataFrame:
    """Streams of instruction and engineer records (key, at, fields) paired: left outer join within ``delay``, state bounded by watermarks."""
    a = cases.withWatermark("at", delay).alias("a")
    b = reports.withWatermark("at", delay).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.at") >= F.col("a.at")) & (F.col("b.at") <= F.col("a.at") + F.expr(f"INTERVAL {delay}"))
    return a.join(b, near, "leftOuter")
