"""Continuous ingest: files that land in folders are validated and appended, each once."""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.delimited import read_csv
from ..sources.files import glob_regex, read_workbook
from ..sources.imports import apply_map, map_headers, split_valid, validate


def ingest(spark: SparkSession, landing: str, headers: list[str], mapping: dict[str, str], dataset: str, out: str, checkpoint: str, pattern: str = "*.csv"):
    """Take all files now in ``landing`` and stop; good rows go to ``out``/good, others to ``out``/rejects.

    For one kind of file with known headers and no line breaks in its rows;
    ``poll`` takes any. The checkpoint is the ledger of files; a batch that is
    tried again writes to its own folder, so that nothing is appended twice.
    """
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    rows = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(landing)

    def take(batch: DataFrame, number: int) -> None:
        checked = validate(apply_map(batch, mapping), dataset).persist()
        good, bad = split_valid(checked)
        good.write.mode("overwrite").parquet(f"{out}/good/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        checked.unpersist()

    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@dataclass(frozen=True)
class Feed:
    """A folder that is polled: which files, what they hold, and what becomes of them once they are taken (keep, archive, delete)."""

    id: int
    connection_id: int
    folder: str
    dataset: str
    pattern: str = "*"
    after: str = "keep"
    archive: str | None = None


_LEDGER = "connection_id long, feed_id long, path string, filename string, size long, rows long, rejected long, status string, error string, processed_at timestamp_ntz"
#: Files of one feed that are read at the same time, and of one batch at most.
AT_ONCE, BATCH = 8, 100


def any_case(pattern: str) -> str:
    """A file pattern for letters of either case; blank matches all."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and c.lower() != c.upper() else c for c in pattern.strip() or "*")


def _headed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a delimited file or the first sheet of a workbook under their headers, with ``_order``."""
    return read_workbook(spark, path) if path.lower().endswith((".xlsx", ".xlsm")) else read_csv(spark, path)


def take_file(spark: SparkSession, feed: Feed, path: str, size: int, out: str) -> tuple:
    """Reads, maps and validates one file, its rows to folders of its own under ``out``; its line of the ledger, with the reason where it fails."""
    name, key = path.rsplit("/", 1)[-1], hashlib.sha256(path.encode()).hexdigest()[:20]
    line = (feed.connection_id, feed.id, path, name, size)
    try:
        if not size:
            raise ValueError("Empty or unreadable remote file.")
        rows = _headed(spark, path)
        mapping = {h: field for h, (field, _) in map_headers([c for c in rows.columns if c != "_order"], feed.dataset).items() if field}
        checked = validate(apply_map(rows, mapping), feed.dataset).withColumn("source_file", F.lit(path)).persist()
        good, bad = split_valid(checked)
        good.write.mode("overwrite").parquet(f"{out}/good/feed={feed.id}/file={key}")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/feed={feed.id}/file={key}")
        n, rejected = checked.agg(F.count("*"), F.count("error")).first()
        checked.unpersist()
        return (*line, n, rejected, "imported", None)
    except Exception as e:  # noqa: BLE001  whatever it is, the other files go on
        return (*line, None, None, "failed", str(e)[:500])


def poll(spark: SparkSession, feed: Feed, out: str, checkpoint: str, now, files: int = BATCH) -> None:
    """Takes the files of ``feed`` that no poll has taken, late ones too, and stops.

    The checkpoint remembers files, failed ones included; each batch of at most
    ``files`` writes its lines of the ledger under its number, so that a batch
    that is tried again replaces its own. Files are archived or deleted by the
    stream once their batch is done, failed ones too. Spark takes brackets,
    braces and question marks in a file's name for a pattern: such files fail.
    """
    spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", any_case(feed.pattern)).option("maxFilesPerTrigger", files).option("maxFileAge", "36500d").option("recursiveFileLookup", "false")
    if feed.after == "archive":
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", feed.archive)
    elif feed.after == "delete":
        source = source.option("cleanSource", "delete")

    def take(batch: DataFrame, number: int) -> None:
        found = batch.select("path", "length").distinct().collect()  # ``files`` rows at most
        with ThreadPoolExecutor(AT_ONCE) as pool:
            lines = list(pool.map(lambda r: (*take_file(spark, feed, r["path"], r["length"], out), now), found))
        spark.createDataFrame(lines, _LEDGER).write.mode("overwrite").parquet(f"{out}/ledger/feed={feed.id}/batch={number}")

    query = source.load(feed.folder).select("path", "length").writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/feed={feed.id}").trigger(availableNow=True).start()
    query.awaitTermination()
    _note_empty(spark, feed, f"{out}/ledger/feed={feed.id}", now)


def _note_empty(spark: SparkSession, feed: Feed, ledger: str, now) -> None:
    """Lines of the ledger for empty files, which the stream passes over: one for each, at its first sight. They stay where they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(feed.folder)
    fs, like = folder.getFileSystem(conf), re.compile(glob_regex(feed.pattern))
    for status in fs.listStatus(folder):
        path = status.getPath().toString()
        name = path.rsplit("/", 1)[-1]
        if status.isFile() and not status.getLen() and like.match(name):
            noted = f"{ledger}/batch=empty-{hashlib.sha256(path.encode()).hexdigest()[:20]}"
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(noted)):
                spark.createDataFrame([(*take_file(spark, feed, path, 0, ""), now)], _LEDGER).write.mode("overwrite").parquet(noted)


def poll_all(spark: SparkSession, feeds: list[Feed], out: str, checkpoint: str, now) -> dict[int, str]:
    """Polls each feed in a stream of its own; one that fails leaves the others alone. Returns the errors by feed."""
    failed = {}
    for feed in feeds:
        try:
            poll(spark, feed, out, checkpoint, now)
        except Exception as e:  # noqa: BLE001
            failed[feed.id] = str(e)[:500]
    return failed


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type, for streams and tables alike; later rows than ``late`` are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select(F.col("w.start").alias("hour"), "event_type", "events", "value")
