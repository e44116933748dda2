"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch: keeps a Python worker's memory bounded even where texts are long.
BATCH_ROWS = 500


def tune(spark: SparkSession) -> None:
    """Small Arrow batches for the Python stages of this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive an executor, and lets several
    consumers read a result that is computed once. The files stay, as the
    result is lazy, unless ``scratch`` ends; clear the folder ``stages`` there
    when jobs have ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_made: list[list[str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Removes the files of frames that ``stage`` returned, once what was made of them has been written."""
    for df in frames:
        _remove(df.sparkSession, _paths.pop(df))


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what ``stage`` wrote within it: for steps whose result has been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            _remove(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a keys-only side that may be broadcast; a longer one is shuffled.
BROADCAST_ROWS = 200_000


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow, already staged) with a broadcast hint if it is proven to have no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Parts of a sample that are cut to size each on its own.
PARTS = 8


def bounded_sample(df: DataFrame, rows: int, key: str, by: str | None = None) -> DataFrame:
    """At most ``rows`` rows (of each value of ``by``): those of the smallest hash of ``key``.

    Rows are counted first, so that only about twice as many as wanted are
    sorted, however many there are. With ``by`` each value's rows are dealt by
    their hash into ``PARTS``, of which each holds its share at most.
    """
    h = unused(df, "h")
    low_hash = F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))
    if by is None:
        low = df.withColumn(h, low_hash).where(F.col(h) <= min(1.0, 2.0 * rows / max(1, df.count())) * float(1 << 62))
        return low.orderBy(h, key).limit(rows).drop(h)
    n, k, value = unused(df, "n"), unused(df, "k"), unused(df, "value")
    counts = maybe_broadcast(stage(df.groupBy(F.col(by).alias(value)).agg(F.count("*").alias(n)), "counts"))
    low = df.withColumn(h, low_hash).join(counts, F.col(by) == F.col(value)).where(F.col(h) <= F.least(F.lit(1.0), 2.0 * rows / F.col(n)) * float(1 << 62))
    low = low.withColumn(k, F.row_number().over(Window.partitionBy(by, F.col(h) % PARTS).orderBy(h, key)))
    return low.where(F.col(k) <= -(-rows // PARTS)).drop(h, n, k, value)


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the smallest node reachable.

    Alternating large-star and small-star: each half is one aggregation (which
    combines on the map side, so a hub costs no more than its edges) and one
    join with its result, which is broadcast while it is small, so that a hub's
    edges stay where they are; a round's edges are written to the shared folder. Roots, and nodes without an
    edge to another node are not returned. Nulls are ignored.
    """
    if edges.isEmpty():
        return edges.selectExpr("u AS node", "v AS root")
    e = stage(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = e.union(e.selectExpr("v AS u", "u AS v"))
        low = maybe_broadcast(stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v")
        large = stage(large.where("u <> v").distinct(), "large")
        low = maybe_broadcast(stage(large.groupBy("u").agg(F.min("v").alias("m")), "low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = stage(small.where("u <> v").distinct(), "small")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("count(distinct u)")).first()
        if now == seen and now[0] == now[2]:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.selectExpr("u AS node", "v AS root")
