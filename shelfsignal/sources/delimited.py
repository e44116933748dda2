"""Delimited files in splits, line breaks within quotes included.

A line break ends a record only where the quotes before it pair up, so a split
can't tell by itself where its first record begins. One pass counts each
split's quotes; their sums over the splits of a file before it say whether a
split begins within quotes. In the second pass every split cuts its lines into
records from its true first row on. Only what crosses a border of splits, a
piece or two a split, is put together by file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import small
from ..functions.shared import shared_dir

_BOM = "﻿"
_PARSER = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
_RECORDS = "file string, at long, row long, head boolean, kind int, text string"
#: A whole record, or a piece of one: the end of one that began before, the begin of one that goes on, a split without either.
_WHOLE, _END, _BEGIN, _MIDDLE = range(4)


def read_whole(spark: SparkSession, path) -> DataFrame:
    """As ``read_csv``, each file by one task and whatever its quotes: Spark's own reader over several lines."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).options(**_PARSER).csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return _filled(raw.select(*(F.col(f"`{c}`") for c in raw.columns), order.alias("_order")), raw.columns)


def _filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    names = [c.replace(_BOM, "").strip() for c in columns]
    df = rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(columns, names, strict=True)), "_order")
    return df.where(F.greatest(*(F.length(F.trim(F.col(f"`{n}`"))) for n in names), F.lit(0)) > 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, at, odd, inside, value), split by split in their order, as records and pieces."""
    where, held, inside, row, seen = None, [], False, 0, False

    def out(texts: list[str] | pa.Array, kind: int) -> pa.RecordBatch:
        nonlocal row, seen
        n = len(texts)
        first = np.zeros(n, bool)
        if kind in (_WHOLE, _BEGIN):
            first[:1] = where[1] == 0 and not seen
            seen = True
        columns = [pa.array([where[0]] * n), pa.array(np.full(n, where[1], np.int64)), pa.array(np.arange(row, row + n)), pa.array(first), pa.array(np.full(n, kind, np.int32)), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())]
        row += n
        return pa.RecordBatch.from_arrays(columns, names=["file", "at", "row", "head", "kind", "text"])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield out(["\n".join(held)], _MIDDLE if inside else _BEGIN)

    for batch in batches:
        if not len(batch):
            continue
        at, file = batch.column("at").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (file[1:] != file[:-1])]))
        for a, b in zip(edges, [*edges[1:], len(batch)], strict=True):
            here = (batch.column("file")[int(a)].as_py(), int(at[a]))
            if here != where:
                yield from rest()
                where, held, row, seen = here, [], 0, False
                inside = open_ = bool(batch.column("inside")[int(a)].as_py())
            lines = batch.column("value").slice(a, b - a)
            odd = batch.column("odd").slice(a, b - a).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((open_ + np.cumsum(odd)) % 2 == 0)
            open_ = bool((open_ + odd.sum()) % 2)
            if len(ends) == len(lines) and not held:
                yield out(lines, _WHOLE)
                continue
            texts, begin, records = lines.to_pylist(), 0, []
            for e in ends.tolist():
                held += texts[begin : e + 1]
                begin = e + 1
                if inside:
                    inside = False
                    yield out(["\n".join(held)], _END)
                else:
                    records.append(held[0] if len(held) == 1 else "\n".join(held))
                held = []
            held += texts[begin:]
            if records:
                yield out(records, _WHOLE)
    yield from rest()


def _kept(splits: DataFrame) -> DataFrame:
    """``splits`` written to the shared folder and read again: asked several times, counted once."""
    spark, path = splits.sparkSession, f"{shared_dir(splits.sparkSession)}/splits/{uuid.uuid4().hex}"
    splits.write.parquet(path)
    return spark.read.schema(splits.schema).parquet(path)


def records(spark: SparkSession, path) -> tuple[DataFrame, list[str]]:
    """(file, at, row, head, text) of each record; and the files whose quotes don't pair up, which have none."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), odd.alias("odd"), "value")
    splits = lines.groupBy("file", "at").agg((F.count_if("odd") % 2).alias("odd"))
    w = Window.partitionBy("file").orderBy("at")
    splits = splits.withColumn("upto", F.sum("odd").over(w) % 2)  # a row a split
    splits = splits.select("file", "at", ((F.col("upto") + F.col("odd")) % 2 == 1).alias("inside"), F.last("upto").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("left")).where("inside OR left = 1")
    splits = _kept(splits)
    broken = [r["file"] for r in splits.where("left = 1").select("file").distinct().collect()]  # as few as files with a stray quote
    starts = splits.where("inside").select("file", "at", "inside")
    crossing = not starts.isEmpty()
    if broken:
        lines = lines.where(~F.col("file").isin(*broken))
    if crossing:
        side = small(starts)
        lines = lines.withColumn("line", F.monotonically_increasing_id()).join(side, ["file", "at"], "left")
        lines = lines.sortWithinPartitions("file", "at", "line")  # a join by shuffle loses the order
    else:
        lines = lines.withColumn("inside", F.lit(False))
    cut = lines.select("file", "at", "odd", F.coalesce("inside", F.lit(False)).alias("inside"), "value").mapInArrow(_cut, _RECORDS)
    found = cut.where(F.col("kind") == _WHOLE).select("file", "at", "row", "head", "text")
    if crossing:
        pieces = cut.where(F.col("kind") != _WHOLE)
        order = Window.partitionBy("file").orderBy("at", "row")
        pieces = pieces.withColumn("number", F.count_if(F.col("kind") == _BEGIN).over(order))
        parts = F.sort_array(F.collect_list(F.struct("at", "row", "head", "text"))).alias("p")
        joined = pieces.groupBy("file", "number").agg(parts).select("file", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["row"].alias("row"), F.col("p")[0]["head"].alias("head"), F.array_join("p.text", "\n").alias("text"))
        found = found.unionByName(joined)
    return found, broken


def read_csv(spark: SparkSession, path) -> DataFrame:
    """Rows of delimited files as text: header trimmed and without a byte-order mark, short rows padded, blank rows left out.

    Files are read in splits, quoted line breaks or not; one whose quotes don't
    pair up is read by one task. The header is that of the first file, each
    file's first record is left out. ``_order`` rises with the rows' order:
    file by name, place of the split, row; it does not depend on how the files
    were dealt. A line that ends in a carriage return loses it.
    """
    columns = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).options(**_PARSER).csv(path).columns
    found, broken = records(spark, path)
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    rows = found.where("NOT head").select(F.from_csv(F.regexp_replace("text", r"\r$", ""), schema, _PARSER).alias("v"), F.struct("file", "at", "row").alias("_order"))
    rows = rows.select(*(F.col(f"v.c{i}").alias(c) for i, c in enumerate(columns)), "_order")
    rows = _filled(rows, columns)
    return rows.unionByName(read_whole(spark, broken).select(*rows.columns)) if broken else rows
