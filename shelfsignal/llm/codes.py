"""Vector code compression: product codes, with VA-file filtering of codebook entries.

Components become integers, a vector ``PARTS`` parts, and each part the number
of its nearest codebook entry. The nearest one is found as in a VA-file: each
coordinate of the entries is quantised to ``BITS`` bits, cells of about equally
many entries with their least and largest component; for each part to be
coded, lookup tables hold the least and the largest squared difference of each
of its components to each cell; summed over an entry's cells they bound its
distance. Only entries whose lower bound does not exceed the least upper bound
are refined, with exact integer distances; ties go to the lower index.

Codebooks start as the parts of the smallest ids. In each round tasks return
componentwise sums and counts for each entry, which are added up by entry;
only the codebooks, whose size is fixed by the vectors' length, pass through
the driver. The integer parts are staged once, so rounds don't parse again.

Defined cases: vectors that are null or hold null or non-finite components are
dropped; zero vectors and repeated rows count like others; null ids come last
in the order, equal ids by their vectors. Vectors of each length have codebooks
of their own; one whose length is no positive multiple of ``PARTS`` has a null
code, error and digest, and its label's error leaves it out (null if it has no
other). Fewer vectors than entries make smaller codebooks. Components whose
squared distances might leave a long are an error. Labels of any number: many
of them are joined by shuffle, but the most frequent ones, whose number is
bounded, by broadcast. Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage, tune, unused

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 16, 64, 2, 256, 4
#: Labels with more than one in so many of all rows are no more than this; they are broadcast where not all can be.
FREQUENT = 10_000
#: Parts that are looked up at once.
SLICE = 8192


class Entries:
    """A codebook for one part (entries x components, integers) and its cells."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book = book
        n, width = book.shape
        cells = min(1 << bits, n)
        order = np.argsort(book, axis=0, kind="stable")
        self.cell = np.empty((n, width), np.int64)
        np.put_along_axis(self.cell, order, np.repeat((np.arange(n) * cells // n)[:, None], width, axis=1), axis=0)
        edge = np.searchsorted(np.arange(n) * cells // n, np.arange(cells + 1))
        ranked = np.take_along_axis(book, order, axis=0)
        self.least, self.most = ranked[edge[:-1]], ranked[edge[1:] - 1]  # cells x components

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``."""
        below, above = self.least[None] - x[:, None], x[:, None] - self.most[None]  # rows x cells x components
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower, upper = np.zeros((len(x), len(self.book)), np.int64), np.zeros((len(x), len(self.book)), np.int64)
        for d in range(self.book.shape[1]):
            lower += least[:, self.cell[:, d], d]
            upper += most[:, self.cell[:, d], d]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        distance = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        begin = np.searchsorted(row, np.arange(len(x)))
        error = np.minimum.reduceat(distance, begin) if len(x) else distance
        hit = np.flatnonzero(distance == error[row])  # by row, then entry: the first hit of a row is the lowest index
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], error


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances), vectors x parts, of integer vectors by codebooks (parts x entries x components)."""
    parts = x.reshape(len(x), len(books), -1)
    code, error = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64)
    for p, book in enumerate(books):
        table = Entries(book)
        for a in range(0, len(x), SLICE):
            code[a : a + SLICE, p], error[a : a + SLICE, p] = table.nearest(parts[a : a + SLICE, p])
    return code, error


def _matrix(batch, dim: int) -> np.ndarray:
    x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
    if len(x) and np.abs(x).max() >= np.sqrt(2.0**61 / dim):
        raise ValueError("components are too large for distances that fit a long")
    return x


def _summed(books: np.ndarray, dim: int):
    def run(batches):
        parts, entries, width = books.shape
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch, dim)
            at = (coded(x, books)[0] + np.arange(parts) * entries).ravel()
            np.add.at(total, at, x.reshape(-1, width))
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, used.size * width + 1, width, dtype=np.int32)), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], names=["at", "n", "total"])

    return run


def _coded(books: np.ndarray, dim: int):
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for batch in batches:
            code, error = coded(_matrix(batch, dim), books)
            text = ["".join(row) for row in digits[code]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def learn(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) of ``rows`` (vec_id, v: integers, all ``dim`` of them)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_summed(books, dim), "at long, n long, total array<long>")
        sums = sums.select("at", "n", *(F.col("total")[i].alias(f"t{i}") for i in range(width)))
        for r in sums.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(width))).collect():  # parts x entries rows
            books[r["at"] // books.shape[1], r["at"] % books.shape[1]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def by_label(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the sum of error over equal labels, nulls together."""
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    sums = sums.withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), same).drop("of", "n")
    many = F.broadcast(sums.where(F.col("n") > rows.count() // FREQUENT))  # FREQUENT labels at most
    rest = rows.join(many, same, "left_anti").join(sums, same)
    return rows.join(many, same).unionByName(rest).drop("of", "n")


def compress(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for the sound rows of ``vectors`` (vec_id, ``column``, label)."""
    tune(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", F.col(column).cast("array<double>").alias("v"))
    rows = rows.where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < cast('infinity' AS double))")
    # a float beyond a long saturates, which the limit of components then refuses
    rows = stage(rows.withColumn("v", F.expr(f"transform(v, x -> cast(floor(greatest(least({SCALE} * x, 9e18D), -9e18D)) AS long))")), "integers")
    size = unused(rows, "size")
    dims = [r[size] for r in rows.select(F.size("v").alias(size)).distinct().collect()]  # lengths of vectors
    found = None
    for dim in sorted(dims):
        own = rows.where(F.size("v") == dim)
        if dim == 0 or dim % parts:
            one = own.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
        else:
            books = learn(own, dim, parts, entries, rounds)
            kinds = f"vec_id {own.schema['vec_id'].dataType.simpleString()}, label {own.schema['label'].dataType.simpleString()}, code string, error long"
            one = own.mapInArrow(_coded(books, dim), kinds).withColumn("codebooks_sha256", F.lit(digest(books)))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    return by_label(stage(found, "codes")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: The same by SQL: brute-force distances instead of bounds, lengths of vectors alike, a multiple of 16 and known to be positive.
SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),
{rounds}
near AS MATERIALIZED ({near2}),
coded AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""
_NEAR = """
  SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
    SELECT r, p, e, CAST(list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(x, c)]) AS BIGINT) AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p"""
_ROUND = """
near{k} AS MATERIALIZED ({near}),
mean{k} AS MATERIALIZED (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
book{next} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e)),"""
SQL = SQL.format(rounds="".join(_ROUND.format(k=k, next=k + 1, near=_NEAR.format(k=k)) for k in range(2)), near2=_NEAR.format(k=2))
