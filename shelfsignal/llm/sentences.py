"""Substring deduplication by sliding spans of sentences.

A text's words (maximal runs of bytes outside space and 0x09-0x0D) form
sentences: one ends with a word that ends in one of ``. ! ? ; : ,`` or in such
a mark of another script, before a line feed, and at the text's end. Of any
``LONGEST`` words in a row without an end the one of least hash is an end too:
what a passage's words make is the same wherever it stands, and no sentence is
longer. So a repeated passage of 29 words or more always holds a span, and of
its words at most ``LONGEST`` stay at its begin and 8 at its end, where
sentences lie across its edges (line feeds within it being alike). A span starts at every sentence and takes
consecutive sentences until it has ``SENTENCES`` of them and ``WORDS`` words;
too short a rest makes none. Spans are hashed over their lower-cased words
(ASCII letters) and joined by hash over all documents. Of equal spans the
first, by (doc_id, position), stays; every sentence that any other one covers
is removed with the white space after it.

A span's hashes are counted before the shuffle; a hash that a third of all rows
share is one row of each task there. Only spans of hashes met twice go on, and
the first is found among these. Its occurrences meet only in a join
that can be split. Texts that lose nothing are not shuffled while those that
do are few enough for a list of their keys.

Defined cases: null text stays null, a text without a repeated span stays as
it is, a text all of whose sentences go becomes empty. Rows of one doc_id
count as one document if their texts are equal; with different texts they are
documents of their own, in the order of a hash of the text. A null doc_id is
left as it is. All columns pass, whatever their names; n_removed is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, maybe_broadcast, stage, tune, unused
from .textvec import _CHUNK, buffers, mix, word_hashes, word_spans

SENTENCES, WORDS = 3, 20
#: So many words in a row hold at least one end of a sentence.
LONGEST = 5
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;:,")] = True
#: Marks of other scripts that end a sentence or clause, by their number of bytes.
_MARKS = {2: "\u037e\u0589\u060c\u061b\u061f\u06d4\u0700\u0701\u0702", 3: "\u2026\u203c\u2047\u2048\u2049\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61\uff64\u0964\u0965\u1362\u1363\u1364\u1367\u104a\u104b\u17d4"}
_CODES = {n: np.array(sorted(int.from_bytes(c.encode()) for c in marks)) for n, marks in _MARKS.items()}
_P = np.uint64(0x5851F42D4C957F2D)
_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that end in a mark of ``_MARKS``."""
    out = np.zeros(len(start), bool)
    wide = np.flatnonzero(data[end - 1] >= 0x80)
    for n, codes in _CODES.items():
        at = wide[end[wide] - start[wide] >= n]
        code = sum(data[end[at] - 1 - i].astype(np.int64) << (8 * i) for i in range(n))
        out[at] = np.isin(code, codes)
    return out


def _chosen(last: np.ndarray, hashes: np.ndarray, longest: int) -> np.ndarray:
    """``last``, and the word of least hash (the last of equal ones) of any ``longest`` words in a row that hold no end."""
    total = np.concatenate([[0], np.cumsum(last)])
    at = np.flatnonzero(total[longest:] == total[:-longest])
    low, least = at.copy(), hashes[at]
    for i in range(1, longest):
        lower = hashes[at + i] <= least
        low, least = np.where(lower, at + i, low), np.where(lower, hashes[at + i], least)
    out = last.copy()
    out[low] = True
    return out


def spans(data: np.ndarray, offsets: np.ndarray, sentences: int, words: int):
    """(document, hash, first byte, byte after it with white space) of every span."""
    start, end, bounds = word_spans(data, offsets)
    n = len(start)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(n, bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    last[:-1] |= lines[start[1:]] > lines[end[:-1]]
    last |= _ENDS[data[end - 1]] | _marked(data, start, end)
    hashes = word_hashes(data, start, end)
    last = _chosen(last, hashes, LONGEST)
    until = np.flatnonzero(last) + 1
    first = np.concatenate([[0], until[:-1]])
    doc = np.searchsorted(bounds, first, "right") - 1
    final = np.maximum(np.arange(len(first)) + sentences - 1, np.searchsorted(until, first + words))
    ok = final < len(first)
    ok[ok] = doc[final[ok]] == doc[ok]
    first, doc, after = first[ok], doc[ok], until[final[ok]]
    with np.errstate(over="ignore"):
        up = np.full(n + 1, _P, np.uint64)
        down = np.full(n + 1, _INV, np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n])])
        value = mix((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64))
    begin = offsets[doc]
    rest = np.where(after < bounds[doc + 1], start[np.minimum(after, n - 1)], offsets[doc + 1])
    return doc, value.view(np.int64), start[first] - begin, rest - begin


def _spans(sentences: int, words: int, text: int):
    """Spans as (h, key columns, at): the text stands in column ``text``; at holds the first byte and the one after the span, 32 bits each."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            keys, i = batch.columns[:text], 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 2 * _CHUNK, "right")) - 1)
                doc, value, a, z = spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sentences, words)
                row = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(value), *(k.take(row) for k in keys), pa.array((a << 32) | z)], names=["h", *batch.schema.names[:text], "at"])
                i = j

    return run


def versions(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the key of a document: doc_id as a long, and where doc_ids are repeated a column that tells their texts apart (0 where there is one row of it, else a hash of the text)."""
    key, again, version = unused(docs, "key"), unused(docs, "again"), unused(docs, "version")
    docs = docs.withColumn(key, F.col("doc_id").cast("long"))
    several = stage(docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(again)).agg(F.count("*").alias("n")).where("n > 1").select(again), "several")
    if several.isEmpty():
        return docs, [key]
    own = F.when(F.col(again).isNotNull(), F.xxhash64("text")).otherwise(0)
    return docs.join(maybe_broadcast(several), F.col(key) == F.col(again), "left").withColumn(version, own).drop(again), [key, version]


def repeated_spans(docs: DataFrame, keys: list[str], sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(keys, at) of every span that is not the first of its kind, for ``docs`` (keys, text); at: its first byte and the one after it, 32 bits each."""
    tune(docs.sparkSession)
    docs = docs.where(F.col(keys[0]).isNotNull()).select(*keys, F.col("text").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(keys))]
    all_ = stage(docs.toDF(*names, "text").mapInArrow(_spans(sentences, words, len(keys)), f"h long, {', '.join(f'{n} long' for n in names)}, at long"), "spans")
    several = stage(all_.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    found = stage(all_.join(several, "h", "left_semi"), "met")
    discard(all_, several)
    at = F.struct(*names, "at")
    first = found.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("h", "first")
    return found.join(stage(first, "repeated"), "h").where(at != F.col("first")).select(*names, "at").toDF(*keys, "at")


def _cut(schema: T.StructType, text: int):
    def run(batches):
        for batch in batches:
            out, gone = [], []
            for value, cuts in zip(batch.column(text).to_pylist(), batch.column(len(batch.schema) - 1).to_pylist(), strict=True):
                n = 0
                if value is not None and cuts:
                    raw, parts, at = value.encode(), [], 0
                    for c in sorted(cuts):
                        a, z = c >> 32, c & 0xFFFFFFFF
                        if z > at:
                            parts.append(raw[at : max(at, a)])
                            n += z - max(at, a)
                            at = z
                    value = b"".join([*parts, raw[at:]]).decode()
                out.append(value)
                gone.append(n)
            columns = list(batch.columns[:-1])
            columns[text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with the repeated sentences taken out of text, and n_removed (bytes)."""
    docs = docs.drop("n_removed").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())])
    rows, keys = versions(docs)
    found = repeated_spans(rows.select(*keys, "text"), keys, sentences, words)
    own, cuts = [unused(rows, f"own{i}") for i in range(len(keys))], unused(rows, "cuts")
    found = stage(found.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).agg(F.collect_set("at").alias(cuts)), "cuts")
    same = [F.col(k) == F.col(o) for k, o in zip(keys, own, strict=True)]
    cut = lambda df: df.drop(*own, *keys).mapInArrow(_cut(schema, docs.columns.index("text")), schema)
    if found.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return cut(rows.join(found, same, "left"))
    few = F.broadcast(found.select(*own))  # texts that keep all their sentences stay where they are
    whole = rows.join(few, same, "left_anti").drop(*keys).withColumn("n_removed", F.lit(0).cast("long"))
    return whole.unionByName(cut(rows.join(few, same, "left_semi").join(found, same)))
