"""Benchmark decontamination by template windows.

Tokens are the words of a text without the ASCII punctuation around them.
Canonical form: a number becomes NUM, a unit after a number UNIT, a name (a
capital followed by small letters, not at the start of a sentence) NAME,
anything else its lower-cased word. ``WINDOW`` tokens in a row make a window;
an item with fewer makes one window of its whole length. A window more than
half of which are placeholders says too little and is matched as it stands.

Two more variants of a window find what these miss. Variant 1: a capitalised
word at the start of a sentence is a NAME too, if four other words are left.
Variant 2: a window that is mostly placeholders then, in canonical form, from
the last word before it on if it holds none (``REACH`` tokens back at most);
such matches count only with ``NEAR`` windows or more on their diagonal. So
changed numbers in an item of mostly numbers are found only if it has ten
tokens and a word before or among them; a shorter one is matched as it stands.

Windows of documents are hash-joined with those of the benchmark. Matches on
one diagonal (document position minus item position) are an alignment; it
holds if its slots are consistent: one value in the item always stands for one
value in the document, whatever the numbers and names were changed to. This is
asked of the plain windows, of these with variant 1, and of all, each apart. A
document is contaminated by an item if its consistent alignments cover at
least ``COVER`` of the item's windows.

Windows of the documents are looked up in a sorted table of the benchmark's
hashes before they are sent, if that table is proven to be small
(``LOOKUP`` windows); with a longer benchmark all are sent to the join.

Defined cases: null and empty texts have no windows; a document or item with a
null id takes no part, and such a document is reported as clean; rows of one
doc_id are one document; an empty benchmark leaves all documents clean; items
without a word are never found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage, tune, unused
from .textvec import _CHUNK, buffers, mix, word_hashes, word_spans

WINDOW, COVER = 8, 0.5
REACH, NEAR, WORDS = 64, 3, 4
LOOKUP = 1_000_000
#: Units of measure, time and money.
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards mg g kg lb lbs oz gram grams kilogram kilograms kilometer kilometers kilometre kilometres ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent pct usd eur gbp dollar dollars cent cents euro euros kmh mph kph degrees degree c f k w kw v a hz khz mhz ghz kb mb gb tb".split()
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True


def _units() -> np.ndarray:
    data, offsets = buffers(pa.array([" ".join(UNITS)]))
    start, end, _ = word_spans(data, offsets)
    return np.sort(word_hashes(data, start, end))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased hash, canonical hash, that with names at the start of sentences, number of tokens up to each document's begin)."""
    start, end, bounds = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), bounds
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    solid = np.flatnonzero(~_PUNCT[data])
    solid = np.concatenate([solid, [len(data)]])
    a = solid[np.searchsorted(solid, start)]
    z = solid[np.searchsorted(solid, end) - 1] + 1
    ok = a < end
    doc = np.searchsorted(bounds, np.arange(len(start)), "right") - 1
    lines = total(data == 10)
    opens = np.ones(len(start), bool)
    opens[1:] = _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    a, z, doc, opens = a[ok], z[ok], doc[ok], opens[ok]
    digits, signs, upper = total((data >= 48) & (data <= 57)), total(_PUNCT[data]), total((data >= 65) & (data <= 90))
    nd = digits[z] - digits[a]
    number = (nd > 0) & (nd + signs[z] - signs[a] == z - a)
    nxt = data[np.minimum(a + 1, len(data) - 1)]
    capital = ((data[a] >= 65) & (data[a] <= 90)) & (upper[z] - upper[a] == 1) | (data[a] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (upper[z] == upper[a])
    raw = word_hashes(data, a, z)
    after = np.zeros(len(a), bool)
    after[1:] = number[:-1] & (doc[1:] == doc[:-1])
    title = capital & (z - a > 1) & ~number
    name = title & ~opens
    unit = after & _among(raw, _units())
    form = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, raw)))
    return raw, form, np.where(title & (form == raw), _NAME, form), np.searchsorted(doc, np.arange(len(offsets)))


def windows(raw: np.ndarray, form: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` tokens from each place on."""
    m = len(raw) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    slots = np.concatenate([[0], np.cumsum(raw != form)])
    plain = 2 * (slots[n:] - slots[:m]) > n
    return _hashed(n, m, lambda i: np.where(plain, raw[i : m + i] ^ np.uint64(1 << 63), form[i : m + i]))


def _hashed(n: int, m: int, token) -> np.ndarray:
    acc = np.full(m, np.uint64(n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + token(i) + np.uint64(i + 1))
    return acc


def titled(raw: np.ndarray, form: np.ndarray, wide: np.ndarray, n: int):
    """(place, hash) of the windows of variant 1."""
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    more, slots = total(wide != form), total(wide != raw)
    used = slots[n:] - slots[:-n]
    at = np.flatnonzero((more[n:] > more[:-n]) & (2 * used <= n) & (n - used >= WORDS))
    return at, _hashed(n, len(at), lambda i: wide[at + i])


def dense(raw: np.ndarray, wide: np.ndarray, begin: np.ndarray, n: int):
    """(place, hash) of the windows of variant 2; begin: each token's document's first token."""
    slots = np.concatenate([[0], np.cumsum(wide != raw)])
    at = np.flatnonzero(2 * (slots[n:] - slots[:-n]) > n)
    last = np.maximum.accumulate(np.where(wide == raw, np.arange(len(raw)), -1))
    first = np.where(slots[at + n] - slots[at] < n, at, last[at])
    ok = (first >= begin[at]) & (at - first <= REACH)
    at, first = at[ok], first[ok]
    acc = np.full(len(at), 0x5555555555555555, np.uint64)
    size = at + n - first
    with np.errstate(over="ignore"):
        for i in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > i)
            acc[on] = mix(acc[on] * np.uint64(0x2545F4914F6CDD1D) + wide[first[on] + i] + np.uint64(i + 1))
    return at, acc


def _windows(lengths: list[int] | None, window: int, table: np.ndarray | None):
    """lengths: those of the windows of every text, None: one window, or a short text as a whole."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids, i = batch.column(0), 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
                raw, form, wide, bounds = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(bounds)
                doc = np.repeat(np.arange(j - i), size)
                begin = bounds[:-1][doc]
                place = np.arange(len(raw)) - begin
                slots = [np.where(raw != f, raw, np.uint64(0)) for f in (form, wide, wide)]
                for n in lengths or sorted({window, *size[(size > 0) & (size < window)].tolist()}):
                    if len(raw) < n:
                        continue
                    h = windows(raw, form, n)
                    found = [(np.arange(len(h)), h), titled(raw, form, wide, n)]
                    if n == window:
                        found.append(dense(raw, wide, begin, n))
                    for variant, (at, h) in enumerate(found):
                        fits = place[at] + n <= size[doc[at]]
                        if lengths is None and n < window:
                            fits &= size[doc[at]] == n
                        if table is not None:
                            fits &= _among(h, table)
                        at, h = at[fits], h[fits]
                        if not len(at):
                            continue
                        own = slots[variant][at[:, None] + np.arange(n)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(h.view(np.int64)),
                                ids.take(pa.array(doc[at] + i)),
                                pa.array(place[at].astype(np.int32)),
                                pa.array(np.full(len(at), n, np.int32)),
                                pa.array(np.full(len(at), variant, np.int32)),
                                pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * n + 1, n, dtype=np.int32)), pa.array(own.ravel().view(np.int64))),
                            ],
                            names=["h", "id", "place", "n", "variant", "slots"],
                        )
                i = j

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, cover) of every document and item of which it holds at least ``cover``."""
    tune(docs.sparkSession)
    schema = "h long, id long, place int, n int, variant int, slots array<long>"
    rows = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    items = stage(rows(benchmark, "item_id").mapInArrow(_windows(None, window, None), schema), "items")
    sizes = items.groupBy("id").agg(F.countDistinct("place", "n").alias("windows"))
    lengths = [r[0] for r in items.select("n").distinct().collect()]  # no more than window values
    known = items.select("h").distinct()
    few = known.limit(LOOKUP + 1).count() <= LOOKUP
    table = np.sort(known.toPandas()["h"].to_numpy(np.int64).view(np.uint64)) if few else None
    if not lengths:
        lengths = [window]
    found = rows(docs, "doc_id").mapInArrow(_windows(lengths, window, table), schema)
    right = items.select("h", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("variant").alias("item_variant"), F.col("slots").alias("item_slots"))
    both = found.join(maybe_broadcast(right), "h").withColumn("diagonal", F.col("place") - F.col("item_place"))
    pairs = F.expr("filter(arrays_zip(item_slots, slots), x -> x.item_slots <> 0 OR x.slots <> 0)")
    levels = F.explode(F.expr("sequence(greatest(variant, item_variant), 2)")).alias("level")
    aligned = both.select(F.col("id").alias("doc_id"), "item_id", "diagonal", levels, F.struct("item_place", "n").alias("at"), pairs.alias("pairs"))
    aligned = aligned.groupBy("doc_id", "item_id", "diagonal", "level").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    same = F.expr("size(array_distinct(transform(pairs, x -> x.item_slots))) = size(pairs)")
    hits = aligned.where(same & ((F.col("level") < 2) | (F.size("at") >= NEAR))).groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hit"))
    share = F.col("hit") / F.col("windows")
    sizes = maybe_broadcast(stage(sizes.withColumnRenamed("id", "item_id"), "sizes"))
    return hits.join(sizes, "item_id").select("doc_id", "item_id", share.alias("cover")).where(F.col("cover") >= cover)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted) and best_cover for every row of ``docs``."""
    found = contaminated(docs, benchmark, window, cover).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("cover").alias("best_cover"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(stage(found, "found"), "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("best_cover", F.lit(0.0)).alias("best_cover"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """The rows of ``docs`` without a contaminated document, all columns."""
    gone = unused(docs, "gone")
    found = stage(contaminated(docs, benchmark, window, cover).select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(maybe_broadcast(found), F.col("doc_id") == F.col(gone), "left_anti")
