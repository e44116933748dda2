"""Spelling variant grouping: two-dimensional range reporting with wavelet trees.

Two words are near if one inserted, deleted or replaced code point makes one
of the other. If the edit is at position i of the longer word, both begin with
its first i code points and end with what follows i: sorted forward, the words
with that prefix are one interval, sorted by their reversals, those with that
suffix are another, and the near words are the points of the rectangle. A
wavelet tree over the forward order, whose values are places in the reverse
order, reports the points of all rectangles of a position at once.

No tree holds the whole vocabulary. The words of size s and those one shorter
meet in *blocks*: a block is a range of edit positions and the code points
before and after it, which two words with an edit in the range share. At first
a word has two ranges, the halves of its positions; a block of more than
``BLOCK`` words is cut at the middle of its range into two of longer keys, and
so on. A block of one position holds words that differ in one code point only,
no more than there are letters, so every block ends small and none is capped.
Each near pair has its edit in one range of one size, so it is counted once: a
deletion within a run of equal letters counts at the run's first place.
Blocks go to tasks by hash; a task puts the blocks of one size together into
one tree until it has ``ROWS`` words.

Words are counted in each task first, so that a frequent word costs a row a
task. Forms are followed by pointer doubling, a form being ten times as
frequent as its word, in few rounds.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty one in the rule that damages runs; repeated rows count again; a run of
any length is one word. Words may be of any code points but U+0000. Extra
columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage, tune

#: Words of a block, beyond which it is cut while it has more than one position.
BLOCK = 2000
#: Words and code points that go into one tree, unless a block alone has more.
ROWS, CELLS = 20_000, 2_000_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Occurrences that a word needs, code points, times that its form is as frequent, and the share of runs that are damaged.
LEAST, SHORTEST, RATIO, DAMAGED = 2, 7, 10, 31
_BLOCK = ["size", "lo", "hi", "key"]


def _counted(shortest: int, damaged: int):
    """Texts are read as Latin-1, in which other characters become ``?``, no letter."""
    runs = re.compile(rb"[A-Za-z\xC0-\xFF]{%d,}" % shortest)

    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs.findall(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    found[word] += n
            if len(found) > COUNTED:
                yield out(found)
                found.clear()
        yield out(found)

    return run


def count_words(docs: DataFrame, shortest: int = SHORTEST, damaged: int = DAMAGED) -> DataFrame:
    """word and n: the lower-cased runs of letters of ``docs`` (doc_id, text), some of them damaged by the rule, with at least ``shortest`` code points."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(shortest, damaged), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """A wavelet tree, level by level, over a permutation of 0 .. n-1."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in reversed(range(self.levels)):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all points with a place in [a, b) and a value in [c, d)."""
        which, low = np.arange(len(a)), np.zeros(len(a), np.int64)
        for bit, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            a1, b1 = ones[a], ones[b]
            a, b = np.concatenate([a - a1, zeros + a1]), np.concatenate([b - b1, zeros + b1])
            which, low = np.concatenate([which, which]), np.concatenate([low, low + (1 << bit)])
            live = (a < b) & (low < d[which]) & (low + (1 << bit) > c[which])
            a, b, which, low = a[live], b[live], which[live], low[live]
        return which, low


def _intervals(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the interval of each place that shares ``depth`` code points; ``shared`` is what a place shares with the one before."""
    n = len(shared)
    begin = np.flatnonzero(shared < depth)
    size = np.diff(np.concatenate([begin, [n]]))
    return np.repeat(begin, size), np.repeat(begin + size, size)


def _ordered(chars: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of code points by block and content, and what each shares with the one before (-1 at a block's begin)."""
    n, width = chars.shape
    if not width:
        chars, width = np.zeros((n, 1), np.uint32), 1
    order = np.lexsort((np.ascontiguousarray(chars).view(f"U{width}").ravel(), block))
    rows, b = chars[order], block[order]
    differ = rows[1:] != rows[:-1]
    shared = np.full(n, -1)
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[1:][b[1:] != b[:-1]] = -1
    return order, shared


def near_in_blocks(words: np.ndarray, n: np.ndarray, block: np.ndarray, size: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word how many are near it within its block, by edits in [lo, hi), and which of them is the most frequent (-1: none).

    ``words`` have ``size`` code points or one fewer; those of a block are distinct.
    """
    count, rows = np.zeros(len(words), np.int64), np.arange(len(words))
    chars = np.ascontiguousarray(words.astype(f"U{size}")).view(np.uint32).reshape(len(words), size)
    long = chars[:, -1] != 0
    by_n = np.lexsort((words, -n))
    rank = np.empty(len(words), np.int64)
    rank[by_n] = rows
    best = np.full(len(words), len(words))
    forward, f_shared = _ordered(chars[:, :-1], block)
    backward, b_shared = _ordered(np.where(long[:, None], chars[:, :0:-1], chars[:, -2::-1]), block)
    f_place, b_place = np.empty_like(rows), np.empty_like(rows)
    f_place[forward], b_place[backward] = rows, rows
    tree = Wavelet(b_place[forward])
    for i in range(int(lo.min()), int(hi.max())):
        (a, b), (c, d) = _intervals(f_shared, i), _intervals(b_shared, size - 1 - i)
        a, b, c, d = a[f_place], b[f_place], c[b_place], d[b_place]
        live = np.flatnonzero((lo <= i) & (i < hi) & (b - a > 1) & (d - c > 1))
        if not len(live):
            continue
        live = live[np.unique(a[live] * len(words) + c[live], return_index=True)[1]]
        which, value = tree.report(a[live], b[live], c[live], d[live])
        row = backward[value]
        order = np.lexsort((rank[row], which))
        which, row = which[order], row[order]
        points = np.bincount(which, minlength=len(live))
        first = np.cumsum(points) - points
        head, second = row[first], row[np.minimum(first + 1, len(row) - 1)]
        which, row = which[points[which] > 1], row[points[which] > 1]
        if not len(row):
            continue
        other = np.where(row == head[which], second[which], head[which])
        np.minimum.at(best, row, rank[other])
        is_long = long[row]
        fresh = is_long & ((i == 0) | (chars[row, i - 1] != chars[row, i]))  # the first place at which this deletion can stand
        longs, freshs = np.bincount(which[is_long], minlength=len(live)), np.bincount(which[fresh], minlength=len(live))
        shorts = points - longs
        np.add.at(count, row, np.where(is_long, longs[which] - 1 + shorts[which] * fresh, freshs[which]))
    return count, np.where(best < len(words), by_n[np.minimum(best, len(words) - 1)], -1)


def _near(batches):
    """Rows come sorted by block; blocks of one size go into one tree together."""
    names = [*_BLOCK, "n"]

    def solve(cols: dict) -> pa.RecordBatch:
        w, size = cols["word"], int(cols["size"][0])
        edge = np.zeros(len(w), np.int64)
        for name in _BLOCK:
            edge[1:] |= cols[name][1:] != cols[name][:-1]
        words = np.array(w, dtype=f"U{size}")
        count, best = near_in_blocks(words, cols["n"], np.cumsum(edge), size, cols["lo"], cols["hi"])
        has = np.flatnonzero(best >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([w[r] for r in has], pa.string()), pa.array(count[has]), pa.array(cols["n"][best[has]]), pa.array([w[r] for r in best[has]], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    def joined(parts: list[dict]) -> dict:
        return {k: np.concatenate([p[k] for p in parts]) if k != "word" else list(chain.from_iterable(p[k] for p in parts)) for k in parts[0]} if len(parts) > 1 else parts[0]

    def cut(cols: dict, a: int, b: int) -> dict:
        return {k: v[a:b] for k, v in cols.items()}

    held: list[dict] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = {k: batch.column(k).to_numpy() for k in names} | {"word": batch.column("word").to_pylist()}
        held.append(cols)
        rows = sum(len(p["word"]) for p in held)
        if rows < ROWS and rows * int(cols["size"].max()) < CELLS and held[0]["size"][0] == cols["size"][-1]:
            continue
        cols = joined(held)
        edge = np.zeros(rows, bool)
        for name in _BLOCK:
            edge[1:] |= cols[name][1:] != cols[name][:-1]
        edges, begin, taken = np.flatnonzero(edge), 0, 0
        for k, e in enumerate(edges):  # [begin, e) are whole blocks of one size
            after = edges[k + 1] if k + 1 < len(edges) else rows
            if cols["size"][e] != cols["size"][begin] or after - begin > ROWS or (after - begin) * int(cols["size"][begin]) > CELLS:
                yield solve(cut(cols, begin, e))
                begin = taken = int(e)
        held = [cut(cols, taken, rows)]
    if held and held[0]["word"]:
        yield solve(joined(held))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, size, lo, hi) with the key of their block: what stands before and after the range."""
    after = F.expr("substr(word, char_length(word) - (size - hi) + 1)")
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", F.expr("substr(word, 1, lo)"), after))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """``words`` (word, n, staged) in each of their blocks, of which those of several positions have at most ``most`` words."""
    long = F.char_length("word")
    rows = words.where(long > 0).select("word", "n", F.explode(F.array(long, long + 1)).alias("size"))
    rows, done = _halved(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("size"))), []
    while True:
        full = stage(rows.groupBy(*_BLOCK).agg(F.count("*").alias("rows")).where(f"rows > {most} AND hi - lo > 1").select(*_BLOCK), "full")
        if full.isEmpty():
            done.append(rows)
            break
        full = maybe_broadcast(full)
        done.append(rows.join(full, _BLOCK, "left_anti").select(*rows.columns))
        rows = stage(_halved(rows.join(full, _BLOCK, "left_semi").drop("key")), "halved")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.expr("(lo + hi) div 2")
    ranges = F.array(F.struct(F.col("lo"), mid.cast("int").alias("hi")), F.struct(mid.cast("int").alias("lo"), F.col("hi")))
    rows = rows.select("word", "n", "size", F.explode(ranges).alias("x")).where("x.lo < x.hi")
    return _keyed(rows.select("word", "n", "size", "x.lo", "x.hi"))


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word, the smallest of equals) for ``words`` (word, n, staged) that have a near one."""
    tune(words.sparkSession)
    rows = blocks(words, most).repartition("size", "lo", "key").sortWithinPartitions(*_BLOCK)
    found = rows.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("x"))
    return found.select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to; each round doubles the way that is done."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # few words are another's form and have one themselves
        ends = roots.select("root").distinct()
        hop = stage(roots.select(F.col("word").alias("at"), F.col("root").alias("next")).join(ends, F.col("at") == F.col("root"), "left_semi"), "hop")
        if hop.isEmpty():
            return roots
        roots = roots.join(maybe_broadcast(hop), F.col("root") == F.col("at"), "left")
        roots = stage(roots.select("word", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(words: DataFrame, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of distinct ``words`` (word, n): the form is the most frequent near word if that is ``ratio`` times as frequent."""
    words = stage(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = words.join(near_words(words, most), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = stage(found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "found")
    roots = follow(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """``group_variants`` of the words of ``docs`` (doc_id, text) that occur at least ``least`` times."""
    return group_variants(count_words(docs, shortest).where(F.col("n") >= least), ratio)
