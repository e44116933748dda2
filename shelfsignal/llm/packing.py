"""Best-fit packing of documents into sequences of a fixed length, with swap-based local search.

Documents are tokenised in Arrow batches; each distinct word goes to the
library once while a task remembers it (this vocabulary drops white space, so
words between spaces stand alone). What leaves the tasks are pieces: place,
length and checksum, not ids. They are written once.

A piece of full length is a sequence. The others are dealt by hash into groups
of about ``GROUP`` pieces; each is packed by best fit, longest first, and then
searched: the emptiest underfull bin gives to others by moving a piece, by
exchanging one piece for one, two for one or one for two, as long as the sum of
squared fills grows; the exchange that raises it most is made. So full bins
get fuller and empty ones empty, until the bins are as few as their tokens
allow or no exchange helps. In the next round the bins that are not full are
dealt anew, whole, into fewer groups, whose search goes on from them or packs
them anew, whichever needs fewer. Rounds end when the open bins are as few as
their tokens allow, when a round saves none, or when one group has held them
all.

A task holds one group; the driver sees counts only.

Defined cases: null and empty texts are one token, the separator; repeated
rows and ids are packed each for itself; a null doc_id stays null; an empty
table gives no rows. Texts of any length are tokenised in spans of ``SPAN``
characters, cut at spaces. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import stage, tune

LENGTH, SEPARATOR = 2048, 0
#: Pieces of a group, rounds at most, and steps that a group's search tries in a round at most.
GROUP, ROUNDS, STEPS = 8192, 5, 4000
#: Distinct lengths of a bin up to which its pairs are looked at.
PAIRED = 48
#: Words and characters that a task remembers, words that go to the library as one string, characters of a span.
REMEMBERED, MOST_CHARS, TOGETHER, SPAN = 500_000, 16_000_000, 3000, 2_000_000


#: ASCII signs but the apostrophe: words between spaces that are letters within such signs are cut there by the pattern of this vocabulary.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Words:
    """The ids of words between spaces: of the signs and letters of plain ones, of others as they stand; each part is encoded once while it is remembered."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.chars = 0
        self.start, self.count, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """ASCII letters (lower-cased) and signs go to the library's model, all else through all its steps, ``TOGETHER`` words as one string."""
        plain = [w for w in new if w.isascii() and (w.isalpha() or not any(map(str.isalnum, w)) and "'" not in w and w.isprintable())]
        there = set(plain)
        other = [w for w in new if w not in there]
        ids = [[t.id for t in self.model.tokenize(w)] for w in plain]
        counts, all_ids = [np.fromiter(map(len, ids), np.int64, len(ids))], [np.fromiter(chain.from_iterable(ids), np.int64)]
        runs = [other[i : i + TOGETHER] for i in range(0, len(other), TOGETHER)]
        for run, e in zip(runs, self.tokenizer.encode_batch([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            size = np.fromiter(map(len, run), np.int64, len(run)) + 1
            first = np.array([a for a, _ in e.offsets], np.int64)
            counts.append(np.diff(np.searchsorted(first, np.cumsum(size)), prepend=0))
            all_ids.append(np.array(e.ids, np.int64))
        self.index.update(zip(plain + other, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        count = np.concatenate(counts)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, *all_ids])

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.index]
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        if len(self.index) > REMEMBERED or self.chars > MOST_CHARS:
            self.forget()
        coded = words.dictionary_encode()
        whole = coded.dictionary
        core = pc.ascii_trim(whole, _SIGNS)
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        parts = np.zeros((len(whole), 3), np.int64)
        parts[:, 1] = self._numbers(pc.if_else(pa.array(plain), pc.ascii_lower(core), whole))
        signs = np.flatnonzero(plain & pc.not_equal(pc.binary_length(core), pc.binary_length(whole)).to_numpy(zero_copy_only=False))
        if len(signs):
            some = pa.array(signs)
            cut = [w.partition(c) for w, c in zip(*(x.take(some).to_numpy(zero_copy_only=False).tolist() for x in (whole, core)), strict=True)]
            parts[signs, 0], parts[signs, 2] = self._numbers(pa.array([x for x, _, _ in cut], pa.string())), self._numbers(pa.array([x for _, _, x in cut], pa.string()))
        parts = parts[coded.indices.to_numpy()].ravel()
        count = self.count[parts]
        before = np.cumsum(count) - count
        return self.ids[np.repeat(self.start[parts] - before, count) + np.arange(int(count.sum()))], count.reshape(-1, 3).sum(axis=1)


def spans(text: str):
    """``text`` in parts of about ``SPAN`` characters, cut at spaces, which go."""
    at = 0
    while len(text) - at > SPAN and (cut := text.find(" ", at + SPAN)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


_words: dict[str, Words] = {}


def _pieces(path: str, length: int, separator: int):
    def encoded(words: Words, texts: pa.Array) -> list[np.ndarray]:
        """The ids of some texts, encoded together."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ids, count = words.encode(cut.flatten())
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        return np.split(ids.astype("<u4"), np.concatenate([[0], np.cumsum(count)])[ends[:-1]])

    def run(batches):
        words = _words.get(path) or _words.setdefault(path, Words(load(path)))  # a worker's later tasks go on with it
        key = TaskContext.get().partitionId() << 36
        end = np.array([separator], "<u4")
        for batch in batches:
            if not len(batch):
                continue
            texts = pc.fill_null(batch.column("text"), "")
            size = np.maximum(1, pc.binary_length(texts).to_numpy().astype(np.int64))
            slices = np.flatnonzero(np.diff(np.cumsum(size) // SPAN, prepend=-1))  # rows with which slices of about SPAN bytes begin
            out, lists = [], []
            for a, b in zip(slices, [*slices[1:], len(batch)], strict=True):
                if b - a == 1 and size[a] > SPAN:
                    lists.append(np.concatenate([encoded(words, pa.array([s]))[0] for s in spans(texts[int(a)].as_py())]))
                else:
                    lists += encoded(words, texts.slice(a, b - a))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), lists, strict=True):
                data = np.concatenate([ids, end])
                for piece in range(-(-len(data) // length)):
                    part = data[piece * length : (piece + 1) * length]
                    out.append((key, doc, piece, piece * length, len(part), zlib.crc32(part)))
                    key += 1
            types = (pa.int64(), batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """key (any distinct number), doc_id, piece, start, length and ids_crc32 of the pieces of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, length, separator), f"key long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(size: np.ndarray, length: int) -> np.ndarray:
    """The bin of each piece: longest first, into the bin with the least room that holds it."""
    bins, room = np.empty(len(size), np.int64), [[] for _ in range(length + 1)]
    some, opened = 0, 0  # bit r of ``some``: there is a bin with room r
    for i in np.argsort(-size, kind="stable").tolist():
        need = int(size[i])
        fits = some >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, opened = length, opened, opened + 1
        bins[i] = b
        if r > need:
            room[r - need].append(b)
            some |= 1 << (r - need)
    return bins


class Search:
    """Bins that are not full, as lists of pieces, and the exchanges between them.

    What bins may give stands in one table (bin, tokens, pieces), rows of a bin
    that has changed are struck out and written anew at its end.
    """

    def __init__(self, size: np.ndarray, bins: np.ndarray, length: int):
        self.size, self.length = size, length
        self.fill = np.bincount(bins, weights=size).astype(np.int64)
        self.members: dict[int, list[int]] = {int(b): [] for b in np.flatnonzero((self.fill > 0) & (self.fill < length))}
        for i, b in enumerate(bins.tolist()):
            if b in self.members:
                self.members[b].append(i)
        self.offers = {b: self._offers(b) for b in self.members}
        self._tabulate()

    def _offers(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pieces) of what a bin may give for an exchange: nothing, one piece or two."""
        own = self.size[self.members[b]]
        size, often = np.unique(own, return_counts=True)
        if len(size) > PAIRED or len(own) < 2:
            pairs = size[:0]
        else:
            i, j = np.triu_indices(len(size), 1)
            pairs = np.unique(np.concatenate([size[i] + size[j], 2 * size[often > 1]]))
        return np.concatenate([[0], size, pairs]), np.repeat([0, 1, 2], [1, len(size), len(pairs)])

    def _tabulate(self) -> None:
        rows = {b: len(o[0]) for b, o in self.offers.items()}
        self.used = sum(rows.values())
        self.table = np.full((3, 2 * self.used + 4096), -1, np.int64)
        begin = 0
        self.place = {}
        for b, n in rows.items():
            self._write(b, begin)
            begin += n

    def _write(self, b: int, begin: int) -> None:
        tokens, count = self.offers[b]
        at = slice(begin, begin + len(tokens))
        self.table[0, at], self.table[1, at], self.table[2, at] = b, tokens, count
        self.place[b] = at

    def _changed(self, b: int) -> None:
        self.table[0, self.place.pop(b)] = -1
        if not 0 < self.fill[b] < self.length:
            del self.offers[b]
            return
        self.offers[b] = self._offers(b)
        n = len(self.offers[b][0])
        if self.used + n > self.table.shape[1]:
            self._tabulate()
        else:
            self._write(b, self.used)
            self.used += n

    def _taken(self, b: int, tokens: int, count: int) -> list[int]:
        """Pieces of a bin, ``count`` of them, with so many tokens."""
        own = self.members[b]
        if count == 0:
            return []
        if count == 1:
            return [next(i for i in own if self.size[i] == tokens)]
        seen: dict[int, int] = {}
        for i in own:
            if (other := seen.get(tokens - int(self.size[i]))) is not None:
                return [other, i]
            seen[int(self.size[i])] = i
        raise AssertionError("no such pair")

    def step(self, a: int) -> bool:
        """The best exchange by which bin ``a`` gives tokens to another one, if the sum of squares grows by one.

        For what another bin gives back, the more tokens it gets the better, so
        that for one or two pieces of ``a`` the largest that fits is the best.
        """
        of, back, n_back = self.table[:, : self.used]
        fill = self.fill[of]
        most, live = back + self.length - fill, (of >= 0) & (of != a)
        out, n_out = self.offers[a]
        best = (0, 0, 0, 0)
        for pieces_, allowed in ((1, 2), (2, 1)):
            mine = out[n_out == pieces_]
            if not len(mine):
                continue
            k = np.searchsorted(mine, most, "right") - 1
            moved = mine[k] - back
            gain = moved * (fill + moved - self.fill[a])
            gain[~live | (k < 0) | (moved <= 0) | (n_back > allowed)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (int(gain[at]), at, int(mine[k[at]]), pieces_)
        if not best[0]:
            return False
        _, at, tokens, pieces_ = best
        b = int(of[at])
        give, get = self._taken(a, tokens, pieces_), self._taken(b, int(back[at]), int(n_back[at]))
        moved = tokens - int(back[at])
        self.members[a] = [i for i in self.members[a] if i not in give] + get
        self.members[b] = [i for i in self.members[b] if i not in get] + give
        self.fill[a] -= moved
        self.fill[b] += moved
        for x in (a, b):
            self._changed(x)
        return True

    def bins(self) -> int:
        return int((self.fill > 0).sum())

    def run(self, least: int, steps: int) -> None:
        """Exchanges from the emptiest bins, pass after pass, until ``least`` bins are left in all, a pass helps none, or ``steps`` were tried."""
        left, some = self.bins(), True
        while some and left > least and steps > 0:
            some = False
            for a in sorted(self.offers, key=lambda b: (self.fill[b], b)):
                while a in self.offers and left > least and steps > 0:
                    steps -= 1
                    if not self.step(a):
                        break
                    some = True
                    left -= self.fill[a] == 0


def pack(size: np.ndarray, length: int, bins: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """The bin (0, 1, ..) of each piece: exchanges from ``bins``, if given; where their tokens would do with fewer, from best fit as well, whichever takes fewer."""
    best, least = None, -(-int(size.sum()) // length)
    for given in (True, False):
        if given and bins is None or best is not None and best.max() < least:
            continue
        begin = np.unique(bins, return_inverse=True)[1] if given else best_fit(size, length)
        search = Search(size, begin, length)
        search.run(least, steps)
        begin = begin.copy()
        for b, own in search.members.items():
            begin[own] = b
        begin = np.unique(begin, return_inverse=True)[1]
        if best is None or begin.max() < best.max():
            best = begin
    return best


def _packed(length: int, turn: int):
    def run(key, table):
        table = table.sort_by("key")
        size = table["length"].to_numpy()
        bins = pack(size, length, table["bin"].to_numpy() if turn else None)
        order = np.lexsort((-size, bins))
        begin = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        first = np.searchsorted(bins[order], np.arange(bins.max() + 1))
        offset = np.empty(len(size), np.int64)
        offset[order] = begin - begin[first][bins[order]]
        fill = np.bincount(bins, weights=size).astype(np.int64)[bins]
        number = (turn << 58) + (key[0].as_py() << 20) + bins
        for name, values in (("bin", number), ("offset", offset), ("fill", fill)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return table.drop(["g"])

    return run


def pack_pieces(found: DataFrame, length: int = LENGTH, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``found`` (key, length and more, staged) with bin, offset and fill: pieces of at most ``length`` in few bins of that length."""
    none = F.lit(None).cast("long")
    whole = found.where(F.col("length") == length).withColumns({"bin": -1 - F.col("key"), "offset": F.lit(0).cast("long"), "fill": F.col("length")})
    open_ = found.where(F.col("length") < length).withColumns({"bin": none, "offset": none, "fill": none})
    done, before = whole, None
    for turn in range(rounds):
        n = open_.count()
        if not n:
            break
        groups = -(-n // group)
        dealt = open_.withColumn("g", F.expr(f"pmod(xxhash64({'bin' if turn else 'key'}, {turn}), {groups}L)"))
        tasks = min(groups, max(1000, groups // 16))
        packed = dealt.repartition(tasks, "g").groupBy("g").applyInArrow(_packed(length, turn), open_.schema)
        packed = stage(packed, "packed")
        done, open_ = done.unionByName(packed.where(F.col("fill") == length)), packed.where(F.col("fill") < length)
        left = open_.agg(F.count_distinct("bin").alias("bins"), F.sum("length").alias("tokens")).first()
        if groups == 1 or left["bins"] * length < (left["tokens"] or 0) + length or (turn and left["bins"] + _full(packed, length) == before):
            break
        before = left["bins"]
    return done.unionByName(open_)


def _full(packed: DataFrame, length: int) -> int:
    """Bins that a round has filled."""
    return packed.where((F.col("fill") == length) & (F.col("offset") == 0)).count()


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of the pieces of ``docs`` (doc_id, text)."""
    packed = pack_pieces(stage(pieces(docs, path, length, separator), "pieces"), length)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
