"""Byte-level BPE with the ``tokenizers`` library over Arrow batches.

``encode`` adds ids and, for each token, the first and the end character of
the text it came from; ``decode`` turns ids back into bytes by reversing the
vocabulary's byte table, so that characters split over tokens come together
again, and ``decode_text`` into a string.

A text is cut where a single space stands between two characters that aren't
white space: there a token always begins, whatever the texts. The library
encodes each distinct piece once while a task remembers it, in a table that is
emptied when full; the new pieces of a batch go to the library in one call,
up to a hundred joined to a string (longer strings cost it more a word).
A batch is worked off in slices of bounded size, and decoding gets the bytes of
all tokens with the task, so that a worker's memory stays small beside the JVM's.

Defined cases: a null or empty text has no tokens; ids outside the vocabulary
are an error; special tokens' strings are ordinary text; null ids and null
lists of ids decode to empty bytes. Extra columns pass unless they bear the names of the results,
which then replace them.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces and characters that a task remembers before it begins anew (a batch may add to them), and the most that go to the library as one string.
REMEMBERED, MOST_CHARS, TOGETHER = 300_000, 8_000_000, 100
#: Characters, and tokens, that a worker takes in hand at once; a longer text goes alone.
SLICE_CHARS, SLICE_TOKENS = 1 << 18, 1 << 16


def byte_table() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: those that print stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + count[i] - 1 of all i in a row."""
    before = np.cumsum(count, dtype=np.int64) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def _slices(sizes, most: int):
    """Ranges of rows whose sizes add up to at most ``most``, or of one row."""
    i = held = 0
    for j, size in enumerate(sizes):
        if j > i and held + size > most:
            yield i, j
            i, held = j, 0
        held += size
    if len(sizes):
        yield i, len(sizes)


class _Numbers(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Pieces:
    """Ids and character offsets of pieces, each distinct one encoded once while it is remembered."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.index = _Numbers()
        self.held = 0  # characters
        self.chars, self.start, self.count, self.ids, self.first, self.end = (array("i") for _ in range(6))  # they grow in place

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in the tables; unknown ones are numbered as they come and encoded."""
        if len(self.index) > REMEMBERED or self.held > MOST_CHARS:
            self.forget()
        index = self.index
        at = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        if index.new:
            self._add(index.new)
            index.new = []
        return at

    def _add(self, new: list[str]) -> None:
        """Encodes pieces; a run goes on where a single space parts two characters that aren't white space."""
        joins = [q[:1] == " " and not (q[1:2].isspace() or p[-1].isspace()) and len(q) > 1 for p, q in pairwise(new)]
        begins = [0] + [i for i, joined in enumerate(joins, 1) if not joined or i % TOGETHER == 0]
        runs = ["".join(new[i:j]) for i, j in pairwise([*begins, len(new)])]
        found = self.tokenizer.encode_batch(runs, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64).reshape(-1, 2)
        chars = np.fromiter(map(len, new), np.int64, len(new))
        start = np.cumsum(chars) - chars  # of the pieces, all runs in a row
        spans += np.repeat(start[begins], np.fromiter(map(len, found), np.int64, len(found)))[:, None]
        owner = np.searchsorted(start, spans[:, 0], "right") - 1
        spans -= start[owner][:, None]
        count = np.bincount(owner, minlength=len(new))
        first = len(self.ids) + np.cumsum(count) - count
        for name, more in (("chars", chars), ("start", first), ("count", count), ("ids", ids), ("first", spans[:, 0]), ("end", spans[:, 1])):
            getattr(self, name).frombytes(more.astype(np.int32).tobytes())
        self.held += int(chars.sum())

    def taken(self, name: str, at: np.ndarray) -> np.ndarray:
        """Entries of one of the tables."""
        return np.asarray(getattr(self, name))[at]


_pieces: dict[str, Pieces] = {}


def _encoded(path: str):
    def run(batches):
        pieces = _pieces.get(path) or _pieces.setdefault(path, Pieces(load(path)))  # a worker's later tasks go on with it
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in _slices([len(t) for t in texts], SLICE_CHARS):
                cut = [_CUT.split(t) if t else [] for t in texts[i:j]]
                unit = pieces.numbers(list(chain.from_iterable(cut)))
                parts = np.cumsum([0] + [len(x) for x in cut])
                chars, count = pieces.taken("chars", unit), pieces.taken("count", unit).astype(np.int64)
                base = np.concatenate([[0], np.cumsum(chars)])
                base = base[:-1] - np.repeat(base[parts[:-1]], np.diff(parts))
                at, base = _spread(pieces.taken("start", unit), count), np.repeat(base, count)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)])[parts].astype(np.int32))
                found = (pieces.taken("ids", at), pieces.taken("first", at) + base, pieces.taken("end", at) + base)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in found]
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*lists, *rest.columns[1:]], names=["ids", "first", "end", *batch.schema.names[1:]])

    return run


def pieces_of_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens by their ids in a row, and how many each has; the last entry, empty, is for null ids."""
    back = byte_table()
    vocabulary = load(path).get_vocab()
    piece = [b""] * (max(vocabulary.values()) + 2)
    for token, i in vocabulary.items():
        piece[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return np.frombuffer(b"".join(piece), np.uint8), np.array([len(x) for x in piece], np.int32)


def _decoded(path: str):
    table, size = pieces_of_bytes(path)  # half a megabyte goes to the tasks, which need no tokenizer then

    def run(batches):
        start = np.cumsum(size) - size
        for whole in batches:
            if whole.column(0).null_count:
                whole = pa.RecordBatch.from_arrays([pc.fill_null(whole.column(0), []), *whole.columns[1:]], names=whole.schema.names)
            for i, j in _slices(pc.list_value_length(whole.column(0)).to_pylist(), SLICE_TOKENS):
                batch = whole.slice(i, j - i)
                lists = batch.column(0)
                ids = lists.flatten()
                known = ids.drop_null().to_numpy()
                if len(known) and not 0 <= known.min() <= known.max() < len(size) - 1:
                    raise ValueError("an id lies outside the vocabulary")
                ids = ids.fill_null(len(size) - 1).to_numpy()
                tokens = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                data = table[_spread(start[ids], size[ids])]
                offsets = np.concatenate([[0], np.cumsum(size[ids], dtype=np.int64)])[tokens]
                out = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([out, *batch.columns[1:]], names=["bytes", *batch.schema.names[1:]])

    return run


def _typed(df: DataFrame, new: list[T.StructField], taken: str) -> T.StructType:
    names = {f.name for f in new} | {taken}
    return T.StructType(new + [f for f in df.schema.fields if f.name not in names])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ids, first and end (arrays of int, one entry a token)."""
    tune(docs.sparkSession)
    schema = _typed(docs, [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "first", "end")], text)
    return docs.select(F.col(text).cast("string").alias(text), *schema.names[3:]).mapInArrow(_encoded(path), schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` without ``ids``, with the decoded bytes."""
    tune(tokens.sparkSession)
    schema = _typed(tokens, [T.StructField("bytes", T.BinaryType())], ids)
    return tokens.select(ids, *schema.names[1:]).mapInArrow(_decoded(path), schema)


def decode_text(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """As ``decode``, the bytes as a string; bytes that are no UTF-8 become U+FFFD."""
    return decode(tokens, path, ids).withColumn("text", F.decode("bytes", "utf-8")).drop("bytes")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_split (tokens that end within a character), ids_sha256 and decoded_sha256 of each row."""
    coded = encode(docs.select("doc_id", "text"), path)
    coded = coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.expr("cast(aggregate(sequence(1, greatest(size(ids) - 1, 1)), 0, (n, i) -> n + if(try_element_at(first, i + 1) < try_element_at(end, i), 1, 0)) as long)").alias("n_split"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
    )
    return decode(coded, path).select("doc_id", "n_tokens", "n_split", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
