"""Substring deduplication over suffixes: every byte in a repeated string of ``LENGTH`` bytes goes.

Leading tokens. In each string of LENGTH bytes the gram of ``GRAM`` bytes with
the smallest hash (the leftmost of equal ones) is its token: equal strings have
it at the same place, so that only strings with a token in common can be
equal, and a token serves about ``STARTS`` / 2 neighbouring starts. A token
with the starts it serves and the bytes around it, from the first start to the
end of the last string, is a context. Contexts are counted by token and by
fingerprint (128 bits, as whole texts are): what lies around a token that
occurs once can't repeat and is left where it is, contexts that occur twice
repeat each other in all their starts and are settled, and one of them stands
for all. Only tokens with two or more different contexts are left.

Order. These contexts are range-partitioned by token with the splitters that
Spark samples. A bucket sorts them as suffixes from the token on, and as
reversed prefixes before it, by multikey quicksort over words of eight bytes
(each round splits what is still tied by the next word), and the longest
common prefixes of neighbours divide each order into classes for each distance
of a start from its token. Two strings are equal if both their classes are:
bytes are compared, not hashes.

Boundaries. A token is never split over buckets. One with more than ``HOT``
different contexts is dealt anew by more of what surrounds it: starts at
distances 0-15, 16-31 ... from the token make narrower contexts, whose leading
token is all that their strings have in common; what is still as frequent is
cut to single strings, which counting settles. So nothing is compared in pairs
and no task takes more than a bounded part of a token, however frequent.

Equal texts are one class: of two or more with LENGTH bytes or more all bytes
go, and one of them stands for all in the index. Texts are told apart by md5.

Defined cases: null text is empty; texts shorter than LENGTH never lose a
byte; a null or repeated doc_id is a row of its own like any other; columns
other than doc_id and text are ignored. Bytes are cut wherever a repeat ends,
also within a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage, tune
from .textvec import _CHUNK, buffers, mix

LENGTH, STARTS = 400, 256
GRAM = LENGTH - STARTS + 1
#: Starts of a context at each level: those of a token, then of narrower windows of a frequent one.
WIDTHS = (STARTS, 16, 1)
#: Contexts of a bucket, about, of a local sort, and the different ones from which a token is dealt anew.
BUCKET, SLAB, HOT = 20_000, 2048, 2048
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Half of a 64-bit word orders grams by hash, half says where they stand.
_POS = np.uint64((1 << 32) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the bytes' polynomial, and the inverse powers: a gram's hash takes two of each."""
    n = len(data) + 1
    size = 1 << max(19, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_P, size), _powers(_INV, size)
    up, down = _tables[size]
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=total[1:])
    return total, down[:n]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(token, place of the token, first start, last start, document) for each run of starts with one token."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    total, down = prefix(data)
    with np.errstate(over="ignore"):
        gram = mix((total[GRAM:] - total[: n - GRAM + 1]) * down[: n - GRAM + 1])
    at = np.arange(len(gram), dtype=np.uint64)
    low = (_window_min((gram & ~_POS) | at, STARTS) & _POS).astype(np.int64)
    size = np.diff(offsets)
    valid = np.zeros(n + 1, np.int64)
    long = size >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(low)] > 0)
    if not len(start):
        return none.astype(np.uint64), none, none, none, none
    place = low[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return gram[place[first]], place[first], start[first], start[last], np.searchsorted(offsets, start[first], "right") - 1


def _sliced(column):
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 2 * _CHUNK, "right")) - 1)
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, part, off
        i = j


#: A context: its token, fingerprint, text, first start, the token's place in it and its number of starts. One without a token is a settled span.
_CONTEXT = "g long, h binary, rid binary, a int, place int, starts int"


def _contexts(batches):
    """The contexts of all texts; of equal ones in a slice the first with a token, their spans settled."""
    for batch in batches:
        for i, data, offsets in _sliced(batch.column("text")):
            token, place, a, z, doc = anchors(data, offsets)
            raw, n = data.tobytes(), len(token)
            prints = [hashlib.md5(raw[p:q]).digest() for p, q in zip(a.tolist(), (z + LENGTH).tolist(), strict=True)]
            seen: dict[tuple, int] = {}
            first = np.fromiter((seen.setdefault(k, j) for j, k in enumerate(zip(prints, token.tolist(), (place - a).tolist(), strict=True))), np.int64, n)
            own = np.flatnonzero(np.bincount(first, minlength=n)[first] > 1 if n else [])
            begin = offsets[doc]
            new = np.ones(len(own), bool)  # overlapping settled spans of a text become one
            new[1:] = (doc[own][1:] != doc[own][:-1]) | (a[own][1:] > z[own][:-1] + LENGTH)
            head, tail = own[new], own[np.concatenate([np.flatnonzero(new)[1:], [len(own)]]).astype(int) - 1] if len(own) else own
            kept = np.flatnonzero(first == np.arange(n))
            row = np.concatenate([kept, head])
            starts = np.concatenate([z[kept] - a[kept], z[tail] - a[head]]) + 1
            settled = np.arange(len(row)) >= len(kept)
            columns = [
                pa.array(token[row].view(np.int64), mask=settled),
                pa.array([prints[j] for j in kept.tolist()] + [None] * len(head), pa.binary()),
                batch.column("rid").take(pa.array(doc[row] + i)),
                *(pa.array(x.astype(np.int32)) for x in ((a - begin)[row], (place - a)[row], starts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "h", "rid", "a", "place", "starts"])


def _fetched(batches):
    """The bytes of the contexts listed with each text."""
    for batch in batches:
        for text, rid, some in zip(batch.column("text").to_pylist(), batch.column("rid").to_pylist(), batch.column("some").to_pylist(), strict=True):
            raw = text.encode()
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                columns = [pa.array([x[c] for x in part], pa.int64() if c == "g" else pa.int32()) for c in ("g", "a", "place", "starts")]
                bytes_ = pa.array([raw[x["a"] : x["a"] + x["starts"] - 1 + LENGTH] for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([rid] * len(part), pa.binary()), *columns[1:], bytes_], names=["g", "rid", "a", "place", "starts", "context"])


def multikey_order(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order of byte strings (rows of one width) within groups: what is tied is split by its next eight bytes, round by round."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    tied = np.concatenate([[0], np.cumsum(group[order][1:] != group[order][:-1])]) if n else np.zeros(0, np.int64)
    for k in range(words.shape[1]):
        at = np.flatnonzero(np.bincount(tied, minlength=n)[tied] > 1) if n else []
        if not len(at):
            break
        word = words[order[at], k]
        way = np.lexsort((word, tied[at]))
        order[at], word = order[at][way], word[way]
        new = np.zeros(n, np.int64)
        new[at[1:]] = (tied[at[1:]] == tied[at[:-1]]) & (word[1:] != word[:-1])
        tied = tied + np.cumsum(new)
    return order


def _classes(group: np.ndarray, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row and each of the lengths ``least`` the class of rows of its group that begin with the same bytes."""
    order = multikey_order(group, rows)
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    out = np.zeros((len(rows), len(least)), np.int64)
    out[order[1:]] = np.cumsum(common[:, None] < least, axis=0)
    return out


def _runs(flags: np.ndarray):
    """(row, first, last) of the runs of true values in each row."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def repeats(g: np.ndarray, place: np.ndarray, starts: np.ndarray, contexts: list[bytes], width: int):
    """(context, first start, last start) of the runs of starts whose strings stand in another context of the token, too."""
    n = len(contexts)
    m = np.zeros((n, width + LENGTH), np.uint8)
    column = width - 1 - place
    for i, c in enumerate(contexts):
        m[i, column[i] : column[i] + len(c)] = np.frombuffer(c, np.uint8)
    back = np.arange(width - 1, -1, -1)  # the distance to the token of the start in each column
    ahead = _classes(g, m[:, width - 1 :], LENGTH - back)
    behind = _classes(g, m[:, width - 2 :: -1] if width > 1 else np.zeros((n, 1), np.uint8), back)
    j = np.arange(width)
    real = (j >= column[:, None]) & (j < (column + starts)[:, None])
    key = np.where(real, ahead * n + behind, -1 - np.arange(n)[:, None]).T
    order = np.argsort(key, axis=1)
    ranked = np.take_along_axis(key, order, axis=1)
    same = np.zeros((width, n + 1), bool)
    same[:, 1:-1] = ranked[:, 1:] == ranked[:, :-1]
    twice = np.zeros((width, n), bool)
    np.put_along_axis(twice, order, same[:, 1:] | same[:, :-1], axis=1)
    row, first, last = _runs(twice.T)
    return row, first - column[row], last - column[row]


def _bucket(width: int):
    """Slabs of whole tokens of a bucket, which comes sorted by token."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 2 * SLAB:
                table = pa.Table.from_batches(held)
                g = table["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1], "left"))
                if cut:
                    yield from slabs(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), len(g) - cut
        if size:
            yield from slabs(pa.Table.from_batches(held))

    def slabs(table: pa.Table):
        g, begin = table["g"].to_numpy(), 0
        while begin < len(g):
            end = int(np.searchsorted(g, g[min(begin + SLAB, len(g)) - 1], "right"))
            part = table.slice(begin, end - begin)
            own, place, starts, a = (part[c].to_numpy() for c in ("g", "place", "starts", "a"))
            row, first, last = repeats(own, place, starts, part["context"].to_pylist(), width)
            yield pa.RecordBatch.from_arrays([part["rid"].combine_chunks().take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (a[row] + first, a[row] + last + LENGTH))], names=["rid", "a", "z"])
            begin = end

    return run


def _narrower(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts cut to windows of ``width`` distances from the token; the new token is what all strings of a window share."""
    low, high = f"greatest(w * {width}, place - starts + 1)", f"least(w * {width} + {width - 1}, place)"
    windows = F.explode(F.expr(f"sequence(cast(floor((place - starts + 1) / {width}) as int), cast(floor(place / {width}) as int))")).alias("w")
    cut = contexts.select("g", "rid", "a", "place", "starts", "context", windows).select("*", F.expr(f"place - {high}").alias("s"), F.expr(f"{high} - {low} + 1").alias("n"))
    core = F.expr(f"substring(context, place - w * {width} + 1, {LENGTH - width + 1})")
    return cut.select(
        F.xxhash64("g", "w", core).alias("g"),
        F.unhex(F.md5(F.expr(f"substring(context, s + 1, n - 1 + {LENGTH})"))).alias("h"),
        "rid",
        (F.col("a") + F.col("s")).alias("a"),
        F.expr(f"place - w * {width} - s").alias("place"),
        F.col("n").alias("starts"),
    )


def _bytes(contexts: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``contexts`` with the bytes of their texts."""
    lists = stage(contexts.groupBy("rid").agg(F.collect_list(F.struct("g", "a", "place", "starts")).alias("some")).join(classes.select("rid", F.col("doc_id").alias("one")), "rid"), "lists")
    some = texts.join(maybe_broadcast(lists.select("rid", "one")), "rid").where("doc_id <=> one").select("rid", "text")
    return some.join(lists.select("rid", "some"), "rid").mapInArrow(_fetched, "g long, rid binary, a int, place int, starts int, context binary")


def repeated_spans(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid, a, z) of bytes in repeated strings, which may overlap, of the texts (doc_id, rid, text); one, of the smallest doc_id, stands for each of ``classes`` (rid, doc_id, n)."""
    span = lambda df: df.select("rid", "a", (F.col("a") + F.col("starts") - 1 + LENGTH).alias("z"))
    copies = stage(classes.where("n > 1").select("rid", F.col("doc_id").alias("one"), F.lit(True).alias("copy")), "copies")
    one = texts.join(maybe_broadcast(copies), "rid", "left").where("copy IS NULL OR doc_id <=> one").select("rid", "text")
    rows = stage(one.mapInArrow(_contexts, _CONTEXT), "contexts")
    out = span(rows.where("g IS NULL"))
    for level, width in enumerate(WIDTHS):
        met = stage(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1 AND g IS NOT NULL").select("g"), "met")
        rows = stage(rows.join(met, "g", "left_semi"), "wanted")
        different = stage(rows.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(F.struct("rid", "a", "place", "starts")).alias("one")), "different")
        out = out.unionByName(span(rows.join(different.where("n > 1").select("g", "h"), ["g", "h"], "left_semi")))
        several = stage(different.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "several")
        left = stage(different.select("g", "one.*").join(several, "g"), "left")
        last = level == len(WIDTHS) - 1  # there a token is a string: different ones share it by a chance of hashes only
        cold = left if last else left.where(f"n <= {HOT}")
        count = cold.count()
        if count:
            contexts = stage(_bytes(cold, texts, classes), "bytes")
            parts = max(2, -(-count // BUCKET))
            bucket = contexts.repartitionByRange(parts, "g").sortWithinPartitions("g")
            out = out.unionByName(bucket.mapInArrow(_bucket(width), "rid binary, a int, z int"))
        hot = left.where(f"n > {HOT}")
        if last or hot.isEmpty():
            return out
        rows = stage(_narrower(_bytes(hot, texts, classes), WIDTHS[level + 1]), "narrower")
    return out


def _cut(batches):
    for batch in batches:
        removed, spans, digest = [], [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            raw, at, end, n, parts = (text or "").encode(), 0, -1, 0, []
            for c in sorted((c["a"], c["z"]) for c in cuts):
                if c[0] > end:
                    n += 1
                    parts.append(raw[at : c[0]])
                end = at = max(end, c[1])
            kept = b"".join([*parts, raw[at:]])
            removed.append(len(raw) - len(kept))
            spans.append(n)
            digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["rid", "removed", "spans", "sha"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("rid", F.unhex(F.md5(F.col("text").cast("binary"))))
    info = stage(texts.select("doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    classes = stage(info.where(F.col("n_bytes") >= LENGTH).groupBy("rid").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")), "classes")
    spans = repeated_spans(texts.where(F.octet_length("text") >= LENGTH), classes)
    cuts = stage(spans.groupBy("rid").agg(F.collect_set(F.struct("a", "z")).alias("cuts")).join(classes, "rid").where("n = 1"), "cuts")
    some = texts.join(maybe_broadcast(cuts.select("rid")), "rid", "left_semi").join(cuts.select("rid", "cuts"), "rid").select("rid", "text", "cuts")
    edited = some.mapInArrow(_cut, "rid binary, removed long, spans long, sha string")
    copies = classes.where("n > 1").select("rid", F.lit(None).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha"))
    changed = stage(edited.unionByName(copies), "changed").withColumnRenamed("sha", "new")
    out = info.join(changed, "rid", "left")
    gone = F.when(F.col("spans").isNull(), 0).otherwise(F.coalesce("removed", "n_bytes"))
    return out.select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("new", "sha").alias("kept_sha256"))
