"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): a set is thrown into ``COORDS``
bins round after round. In round i every element draws a bin and a value from
a hash of its own; a bin keeps the smallest value of the first round that hits
it. After as many rounds as there are bins, round ``COORDS + j`` throws every
element into bin j, so that every coordinate fills however small the set is.
Equal coordinates are as likely as the Jaccard similarity, with the
concentration of sampling without replacement; a large set needs few rounds.

``BANDS`` bands of ``ROWS`` coordinates make the candidate buckets: a pair at
similarity 0.85 shares no band with a chance of about 6e-9, one at 0.8 of
about 5e-6. Exact copies of a set are collapsed before. Buckets are worked off
with leaders, not with all pairs: a round compares the smallest members of a
bucket with the rest of it, on full sets; members that meanwhile are in one
component aren't compared again, and leaders leave the bucket after the round.
Pairs whose set sizes rule the similarity out aren't made, nor those whose
sketches do by their concentration bound: one bit of each coordinate makes a
signature, and a pair at the threshold differs in more bits than allowed with a
fiftieth of the chance that the bands miss it.
What is in mixed buckets after the first round moves to narrower ones: a
bucket for each of the rarest shingles of a text, so many of them that two
texts at the similarity must share one (prefix filtering, exact), early enough
for the overlap they need. So a bucket
of n near copies costs n comparisons, no bucket is capped, and no link that
joins two components is lost.

Defined cases: null or blank text has an empty set and links with nothing;
fewer than k words make one shingle; rows of one doc_id are one document (any
of its texts may link it); a null doc_id links with nothing, has a null
component and is kept. Extra columns are left out here.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, maybe_broadcast, stage, tune, unused
from .textvec import mix, shingle_sets

COORDS, ROWS = 240, 6
BANDS = COORDS // ROWS
#: Members of one leader that are compared in one run of rows.
RUN = 256
_SHIFT = np.uint64(55)
_EMPTY = np.uint64(2**64 - 1)


def sketch(value: np.ndarray, doc: np.ndarray, rows: int, coords: int = COORDS) -> np.ndarray:
    """Sketches (rows x coords) of sets given as (element hash, row); a row without elements stays at the maximum."""
    out = np.full(rows * coords, _EMPTY, np.uint64)
    at = doc.astype(np.int64) * coords
    with np.errstate(over="ignore"):
        for i in range(2 * coords):
            if not len(value):
                break
            h = mix(value + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
            bins = ((h >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64) if i < coords else i - coords
            np.minimum.at(out, at + bins, (np.uint64(i) << _SHIFT) | (mix(h) >> np.uint64(9)))
            open_ = (out.reshape(rows, coords) == _EMPTY).any(axis=1)[at // coords]
            if not open_.all():
                value, at = value[open_], at[open_]
    return out.reshape(rows, coords)


def band_hashes(sketches: np.ndarray, rows_per_band: int = ROWS) -> np.ndarray:
    n, coords = sketches.shape
    acc = np.arange(coords // rows_per_band, dtype=np.uint64)[None, :] + np.zeros((n, 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows_per_band):
            acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + sketches[:, i::rows_per_band])
    return acc


def signature(sketches: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, in four 64-bit words."""
    bits = np.zeros((len(sketches), 256), np.uint8)
    bits[:, : sketches.shape[1]] = sketches & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.uint64)


def missed(percent: int) -> float:
    """The chance that sets at ``percent`` similarity share no band."""
    return (1 - (percent / 100) ** ROWS) ** BANDS


def most_different(percent: int) -> int:
    """Bits in which signatures of sets at ``percent`` similarity may differ: more of them have a fiftieth of the chance of ``missed`` at most (binomial tail)."""
    p, bits, tail = (1 - percent / 100) / 2, COORDS, 0.0
    while bits > 0:
        tail += comb(COORDS, bits) * p**bits * (1 - p) ** (COORDS - bits)
        if tail > missed(percent) / 50:
            break
        bits -= 1
    return bits


def _sketched(k: int):
    def run(batches):
        for batch in batches:
            for i, rows, value, doc in shingle_sets(batch.column("text"), k):
                with np.errstate(over="ignore"):
                    a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                    np.add.at(a, doc, mix(value))
                    np.add.at(b, doc, mix(value ^ np.uint64(0xA5A5A5A5DEADBEEF)))
                coords = sketch(value, doc, rows)
                bands, bits = band_hashes(coords).view(np.int64), signature(coords).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, rows),
                        pa.array(np.bincount(doc, minlength=rows).astype(np.int64)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, rows * 4 + 1, 4, dtype=np.int32)), pa.array(bits.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "bits"],
                )

    return run


def _confirmed(k: int, percent: int):
    """Rows come sorted by (lead, run, role): the leader's texts first, then the members'."""

    def run(batches):
        key, leaders = None, []
        for batch in batches:
            lead, part, role, ids = (batch.column(c).to_pylist() for c in ("lead", "run", "role", "id"))
            out = []
            for i, rows, value, doc in shingle_sets(batch.column("text"), k):
                ends = np.searchsorted(doc, np.arange(rows + 1))
                for r in range(rows):
                    own, n = value[ends[r] : ends[r + 1]], i + r
                    if (lead[n], part[n]) != key:
                        key, leaders = (lead[n], part[n]), []
                    if role[n] == 0:
                        leaders.append(own.copy())
                        continue
                    for x in leaders:
                        small, large = (own, x) if len(own) < len(x) else (x, own)
                        if 100 * len(small) < percent * len(large) or not len(small):
                            continue
                        pos = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[pos] == small).sum())
                        if 100 * both >= percent * (len(own) + len(x) - both):
                            out.append((lead[n], ids[n]))
                            break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    return run


def confirm_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (lead, id) whose full shingle sets reach ``percent``; a leader with many members is split into runs."""
    n = pairs.groupBy("lead").agg(F.count("*").alias("n"))
    runs = stage(pairs.join(n, "lead").select("lead", F.expr(f"pmod(xxhash64(id), ceil(n / {RUN}D))").cast("int").alias("run"), "id"), "runs")
    members = runs.withColumn("role", F.lit(1)).join(texts, F.col("id") == F.col("doc_id"))
    leaders = runs.select("lead", "run").distinct().select("lead", "run", F.col("lead").alias("id"), F.lit(0).alias("role")).join(texts, F.col("id") == F.col("doc_id"))
    rows = members.select("lead", "run", "role", "id", "text").unionByName(leaders.select("lead", "run", "role", "id", "text"))
    rows = rows.repartition("lead", "run").sortWithinPartitions("lead", "run", "role", "id")
    return rows.mapInArrow(_confirmed(k, percent), "u long, v long").distinct()


def _elements(k: int):
    def run(batches):
        for batch in batches:
            for i, rows, value, doc in shingle_sets(batch.column("text"), k):
                size, text = np.bincount(doc, minlength=rows), np.zeros(rows, np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(text, doc, mix(value))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc + i)), pa.array(text[doc].view(np.int64)), pa.array(size[doc].astype(np.int64)), pa.array(value.view(np.int64))], names=["id", "text", "size", "h"]
                )

    return run


def rare_elements(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(h, id, r): the rarest shingles of each text, so many that two sets at ``percent`` similarity share one of them, and their places by rarity."""
    rows = stage(texts.mapInArrow(_elements(k), "id long, text long, size long, h long"), "elements")
    often = stage(rows.groupBy("h").agg(F.count("*").alias("often")), "often")
    order = Window.partitionBy("id", "text").orderBy("often", "h")
    ranked = rows.join(often, "h").withColumn("r", F.row_number().over(order))
    return ranked.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).groupBy("h", "id").agg(F.min("r").alias("r"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (u, v): only the old roots that they join are looked at."""
    for end in ("u", "v"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    more = stage(connected_components(links.where("u <> v")), "more")
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return stage(moved.unionByName(more), "roots")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(docs.mapInArrow(_sketched(k), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, bits array<long>"), "sets")
    live = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(live.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = live.join(classes.withColumnRenamed("rep", "doc_id"), ["f1", "f2", "doc_id"]).select(F.col("doc_id").alias("id"), F.explode("bands").alias("h"))
    buckets = stage(reps.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h"), "buckets")
    left = stage(reps.join(buckets, "h", "left_semi").distinct(), "members")
    involved = stage(left.select("id").union(live.groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).where("a <> b").select("doc_id")).distinct(), "involved")
    texts = stage(docs.join(maybe_broadcast(involved), F.col("id") == F.col("doc_id"), "left_semi"), "texts")
    # one doc_id with several texts joins their classes
    links = live.join(classes, ["f1", "f2"]).where("rep <> doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    tested, leaders, rare = None, 1, False
    roots = stage(connected_components(stage(links.distinct(), "links")), "roots")
    size = live.join(left.select("id").distinct(), F.col("id") == F.col("doc_id")).groupBy("id").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("bits").alias("bits"), F.count_distinct("f1").alias("texts"))
    size = stage(size.select("id", "low", "high", "texts", *(F.col("bits")[i].alias(f"s{i}") for i in range(4))), "sizes")
    left = left.join(size, "id").withColumn("r", F.lit(0))
    near = f"{percent} * low <= 100 * lead_high AND {percent} * lead_low <= 100 * high"
    differ = " + ".join(f"bit_count(s{i} ^ lead_s{i})" for i in range(4))
    near = f"{near} AND ({differ} <= {most_different(percent)} OR texts > 1 OR lead_texts > 1)"
    # the first shingle that two sets share leaves no more overlap than what follows it in either
    enough = f"(100 + {percent}) * (1 + least(low - r, lead_low - lead_r)) >= {percent} * (low + lead_low)"
    near = f"{near} AND (r = 0 OR {enough} OR texts > 1 OR lead_texts > 1)"
    facts = ["r", "low", "high", "texts", "s0", "s1", "s2", "s3"]
    while True:
        mine = left.join(roots, left.id == roots.node, "left").select("h", "id", F.coalesce("root", "id").alias("root"), *facts)
        mixed = mine.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h")
        left = stage(mine.join(mixed, "h", "left_semi"), "left")
        if left.isEmpty():
            break
        if tested is not None and not rare:
            ids, rare = stage(left.select("id").distinct(), "ids"), True
            some = texts.join(maybe_broadcast(ids), F.col("id") == F.col("doc_id"), "left_semi")
            left = stage(rare_elements(some, k, percent).join(size, "id"), "rare")
            continue
        lead = left.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= leaders).select("h", F.col("id").alias("lead"), *(F.col(c).alias(f"lead_{c}") for c in ["root", *facts]))
        lead = stage(lead, "lead")
        near_by = F.expr(f"left.h = lead.h AND id > lead AND root <> lead_root AND {near}")
        pairs = left.alias("left").join(lead.alias("lead"), near_by).select("lead", "id").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["lead", "id"], "left_anti")
        pairs = stage(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        new = stage(confirm_pairs(pairs, texts, k, percent), "confirmed")
        if not new.isEmpty():
            roots = joined(roots, new)
        left = left.join(lead.select("h", F.col("lead").alias("id")), ["h", "id"], "left_anti").select("h", "id", *facts)
        leaders *= 32
    roots = stage(classes.join(roots, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("root", "rep").alias("root")), "roots")
    out = sets.join(roots, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; of rows with one doc_id (null too) and one text one stays."""
    one, twice = unused(docs, "gone"), unused(docs, "again")
    gone = stage(near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias(one)), "gone")
    out = docs.join(maybe_broadcast(gone), F.col("doc_id") == F.col(one), "left_anti")
    key = F.xxhash64("doc_id", "text")
    again = stage(out.groupBy(key.alias(twice)).agg(F.count("*").alias("n")).where("n > 1").select(twice), "again")
    if again.isEmpty():
        return out
    again = maybe_broadcast(again)
    once = out.join(again, key == F.col(twice), "left_anti")
    return once.unionByName(out.join(again, key == F.col(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
