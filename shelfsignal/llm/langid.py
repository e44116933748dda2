"""Language identification with bit-sliced Bloom filters of n-grams.

Learning: of at most ``SAMPLE`` labelled documents a language (those of the
smallest hash of doc_id) the byte n-grams of the lower-cased text are counted;
a language contains an n-gram seen ``SEEN`` times or more whose share there is
at least half of the largest share in any language; at most ``GRAMS`` n-grams
a language, the most frequent ones, are kept. These bounds are parameters of
the classifier; predictions cover every whole text.

The filters of all languages are arrays of 64-bit words, one for each 64
languages: word r holds, as bit l, position r of language l's filter. The words at the ``HASHES``
positions of an n-gram, and-ed, give at once the mask of all languages that
contain it. A language's popcount over a text is corrected for its filter's
false positives, (hits - n f) / (1 - f); the largest wins, ties by name.

Defined cases: null text and text without a letter is ``und`` with score 0; so
is any text if nothing could be learned. A text without a known n-gram gets
the first language with score 0. Rows with null doc_id are predicted like
others and are not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, stage, tune
from .textvec import mix

SIZES = (3, 4)
SAMPLE, SEEN, GRAMS = 2000, 5, 20_000
#: Positions of a filter and hashes of an n-gram: about 1 % false positives with GRAMS n-grams.
POSITIONS, HASHES = 1 << 18, 3
_SLICE = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def grams(texts: list[str]):
    """(n-gram codes, number of the text) of all n-grams; what is no letter counts as one space."""
    raw = [(" " + t + " ").lower().encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) for x in raw])
    data = np.where(_LETTER[data], data, 32).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep].astype(np.uint64), doc[keep]
    codes, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        code = np.full(m, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | data[i : i + m]
        own = doc[:m] == doc[n - 1 :]
        codes.append(code[own])
        owners.append(doc[:m][own])
    return (np.concatenate(codes), np.concatenate(owners)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def slices(texts: list[str]):
    """Ranges of ``texts`` of about 250,000 characters, which bound a worker's memory."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _SLICE):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _counted(batches):
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        for i, j in slices(texts):
            code, doc = grams(texts[i:j])
            lang = np.array([number[x] for x in langs[i:j]], np.uint64)[doc]
            key, n = np.unique((lang << np.uint64(48)) | code, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[x] for x in (key >> np.uint64(48)).tolist()], pa.string()),
                    pa.array((key & np.uint64((1 << 48) - 1)).view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )


def held_out(doc_id="doc_id", mod: int = 5, rest: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


class Filters:
    """The sliced filters: languages, words, and each language's rate of false positives."""

    def __init__(self, languages: list[str], sets: dict[str, np.ndarray]):
        self.languages, self.words = languages, np.zeros((-(-len(languages) // 64) or 1, POSITIONS), np.uint64)
        rates = []
        for bit, lang in enumerate(languages):
            at = np.unique(self.at(sets[lang]))
            self.words[bit // 64, at] |= np.uint64(1 << bit % 64)
            rates.append((len(at) / POSITIONS) ** HASHES)
        self.rates = np.array(rates)

    @staticmethod
    def at(code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix(code * np.uint64(0x9E3779B97F4A7C15))
        return np.stack([((h >> np.uint64(20 * i)) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)])

    def masks(self, code: np.ndarray) -> np.ndarray:
        """A mask of all languages for each n-gram, 64 languages a row."""
        out = None
        for at in self.at(code):
            out = self.words[:, at] if out is None else out & self.words[:, at]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts (texts x languages) and the number of n-grams."""
        code, doc = grams(texts)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        mask, hits = self.masks(code), np.zeros((len(texts), len(self.languages)))
        for bit in range(len(self.languages)):
            hits[:, bit] = np.bincount(doc, ((mask[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(float), len(texts))
        return np.maximum(0, (hits - n[:, None] * self.rates) / (1 - self.rates)), n


def learn(docs: DataFrame) -> Filters:
    """Filters from the rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    tune(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = bounded_sample(rows.select("lang", "text", "doc_id"), SAMPLE, "doc_id", by="lang")
    found = rows.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = stage(found.where(F.col("n") >= SEEN), "grams")
    total = found.groupBy("lang").agg(F.sum("n").alias("total"))
    share = found.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    kept = share.join(best, "gram").where("share >= 0.5 * best")
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= GRAMS)
    table = kept.select("lang", "gram").toPandas()  # at most GRAMS rows a language
    return Filters(sorted(set(table["lang"])), {k: g.to_numpy().view(np.uint64) for k, g in table.groupby("lang")["gram"]})


def _predicted(filters: Filters):
    def run(batches):
        names = filters.languages
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, score, cover = [], [], []
            for i, j in slices(texts):
                part = texts[i:j]
                if not names:
                    count, n, top = np.zeros((len(part), 1)), np.zeros(len(part)), np.zeros(len(part), int)
                else:
                    count, n = filters.counts(part)
                    top = count.argmax(axis=1)
                best, total = count[np.arange(len(part)), top], count.sum(axis=1)
                for t, k, b, s, m in zip(part, top.tolist(), best.tolist(), total.tolist(), n.tolist(), strict=True):
                    known = bool(names) and any(map(str.isalpha, t))
                    lang.append(names[k] if known else "und")
                    score.append(b / s if known and s else 0.0)
                    cover.append(b / m if known and m else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64())], names=["doc_id", "lang_pred", "score", "cover"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the winner in all popcounts) and cover (share of n-grams that the winner contains)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predicted(filters), "doc_id long, lang_pred string, score double, cover double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cover")


#: A text that its best language covers less is not in any of the languages.
LEAST_COVER = 0.2


def _known(filters: Filters):
    predicted = _predicted(filters)

    def run(batches):
        for batch in batches:
            for found in predicted([batch]):
                columns = (found.column(name).to_pylist() for name in ("doc_id", "lang_pred", "cover"))
                yield batch.filter(pa.array([i is None or lang != "und" and cover >= LEAST_COVER for i, lang, cover in zip(*columns, strict=True)], pa.bool_()))

    return run


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language, each by its own text, all columns; rows with a null doc_id stay."""
    filters = learn(docs)
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_known(filters), docs.schema)
