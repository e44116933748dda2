"""MinHash near-dedup, sentence spans, suffixes and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shelfsignal.llm import minhash, sentences, suffixes, vectors
from shelfsignal.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def corpus(seed=3, families=12, lone=20):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    texts = [prose(rng.randint(1, 200)) for _ in range(lone)]
    for _ in range(families):
        base = prose(rng.randint(30, 260)).split()
        for _ in range(rng.randint(2, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([str, str.upper])(" ".join(copy)))
    return texts


ODD = ["", None, "one", "one two three four", "ONE  two\tthree\nfour", "é é é é é é", "   ", "one"]


def near_brute(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = list(enumerate([*ODD, *corpus()]))
    sets, want = near_brute(rows, percent)
    got = minhash.near_duplicates(spark.createDataFrame([*rows, (None, "one")], DOCS), 5, percent).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_dense_group_without_a_hub(spark):
    """Copies with many own edits each: near the threshold, hardly any linked, all in the same buckets."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    _, want = near_brute(rows, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 5, 85).collect()}
    assert got == want


def test_rows_of_one_id_are_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (2, a), (3, b), (1, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 5


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5), (2, "a b", 6)], "doc_id long, text string, component_id long")
    assert [tuple(r) for r in minhash.keep_one(docs).collect()] == [(1, "a b", 5)]


def test_repeated_rows_stay_once(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, a), (None, b), (None, None), (3, "x y")]
    got = [tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted({r for r in rows if r[0] != 2}, key=str)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    both = np.concatenate([a[:850], rng.integers(0, 2**63, 50).astype(np.uint64)])
    value, doc = np.concatenate([a, both, a[:3]]), np.repeat([0, 1, 2], [900, 900, 3])
    s = minhash.sketch(value, doc, 3)
    assert (s != minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 850 / 950) < 0.08


def test_components(spark):
    edges = [(5, 1), (1, 5), (5, 9), (20, 21), (21, 22), (7, 7)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: v for k, v in roots({x for e in edges for x in e}, edges).items() if k != v}
    assert got == want


# Sentence spans


def sentence_brute(rows, least=3, words=20):
    def parts(raw):
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        out, first = [], 0
        for i, (_, z) in enumerate(w):
            after = w[i + 1][0] if i + 1 < len(w) else len(raw)
            if raw[z - 1 : z] in (b".", b"!", b"?", b";", b":", b",") or b"\n" in raw[z:after] or i + 1 == len(w):
                out.append((first, i + 1, w[first][0], after))
                first = i + 1
        return w, out

    seen = defaultdict(list)
    for d, t in rows:
        if d is None or t is None:
            continue
        raw = t.encode()
        w, s = parts(raw)
        low = [bytes(c | 32 if 65 <= c <= 90 else c for c in raw[a:z]) for a, z in w]
        for i in range(len(s)):
            j = i
            while j < len(s) and (j - i + 1 < least or s[j][1] - s[i][0] < words):
                j += 1
            if j < len(s):
                seen[tuple(low[s[i][0] : s[j][1]])].append((d, s[i][2], s[j][3]))
    gone = defaultdict(list)
    for v in seen.values():
        for x in set(v) - {y for y in v if y[:2] == min(v)[:2]}:
            gone[x[0]].append(x[1:])
    out = []
    for d, t in rows:
        raw = None if t is None else t.encode()
        keep = None if raw is None else bytes(c for i, c in enumerate(raw) if not any(a <= i < z for a, z in gone.get(d, ())))
        out.append((d, None if keep is None else keep.decode()))
    return out


@pytest.mark.parametrize("few", [200_000, 0])
def test_sentence_spans(spark, monkeypatch, few):
    """With texts that stay where they are, and with all of them shuffled."""
    monkeypatch.setattr(sentences, "BROADCAST_ROWS", few)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n)) + "."
    passage = [prose(60) for _ in range(3)]
    rows = [(i, prose(rng.randint(0, 40)) + " " + rng.choice([*passage, ""]) + " " + prose(rng.randint(0, 40))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, passage[0] * 3), (None, passage[0]), (103, "x" * 5000), (104, passage[1].upper())]
    got = sentences.remove_repeats(spark.createDataFrame([(d, t, "kept") for d, t in rows], "doc_id long, text string, n_removed string")).collect()
    key = lambda r: (r[0] is None, r[0])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(sentence_brute(rows), key=key)
    assert sentences.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_of_one_id_are_cut_apart(spark):
    """Rows of one doc_id with different texts, and columns with the names that the plans use."""
    span = "die größte Übung, heißt es, ist die längste: wer früh übt, der bleibt schön dabei, und wer spät beginnt, der müht sich ab und kommt doch an."
    rows = [(1, f"ää öö. {span}"), (1, f"ü. {span} ende"), (2, span), (1, f"ää öö. {span}"), (None, span), (3, "ganz anders")]
    names = "doc_id long, text string, _id int, id int, _gone int, gone int, version int, again int, cuts int, own int, h int, n int"
    docs = spark.createDataFrame([(*r, *range(10)) for r in rows], names)
    got = sentences.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert sum(span in t for d, t in texts if d is not None) in (1, 2)  # 2: the first text of its doc_id stands in two rows
    assert (None, span) in texts and (3, "ganz anders") in texts and len(texts) == 6
    assert all(set(tuple(r)[2:12]) == set(range(10)) for r in got.collect())
    assert set(minhash.keep_one(docs).columns) == set(docs.columns)


def test_repeated_windows_of_51_words(spark):
    """Against plain windows of words, whatever the punctuation: of a repeated run some words at its edges stay at most."""
    rng = random.Random(9)
    fresh = iter(range(10**6))
    prose = lambda n, ends: [f"w{next(fresh)}" + rng.choice(ends) for _ in range(n)]
    passages = [prose(rng.randint(51, 90), ends) for ends in [[""], [""] * 30 + ["."], [""] * 9 + [","], ["", "", "."], [""] * 5 + ["。"]] for _ in range(4)]
    rows = []
    for i in range(120):
        p = rng.choice(passages)
        a = rng.randint(0, len(p) - 51)
        rows.append((i, [*prose(rng.randint(0, 30), [""]), *p[a : rng.randint(a + 51, len(p))], *prose(rng.randint(0, 30), [""])]))
    seen, runs = set(), {}
    for d, words in rows:
        for k in range(len(words) - 50):
            window = tuple(words[k : k + 51])
            if window in seen:
                runs.setdefault(d, set()).update(window)
            seen.add(window)
    assert len(runs) > 60
    for r in sentences.remove_repeats(spark.createDataFrame([(d, " ".join(words)) for d, words in rows], DOCS)).collect():
        kept = set(r.text.split())
        assert len(runs.get(r.doc_id, set()) & kept) <= 13, r.doc_id


# Suffixes


def suffix_brute(rows, length=400):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raws, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def suffix_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(180)
    rows = [(i, prose(rng.randint(0, 80)) + passage[rng.randint(0, 50) : rng.randint(440, len(passage))] + prose(rng.randint(0, 80))) for i in range(30)]
    rows += [(40, prose(200)), (41, None), (42, ""), (43, "ab " * 700), (44, "Z" * 399), (45, "Z" * 400), (46, "Z" * 401), (45, "Z" * 400), (None, passage), (47, passage), (48, "é" * 300), (49, prose(3000))]
    return rows


@pytest.mark.parametrize(("bucket", "slab", "hot"), [(20_000, 2048, 2048), (7, 3, 2048), (7, 3, 2)])
def test_suffixes(spark, monkeypatch, bucket, slab, hot):
    """With one bucket, with many, and with tokens that are dealt anew by narrower windows."""
    rows = suffix_rows()
    key = lambda r: (r[0] is None, *((x or 0) if i == 0 else x for i, x in enumerate(r)))
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(suffixes, "SLAB", slab)
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = suffixes.deduplicate(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rid int"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(suffix_brute(rows), key=key)


def test_suffixes_of_nothing(spark):
    assert suffixes.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_multikey_order():
    """Against the order of Python's tuples; groups stay together."""
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 3, (400, 21)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[200:300, :17] = rows[:100, :17]
    group = rng.integers(0, 3, 400)
    order = suffixes.multikey_order(group, rows)
    ranked = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert ranked == sorted(ranked) and sorted(order.tolist()) == list(range(400))
    assert len(suffixes.multikey_order(group[:0], rows[:0])) == 0


@pytest.mark.parametrize("width", [256, 16, 1])
def test_repeats_in_a_slab(width):
    """Each start of each context against all strings of the other contexts of its token at the same distance."""
    rng = random.Random(width)
    pieces = ["".join(rng.choices("ab", k=width)).encode() for _ in range(3)]
    core = [bytes([c]) * (400 + width) for c in b"xy"]
    g, place, starts, contexts = [], [], [], []
    for _ in range(40):
        p = rng.randrange(width)
        n = rng.randint(1, p + 1)
        token = rng.randrange(2)
        left = rng.choice(pieces)
        tail = rng.choice([b"", bytes(rng.choices(b"uv", k=3))])
        right = core[token][: 400 - p + n - 1 - len(tail)] + tail
        g.append(token)
        place.append(p)
        starts.append(n)
        contexts.append((left[width - p :] if p else b"") + right)
    row, first, last = suffixes.repeats(np.array(g), np.array(place), np.array(starts), contexts, width)
    got = {(int(r), s) for r, a, z in zip(row, first, last, strict=True) for s in range(a, z + 1)}
    strings = Counter((g[i], place[i] - s, contexts[i][s : s + 400]) for i in range(40) for s in range(starts[i]))
    want = {(i, s) for i in range(40) for s in range(starts[i]) if strings[g[i], place[i] - s, contexts[i][s : s + 400]] > 1}
    assert got == want and want


# Vectors


@pytest.mark.parametrize("most", [8192, 3])
def test_vectors(spark, monkeypatch, most):
    """With one level of centroids and with two."""
    monkeypatch.setattr(vectors, "CENTROIDS", most)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 24))
    near = np.concatenate([base[rng.integers(0, 20, 250)] + 0.08 * rng.standard_normal((250, 24)), np.repeat(base[:1], 120, axis=0) + 0.06 * rng.standard_normal((120, 24))])
    x = np.concatenate([base, near, base[:30]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [1.0, None]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, x[0].tolist()), (1007, [float("inf")] * 24)]
    monkeypatch.setattr(vectors, "SHARD", 120)
    monkeypatch.setattr(vectors, "MEMBERS", 60)
    got = vectors.near_duplicates(spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>"), 90).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    true = link.sum(axis=1)
    root = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(link)), strict=True)])
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(bad)
    assert all(by[i].n_links <= true[i] for i in range(len(x)))
    assert sum(by[i].n_links for i in range(len(x))) >= 0.95 * true.sum()
    assert sum(by[i].component_id == root[i] for i in range(len(x))) >= 0.99 * len(x)
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[1005].component_id == by[1006].component_id == 1005 and by[1006].n_links == 1
    assert by[None].component_id is None and by[None].kept
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_a_search_compares_what_it_meets():
    """The graph finds the links of a shard without comparing all pairs of it."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 32))
    x = np.concatenate([base, base[:150] + 0.1 * rng.standard_normal((150, 32)), rng.standard_normal((1050, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = vectors.build(x)
    found = vectors.search(x, graph, 0.9)
    true = x @ x.T >= 0.9
    np.fill_diagonal(true, False)
    assert true.sum() >= 300 and (found & true).sum() >= 0.97 * true.sum() and not (found & (x @ x.T < 0.89)).any()
    walk = vectors.Walk(x, graph, np.arange(256))
    walk.greedy(vectors.medoid(x))
    walk.range(0.82)
    assert walk.compared < 0.7 * 256 * len(x)
    assert np.allclose(walk.s[np.isfinite(walk.s)], (x[:256] @ x.T)[np.isfinite(walk.s)], atol=1e-5)


def test_pruned_neighbours():
    """Against the rule step by step: the nearest candidate stays, and what is nearer to it than to the node goes."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).astype(np.float32)
    got = vectors.prune(x, np.arange(40), np.repeat(np.arange(40)[None], 40, axis=0), s)
    far = lambda a, b: max(0.0, 2 - 2 * float(x[a] @ x[b]))
    for i in range(40):
        left, want = sorted((j for j in range(40) if j != i), key=lambda j: -s[i, j]), []
        while left and len(want) < vectors.DEGREE:
            want.append(left.pop(0))
            left = [j for j in left if vectors.ALPHA**2 * far(want[-1], j) > max(0.0, 2 - 2 * float(s[i, j]))]
        assert [j for j in got[i] if j >= 0] == want


def test_recall_too_low_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(vectors, "audit", lambda *a: 0.5)
    monkeypatch.setattr(vectors, "MOST_OVERLAP", 2)
    rows = [(i, [1.0, float(i)]) for i in range(5)]
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_pairs_count_in_their_first_shard():
    rng = np.random.default_rng(2)
    lists = [sorted({5, *rng.integers(0, 9, rng.integers(0, 4)).tolist()}) for _ in range(40)]
    found = vectors.met_before(vectors.pa.array(lists, vectors.pa.list_(vectors.pa.int64())), 5)
    assert found.tolist() == [[min(set(a) & set(b)) < 5 for b in lists] for a in lists]
    assert not vectors.met_before(vectors.pa.array([[5], [5, 7]]), 5).any()


def test_a_dense_group_is_compared_by_products(spark, monkeypatch):
    """One group of near copies over several blocks, beside vectors that link with few: counts are exact, and no graph is built for it."""
    monkeypatch.setattr(vectors, "SHARD", 200)
    rng = np.random.default_rng(3)
    base = rng.normal(size=24)
    x = np.concatenate([base + rng.normal(0, 0.3, (700, 24)), rng.normal(size=(150, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    assert vectors.dense(u[:200], 0.9) and not vectors.dense(u[700:], 0.9) and not vectors.dense(u[:60], 0.9)
    found, other = vectors.products(u, 0.9), ~np.eye(len(u), dtype=bool)
    assert not (linked & other & ~found).any() and not (found & (u @ u.T < 0.8998)).any() and not found.diagonal().any()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(rows).collect()}
    assert [got[i] for i in range(700)] == (linked.sum(axis=1) - 1)[:700].tolist()
