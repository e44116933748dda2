"""Tokenizing, extraction, chat formatting, quality, decontamination, language ID and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfsignal.llm import bpe, chat, decontam, htmlnet, langid, quality

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


TEXTS = [None, "", " ", "a  b \n c  d   e  ", "\U0001f600\U0001f601 x" * 20, "x" * 30_000, " lead <|endoftext|> \x1c a \x1d b\x85 c", "日本語 テキスト\t\tfoo  bar", "I'll don't WE'VE 123 4.5", "  nbsp  em", "word " * 500]


def test_bpe_round_trip(spark, paths):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths[1], "rb"))}
    one = tiktoken.Encoding("own", pat_str=paths[2], mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(rows, DOCS), paths[0]).collect()}
    for i, t in rows:
        ids = one.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[4].n_split > 0 and got[10].n_split == 0


def test_bpe_offsets_and_extra_columns(spark, paths):
    rows = [(1, "Grüße an\n\ndie  Welt \U0001f600!", "mine"), (2, None, "other")]
    coded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), paths[0])
    assert coded.columns == ["ids", "first", "end", "doc_id"]
    text = rows[0][1]
    r = coded.where("doc_id = 1").first()
    whole = htmlnet.re.sub("", "", text)
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(paths[0]).encode(whole, add_special_tokens=False).offsets
    assert list(zip(r["first"], r["end"], strict=True)) == want
    back = bpe.decode_text(coded, paths[0]).collect()
    assert {x.doc_id: x.text for x in back} == {1: text, 2: ""}
    odd = spark.createDataFrame([(1, [r["ids"][0], None, r["ids"][1]]), (2, None), (3, []), (4, [None])], "doc_id long, ids array<int>")
    assert {x.doc_id: x.text for x in bpe.decode_text(odd, paths[0]).collect()} == {1: text[: r["end"][1]], 2: "", 3: "", 4: ""}
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_text(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), paths[0]).collect()


def test_pieces_that_are_forgotten(paths, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    pieces = bpe.Pieces(bpe.load(paths[0]))
    for words in (["a", " b", " cc"], [" b", " dd", " ee"], [" b", "zz"]):
        at = pieces.numbers(words)
        ids = [pieces.ids[pieces.start[i] : pieces.start[i] + pieces.count[i]].tolist() for i in at]
        assert ids == [pieces.tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_new_pieces_in_short_runs(paths):
    words = [" w" + "".join(map(chr, np.random.default_rng(i).integers(97, 123, 9))) for i in range(1000)]
    odd = ["Ab", " ", "\n c", "d ", " é\U0001f601", "\x1c", " '", "'s", " 's", "\x85e", " f\ng", "  h", " ", " i\t", " j"]
    pieces = bpe.Pieces(bpe.load(paths[0]))
    plain, asked = pieces.tokenizer, []

    class Heard:
        def encode_batch(self, texts, **options):
            asked.extend(texts)
            return plain.encode_batch(texts, **options)

    pieces.tokenizer = Heard()
    given = words[:500] + odd + words
    at = pieces.numbers(given)
    for p, i in zip(given, at, strict=True):
        e, of = plain.encode(p, add_special_tokens=False), slice(pieces.start[i], pieces.start[i] + pieces.count[i])
        assert pieces.ids[of].tolist() == e.ids and pieces.chars[i] == len(p)
        assert list(zip(pieces.first[of].tolist(), pieces.end[of].tolist(), strict=True)) == e.offsets
    assert sum(map(len, asked)) == sum(map(len, set(given)))  # each once
    assert max(x.count(" w") for x in asked) <= 100  # long strings cost the library twice the time a word
    assert len(asked) < len(odd) + 20
    assert pieces.numbers(words).tolist() == at[-1000:].tolist() and sum(map(len, asked)) == sum(map(len, set(given)))
    assert pieces.numbers([]).tolist() == []


def test_bounded_slices(paths, monkeypatch):
    """A worker takes a quarter of a million characters, or 65,536 tokens, in hand at once, however long a batch's texts are; decoding needs no tokenizer there."""
    texts = [None, "", *[f"a{i} word " * 2000 for i in range(60)], "", "z y" * 200_000, "\U0001f600 end", None]
    asked, plain = [], bpe.Pieces.numbers
    monkeypatch.setattr(bpe.Pieces, "numbers", lambda self, pieces: asked.append(sum(map(len, pieces))) or plain(self, pieces))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], names=["text", "doc_id"])
    coded = list(bpe._encoded(paths[0])([batch]))
    assert sorted(asked)[-1] == 600_000 and sorted(asked)[-2] <= 1 << 18  # the one long text goes alone
    tokenizer = bpe.load(paths[0])
    rows = pa.Table.from_batches(coded).to_pylist()
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for t, r in zip(texts, rows, strict=True):
        e = tokenizer.encode(t or "", add_special_tokens=False)
        assert r["ids"] == e.ids and list(zip(r["first"], r["end"], strict=True)) == e.offsets
    run = bpe._decoded(paths[0])
    monkeypatch.setattr(bpe, "load", None)
    ids = pa.RecordBatch.from_arrays([pa.array([r["ids"] for r in rows] + [None], pa.list_(pa.int32())), pa.array(range(len(rows) + 1))], names=["ids", "doc_id"])
    back = list(run([ids, ids.slice(0, 0)]))
    sizes = [[len(rows[i]["ids"]) for i in b["doc_id"].to_pylist() if i < len(rows)] for b in back]
    assert len(back) > 3 and all(sum(x) <= 1 << 16 or len(x) == 1 for x in sizes)
    assert [x.decode() for x in pa.Table.from_batches(back)["bytes"].to_pylist()] == [t or "" for t in texts] + [""]


# HTML


def test_blocks():
    page = "<html><head><title>t</title></head><body><script>var a='</p>';</script><!-- x --><nav><a href='/'>Home</a></nav><p>One &amp; two\n three<p>Four<br>five<ul><li>a<li>b</ul></article><div class='mainText'>six</body>"
    found = htmlnet.blocks(page)
    assert [b[0] for b in found] == ["Home", "One & two three", "Four five", "a", "b", "six"]
    assert found[0][2] == 1.0 and found[1][2] == 0.0 and ".main" in found[-1][1].names and found[1][1].depth == 3
    assert htmlnet.blocks("") == [] and [(t, p.depth, x) for t, p, x in htmlnet.blocks("plain < text")] == [("plain < text", 0, 0.0)]


def test_what_is_text():
    """Only scripts, styles, templates, frames and the head are silent; a silent element closed by a slash holds nothing."""
    text = lambda page: [b[0] for b in htmlnet.blocks(page)]
    assert text("<p>Energy is <math>E=m</math> here.</p>") == ["Energy is E=m here."]
    assert text("<p>a</p><noscript><p>b</p></noscript><p>c<svg><path d='x'/><text>d</text></svg>e") == ["a", "b", "cde"]
    assert text("<div>a<iframe src='x' /><p>b<template>c</template></p>d</div>") == ["a", "b", "d"]
    assert text("<p>a<iframe>x</p><p>b") == ["a", "b"]
    assert text("<p title='>' class=x/>a</p><p data-x=\"it's > 1\">b</p><p it's>c</p>") == ["a", "b", "c"]
    assert text("a<script>if (a < b) '</p>'</scripts></script >b<style>x</style") == ["ab"]
    assert text("<head><title>t</title><body>x<title>u</title>y") == ["xy"]
    assert text("a <!-- <p> --> b <!x> c <?y?> d </> e </ f> g <") == ["a b c d e g <"]
    assert text("a<p class='never closed") == ["a"]


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<i><p>y</p>", "<div></x>", '<a href="x ', "<!-- ", "< ", "<script> ", "<title><body>", "<p>z</div>"])
def test_time_follows_the_length(part):
    import time

    page = part * (400_000 // len(part))
    start = time.process_time()
    htmlnet.blocks(page)
    assert time.process_time() - start < 3


def test_gradients():
    layouts = htmlnet.Layouts([])
    pages = [layouts.page() for _ in range(2)]
    x, mask = htmlnet.padded(htmlnet.vectors([htmlnet.blocks(p) for p, _ in pages]))
    y = np.zeros(mask.shape)
    for k, (_, labels) in enumerate(pages):
        y[: len(labels), k] = labels
    net = htmlnet.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    loss = lambda: -np.where(mask, y * np.log(net.forward(x, mask)[0]) + (1 - y) * np.log(1 - net.forward(x, mask)[0]), 0).sum() / mask.sum()
    grad = net.gradients(x, mask, y)
    for k in ("Wf", "Ub", "cf", "V"):
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-4
        up = loss()
        net.p[k][i] = old - 1e-4
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-4 - grad[k][i]) < 1e-3 * max(1, abs(grad[k][i]))


def test_network_step_by_step():
    """Against the equations of the recurrent network, one number at a time."""
    import math

    net, rng = htmlnet.Network(), np.random.default_rng(8)
    pages = [rng.standard_normal((n, htmlnet.WIDTH)).astype(np.float32) * 0.3 for n in (5, 3, 1)]
    got = net.label(pages)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    H = htmlnet.HIDDEN
    for x, p in zip(pages, got, strict=True):
        states = {}
        for d in "fb":
            h, c = [0.0] * H, [0.0] * H
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                gate = [float(net.p[f"c{d}"][k]) + float(x[t] @ net.p[f"W{d}"][:, k]) + sum(h[j] * float(net.p[f"U{d}"][j, k]) for j in range(H)) for k in range(4 * H)]
                c = [sigmoid(gate[H + k]) * c[k] + sigmoid(gate[k]) * math.tanh(gate[3 * H + k]) for k in range(H)]
                h = [sigmoid(gate[2 * H + k]) * math.tanh(c[k]) for k in range(H)]
                states[d, t] = h
        for t in range(len(x)):
            z = [*states["f", t], *states["b", t], *x[t].tolist()]
            assert abs(sigmoid(sum(a * float(b) for a, b in zip(z, net.p["V"][:, 0], strict=True)) + float(net.p["v"][0])) - p[t]) < 1e-4


def test_pages_of_other_hands(spark):
    """Layouts written down by hand, as common publishing systems make them, with names that the generator has not."""
    text = lambda n, k: " ".join(f"{w}{k}" for w in ("the river keeps rising while farmers wait for news about their fields and nobody knows when it will stop because the forecast changes every hour").split()[:n]) + "."
    pages = {
        1: (f'<body><div id="masthead"><a href="/">Daily</a></div><ul class="main-nav"><li><a href="/a">News</a><li><a href="/b">Sport</a></ul><article class="hentry"><h1>{text(5, 1)}</h1><p>{text(24, 1)}</p><p>{text(20, 2)}</p></article><aside class="widget-area"><h3>Popular</h3><a href="/c">{text(4, 3)}</a></aside><footer>&copy; 2024 Daily</footer></body>', [text(5, 1), text(24, 1), text(20, 2)]),
        2: (f'<body><nav class="breadcrumb"><a href="/">Home</a> <a href="/x">Docs</a></nav><main><h2>{text(4, 4)}</h2><p>{text(22, 4)}</p><ul><li>{text(8, 5)}</li><li>{text(9, 6)}</li></ul></main><div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div></body>', [text(4, 4), text(22, 4), text(8, 5), text(9, 6)]),
        3: (f'<body><header class="site-header"><p>Blog</p></header><div class="post-content"><p>{text(24, 7)}</p><blockquote><p>{text(12, 8)}</p></blockquote><p>{text(21, 9)}</p></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{text(9, 1)}</p></div></div><form><label>Mail</label><input><button>Go</button></form></body>', [text(24, 7), text(12, 8), text(21, 9)]),
    }
    rows = [(i, "u", h) for i, (h, _) in pages.items()] + [(100 + i, "u", h) for i, h in enumerate(f"<article><p>{text(20, i)}</p></article>" for i in range(20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in htmlnet.extract(df, htmlnet.learn(df)).collect()}
    right = total = 0
    for i, (h, want) in pages.items():
        for b in htmlnet.blocks(h):
            right += (b[0] in got[i]) == (b[0] in want)
            total += 1
    assert right / total > 0.9, {i: got[i] for i in pages}


def test_extraction_on_layouts_it_has_not_seen(spark):
    layouts, rows, want = htmlnet.Layouts([f"word{i}" for i in range(300)], seed=99), [], {}
    for i in range(60):
        page, labels = layouts.page()
        found = htmlnet.blocks(page)
        rows.append((i, f"http://x/{i}", page))
        want[i] = (found, labels)
    rows += [(100, None, None), (101, "u", ""), (None, None, "<p>" + "x " * 50_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = htmlnet.extract(pages, htmlnet.learn(pages)).collect()
    assert len(got) == 63 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[100] == by[101] == ""
    right = total = 0
    for i, (found, labels) in want.items():
        lines = set(by[i].split("\n"))
        right += sum((b[0] in lines) == bool(y) for b, y in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


# Chats


def test_snapshots_collapse(spark):
    say = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = say(1, "a", "b") + say(2, "a", "b", "c") + say(3, "a", "b", "c") + say(4, "a", "x") + say(5, "a") + [(6, None, None, None), (6, 1, "user", "z"), (6, 1, "user", "z"), (None, 0, "user", "q")]
    conversations = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    got = {r.conv_id: r for r in chat.format_chats(conversations).collect()}
    assert set(got) == {2, 4, 6} and got[2].copies == 2
    assert got[2].text == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert got[6].text == "<||>\n\n<|end|>\n<|user|>\nz\n<|end|>\n"
    assert chat.format_chats(conversations.limit(0)).count() == 0


def test_long_conversations_are_rolled_in_blocks(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 25), (2, 12), (3, 13), (4, 25)) for t in range(n)] + [(5, t, "user", f"t{t}" if t < 9 else "other") for t in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.format_chats(df, block=4).collect()))
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(c.sql(chat.SQL.replace("1024", "4")).fetchall())
    assert {r[0] for r in got} == {1, 5}


def test_many_turns_without_a_number(spark):
    """Null and equal turns of one conversation, over several partitions, go by role and text."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(2)
    rows = [(1, None if i % 3 else 7, rng.choice(["user", "bot", None]), f"t{rng.randrange(500)}") for i in range(600)] + [(2, None, "user", f"t{i}") for i in range(40)] + [(3, None, "user", f"t{i}") for i in range(55)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(map(tuple, chat.format_chats(df, block=8).collect()))
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(c.sql(chat.SQL.replace("1024", "8")).fetchall())


# Quality


def test_ranking(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    good = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(rng.randint(20, 200)))
    bad = lambda: " ".join(rng.choice(words) + rng.choice(["!!!", "$$$", "|"]) for _ in range(rng.randint(20, 200)))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)]
    odd = [(1000, None), (1001, ""), (None, good()), (1002, "x" * 100_000)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)] + [(1000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.rank(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    assert {r.score for r in quality.rank(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_threshold_is_that_of_all_labels():
    """Scores against step by step figures; a capped sample of the labels must not move the threshold."""
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.1).astype(int)
    x = rng.standard_normal((4000, quality.WIDTH)) + 0.8 * y[:, None] * (np.arange(quality.WIDTH) < 3)
    whole = quality.fit(x, y)
    share = (whole.score(x) >= 0.5).mean()
    assert abs(share - y.mean()) < 0.005
    some = np.concatenate([np.flatnonzero(y == 1)[:200], np.flatnonzero(y == 0)[:200]])
    capped = quality.fit(x[some], y[some], {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    plain = quality.fit(x[some], y[some])
    assert abs((capped.score(x) >= 0.5).mean() - share) < 0.1 < 0.15 < abs((plain.score(x) >= 0.5).mean() - share)
    assert quality.quantile(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 1.0, 1.0, 1.0]), 0.5) == 2.5
    for i in (0, 17):
        z = [min(8, max(-8, (x[i, j] - whole.mean[j]) / whole.scale[j])) for j in range(quality.WIDTH)]
        margin = sum(a * b for a, b in zip(z, whole.weights, strict=True)) - whole.threshold
        assert abs(whole.score(x[i : i + 1])[0] - 1 / (1 + np.exp(-margin))) < 1e-9


# Decontamination


def test_templates(spark):
    filler = "quick brown foxes jump over lazy dogs near the old river bank every single morning without fail"
    items = [(1, "A train leaves at 9 and travels 120 km while Anna counts 12 red cars along the way to town."), (2, "short item here"), (None, filler), (3, None), (4, "")]
    docs = [
        (1, f"{filler}. {items[0][1]} {filler}"),
        (2, f"{filler}. A train leaves at 7 and travels 310 miles while Boris counts 45 red cars along the way to town. {filler}"),
        (3, f"{filler}. a bus leaves at noon and nobody counts anything on the way. {filler}"),
        (4, "it is a SHORT, item (here)"), (5, None), (6, ""), (None, items[0][1]), (7, filler * 200), (1, "again"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    got = decontam.report(frame, bench).collect()
    assert len(got) == len(docs)
    flagged = {r.doc_id: r.item_ids for r in got if r.contaminated}
    assert flagged == {1: [1], 2: [1]} | {4: [2]}
    assert {r.doc_id for r in decontam.keep_clean(frame, bench).collect()} == {3, 5, 6, 7, None}
    assert not any(r.contaminated for r in decontam.report(frame, bench.limit(0)).collect())


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "add 3 apples to 3 pears then give 3 plums to the very kind old man at the gate")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "add 8 apples to 8 pears then give 8 plums to the very kind old man at the gate"), (2, "add 8 apples to 9 pears then give 7 plums to the very kind old man at the gate")], DOCS)
    assert {r.doc_id: r.contaminated for r in decontam.report(docs, bench).collect()} == {1: True, 2: False}


def test_names_open_sentences_and_numbers_are_dense(spark):
    items = [(1, "Tom has 5 apples. Ann has 7 pears. Bob gives 3 plums away."), (2, "compute 12 7 3 4 2 9 12 8 1 6 5 11 and add them"), (3, "Hello world"), (4, "sum 4 5 6")]
    around = "nobody in the old town has ever heard of such a thing"
    docs = [
        (1, f"{around}. Eva has 8 apples. Max has 2 pears. Lea gives 6 plums away. {around}"),
        (2, f"{around} compute 31 2 5 6 7 8 31 4 9 3 1 77 and add them {around}"),
        (3, f"{around} compute 31 2 5 6 7 8 30 4 9 3 1 77 and then stop {around}"),
        (4, " ".join(str(i) for i in range(3000))), (5, f"Dear world. Total 7 8 9. {around}. Hello there"), (6, "sum 7 8 9"),
        (7, f"{around}. Eva has 8 chairs. Max sold 2 pears. Lea took 6 plums away. {around}"),
    ]
    got = decontam.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in got if r.contaminated} == {1: [1], 2: [2]}


def template_tokens(text):
    """(word, form, form with names at the start of sentences) of every token, one at a time."""
    raw, out, before, was_number = (text or "").encode(), [], None, False
    punct = bytes(b for b in range(33, 127) if not chr(b).isalnum())
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        opens = before is None or raw[before - 1 : before] in (b".", b"!", b"?", b":") or b"\n" in raw[before : m.start()]
        before, token = m.end(), m[0].strip(punct)
        if not token:
            continue
        low = bytes(c | 32 if 65 <= c <= 90 else c for c in token)
        number = any(48 <= c <= 57 for c in token) and all(48 <= c <= 57 or c in punct for c in token)
        upper = sum(65 <= c <= 90 for c in token)
        capital = 65 <= token[0] <= 90 and upper == 1 or token[0] == 0xC3 and 0x80 <= token[1] <= 0x9E and upper == 0
        title = capital and len(token) > 1 and not number
        form = "NUM" if number else "UNIT" if was_number and low.decode("utf-8", "replace") in decontam.UNITS else "NAME" if title and not opens else low
        out.append((low, form, "NAME" if title and form == low else form))
        was_number = number
    return out


def template_windows(text, lengths):
    """(variant, length, place, key, slots) of every window."""
    t = template_tokens(text)
    for n in lengths:
        for at in range(len(t) - n + 1):
            w = t[at : at + n]
            plain = 2 * sum(a != b for a, b, _ in w) > n
            slots = lambda k, w=w: tuple(x[0] if x[0] != x[k] else None for x in w)
            yield 0, n, at, (n, *((("plain", a) if plain else b) for a, b, _ in w)), slots(1)
            used = sum(a != c for a, _, c in w)
            if any(b != c for _, b, c in w) and 2 * used <= n and n - used >= 4:
                yield 1, n, at, (n, *(c for _, _, c in w)), slots(2)
            if n == 8 and 2 * used > n:
                first = at if used < n else max((i for i in range(at) if t[i][0] == t[i][2]), default=-1)
                if 0 <= first and at - first <= 64:
                    yield 2, n, at, ("dense", *(c for _, _, c in t[first : at + n])), slots(2)


def contaminated_brute(docs, items):
    lengths = {i: [min(8, len(template_tokens(t)))] for i, t in items if template_tokens(t)}
    out = {}
    for d, text in docs:
        mine = list(template_windows(text, sorted({n for v in lengths.values() for n in v})))
        for i, item in items:
            theirs = list(template_windows(item, lengths.get(i, [])))
            hit = set()
            aligned = {}
            for v, n, place, key, slots in mine:
                for iv, _, iplace, ikey, islots in theirs:
                    if key == ikey:
                        for level in range(max(v, iv), 3):
                            at, pairs = aligned.setdefault((place - iplace, level), (set(), set()))
                            at.add((iplace, n))
                            pairs.update((a, b) for a, b in zip(islots, slots, strict=True) if a is not None or b is not None)
            for (_, level), (at, pairs) in aligned.items():
                if len({a for a, _ in pairs}) == len(pairs) and (level < 2 or len(at) >= 3):
                    hit |= at
            if theirs and len(hit) / len({(n, p) for _, n, p, _, _ in theirs}) >= 0.5:
                out.setdefault(d, []).append(i)
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(14)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("ba", "ne", "ko", "ri")]
    names, units = ["Anna", "Boris", "Émile", "Zoe"], ["km", "hours", "kg"]

    def template(n):
        kinds = [rng.choice(["w", "w", "w", "w", "n", "u", "N", "."]) for _ in range(n)]
        fixed = [rng.choice(words) for _ in range(n)]
        return lambda r: " ".join({"w": w, ".": w + ".", "n": str(r.randint(1, 40)), "u": f"{r.randint(2, 90)} {r.choice(units)}", "N": r.choice(names)}[k] for k, w in zip(kinds, fixed, strict=True))

    shapes = [template(rng.choice([3, 7, 9, 14, 22])) for _ in range(10)] + [lambda r: "compute " + " ".join(str(r.randint(1, 30)) for _ in range(12)) + " now"]
    items = [(i, f(rng)) for i, f in enumerate(shapes)] + [(50, ""), (51, None), (52, "!!!")]
    prose = lambda n: " ".join(rng.choice(words).capitalize() + rng.choice([".", "", ","]) if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    docs = [(i, f"{prose(rng.randint(0, 12))} {rng.choice([rng.choice(items)[1] or '', rng.choice(shapes)(rng), prose(9)])} {prose(rng.randint(0, 12))}") for i in range(60)] + [(90, None), (91, "")]
    want = contaminated_brute(docs, items)
    got = decontam.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in got if r.contaminated} == {d: sorted(v) for d, v in want.items()} and len(want) > 10


# Language ID


def test_languages(spark):
    rng = random.Random(3)
    sound = {"aa": ["la", "mo", "ne", "ri"], "bb": ["sch", "tz", "ung", "ver"], "cc": ["ción", "rr", "ñe", "ado"]}
    text = lambda lang: " ".join("".join(rng.choices(sound[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choices(list(sound), k=600))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (None, text("bb"), "bb"), (1003, text("cc") * 500, None), (1004, text("aa"), None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, score int")
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == 606 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "cc" and by[None].lang_pred == "bb"
    held = [(r, dict((i, lang) for i, _, lang in rows)[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.99
    nothing = langid.predict(docs, langid.learn(docs.where("lang IS NULL"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert {r.doc_id for r in langid.keep_known(docs).where("doc_id >= 1000").collect()} == {1003, 1004}


def test_language_of_each_row(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choices("abcde", k=3)) + " la mo ne ri" * rng.randint(2, 9)
    rows = [(i, text(), "aa") for i in range(400)]
    docs = spark.createDataFrame([*rows, (7, "123 !!", None), (None, "456", None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, langid.keep_known(docs).collect()), key=str) == sorted([*rows, (None, "456", None)], key=str)


def test_filters_return_every_member():
    sets = {"a": np.arange(5000, dtype=np.uint64), "b": np.arange(2500, 9000, dtype=np.uint64)}
    f = langid.Filters(["a", "b"], sets)
    assert (f.masks(sets["a"])[0] & np.uint64(1)).all() and (f.masks(sets["b"])[0] & np.uint64(2)).all()
    assert (f.masks(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)) != 0).mean() < 0.02


def test_many_languages():
    """Against exact sets of n-grams, with more languages than a word has bits."""
    rng = random.Random(12)
    names = [f"l{i:03}" for i in range(130)]
    text = {x: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(120)) for x in names}
    sets = {x: np.unique(langid.grams([t])[0]) for x, t in text.items()}
    f = langid.Filters(names, sets)
    some = names[::7]
    count, n = f.counts([text[x] for x in some])
    for row, x in enumerate(some):
        code = langid.grams([text[x]])[0]
        exact = np.array([np.isin(code, sets[y]).sum() for y in names])
        assert n[row] == len(code) and names[int(count[row].argmax())] == x == names[int(exact.argmax())]
        assert np.abs(count[row] - exact).max() < 0.02 * len(code) + 5


# Pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_dedup import near_brute, sentence_brute

    rng = random.Random(8)
    sound = {"aa": ["la", "mo", "ne", "ri", "su", "ko"], "bb": ["sch", "tz", "ung", "ver", "ich", "pf"]}
    word = lambda lang: "".join(rng.choices(sound[lang], k=rng.randint(2, 5)))
    prose = lambda lang, n: " ".join(word(lang) + rng.choice(["", "", ".", ","]) for _ in range(n))
    passage, item = prose("aa", 70) + ".", "please tell how many lamoneri stand in the sukolamo today my dear friend of the house"
    rows = [(i, prose(lang, rng.randint(30, 90)), lang, "s", 0) for i, lang in enumerate(rng.choices(["aa", "bb"], k=150))]
    rows += [(200 + i, rows[i][1], rows[i][2], "s", 0) for i in range(10)]
    rows += [(300 + i, f"{prose('aa', 30)}. {passage} {prose('aa', 30)}", "aa", "s", 0) for i in range(6)]
    rows += [(400, f"{prose('aa', 40)} {item} {prose('aa', 40)}", "aa", "s", 0), (401, "123 456", "aa", "s", 0), (402, None, "aa", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(r[0], r[1]) for r in rows if r[0] not in (401, 402)]
    _, root = near_brute(docs, 80)
    docs = sentence_brute([(i, t) for i, t in docs if root[i] == i])
    want = {i: t for i, t in docs if item not in t}
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_every_stage_takes_odd_tables(spark, tmp_path):
    """Repeated and null ids, null, empty and long texts, ties, clashing columns; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    words = ["größe", "übung", "straße", "tür", "öl", "ärger", "mühe", "schön"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    shared = prose(60) + "."
    rows = [(i, prose(rng.randint(20, 60)), "de") for i in range(60)]
    rows += [(7, f"{prose(9)}. {shared}", "de"), (7, f"ü. {shared} {prose(12)}", "de"), (8, shared, "de"), (8, shared, "de"), (None, shared, "de"), (None, None, None), (109, None, "de"), (110, "", None), (111, prose(20_000), "de"), (112, "🙂" * 3000, None)]
    names = "doc_id long, text string, lang string, n_chars long, source string, _id int, _gone int, gone int, h int, n int, k int, version int, cuts int, _k int, id int, again int"
    for folder, some in (("full", rows), ("none", [])):
        where = f"{tmp_path}/{folder}"
        spark.createDataFrame([(*r, len(r[1] or ""), "s", *range(11)) for r in some], names).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for name, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, docs, where).columns == docs.columns, name
        got = corpus_pipeline.run(spark, where).collect()
        assert bool(got) == bool(some) and all(len(r.ids) == r.n_tokens for r in got)
        ids = {r.doc_id for r in got}
        assert not some or ({111, None} <= ids and not {109, 110} & ids), ids
