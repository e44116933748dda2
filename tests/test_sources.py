"""Splits of delimited files, polling, database reads, dates in words, header similarity, interval joins, watches on a stream."""

import datetime as dt
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfsignal.functions.dates import natural_date
from shelfsignal.functions.ranges import interval_join, pruned
from shelfsignal.sources import database, delimited, files, imports
from shelfsignal.streaming import ingest
from shelfsignal.streaming import watches as stream

# Delimited files


def written(path, rows, seed=0):
    """Fields with commas, doubled quotes and line breaks; as text and as they must be read."""
    rng = random.Random(seed)
    kinds = [lambda i: f"plain{i}", lambda i: f"a,{i}", lambda i: f'say "{i}"', lambda i: f"line\nbreak {i}\n\nend", lambda i: "", lambda i: "x" * rng.randint(1, 80) + "\n" * rng.randint(0, 4) + "é", lambda i: '"', lambda i: '\n"\n']
    data = [[str(i), *(rng.choice(kinds)(i) for _ in range(3))] for i in range(rows)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n') or rng.random() < 0.1 else v
    path.write_text("﻿id, one ,two,three\n" + "\n".join(",".join(map(quoted, r)) for r in data) + ("\n" if seed % 2 else ""), encoding="utf-8")
    return data


@pytest.mark.parametrize("size", [None, 7000, 997, 211])
def test_splits_equal_the_whole(spark, tmp_path, size):
    want = written(tmp_path / "a.csv", 400, 1) + written(tmp_path / "b.csv", 3, 2)
    (tmp_path / "c.csv").write_text("id,one,two,three\n\n9001,short\n,,,\n9002,a,b,c,too,many\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = delimited.read_csv(spark, str(tmp_path))
        assert got.columns == ["id", "one", "two", "three", "_order"]
        if size:
            assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > (40 if size == 211 else 1)
        rows = [tuple(r)[:4] for r in got.orderBy("_order").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert rows == [tuple(r) for r in want] + [("9001", "short", "", ""), ("9002", "a", "b", "c")]
    one = [tuple(r)[:4] for r in delimited.read_whole(spark, str(tmp_path)).orderBy("_order").collect()]
    assert one == rows


def test_files_whose_quotes_do_not_pair_up(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,size\n1,5" pipe\n2,ok\n')
    (tmp_path / "b.csv").write_text('id,size\r\n3,"two\nlines"\r\n4,last\r\n')
    got = {r["id"]: r["size"] for r in delimited.read_csv(spark, str(tmp_path)).collect()}
    assert got == {"1": '5" pipe', "2": "ok", "3": "two\nlines", "4": "last"}
    (tmp_path / "a.csv").unlink()
    (tmp_path / "b.csv").write_text("id,size\n")
    assert delimited.read_csv(spark, str(tmp_path)).collect() == []


# Polling


def test_feeds_are_polled_once(spark, tmp_path):
    folder, out, archive, now = tmp_path / "in", tmp_path / "out", tmp_path / "archive", dt.datetime(2024, 5, 1)
    folder.mkdir()
    good = "Date,SKU,Qty\n2024-01-01,A,1\n2024-01-02,B,x\n"
    (folder / "SALES_1.CSV").write_text(good)
    (folder / "sales_empty.csv").write_text("")
    (folder / "sales 2.csv").write_text('Date,SKU,Qty\n"5 March\n2024",C,2\n')
    (folder / "other.txt").write_text("no\n")
    (folder / "sales_3.xlsx").write_bytes(b"no workbook")
    feed = ingest.Feed(4, 9, f"file://{folder}", "sales", "sales*", "archive", f"file://{archive}")
    missing = ingest.Feed(5, 9, f"file://{tmp_path}/none", "sales")
    failed = ingest.poll_all(spark, [missing, feed], f"file://{out}", f"file://{tmp_path}/checkpoint", now)
    assert set(failed) == {5}, failed
    ledger = lambda: {r["filename"].replace("%20", " "): (r["status"], r["rows"], r["rejected"]) for r in spark.read.parquet(f"file://{out}/ledger").collect()}
    want = {"SALES_1.CSV": ("imported", 2, 1), "sales_empty.csv": ("failed", None, None), "sales 2.csv": ("imported", 1, 0), "sales_3.xlsx": ("failed", None, None)}
    assert ledger() == want
    assert {r["error"] for r in spark.read.parquet(f"file://{out}/ledger").where("filename like '%empty%'").collect()} == {"Empty or unreadable remote file."}
    assert sorted(r["sku"] for r in spark.read.parquet(f"file://{out}/good").collect()) == ["A", "C"]
    ingest.poll(spark, feed, f"file://{out}", f"file://{tmp_path}/checkpoint", now)
    assert ledger() == want and (folder / "other.txt").exists()
    late = folder / "sales_late.csv"
    late.write_text(good)
    import os

    os.utime(late, (1_000_000_000, 1_000_000_000))  # older than all that was taken
    ingest.poll(spark, feed, f"file://{out}", f"file://{tmp_path}/checkpoint", now)
    assert ledger() == want | {"sales_late.csv": ("imported", 2, 1)}
    assert sorted(p.name for p in archive.rglob("*") if p.is_file() and not p.name.startswith("."))[:2] == ["SALES_1.CSV", "sales 2.csv"]


def test_patterns_of_any_case():
    assert ingest.any_case(" Sales_*.csv ") == "[sS][aA][lL][eE][sS]_*.[cC][sS][vV]" and ingest.any_case("") == "*"


# Databases


def test_reads_of_a_database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_partkey AS ID", "p_name AS NAME", "CAST(p_size AS INT) AS SIZE_OF")
    database.write_table(parts, url, "PARTS", options)
    table = database.read_table(spark, url, "PARTS", "ID", rows=20, parts=5, options=options)
    assert table.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, parts.collect()))
    some = table.where("SIZE_OF > 20 AND ID <= 100").select("NAME")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(SIZE_OF)" in plan and "*GreaterThan(SIZE_OF,20)" in plan and "ReadSchema: struct<NAME:string>" in plan
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, parts.where("SIZE_OF > 20 AND ID <= 100").select("NAME").collect()))
    one = database.read_table(spark, url, "(SELECT ID FROM PARTS WHERE ID < 10) q", "ID", options=options)
    assert one.rdd.getNumPartitions() == 1 and one.count() == parts.where("ID < 10").count()
    assert database.read_table(spark, url, "(SELECT ID FROM PARTS WHERE ID < 0) q", "ID", options=options).count() == 0


# Dates in words

T = dt.date(2024, 1, 31)  # a Wednesday
D = dt.date
DATES = {
    "2024-03-05": D(2024, 3, 5), "2024/3/5": D(2024, 3, 5), "20240305": D(2024, 3, 5), "3/5/2024": D(2024, 3, 5), "3/5/24": D(2024, 3, 5), "3/5/75": D(1975, 3, 5), "05-03-2024": D(2024, 3, 5), "5.3.2024": D(2024, 3, 5), "2024-03-05 14:30": D(2024, 3, 5),
    "2024-03-05T14:30:15.123Z": D(2024, 3, 5), "2024-03-05 14:30:15 +02:00": D(2024, 3, 5), "5 March 2024": D(2024, 3, 5), "5th march 2024": D(2024, 3, 5), "March 5, 2024": D(2024, 3, 5), "MAR 5TH 2024": D(2024, 3, 5), "5-Mar-2024": D(2024, 3, 5), "Mar-05-2024": D(2024, 3, 5),
    "2024-Mar-05": D(2024, 3, 5), "Tue, 5 Mar 2024": D(2024, 3, 5), "Tuesday, March 5 2024 3pm": D(2024, 3, 5), "5 Mar 2024 3:15 pm": D(2024, 3, 5), "Sept. 9, 2023": D(2023, 9, 9), "March 2024": D(2024, 3, 1), "2024-02-30": D(2024, 3, 1), "31 April 2024": D(2024, 5, 1),
    "@0": D(1970, 1, 1), "@1709596800": D(2024, 3, 5), "@-1": D(1969, 12, 31),
}
RELATIVE = {
    "today": T, " NOW ": T, "yesterday": D(2024, 1, 30), "Tomorrow": D(2024, 2, 1), "3 days ago": D(2024, 1, 28), "+1 week": D(2024, 2, 7), "2 weeks": D(2024, 2, 14), "-1 month": D(2023, 12, 31), "+ 1 month": D(2024, 3, 2), "next month": D(2024, 3, 2), "last year": D(2023, 1, 31), "a fortnight ago": D(2024, 1, 17),
    "two days ago": D(2024, 1, 29), "wednesday": T, "next wednesday": D(2024, 2, 7), "last wednesday": D(2024, 1, 24), "friday": D(2024, 2, 2), "this fri": D(2024, 2, 2), "last friday": D(2024, 1, 26), "next monday": D(2024, 2, 5), "first day of next month": D(2024, 2, 1), "last day of next month": D(2024, 2, 29),
    "last day of february 2023": D(2023, 2, 28), "first day of march": D(2024, 3, 1), "5 March": D(2024, 3, 5), "March 5": D(2024, 3, 5), "12th dec": D(2024, 12, 12),
}
NONE = ["", " ", None, "soon", "13/45/2024", "2024-13-01", "32 March 2024", "5 Marsh 2024", "0 March 2024", "2024", "12345", "the 5th", "3 daze ago", "next", "@x", "5", "March", "1.5", "2024-03-05 and more", "--"]


def test_dates_in_words(spark):
    read = lambda texts, today: {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", natural_date(F.col("t"), today).alias("d")).collect()}
    today = F.lit(T)
    assert read([*DATES, *RELATIVE], today) == DATES | RELATIVE
    assert read(DATES, None) == DATES and set(read(RELATIVE, None).values()) == {None}
    assert {k: v for k, v in read([x for x in NONE if x != "March"], today).items() if v is not None} == {}
    rows = spark.createDataFrame([("5th March 2024", "A", "1"), ("yesterday", "A", "1"), ("nonsense", "A", "1")], "date string, sku string, quantity string")
    got = [(r["date"], r["error"]) for r in imports.validate(rows, "sales", today=today).collect()]
    assert got == [(D(2024, 3, 5), None), (D(2024, 1, 30), None), (None, "Invalid date: date")]
    assert [r["error"] for r in imports.validate(rows, "sales").collect()] == [None, "Invalid date: date", "Invalid date: date"]


# Headers


def common(a, b):
    """Characters in common, by its definition: the first longest run, then left and right of it."""
    runs = [(n, i, j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]]
    if not runs:
        return 0
    longest = max(n for n, _, _ in runs)
    _, i, j = next(r for r in runs if r[0] == longest)
    return longest + common(a[:i], b[:j]) + common(a[i + longest :], b[j + longest :])


def test_headers_by_similarity(spark):
    from shelfsignal.plans.ingest_catalogue import CAT
    from shelfsignal.schema import FIELD_ORDER

    got = CAT.queries["fuzzy_header_scores"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["rows"] for r in got) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert len({r["confidence"] for r in got}) > 10 and any(r["field"] is None for r in got) and any(r["field"] for r in got)
    for r in got:
        plain = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "_" for c in r["header"].strip().lower())
        best, score = None, 0.0
        for field in FIELD_ORDER["sales"]:
            for alias in imports.ALIASES.get(field, (field,)):
                s = 2 * common(plain, alias) / (len(plain) + len(alias))
                if s > score + 1e-12:
                    best, score = field, s
        assert (r["field"], r["confidence"]) == (best if score >= 0.5 else None, round(score, 2)), r


# Intervals


def test_intervals_meet_their_points(spark):
    rng = random.Random(1)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    a = [(i, rng.choice("xyz"), day(rng.randint(0, 400)), day(rng.randint(0, 500))) for i in range(60)] + [(60, "x", None, day(5)), (61, None, day(0), day(400)), (62, "x", day(7), day(7))]
    p = [("x" if rng.random() < 0.9 else "y", day(rng.randint(-300, 900)), i) for i in range(2000)] + [("x", None, -1), (None, day(3), -2)]
    intervals, points = spark.createDataFrame(a, "id int, k string, low date, high date"), spark.createDataFrame(p, "k string, at date, v int")
    want = sorted((i, v) for i, k, low, high in a for q, at, v in p if k and k == q and low and at and low <= at <= high)
    for days in (1, 32, 10_000):
        found = interval_join(intervals, pruned(points, intervals, "low", "high", "at"), "k", "low", "high", "at", days)
        assert sorted((r["id"], r["v"]) for r in found.collect()) == want
    assert pruned(points, intervals, "low", "high", "at").count() < 1400
    assert interval_join(intervals.where("id = 60"), pruned(points, intervals.where("id = 60"), "low", "high", "at"), "k", "low", "high", "at").count() == 0


def test_history_is_not_read_whole(spark):
    """Outcome windows: the dates of the cases reach the scan, and the join is by SKU and bucket."""
    from shelfsignal.context import Context
    from shelfsignal.operators import outcomes

    sales = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("CAST(o_orderdate AS DATE) AS date", "o_orderpriority AS sku", "o_totalprice AS total_amount", "1 AS quantity", "1.0 AS unit_price")
    cases = spark.createDataFrame([(1, "1-URGENT", D(1999, 2, 1), D(1999, 2, 9))], "case_id long, sku string, detected_on date, done_on date")
    c = Context({"sales": sales, "cases": cases}, D(2001, 8, 1), dt.datetime(2001, 8, 1), 1)
    rows = outcomes.windows(c)
    assert rows.count() == 1
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Subquery" in text


# Watches on a stream


def test_a_watch_tells_once_over_restarts(spark, tmp_path):
    source, told = tmp_path / "events", []
    at = dt.datetime(2024, 1, 1)
    put = lambda n, rows: pd.DataFrame([(w, s, "e", 1, 2, None, at + dt.timedelta(minutes=i)) for i, (w, s) in enumerate(rows)], columns=["watch_id", "signature", "event", "investigation_id", "user_id", "team_id", "at"]).astype({"team_id": "Int64", "at": "datetime64[us]"}).to_parquet(source / f"{n}.parquet")
    source.mkdir()
    schema = "watch_id long, signature string, event string, investigation_id long, user_id long, team_id long, at timestamp_ntz"

    def run(send=lambda rows, n: told.extend((r["watch_id"], r["signature"]) for r in rows.collect())):
        stream.tell(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}"), send, f"file://{tmp_path}/checkpoint")

    put(1, [(1, "a"), (1, "a"), (2, "a")])
    put(2, [(1, "a"), (1, "b")])
    run()
    assert sorted(told) == [(1, "a"), (1, "b"), (2, "a")]
    put(3, [(2, "a"), (2, "b"), (1, "b")])

    def fails(rows, n):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(fails)
    run()  # the batch that was not finished is handed on again, the others are not
    assert sorted(told) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    run()
    assert len(told) == 4


def test_comments_become_events(spark, tmp_path):
    from shelfsignal.context import Context

    w = spark.createDataFrame([(1, 7, 5, None, True, ["comment"]), (2, 7, 6, None, True, ["recovery"]), (3, 7, None, 4, True, ["comment"]), (4, 7, 8, None, False, ["comment"])], "id long, investigation_id long, user_id long, team_id long, active boolean, triggers array<string>")
    comments = spark.createDataFrame([(100, 7, 5, dt.datetime(2024, 1, 1)), (101, 7, 9, dt.datetime(2024, 1, 1)), (102, 8, 9, dt.datetime(2024, 1, 1))], "id long, investigation_id long, author_id long, created_at timestamp_ntz")
    got = sorted((r["watch_id"], r["signature"]) for r in stream.comment_events(Context({"watches": w}, T, dt.datetime(2024, 1, 1), 1), comments).collect())
    assert got == [(1, "comment:101"), (3, "comment:100"), (3, "comment:101")]
    assert files.read_csv is delimited.read_csv
