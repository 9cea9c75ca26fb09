import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from rankloom.llm import retention

START, CUT, EPOCH = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, client int, part int, digest string, known int, n int, first0 int, parts int, crc int"
CLIENTS = "client_id long, source string, segment string, client int, n int"


def crc(x):
    return zlib.crc32(str(x).encode())


def brute(clicks, clients):
    rows = {r[:7] for r in clicks if r[1] is not None and r[3] is not None}
    sources = defaultdict(list)
    for c, s, *_ in clients:
        if s is not None:
            sources[c].append(s)
    known = [[], []]
    for r in rows:
        h = 1 if r[0] is None else crc(r[0])
        known[1].append(r)
        if r[2] is not None and r[2] + timedelta(days=h % 100 if h % 3 == 0 else 0) < CUT:
            known[0].append(r)
    first = [{}, {}]
    for state in (0, 1):
        for r in known[state]:
            if r[4] == "error":
                first[state][r[3]] = min(r[1], first[state].get(r[3], r[1]))
    week = timedelta(days=7)
    cohort = [{c: (t - EPOCH) // week for c, t in f.items()} for f in first]
    users, cents = defaultdict(set), defaultdict(int)
    for state in (0, 1):
        for r in known[state]:
            c = r[3]
            if c in first[state] and r[1] >= first[state][c]:
                key = (state, min(sources[c], default=""), cohort[state][c], (r[1] - first[state][c]) // week)
                users[key].add(c)
                cents[key] += 0 if r[5] is None else int((100 * r[5] + 0.5) // 1)
    moved = {c for c in cohort[0] if c in cohort[1] and cohort[0][c] != cohort[1][c]}
    return sorted((*k, len(u), sum(map(crc, u)), len(u & moved), cents[k]) for k, u in users.items())


def some(n, seed, hot=0.4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = START + timedelta(microseconds=rng.randrange(0, 120 * 86_400_000_000)) if rng.random() < 0.8 else START + timedelta(days=7 * rng.randrange(12))
        client = 7 if rng.random() < hot else rng.choice([None, *range(30)])
        rows.append((None if i % 41 == 0 else i, None if i % 37 == 0 else ts, None if i % 29 == 0 else ts + timedelta(hours=rng.randrange(200)), client, rng.choice(["error", "view", "click", None]), rng.choice([None, 0.005, -3.455, 12.0, round(rng.uniform(-9, 99), 2)]), rng.choice([None, "", "{}", '{"k": 1}'])))
    rows += rng.sample(rows, n // 5)  # repeated rows
    rows += [(*r[:6], "other") for r in rng.sample(rows, n // 20)]  # the same but for one column
    rng.shuffle(rows)
    return [(*r, 1, 2, "x", 3, 4, 5, 6, 7) for r in rows]


@pytest.fixture(scope="module")
def clients():
    return [(i, ["crm", "web", None, ""][i % 4], "s", 1, 2) for i in range(25)] + [(3, "app", "s", 1, 2), (3, None, "s", 1, 2), (None, "crm", "s", 1, 2)]


@pytest.mark.parametrize("seed,least", [(1, 1024), (2, 3), (3, 40)])
def test_cells(spark, clients, monkeypatch, seed, least):
    monkeypatch.setattr(retention, "LEAST", least)  # the smaller, the more clients are split
    monkeypatch.setattr(retention, "SHARES", 1024)
    clicks = some(900, seed)
    got = retention.retention(spark.createDataFrame(clicks, CLICKS).repartition(5), spark.createDataFrame(clients, CLIENTS))
    assert sorted(map(tuple, got.collect())) == brute(clicks, clients)


def test_batches_of_any_size(spark, clients):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    clicks = some(300, 4)
    want = brute(clicks, clients)
    try:
        for size in ("1", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS)).collect()
            assert sorted(map(tuple, got)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_zone_of_the_session_plays_no_part(spark, clients):
    clicks = some(200, 5)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        got = retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got)) == brute(clicks, clients)


def test_no_rows(spark, clients):
    no_clicks, no_clients = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert retention.retention(no_clicks, no_clients).count() == 0
    assert retention.retention(no_clicks, spark.createDataFrame(clients, CLIENTS)).count() == 0
    clicks = some(60, 6)
    assert sorted(map(tuple, retention.retention(spark.createDataFrame(clicks, CLICKS), no_clients).collect())) == brute(clicks, [])
    views = [(*r[:4], "view", *r[5:]) for r in clicks]
    assert retention.retention(spark.createDataFrame(views, CLICKS), no_clients).count() == 0
