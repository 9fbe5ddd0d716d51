"""Skew-safe ordered operators against brute force, with one hot key and tiny slices."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, workload

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def points():
    """A third of the rows on one key, many equal times and values, null keys."""
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        at = START + dt.timedelta(minutes=rng.choice([rng.randrange(4000), 77]))
        rows.append((i, key, at, rng.choice([0, 0, rng.randrange(50)])))
    return rows


@pytest.fixture
def frame(spark, points):
    return spark.createDataFrame(points, "id long, k string, at timestamp_ntz, v long")


def by_key(points):
    groups = {}
    for row in points:
        groups.setdefault(row[1], []).append(row)
    return groups


def test_running_totals(frame, points):
    instants = frame.groupBy("k", "at").agg(F.sum("v").alias("v"))
    rows = ordered.running_totals(instants, ["k"], "at", F.date_trunc("hour", "at"), ["v"]).collect()
    assert len(rows) == len({(p[1], p[2]) for p in points})
    for r in rows:
        assert r.run_v == sum(p[3] for p in points if p[1] == r.k and p[2] <= r.at)


def test_positions(frame, points):
    got = {r.id: r.pos for r in ordered.with_positions(frame, ["k"], ["v", "id"]).collect()}
    want = {p[0]: i for rows in by_key(points).values() for i, p in enumerate(sorted(rows, key=lambda p: (p[3], p[0])))}
    assert got == want


@pytest.mark.parametrize("block", [4, 7, 100_000])
def test_moving_mean(frame, points, block):
    got = {r.id: r.moving_mean for r in ordered.moving_mean(frame, ["k"], ["at", "id"], "v", 4, block).collect()}
    assert len(got) == len(points)
    for rows in by_key(points).values():
        rows = sorted(rows, key=lambda p: (p[2], p[0]))
        for i, p in enumerate(rows):
            assert got[p[0]] == pytest.approx(np.mean([q[3] for q in rows[max(0, i - 3) : i + 1]]))


def test_as_of(spark, frame, points):
    facts = frame.filter("id % 5 = 0").select("k", "at", F.col("id").alias("fact_id"))
    asked = frame.filter("id % 5 <> 0").select("id", "k", "at")
    rows = ordered.as_of(asked, facts, ["k"], "at", ["fact_id"], F.date_trunc("hour", "at")).collect()
    assert len(rows) == sum(p[0] % 5 != 0 for p in points)
    for r in rows:
        times = [p[2] for p in points if p[0] % 5 == 0 and p[1] == r.k and p[2] <= r.at]
        assert r.fact_at == (max(times) if times else None)


def test_sessions(frame, points):
    got = {(r.k, r.session_start): (r.session_end, r.n_rows, r.v) for r in ordered.sessions(frame, ["k"], "at", 1800, {"v": F.col("v")}).collect()}
    want = {}
    for key, rows in by_key(points).items():
        run = []
        for p in [*sorted(rows, key=lambda p: p[2]), None]:
            if run and (p is None or (p[2] - run[-1][2]).total_seconds() > 1800):
                want[(key, run[0][2])] = (run[-1][2], len(run), sum(q[3] for q in run))
                run = []
            run.append(p)
    assert got == want


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_exact_percentiles(frame, points, width):
    rows = ordered.exact_percentiles(frame, ["k"], "v", [0.0, 0.5, 0.95, 1.0], width).collect()
    groups = by_key(points)
    assert {r.k for r in rows} == set(groups)
    for r in rows:
        values = [p[3] for p in groups[r.k]]
        assert [r.p0, r.p50, r.p95, r.p100] == pytest.approx(np.quantile(values, [0, 0.5, 0.95, 1]))


@pytest.mark.parametrize("tiles", [10, 3, 500])
def test_deciles(frame, points, tiles):
    got = {r.id: (r.tile, r.percent_rank) for r in ordered.deciles(frame, ["k"], "v", ["id"], tiles).collect()}
    for rows in by_key(points).values():
        rows = sorted(rows, key=lambda p: (p[3], p[0]))
        n = len(rows)
        sizes = [n // tiles + (i < n % tiles) for i in range(tiles)]
        tile_of = [i + 1 for i, size in enumerate(sizes) for _ in range(size)]
        for i, p in enumerate(rows):
            below = sum(q[3] < p[3] for q in rows)
            assert got[p[0]] == (tile_of[i], pytest.approx(below / (n - 1)))


@pytest.mark.parametrize("block", [1, 2, 7, 100_000])
def test_first_positions_across_blocks(spark, block):
    """Runs of equal values that begin in a block, span blocks, or are null."""
    rng, rows = random.Random(block), []
    for key in ("a", "b", None):
        values = sorted(rng.choice([1, 1, 1, 2, 3, 8]) for _ in range(40)) if key else [5] * 30
        values = [None] * 9 + values if key == "a" else values
        rows += [(key, i, v) for i, v in enumerate(values)]
    placed = spark.createDataFrame(rows, "k string, pos long, v int")
    got = {(r.k, r.pos): r.first_pos for r in ordered._with_first_positions(placed, ["k"], "v", block).collect()}
    assert got == {(k, i): min(j for q, j, w in rows if q == k and w == v) for k, i, v in rows}


def test_deciles_join_on_no_value(spark, frame):
    plan = ordered.deciles(frame, ["k"], "v", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "(v#" in line]


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(9)
    rows = []
    for i in range(600):
        user = "hot" if i % 3 == 0 else rng.choice(["a", "b"])
        rows.append((f"q{i}", user, START + dt.timedelta(minutes=rng.randrange(3000)), rng.choice([0, 60_000, rng.randrange(9_000_000)])))
    return rows


def test_overlap_counts(spark, runs):
    log = spark.createDataFrame(runs, "query_id string, user_name string, ts_start timestamp_ntz, query_time_ms long")
    got = {r.query_id: r.n_overlapping for r in workload.overlap_counts(log, ["user_name"]).collect()}
    timed = [(q, u, s, s + dt.timedelta(milliseconds=ms)) for q, u, s, ms in runs if ms > 0]
    want = {q: sum(u == v and p != q and s < f and b < e for p, v, b, f in timed) for q, u, s, e in timed}
    assert got == {q: 0 for q, *_ in runs} | want


def test_concurrency_counts_runs_from_the_day_before(spark):
    rows = [("g", START + dt.timedelta(hours=23), 7_200_000), ("g", START + dt.timedelta(hours=23, minutes=30), 7_200_000),
            ("g", START + dt.timedelta(hours=25), 60_000)]
    log = spark.createDataFrame(rows, "rg_name string, ts_start timestamp_ntz, query_time_ms long")
    groups = spark.createDataFrame([("g", 1)], "rg_name string, concurrency_limit int")
    peaks = {str(r.day): (r.peak, r.over_limit) for r in workload.concurrency_peaks(log, groups).collect()}
    # The first run ends at 01:00 exactly when the third starts.
    assert peaks == {"2024-01-01": (2, True), "2024-01-02": (2, True)}


def test_classification_rules(spark):
    log = spark.createDataFrame(
        [("q1", "u", "r", "query", "ip", "d"), ("q2", "u", "x", None, "ip", "e"), ("q3", None, None, None, None, None)],
        "query_id string, user_name string, role_name string, query_type string, client_ip string, db string",
    )
    rules = spark.createDataFrame(
        [(5, "one", "u", None, None, None, None), (4, "low", "u", None, None, None, None), (9, "two", "u", "r", None, None, None),
         (1, "never", None, None, None, None, None), (2, "db", None, None, None, None, "e")],
        "classifier_id int, rg_name string, user_name string, role_name string, query_type string, source_ip string, db string",
    )
    got = {r.query_id: r.rg_name for r in workload.classify(log, rules).collect()}
    assert got == {"q1": "two", "q2": "db", "q3": "rg_default"}
    assert {r.rg_name for r in workload.classify(log, rules.limit(0)).collect()} == {"rg_default"}


def test_a_run_without_end_keeps_counting(spark):
    rows = [("g", START, None), ("g", START + dt.timedelta(days=1), 60_000)]
    log = spark.createDataFrame(rows, "rg_name string, ts_start timestamp_ntz, query_time_ms long")
    groups = spark.createDataFrame([("g", 0)], "rg_name string, concurrency_limit int")
    peaks = {str(r.day): (r.peak, r.over_limit) for r in workload.concurrency_peaks(log, groups).collect()}
    assert peaks == {"2024-01-01": (1, False), "2024-01-02": (2, False)}


def test_group_rows_fold_to_the_first_limit_set(spark):
    rows = spark.createDataFrame([("a", 1, "", "0"), ("a", 2, "10", None), ("a", 3, "20", "7"), ("b", 1, None, "0")], "rg_name string, at int, cpu string, mem string")
    assert {tuple(r) for r in workload.fold_group_rows(rows, "at").collect()} == {("a", "10", "7"), ("b", None, None)}


def test_a_day_between_start_and_end_counts(spark):
    log = spark.createDataFrame([("q", "g", dt.datetime(2024, 1, 1, 12), 2 * 86_400_000)], "query_id string, rg_name string, ts_start timestamp_ntz, query_time_ms long")
    groups = spark.createDataFrame([("g", 1)], "rg_name string, concurrency_limit int")
    assert sorted((r.day.day, r.peak) for r in workload.concurrency_peaks(log, groups).collect()) == [(1, 1), (2, 1), (3, 1)]
