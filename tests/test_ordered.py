"""Window forms against sequential loops, with contexts whole and cut in chunks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import sequential
from gaugeline.operators.layout import Layout, context, dense_index, last_marks, measure, number_rows, with_previous
from gaugeline.operators.rules import decode_ruleset, judge, violations
from gaugeline.operators.statistics import exact_median
from gaugeline.operators.subgroups import form_subgroups, sequence_rows

SCHEMA = "k string, row_number int, event_timestamp timestamp_ntz, value double, subgroup_id string"


def make_rows(seed, lengths, missing_times=False):
    rng, rows = random.Random(seed), []
    for c, n in enumerate(lengths):
        at = datetime(2026, 1, 1)
        for i in range(n):
            at += timedelta(seconds=rng.choice([0, 60, 600, 1800, 3600, 3601, 9000]))
            ts = None if missing_times and rng.random() < 0.15 else at
            rows.append((f"c{c}", i, ts, float(rng.choice([9, 10, 11, 12, rng.gauss(10, 2)])), f"g{rng.randrange(max(n // 3, 1))}"))
    rng.shuffle(rows)
    return rows


LAYOUTS = [None, 6, 17]


def framed(spark, rows, chunk):
    df = context(spark.createDataFrame(rows, SCHEMA), ["k"]).drop("k")
    return df, Layout(chunk, len(rows), 5)


def ordered(rows):
    by = {}
    for k, n, ts, v, g in rows:
        by.setdefault(k, []).append((ts is None, ts or datetime.min, n, ts, v, g))
    return {
        k: [(i, r[3], r[4], r[5]) for i, r in enumerate(sorted(items), start=1)] for k, items in by.items()
    }


@pytest.mark.parametrize("chunk", LAYOUTS)
def test_primitives(spark, chunk):
    rows = make_rows(1, [1, 5, 6, 7, 40])
    df, layout = framed(spark, rows, chunk)
    numbered = number_rows(df, layout, [F.col("event_timestamp"), F.col("row_number")])
    moved = with_previous(numbered, layout, "seq", {"before": "value"})
    marked = last_marks(moved, layout, "seq", {"mark": F.col("value") == 10.0})
    thinned = dense_index(marked.filter("seq % 3 != 1"), layout, "seq", "dense")
    got = {(r.ctx.k, r.seq): (r.value, r.before, r.mark) for r in marked.collect()}
    dense = {(r.ctx.k, r.seq): r.dense for r in thinned.collect()}
    for k, items in ordered(rows).items():
        last, count, before = None, 0, None
        for seq, _, value, _ in items:
            last = seq if value == 10.0 else last
            assert got[(k, seq)] == (value, before, last)
            before = value
            if seq % 3 != 1:
                count += 1
                assert dense[(k, seq)] == count


@pytest.mark.parametrize("chunk", LAYOUTS)
@pytest.mark.parametrize("method", ["CONSECUTIVE", "FIXED_SIZE", "TIME_WINDOW", "EXISTING_ID"])
@pytest.mark.parametrize("missing", [False, True])
def test_subgroups(spark, method, chunk, missing):
    rows = make_rows(7, [1, 4, 5, 23, 90], missing)
    df, layout = framed(spark, rows, chunk)
    size, gap = 5, 3600
    numbered = sequence_rows(df, layout, ["row_number"]).withColumns(
        {"subgroup_size": F.lit(size), "subgroup_method": F.lit(method), "maximum_time_gap_seconds": F.lit(gap)}
    )
    got = {}
    for r in form_subgroups(numbered, layout, [method]).orderBy("subgroup_index").collect():
        got.setdefault(r.ctx.k, []).append(
            (r.subgroup_index, r.first_seq, r["count"], r.mean, r.range, r.std_dev, r.subgroup_id)
        )
    for k, items in ordered(rows).items():
        plain = [(s, t, v) for s, t, v, _ in items]
        if method == "CONSECUTIVE":
            groups = sequential.consecutive(plain, size, gap)
        elif method == "FIXED_SIZE":
            groups = sequential.fixed(plain, size)
        elif method == "TIME_WINDOW":
            groups = sequential.windows(plain, size, gap)
        else:
            named = {}
            for s, t, v, g in items:
                named.setdefault(g, []).append((s, t, v))
            groups = list(named.values())
        want = sequential.statistics_of(groups)
        assert len(want) == len(got.get(k, []))
        for w, g in zip(want, got.get(k, [])):
            assert w[:3] == g[:3]
            assert g[3:6] == pytest.approx(w[3:6])
            if method != "EXISTING_ID":
                assert g[6] == f"SG-{w[0]:05d}"


def test_rows_keep_their_order_unless_all_have_times(spark):
    rows = [("a", 1, datetime(2026, 1, 2), 1.0, None), ("a", 2, datetime(2026, 1, 1), 2.0, None),
            ("b", 1, datetime(2026, 1, 2), 1.0, None), ("b", 2, None, 2.0, None), ("b", 3, datetime(2026, 1, 1), 3.0, None)]
    df, layout = framed(spark, rows, None)
    got = sequence_rows(df, layout, ["row_number"], stored_order=False).orderBy("ctx", "seq").collect()
    assert [(r.ctx.k, r.value) for r in got] == [("a", 2.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]


def test_time_window_accepts_unsorted_times(spark):
    at = datetime(2026, 1, 1)
    hours = [5, 0, 1, 9, 2, 2, 2, 2, 20, 3]
    rows = [("a", i, at + timedelta(hours=h), float(i), None) for i, h in enumerate(hours)]
    df, _ = framed(spark, rows, None)
    for layout in (Layout(None, 10, 1), Layout(4, 10, 1)):
        numbered = number_rows(df, layout, [F.col("row_number")]).withColumns(
            {"subgroup_size": F.lit(3), "subgroup_method": F.lit("TIME_WINDOW"), "maximum_time_gap_seconds": F.lit(3600)}
        )
        got = [(r.first_seq, r["count"]) for r in form_subgroups(numbered, layout, ["TIME_WINDOW"]).orderBy("first_seq").collect()]
        plain = [(i + 1, at + timedelta(hours=h), float(i)) for i, h in enumerate(hours)]
        assert got == [(g[0][0], len(g)) for g in sequential.windows(plain, 3, 3600)]


RULES = (
    '[{"rule_name":"TREND_INCREASING","parameters":{"consecutive_points":3}},'
    '{"rule_name":"TREND_DECREASING","severity":"CRITICAL","parameters":{"consecutive_points":4}},'
    '{"rule_name":"RUN_SAME_SIDE","parameters":{"consecutive_points":2}},'
    '{"rule_name":"POINT_OUTSIDE_LIMITS"},'
    '{"rule_name":"TREND_INCREASING","parameters":{"consecutive_points":1}}]'
)


@pytest.mark.parametrize("chunk", LAYOUTS)
def test_rules(spark, chunk):
    rng = random.Random(3)
    series = {f"c{c}": [float(rng.choice([8, 9, 10, 10, 11, 12, 13])) for _ in range(n)] for c, n in enumerate([1, 2, 30, 120])}
    series["up"] = [float(i) for i in range(50)]
    series["flat"] = [10.0] * 20
    rows = [(k, i + 1, v) for k, values in series.items() for i, v in enumerate(values)]
    points = context(spark.createDataFrame(rows, "k string, point_number long, mean double"), ["k"]).withColumns(
        {"center_line": F.lit(10.0), "ucl": F.lit(12.0), "lcl": F.lit(9.0), "chart_type": F.lit("IMR"),
         "ruleset": decode_ruleset(F.lit(RULES))}
    )
    found = violations(judge(points, Layout(chunk, len(rows), 6))).collect()
    got = sorted((r.ctx.k, r.rule_position, r.start_index, r.end_index, r.severity) for r in found)
    want = []
    for k, values in series.items():
        want += [(k, 0, s, e, "WARNING") for s, e in sequential.rising(values, 3)]
        want += [(k, 1, s, e, "CRITICAL") for s, e in sequential.falling(values, 4)]
        want += [(k, 2, s, e, "WARNING") for s, e in sequential.same_side(values, 10.0, 2)]
        want += [(k, 3, i, i, "WARNING") for i, v in enumerate(values) if v > 12 or v < 9]
    assert got == sorted(want)
    assert all(r.affected_points == list(range(r.start_index, r.end_index + 1)) for r in found)


@pytest.mark.parametrize("chunk", [None, 5, 40])
def test_exact_median(spark, chunk):
    import statistics

    rng = random.Random(11)
    data = {
        "skew": [rng.expovariate(1) ** 4 for _ in range(501)],
        "even": [rng.gauss(0, 1) for _ in range(300)],
        "ties": [1.0] * 200 + [2.0] * 150 + [9e9] * 50,
        "split": [1.0] * 60 + [5.0] * 60,
        "one": [3.0],
    }
    df = context(spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, value double"), ["k"])
    layout = measure(df, chunk) if chunk else Layout()
    got = {r.ctx.k: r.median for r in exact_median(df.select("ctx", "value"), layout).collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in data.items()})


def test_measure_decides_by_the_largest_context(spark):
    df = context(spark.createDataFrame([("a",)] * 7 + [("b",)], "k string"), ["k"])
    assert measure(df, 7).chunk_rows is None
    assert measure(df, 6).chunk_rows == 6
    assert measure(df, 6).contexts == 2
