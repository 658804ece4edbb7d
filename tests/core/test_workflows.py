"""The evaluation table and declared motions on hand-made cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from sceneloom.operators import evaluation
from sceneloom.operators.motion import sample_motion, schedule_value
from sceneloom.plans.workflows import evaluate_states, w3_retrieval_audit


def states(spark, rows):
    return spark.createDataFrame(rows, "clip long, instance string, t double, x double, y double")


def table(spark, truth, guess, limit=1.0):
    config = spark.createDataFrame([(1, "c")], "clip long, config string")
    return {r.window: r for r in evaluate_states(states(spark, truth), states(spark, guess), "clip", "instance", config, limit).collect()}


def two(shift=0.0, end=10):
    return [(1, n, float(t), x + 0.1 * t + shift, 0.0) for n, x in (("a", 0.0), ("b", 5.0)) for t in range(end + 1)]


def test_evaluating_the_truth_against_itself(spark):
    got = table(spark, two(), two())
    assert all(r.recall == 1 and r.precision == 1 and abs(r.median_error) < 1e-9 and r.matched == 2 for r in got.values())


def test_missing_and_extra_objects(spark):
    got = table(spark, two(), [r for r in two() if r[1] == "a"])
    assert all(r.recall == 0.5 and r.precision == 1 for r in got.values())
    extra = two() + [(1, "z", float(t), 90.0, 0.0) for t in range(11)]
    assert all(r.recall == 1 and math.isclose(r.precision, 2 / 3) for r in table(spark, two(), extra).values())


def test_a_turned_and_shifted_run_is_aligned_by_its_fit_window(spark):
    rows = [(1, n, float(t), x + 0.1 * t, y) for n, x, y in (("a", 0.0, 0.0), ("b", 5.0, 1.0), ("c", 2.0, 7.0)) for t in range(11)]
    turned = [(c, n, t, -y + 30.0, x - 4.0) for c, n, t, x, y in rows]
    config = spark.createDataFrame([(1, "c")], "clip long, config string")
    run = lambda guess, **k: {r.window: r for r in evaluate_states(states(spark, rows), states(spark, guess), "clip", "instance", config, 1.0, **k).collect()}
    assert all(r.matched == 0 for r in run(turned).values())
    got = run(turned, gauge=0.5)
    assert all(r.matched == 3 and r.median_error < 1e-9 for r in got.values())
    spoiled = [(c, n, t, x + (50 if t > 8 else 0), y) for c, n, t, x, y in turned]
    assert run(spoiled, gauge=0.5)["fit"] == got["fit"]


def test_nothing_after_the_cut_reaches_the_fit(spark):
    spoiled = [(c, n, t, x * (100 if t > 8 else 1), y) for c, n, t, x, y in two(0.25)]
    a, b = table(spark, two(), two(0.25))["fit"], table(spark, two(), spoiled)["fit"]
    assert a == b and math.isclose(a.median_error, 0.25, abs_tol=1e-6)
    assert table(spark, two(), spoiled)["holdout"].median_error > 1


def test_tracks_that_end_early_are_not_judged_in_the_holdout(spark):
    got = table(spark, two(), two(end=8))
    assert got["fit"].matched == 2 and got["holdout"].matched == 0 and got["holdout"].median_error is None


def test_schedules_hold_and_key_frames_curve(spark):
    def plain(schedule, start, t):
        value = prev = start
        for at, to, d in schedule:
            if t < at:
                return value
            if t < at + d:
                return prev + (to - prev) * (t - at) / d
            value = prev = to
        return value

    schedule = [(1.0, 4.0, 2.0), (2.0, -1.0, 1.0), (5.0, 3.0, 0.5)]
    rows = spark.createDataFrame([(float(t), [dict(t=a, to=b, duration=c) for a, b, c in schedule]) for t in np.arange(0, 7, 0.25)], "t double, s array<struct<t:double,to:double,duration:double>>")
    for r in rows.select("t", schedule_value(F.col("s"), F.lit(0.5), F.col("t")).alias("v")).collect():
        assert math.isclose(r.v, plain(schedule, 0.5, r.t), abs_tol=1e-12)
    frames = [dict(t=float(i), pos=[float(i), float(i % 2), 0.0]) for i in range(4)]
    n = spark.createDataFrame([(1, 1, "trajectory", [9.0, 9.0, 9.0], [0.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0], 0.0, 0.0, 0.0, 1.0, 0.0, [], frames, smooth) for smooth in (True, False)] + [(1, 2, "spin", [1.0, 2.0, 3.0], [0.0, 0.0, 0.0, 1.0], [0.0, 2.0, 0.0], 0.0, 90.0, 0.0, 1.0, 0.0, [], [], False)],
        "clip long, node long, motion string, pos array<double>, quat array<double>, axis array<double>, start double, rate double, amp double, period double, phase double, schedule array<struct<t:double,to:double,duration:double>>, keyframes array<struct<t:double,pos:array<double>>>, smooth boolean")
    got = sample_motion(n, F.array(F.lit(-1.0), F.lit(1.0), F.lit(1.5), F.lit(9.0))).collect()
    at = lambda t: [r.pos for r in got if r.node == 1 and r.t == t]
    assert at(-1.0) == [[0.0, 0.0, 0.0]] * 2 and at(9.0) == [[3.0, 1.0, 0.0]] * 2
    assert np.allclose(at(1.0), [[1.0, 1.0, 0.0]] * 2) and np.allclose(at(1.5), [[1.5, 0.5, 0.0]] * 2)
    spin = next(r for r in got if r.node == 2 and r.t == 1.0)
    assert spin.pos == [1.0, 2.0, 3.0] and np.allclose(spin.quat, [0, math.sqrt(0.5), 0, math.sqrt(0.5)])


def test_every_part_of_an_object_is_asked_for(spark, tmp_path):
    parts = [(k, f"name{k} thing{k}", "Brand#1", "TYPE") for k in (7, 2_500, 9_001)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 7, 1, "O"), (1, 2_500, 2, "O"), (2, 2_500, 1, "O"), (3, 9_001, 1, "O"), (4, 7, 1, "F")]
    li = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_linestatus string").selectExpr(
        "*", "1L AS l_suppkey", "1D AS l_quantity", "1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "DATE'2020-01-01' AS l_shipdate")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.query: (r.objects, r.clips, r.same_name) for r in w3_retrieval_audit(spark, str(tmp_path)).collect()}
    assert got == {"name7 thing7": (1, 1, True), "name2500 thing2500": (2, 2, True), "name9001 thing9001": (1, 1, True)}


def test_middle_of_follow_errors_without_lists(spark, monkeypatch):
    """No list of a mode's values is made, and the median is that of all of them."""
    def refuse(*_):
        raise AssertionError("a whole mode in one list")

    monkeypatch.setattr(F, "collect_list", refuse)
    rnd, inf, nan = np.random.default_rng(3), math.inf, math.nan
    cases = {"many": rnd.normal(size=2_000).tolist(), "even": [1.0, 2.0, 3.0, 4.0], "one": [0.5], "same": [2.0] * 7, "skew": [0.0] * 5 + [1e9] * 4 + [1e-9 * k for k in range(9)],
             "odd": [-inf, -inf, 1.0, inf, nan], "ends": [-1.7e308, 1.7e308, 0.0], "infinite": [inf, inf, -inf], "gaps": [None, 3.0, None, 1.0], "none": [None, None], None: [4.0, 6.0, 5.0]}
    rows = [(m, 1.0, v, 0.0) for m, vs in cases.items() for v in vs]
    got = {r["mode"]: r for r in evaluation.interaction_summary(spark.createDataFrame(rows, "mode string, lift double, follow double, speed double"), "mode", "lift", "follow", "speed").collect()}
    assert set(got) == set(cases)
    for m, vs in cases.items():
        known = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
        assert got[m].n == len(vs) and got[m].follow_error == (known[(len(known) - 1) // 2] if known else None), m
