"""Orientations between key frames, motion parameters and top assets against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.operators import motion as N
from sceneloom.operators import retrieval as R


def turn(axis, degrees):
    a = np.array(axis, float) / np.linalg.norm(axis)
    h = math.radians(degrees) / 2
    return [*(a * math.sin(h)).tolist(), math.cos(h)]


def rotate(q, v):
    x, y, z, w = q
    u = np.array([x, y, z])
    return v + 2 * np.cross(u, np.cross(u, v) + w * v)


@pytest.mark.parametrize("a, b, way", [(0, 90, 90), (0, 270, -90), (10, 10, 0), (10, 10.0000001, 0), (350, 20, 30), (0, 179, 179)])
def test_slerp_goes_the_short_way_at_an_even_pace(spark, a, b, way):
    axis = [1.0, 2.0, -0.5]
    df = spark.createDataFrame([(turn(axis, a), turn(axis, b), [-x for x in turn(axis, b)], u) for u in (0.0, 0.25, 0.5, 1.0)], "a array<double>, b array<double>, c array<double>, u double")
    v = np.array([0.3, -1.0, 2.0])
    for r in df.select("u", N.slerp(F.col("a"), F.col("b"), F.col("u")).alias("q"), N.slerp(F.col("a"), F.col("c"), F.col("u")).alias("p")).collect():
        want = rotate(turn(axis, a + way * r.u), v)
        assert np.allclose(rotate(r.q, v), want, atol=1e-6) and np.allclose(rotate(r.p, v), want, atol=1e-6)
        assert math.isclose(sum(x * x for x in r.q), 1, abs_tol=1e-9)


def test_frames_without_an_orientation_have_that_of_their_node(spark):
    base, other = turn([0, 0, 1], 90), turn([0, 1, 0], 60)
    frames = [(0.0, [0.0] * 3, None), (1.0, [1.0] * 3, [2 * x for x in other]), (3.0, [2.0] * 3, [0.0] * 4)]
    df = spark.createDataFrame([(frames, base)], "k array<struct<t:double,pos:array<double>,quat:array<double>>>, b array<double>")
    at = lambda t: df.select(N.keyframe_orientation(F.col("k"), F.col("b"), F.lit(t)).alias("q")).first().q
    assert np.allclose(at(-1.0), base) and np.allclose(at(0.0), base) and np.allclose(at(1.0), other) and np.allclose(at(9.0), [0, 0, 0, 1])
    half = at(0.5)
    assert np.isclose(abs(np.dot(half, base)), abs(np.dot(half, other)))


GUESS = "clip long, instance string, type string, axis array<double>, amp double, amp_deg double, period double, phase double, rate double, pivot array<double>, range_deg array<double>"


@pytest.mark.parametrize("phase", [0.2, 1.4, 2.0, 3.0, -2.5, -0.4])
def test_an_oscillation_is_recovered_on_its_branch(spark, phase):
    times = np.arange(0, 8, 0.1) + 0.7
    x = 5 + 2 * np.sin(2 * np.pi * times / 4 + phase)
    track = spark.createDataFrame([(1, "a", float(t), float(v), 1.0, 2.0) for t, v in zip(times, x)], "clip long, instance string, t double, x double, y double, z double")
    guess = spark.createDataFrame([(1, "a", "periodic_translate", [1.0, 0.0, 0.0], 2.0, None, 4.0, None, None, None, None)], GUESS)
    r = N.motion_from_guess(guess, track, ["clip", "instance"]).first()
    back = r.pos[0] + r.amp * np.sin(2 * np.pi * times / r.period + r.phase)
    assert np.abs(back - x).max() < 0.05


def test_hinges_spins_paths_and_what_says_nothing(spark):
    rows = [(1, n, float(t), float(t), 0.0, -float(t)) for n in "abcdef" for t in range(30)] + [(1, "g", 0.0, 0.0, 0.0, 0.0), (1, "h", 1.0, 0.0, 0.0, 0.0), (1, "h", 1.2, 1.0, 0.0, 0.0)]
    track = spark.createDataFrame(rows, "clip long, instance string, t double, x double, y double, z double")
    g = lambda n, kind, **v: (1, n, kind, *[v.get(k) for k in ("axis", "amp", "amp_deg", "period", "phase", "rate", "pivot", "range_deg")])
    guesses = [g("a", "revolute", pivot=[1.0, 0.0, 0.0], range_deg=[0.0, 70.0]), g("b", "revolute"), g("c", "spin", rate=-20.0), g("d", "unknown"), g("e", "periodic_rotate"), g("f", "prismatic"), g("g", "spin"), g("h", "revolute", pivot=[0.0, 0.0, 0.0])]
    got = {r.instance: r for r in N.motion_from_guess(spark.createDataFrame(guesses, GUESS), track, ["clip", "instance"]).collect()}
    assert set(got) == set("abcefh")
    a, h = got["a"], got["h"]
    assert (a.motion, a.range_deg, a.pivot, [tuple(s) for s in a.schedule]) == ("revolute", [0.0, 70.0], [1.0, 0.0, 0.0], [(0.0, 70.0, 29.0)])
    assert (h.range_deg, [tuple(s) for s in h.schedule]) == ([0.0, 90.0], [(1.0, 90.0, 0.5)])
    assert got["b"].motion == got["f"].motion == "trajectory" and (got["c"].motion, got["c"].rate) == ("spin", -20.0)
    assert (got["e"].amp, got["e"].period, got["e"].phase) == (30.0, 58.0, 0.0)
    even = np.unique(np.round(np.linspace(0, 29, 12)).astype(int))
    assert [k.t for k in got["f"].keyframes] == even.tolist() and got["f"].keyframes[3].pos == [even[3], 0.0, -even[3]]


@pytest.mark.parametrize("k, query_block, asset_block", [(1, 3, 5), (5, 100, 7), (24, 4, 10_000), (1_000, 4, 30)])
def test_top_assets_are_those_of_scoring_all(spark, k, query_block, asset_block):
    rnd = random.Random(k)
    words = "red ball box chair sofa couch mug cup small tower gate wall block 3 bus buses plant pot".split()
    common = ["thing", "toy"]
    phrase = lambda n: " ".join(rnd.choice(words if rnd.random() < 0.6 else common) for _ in range(rnd.randrange(1, n)))
    assets = spark.createDataFrame([(i, phrase(5), rnd.choice(["train", "house", "cup"]), phrase(3)) for i in range(160)], "asset_id long, name string, kit string, kit_title string")
    queries = spark.createDataFrame([(q,) for q in {phrase(5) for _ in range(40)} | {"zzz", "", "the of", "train ball"}], "query string")
    want = R.retrieve(R.score_assets(queries, assets), None, k)
    got = R.retrieve(R.top_assets(queries, assets, k, query_block, asset_block), None, k)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and got.count() > 20


def test_few_assets_leave_a_block(spark):
    assets = spark.range(3_000).selectExpr("id AS asset_id", "concat('thing number ', id % 50) AS name", "'k' AS kit", "'toy' AS kit_title")
    queries = spark.range(20).selectExpr("concat('thing number ', id) AS query")
    assert R.score_assets(queries, assets).count() == 60_000 and R.top_assets(queries, assets, 5, asset_block=1_000).count() == 100
