"""Chunked and plain plans give the same rows, and both agree with a plain Python reading."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pairlane.operators import ordered as O, series as S
from pairlane.operators.steps import apply_steps, fill_small_gaps, majority5, remove_teleports, rolling, savgol, sg_matrix, sustained


def frame(spark, xs, ys=None, clip=1):
    f = lambda v: None if v is None or v != v else float(v)
    ys = xs if ys is None else ys
    return spark.createDataFrame([(clip, i, f(x), f(y)) for i, (x, y) in enumerate(zip(xs, ys))], "clip long, frame int, x double, y double")


def column(df, c, order="frame"):
    return [r[c] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def noisy():
    g = np.random.default_rng(3)
    x = np.cumsum(g.normal(0, 1, 300))
    x[g.random(300) < 0.08] = np.nan
    x[100:109] = np.nan
    return x


@pytest.mark.parametrize("size", [7, 32, 1000])
def test_running_and_islands_do_not_depend_on_chunks(spark, noisy, size):
    d = frame(spark, noisy)
    spec = {"s": ("sum", F.coalesce("x", F.lit(0.0))), "l": ("last", F.col("x")), "m": ("max", F.col("x"))}
    with O.layout(True):
        ref = [tuple(r) for r in O.running(d, ["clip"], spec).orderBy("frame").select("s", "l", "m").collect()]
        isl = sorted(map(tuple, O.islands(d, ["clip"], F.col("x").isNotNull(), 1, 2).collect()))
    got = [tuple(r) for r in O.running(d, ["clip"], spec, size=size).orderBy("frame").select("s", "l", "m").collect()]
    assert all(a[1:] == b[1:] and (a[0] is None) == (b[0] is None) and abs((a[0] or 0) - (b[0] or 0)) < 1e-9 for a, b in zip(ref, got))
    assert sorted(map(tuple, O.islands(d, ["clip"], F.col("x").isNotNull(), 1, 2, size=size).collect())) == isl
    back = O.running(d, ["clip"], {"l": ("last", F.col("x"))}, size=size, reverse=True)
    want, last = [], None
    for v in noisy[::-1]:
        last = None if last is None and v != v else (last if v != v else v)
        want.append(last)
    assert column(back, "l") == want[::-1]


def test_chain_is_chunk_free(spark, noisy):
    d = frame(spark, noisy, noisy * 0.5 + 1)
    chain = lambda size: column(S.sg_derivatives(d, ["clip"], size=size), "residual")
    a, b = chain(None), chain(40)
    assert sum(v is not None for v in a) > 50
    assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b))


def test_savgol_matches_direct_fit(spark):
    t = np.arange(60) / 30.0
    x = np.sin(2 * np.pi * 0.8 * t)
    x[40:] = np.nan
    d = apply_steps(frame(spark, x), ["clip"], savgol(["x"], 30.0, 11, derivs=(0, 1)))
    s, v = column(d, "x_d0"), column(d, "x_d1")
    for i in range(40):
        lo = min(max(i - 5, 0), 29)
        c = np.polyfit(np.arange(11) - (i - lo), x[lo:lo + 11], 3)
        assert abs(s[i] - c[-1]) < 1e-8
        if 5 <= i < 35:
            assert abs(v[i] - c[-2] * 30) < 1e-6
        else:
            assert v[i] is None
    assert s[40] is None


def test_no_derivative_across_a_gap_and_short_gaps_filled(spark):
    x = np.arange(100.0)
    x[30:32] = np.nan
    x[60:64] = np.nan
    d = apply_steps(frame(spark, x), ["clip"], fill_small_gaps("x", 2, "xf", "fl"), savgol(["xf"], 30.0, 11, derivs=(0, 1)))
    fl, v = column(d, "fl"), column(d, "xf_d1")
    assert [i for i, f in enumerate(fl) if f] == [30, 31]
    assert all(v[i] is None for i in range(55, 69)) and abs(v[40] - 30) < 1e-6


def test_jerk_floor_against_simulated_noise():
    g = np.random.default_rng(0)
    c = sg_matrix(11, 3, 3, 1 / 30)[5]
    j = np.hypot(np.convolve(g.normal(0, 1, 20000), c[::-1], "valid"), np.convolve(g.normal(0, 1, 20000), c[::-1], "valid")).mean()
    assert abs(j / S.jerk_floor_factor(30.0) - 1) < 0.1


def test_teleport_and_majority_and_sustained(spark):
    x = np.zeros(20)
    x[10] = 500
    d = apply_steps(frame(spark, x), ["clip"], remove_teleports("x", "y", 100.0, "t"))
    assert [i for i, v in enumerate(column(d, "x")) if v is None] == [10, 11]
    m = [True, False, True, True, False, False, False, True, True]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(m)], "clip long, frame int, m boolean")
    pad = [m[1], m[0]] + m + [m[-1], m[-2]]
    for size in (None, 3):
        assert column(apply_steps(df, ["clip"], majority5("m", "o"), size=size), "o") == [sum(pad[i:i + 5]) >= 3 for i in range(len(m))]
        assert column(apply_steps(df, ["clip"], sustained("m", 2, "o"), size=size), "o") == [False, False, True, True, False, False, False, True, True]


def test_camera_pan_is_removed(spark):
    t = np.arange(200)
    x, y = 5 * np.sin(t / 9), 3 * np.cos(t / 7)
    rows = [(1, int(i), float(x[i] + 2 * i), float(y[i]), 1.0, 0.0, 2.0, 0.0, 1.0, 0.0) for i in t]
    d = spark.createDataFrame(rows, "clip long, frame int, x double, y double, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    for size in (None, 33):
        q = np.array(column(S.compensate_camera(d, ["clip"], size), "qx"))
        assert np.allclose(q - q[0], x - x[0], atol=1e-8)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=1, max_size=40))
def test_hysteresis_is_the_loop(spark, vs):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vs)], "clip long, frame int, d double")
    d = F.coalesce("d", F.lit(9.0))
    got = column(S.hysteresis(df, ["clip"], d < 0.25, d > 0.4, "on", 5), "on")
    on, want = False, []
    for v in vs:
        z = 9.0 if v is None else v
        on = z < 0.25 if not on else z <= 0.4
        want.append(on)
    assert got == want


def test_ranks_and_quantiles_split_equals_numpy(spark):
    g = np.random.default_rng(1)
    v = np.round(g.exponential(3, 500), 1)
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "k int, v double")
    for split in (True, None):
        for row in O.quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "p": 0.93}, split=split).collect():
            s = v[row["k"]::2]
            assert np.allclose([row["q1"], row["m"], row["p"]], np.quantile(s, [0.25, 0.5, 0.93]))
    r = {x["v"]: x["rank"] for x in O.average_ranks(df.select("v"), [], "v").collect()}
    order = np.sort(v)
    assert all(abs(r[x] - (np.flatnonzero(order == x).mean() + 1)) < 1e-9 for x in v[:50])


def test_bucketed_row_number(spark):
    df = spark.createDataFrame([(1, (i * 37) % 101) for i in range(101)], "k int, t int")
    got = O.bucketed_row_number(df, ["k"], F.floor(F.col("t") / 10), ["t"], "n")
    assert all(x["t"] == x["n"] for x in got.collect())


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_short_and_long_keys_are_numbered_ranked_and_cut_alike(spark, size):
    g = np.random.default_rng(8)
    rows = [(k, int(t), float(v)) for k, n in ((1, 3), (2, 30), (3, 200), (None, 4)) for t, v in zip(g.permutation(n), g.integers(0, 90, n))]
    d = spark.createDataFrame(rows, "clip long, t int, v double")
    by = {k: sorted((t, v) for c, t, v in rows if c == k) for k in (1, 2, 3, None)}
    n = O.bucketed_row_number(d, ["clip"], F.floor(F.col("t") / 16), ["t"], "i", size=size)
    assert all(r["i"] == r["t"] for r in n.where("clip IS NOT NULL").collect()) and n.where("clip IS NOT NULL").count() == 233
    q = {r["clip"]: (r["n"], r["m"], r["p"]) for r in O.quantiles(d, ["clip"], "v", {"m": 0.5, "p": 0.95}, size=size).collect()}
    ranks = {(r["clip"], r["v"]): (r["ties"], r["rank"], r["n"]) for r in O.average_ranks(d, ["clip"], "v", size=size).collect()}
    for k in (1, 2, 3):
        v = np.array([x for _, x in by[k]])
        assert q[k][0] == len(v) and np.allclose(q[k][1:], np.quantile(v, [0.5, 0.95]))
        for x in set(v):
            assert ranks[k, x] == ((v == x).sum(), (v < x).sum() + ((v == x).sum() + 1) / 2, len(v))


def test_short_keys_write_no_staged_rows(spark, monkeypatch):
    """Numbers of short series come from one window over the scan: nothing is written first, no chunk sums are joined."""
    monkeypatch.setattr(O, "staged", lambda df, name: pytest.fail(f"{name} staged"))
    d = spark.range(100).selectExpr("id % 3 AS clip", "id AS t")
    n = O.bucketed_row_number(d, ["clip"], F.col("t"), ["t"], "i")
    assert sorted(r["i"] for r in n.where("clip = 0").collect()) == list(range(34))
