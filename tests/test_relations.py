"""Lagged correlation, nulls, joins, sequences, graphs, filters and trackers against brute force."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlane.operators import graph as GR, inference as I, joins as J, lags as L, sequences as Q, spectral as SP, windows as WN
from pairlane.operators.ordered import layout
from pairlane.operators.tracking import TwoSlots


def ar(n, seed, phi=0.95):
    g = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + g.normal()
    return x


def table(spark, a, b, mask=None):
    f = lambda v: None if v != v else float(v)
    m = [True] * len(a) if mask is None else mask
    return spark.createDataFrame([(1, i, f(x), f(y), bool(k)) for i, (x, y, k) in enumerate(zip(a, b, m))], "clip long, frame int, a double, b double, mask boolean")


def brute(a, b, L_, n_min):
    out = {}
    for k in range(-L_, L_ + 1):
        p = [(a[t], b[t + k]) for t in range(len(a)) if 0 <= t + k < len(b) and a[t] == a[t] and b[t + k] == b[t + k]]
        out[k] = np.corrcoef(np.array(p).T)[0, 1] if len(p) >= n_min else None
    return out


def test_lagged_corr_sign_gaps_and_chunks(spark):
    a = ar(400, 1)
    b = np.r_[np.zeros(10), a[:-10]] + 0.1 * ar(400, 2)
    a = a.copy()
    a[150:220] = np.nan
    d = table(spark, a, b)
    want = brute(a, b, 15, 50)
    for size in (None, 50):
        got = {r["lag"]: r["r"] for r in L.lagged_corr(d, ["clip"], max_lag=15, size=size).collect()}
        assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    p = L.peak(L.lagged_corr(d, ["clip"], max_lag=15), ["clip"], 1.0).first()
    assert p["peak_lag_s"] == 10                                       # positive: A leads


def test_shift_null_join_equals_fft_and_p_is_sane(spark):
    a, b = ar(300, 3), ar(300, 4)
    a[40:60] = np.nan
    mask = np.arange(300) % 50 > 8
    d, sh = table(spark, a, b, mask), L.shift_table(12, 30, 270)
    j = {r["shift"]: r["peak_r"] for r in L.shift_null_join(d, ["clip"], 1.0, 5, sh, 50, size=64).collect()}
    f = {r["shift"]: r["peak_r"] for r in L.shift_null(d, ["clip"], 1.0, 5, sh, 50).collect()}
    for size in (37, 64, 299):
        cut = {r["shift"]: r["peak_r"] for r in L.shift_null(d, ["clip"], 1.0, 5, sh, 50, size=size).collect()}
        assert cut.keys() == f.keys() and all(abs(cut[k] - f[k]) < 1e-8 for k in f)
    assert j.keys() == f.keys() and all(abs(j[k] - f[k]) < 1e-8 for k in j)
    A = np.where(mask, a, np.nan)
    k = sh[3]
    want = brute(A, np.where(mask, np.roll(b, k), np.nan), 5, 50)
    assert abs(abs(f[k]) - max(abs(v) for v in want.values())) < 1e-8


def test_rolled_similarity_two_ways(spark):
    g = np.random.default_rng(0)
    rows = [(1, i, [float(x) for x in g.normal(size=2)], [float(g.normal()), None if i % 7 == 0 else float(g.normal())], i % 5 > 0) for i in range(80)]
    d = spark.createDataFrame(rows, "clip long, frame int, a array<double>, b array<double>, mask boolean")
    get = lambda: {r["shift"]: (r["s"], r["n"]) for r in L.rolled_similarity(d, ["clip"], [5, -9], 1).collect()}
    with layout(True):
        x = get()
    y = get()
    assert x.keys() == y.keys() and all(abs(x[k][0] - y[k][0]) < 1e-12 and x[k][1] == y[k][1] for k in x)


def test_pseudo_pairs_chunked_equals_whole(spark):
    rows = [(c, t, float(x), float(y)) for c in range(5) for t, (x, y) in enumerate(zip(ar(120, c), ar(120, 50 + c)))]
    d = spark.createDataFrame(rows, "clip long, frame int, a double, b double")
    g = spark.createDataFrame([(c, c % 2) for c in range(5)], "clip long, grp int")
    get = lambda: {(r["clip_a"], r["clip_b"]): r["abs_r"] for r in J.pseudo_pairs(d, g, 2, 20, block=2).collect()}
    with layout(True):
        w = get()
    s = get()
    assert set(w) == set(s) == {(a, b) for a in range(5) for b in range(5) if a == b or a % 2 != b % 2}
    assert all(abs(w[k] - s[k]) < 1e-8 for k in w)
    want = max(abs(v) for v in brute(ar(120, 0), ar(120, 51), 2, 20).values())
    assert abs(w[0, 1] - want) < 1e-8


def test_range_and_grid_joins(spark):
    g = np.random.default_rng(5)
    pts = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(g.integers(0, 3, 80), g.integers(0, 300, 80)))]
    iv = [(int(k), i, int(s), int(s + w)) for i, (k, s, w) in enumerate(zip(g.integers(0, 3, 40), g.integers(0, 280, 40), g.integers(0, 90, 40)))]
    P, S = spark.createDataFrame(pts, "k int, p int, t int"), spark.createDataFrame(iv, "k int, s int, a int, b int")
    got = {(r["p"], r["s"]) for r in J.interval_join(P, S, "k", "t", "a", "b", 16).collect()}
    assert got == {(p, s) for k, p, t in pts for q, s, a, b in iv if k == q and a <= t <= b}
    A, B = S.toDF("k", "ia", "start_a", "end_a"), S.toDF("k", "ib", "start_b", "end_b")
    got = sorted((r["ia"], r["ib"]) for r in J.overlap_join(A, B, "k", 16).collect())
    assert got == sorted((x[1], y[1]) for x in iv for y in iv if x[0] == y[0] and x[2] < y[3] and x[3] > y[2])
    xy = g.uniform(0, 30, (60, 2))
    a = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy[:30])], "k int, id_a int, x_a double, y_a double")
    b = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy[30:])], "k int, id_b int, x_b double, y_b double")
    got = {(r["id_a"], r["id_b"]) for r in J.grid_join(a, b, ["k"], 4.0).collect()}
    assert got == {(i, j) for i in range(30) for j in range(30) if np.hypot(*(xy[i] - xy[30 + j])) < 4}


def test_crowded_points_meet_without_their_pairs(spark):
    g = np.random.default_rng(11)
    xy = {(k, i): (float(x), float(y)) for k, n in ((0, 150), (1, 40)) for i, (x, y) in enumerate(g.uniform(0, 60, (n, 2)).round(0))}
    side = lambda s, odd: spark.createDataFrame([(k, i, *p) for (k, i), p in xy.items() if i % 2 == odd], f"k int, id_{s} long, x_{s} double, y_{s} double")
    a, b = side("a", 0), side("b", 1)
    rows = lambda d: sorted((r["k"], r["id_a"], r["id_b"], r["d"]) for r in d.collect())
    assert rows(J.nearest_in_tiles(a, b, ["k"], 5.0, block=7)) == rows(J.nearest_within(a, b, ["k"], 5.0))
    p = spark.createDataFrame([(k, i, *p) for (k, i), p in xy.items()], "k int, id long, x double, y double")
    links = [((r["k"], r["id_a"]), (r["k"], r["id_b"])) for r in J.patch_links(p, ["k"], 6.0, block=5).collect()]
    pairs = [(u, v) for u in xy for v in xy if u[0] == v[0] and u < v and np.hypot(xy[u][0] - xy[v][0], xy[u][1] - xy[v][1]) < 6.0]

    def named(edges):
        root = {u: u for u in xy}
        for _ in xy:
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        return root
    assert named(links) == named(pairs) and len(links) < len(pairs)


def test_components_of_long_paths(spark):
    """Shuffled ids, ascending ids, and the smallest id at the far end; two groups use the same ids."""
    g = np.random.default_rng(11)
    paths = {0: g.permutation(120), 1: np.arange(120), 2: np.r_[np.arange(1, 100), 0]}
    edges = spark.createDataFrame([(f, int(x), int(y)) for f, p in paths.items() for x, y in zip(p[:-1], p[1:])], "frame int, id_a long, id_b long")
    nodes = spark.createDataFrame([(f, int(x)) for f, p in paths.items() for x in p] + [(3, 5)], "frame int, id long")
    got = {(r.frame, r.id): r.comp for r in GR.components(nodes, edges, ["frame"]).collect()}
    assert got == {(f, int(x)): 0 for f, p in paths.items() for x in p} | {(3, 5): 5}


def test_components_and_metrics(spark):
    e = [(0, 1), (1, 2), (2, 3), (5, 6)]
    nodes = spark.createDataFrame([(0, 0, i) for i in range(8)], "clip int, frame int, id long")
    edges = spark.createDataFrame([(0, 0, a, b) for a, b in e], "clip int, frame int, id_a long, id_b long")
    c = GR.components(nodes, edges, ["clip", "frame"])
    assert {r["id"]: r["comp"] for r in c.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    m = GR.frame_metrics(nodes, edges, c).first()
    assert (m["n_nodes"], m["n_edges"], m["n_components"], m["largest_component"], m["mean_degree"]) == (8, 4, 4, 4, 1.0)


def test_sequences(spark):
    s = list("aabbbcaabccdaabbcdabcdd") * 3
    d = spark.createDataFrame([(1, i * 2, v) for i, v in enumerate(s)], "clip long, pos int, symbol string")
    col = [k for k, _ in itertools.groupby(s)]
    c = Q.collapse(d, ["clip"], size=16)
    assert [r["symbol"] for r in c.orderBy("i").collect()] == col
    from collections import Counter
    H = lambda cs: -sum(v / sum(cs.values()) * math.log2(v / sum(cs.values())) for v in cs.values()) + (len(cs) - 1) / (2 * sum(cs.values()) * math.log(2))
    want = H(Counter(zip(col, col[1:], col[2:]))) - H(Counter(list(zip(col, col[1:]))[:-1]))
    assert abs(Q.cond_entropy(c, ["clip"], 2, "h").first()["h"] - want) < 1e-9
    h, seen, new, sec = len(col) // 2, set(), 0, []
    seen |= {tuple(col[i:i + 2]) for i in range(0, h - 1)}
    sec = [tuple(col[i:i + 2]) for i in range(h, len(col) - 1)]
    for q in sec:
        new += q not in seen
        seen.add(q)
    assert abs(Q.late_novelty(c, ["clip"], 2, "v").first()["v"] - new / len(sec)) < 1e-12
    for kind in ("shuffle", "markov1"):
        out = Q.surrogates(c.select("clip", "i", "symbol"), "clip", 3, kind).toPandas()
        for _, g in out.groupby("rep"):
            w = g.sort_values("i")["symbol"].tolist()
            assert len(w) == len(col) and (kind == "markov1" or sorted(w) == sorted(col))
            assert kind == "shuffle" or (w[0] == col[0] and all(x != y for x, y in zip(w, w[1:])))


def test_filters():
    fs, t = 30.0, np.arange(600) / 30.0
    b, a = SP.butter2(fs, None, 1.5)
    w = np.exp(-1j * 2 * np.pi * 1.5 / fs * np.arange(3))
    assert abs(abs(b @ w) / abs(a @ w) - 2 ** -0.5) < 1e-9 and abs(b.sum() / a.sum() - 1) < 1e-9
    x = np.sin(2 * np.pi * 0.3 * t) + np.sin(2 * np.pi * 6 * t)
    y = SP.filtfilt(b, a, x)
    assert np.abs(y - np.sin(2 * np.pi * 0.3 * t))[60:-60].max() < 0.02
    zi = np.zeros(2)
    direct = SP._recursion(b, a, x - x[0], zi)                          # steady start of x[0]: gain one at DC
    assert np.allclose(SP._lfilter(b, a, x), direct + x[0], atol=1e-9)
    for band in ((0.5, 1.5), (1.5, None)):
        b, a = SP.butter2(fs, *band)
        assert abs(b.sum() / a.sum()) < 1e-9 and np.abs(np.roots(a)).max() < 1


def test_filter_runs_chunked(spark):
    x = ar(500, 9)
    x[200] = np.nan
    d = spark.createDataFrame([(1, i, None if v != v else float(v)) for i, v in enumerate(x)], "clip long, frame int, x double")
    get = lambda size: {r["frame"]: r["x_f"] for r in SP.filter_runs(d, ["clip"], ["x"], 30.0, hi=3.0, size=size).collect()}
    with layout(True):
        w = get(None)
    s = get(128)
    assert w.keys() == s.keys() and all((w[k] is None) == (s[k] is None) and (w[k] is None or abs(w[k] - s[k]) < 1e-6) for k in w)


def test_surrogates_of_one_task_are_those_of_the_rows(spark):
    """A sequence that fits a piece draws the same replicates in one task, and both ways give the same tests."""
    g = np.random.default_rng(7)
    rows = []
    for k, n in ((1, 60), (2, 25), (3, 2), (4, 1), (5, 11)):
        x = [0]
        while len(x) < n:
            x.append(int((x[-1] + g.integers(1, 4)) % 4))
        rows += [(k, i, "abcd"[v]) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "clip long, i int, symbol string")
    number = {r["clip"]: r["k"] for r in d.selectExpr("clip", "xxhash64(clip) AS k").distinct().collect()}
    for kind in ("shuffle", "markov1"):
        out = Q.surrogates(d, "clip", 4, kind).toPandas()
        for k in (1, 2, 5):
            own = [s for c, _, s in rows if c == k]
            want = [["abcd".index(s) for s in q.sort_values("i").symbol] for _, q in out[out["clip"] == k].groupby("rep")]
            names = sorted(set(own))
            assert [["abcd".index(names[v]) for v in row] for row in Q.replicates(own, number[k], 4, kind)] == want
    get = lambda size: {r["clip"]: r.asDict() for r in Q.surrogate_tests(d, "clip", 5, size=size).collect()}
    whole, cut = get(1000), {r["clip"]: r.asDict() for r in Q.measures(d, ["clip"]).collect()}
    assert set(whole) == set(cut) == {1, 2, 3, 5}
    for k in cut:
        for c in Q.MEASURES:
            assert (whole[k][c] is None) == (cut[k][c] is None) and (cut[k][c] is None or abs(whole[k][c] - cut[k][c]) < 1e-9)


def test_bands_of_one_pass_are_the_filters_alone(spark):
    """Three bands of many series, one with a missing stretch, come from one pass and equal the filter on the run itself."""
    xs = {1: ar(120, 4), 2: ar(60, 5), 3: ar(10, 6)}
    xs[1][50:53] = np.nan
    d = spark.createDataFrame([(k, i, None if v != v else float(v)) for k, x in xs.items() for i, v in enumerate(x)], "clip long, frame int, x double")
    bands = {"low": (None, 0.5), "mid": (0.5, 1.5), "high": (1.5, None)}
    got = {(r["clip"], r["frame"]): r for r in SP.filter_bands(d, ["clip"], ["x"], 10.0, bands, 16).collect()}
    assert len(got) == 190 and got[1, 50]["x"] is None and got[3, 4]["x_low"] is None
    for n, (lo, hi) in bands.items():
        b, a = SP.butter2(10.0, lo, hi)
        for k, i, j in ((1, 0, 50), (1, 53, 120), (2, 0, 60)):
            assert np.allclose([got[k, f][f"x_{n}"] for f in range(i, j)], SP.filtfilt(b, a, xs[k][i:j]))


def test_rank_tests_and_exact_p(spark):
    g = np.random.default_rng(2)
    a, b = np.round(g.normal(0.3, 1, 60), 1), np.round(g.normal(0, 1, 50), 1)
    d = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    u = I.rank_sum(d.withColumn("k", F.lit(0)), ["k"], "v", "g", "a", "b").first()
    want = (a[:, None] > b[None]).mean() - (a[:, None] < b[None]).mean()
    assert abs(u["delta"] - want) < 1e-9 and u["u"] == (a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()
    t = spark.createDataFrame([(8, 2, 1, 5), (1, 9, 11, 3)], "a int, b int, c int, d int")
    p = [r[0] for r in t.select(I.fisher_greater("a", "b", "c", "d")).collect()]
    C = math.comb
    assert abs(p[0] - sum(C(10, i) * C(6, 9 - i) for i in range(8, 10)) / C(16, 9)) < 1e-12 and p[1] > 0.99
    s = [0, 1, 0, 0, 1, 0, 1]
    sw = sum(x != y for x, y in zip(s, s[1:]))
    null = [sum(x != y for x, y in zip(q, q[1:])) for q in set(itertools.permutations(s))]
    r = spark.createDataFrame([(7, 3, sw)], "n int, k int, sw int").select(I.alternation_p("n", "k", "sw").alias("t")).first()["t"]
    assert abs(r["more"] - np.mean([x >= sw for x in null])) < 1e-9 and abs(r["less"] - np.mean([x <= sw for x in null])) < 1e-9


def test_sparc_is_scale_free_and_windows_cover(spark):
    t = np.arange(40) / 10
    v = np.exp(-((t - 2) ** 2))
    d = spark.createDataFrame([(1, [float(x) for x in v]), (2, [float(5 * x) for x in v]), (3, [0.0] * 40)], "i int, s array<double>")
    r = {x["i"]: x["p"] for x in d.select("i", WN.sparc_udf(10.0)("s").alias("p")).collect()}
    assert abs(r[1] - r[2]) < 1e-9 and r[3] is None and -3 < r[1] < -1
    f = spark.range(100).select(F.lit(1).alias("clip"), F.col("id").cast("int").alias("frame"))
    w = WN.window_rows(f, 40, 10).groupBy("wid").agg(F.count("*").alias("n"), F.min("frame").alias("a")).where("n = 40")
    assert sorted((x["wid"], x["a"]) for x in w.collect()) == [(i, 10 * i) for i in range(7)]


def test_two_slots_keep_identities():
    tr = TwoSlots(100.0, 1 / 30)
    box = lambda i, x, s=20: {"track_id": i, "cx": x, "cy": 0.0, "x1": x - s, "x2": x + s, "y1": -s, "y2": s}
    out = []
    for f in range(60):
        dets = [box(7, 100 - f), box(9, f), box(50, 300, 4)]
        if 20 <= f < 24:
            dets = dets[:1] + dets[2:]
        out.append(tuple(None if d is None else d["track_id"] for d in tr.step(dets)))
    assert out[0] == (9, 7) and out[21] == (None, 7) and all(o == (9, 7) for o in out[24:])


def test_camera_fit_finds_the_swap(spark):
    g = np.random.default_rng(4)
    rows = []
    P = np.array([[500, 20, 30, 600], [10, 480, -20, 300], [0.1, 0.05, 0.2, 8.0]])
    proj = lambda X: (P @ np.r_[X, 1])[:2] / (P @ np.r_[X, 1])[2]
    for f in range(60):
        l, k = g.uniform(-2, 0, 3), g.uniform(0.5, 2, 3)
        u, v = proj(l), proj(k)
        swap = f % 12 == 0
        p, q = (v, u) if swap else (u, v)
        s3, s2 = lambda a: tuple(map(float, a)), lambda a: tuple(map(float, a))
        rows.append((1, f, s3(l), s3(k), s2(p), s2(q)))
    X, U = "struct<x: double, y: double, z: double>", "struct<x: double, y: double>"
    d = spark.createDataFrame(rows, f"clip long, frame int, l {X}, f {X}, p {U}, q {U}")
    r = {x["frame"]: x["lead"] for x in I.fit_camera_rounds(d, 8).collect()}
    assert all(r[f] == (f % 12 != 0) for f in r)


@pytest.mark.parametrize("dyads", [[(1, 5.0, 5.0), (2, 9.0, 4.0), (3, 1.0, 7.0)], [(1, 5.0, 5.0), (2, 3.0, 4.0)], []])
def test_condition_contrast_ranks_zeros_as_its_sql(spark, tmp_path, dyads):
    import duckdb
    from pairlane.plans import catalogue
    rows = [(k, flag, status, v) for k, a, n in dyads for flag, status, v in (("A", "O", a), ("N", "F", n))]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_extendedprice double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    cur = con.execute(catalogue.ORACLES["condition_contrast"])
    want = [dict(zip([c[0] for c in cur.description], x)) for x in cur.fetchall()]
    assert [x.asDict() for x in catalogue.QUERIES["condition_contrast"](spark, str(tmp_path)).collect()] == want


def test_condition_contrast_adds_up_once(spark, monkeypatch):
    from pairlane.plans import catalogue
    from pairlane.sources import views as V
    last = F.udf(lambda v: v + np.random.default_rng().random() * 1e-9, "double").asNondeterministic()       # sums that end differently each time they are made
    rows = [(k, flag, status, v) for k in range(40) for flag, status, v in (("A", "O", 10.0 + k), ("N", "F", 1.0))]
    d = spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_extendedprice double")
    monkeypatch.setattr(V, "table", lambda *_: d.withColumn("l_extendedprice", last("l_extendedprice")))
    got = catalogue.QUERIES["condition_contrast"](spark, "").collect()[0]
    assert (got.n, got.positive, got.w_plus) == (40, 40, 820.0)


def test_continuity_gives_jitter_and_bodies_without_speed(spark, tmp_path):
    import datetime
    import duckdb
    from pairlane.plans import catalogue
    g = np.random.default_rng(4)
    day = datetime.datetime(1996, 1, 1)
    rows = [(i, int(g.integers(0, 40)), s, 1, float(g.integers(20, 30)), 40_000 + float(g.integers(0, 9000)), 0.05, 0.08 if s == 2 else 0.02, day + datetime.timedelta(days=i)) for s in (1, 2) for i in range(80)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    cur = con.execute(catalogue.ORACLES["continuity"])
    want = sorted((dict(zip([c[0] for c in cur.description], x)) for x in cur.fetchall()), key=lambda x: (x["clip"], x["body"]))
    got = sorted((x.asDict() for x in catalogue.QUERIES["continuity"](spark, str(tmp_path)).collect()), key=lambda x: (x["clip"], x["body"]))
    assert got == want and len(got) == 4
    assert got[0]["jitter_med"] > 0 and got[2] == {"clip": 2, "body": "A", "n": 0, "stop_frac": None, "speed_med": None, "jitter_med": None}


def test_nearest_pairs_never_leave_their_task(spark):
    from pairlane.plans import catalogue
    plan = catalogue.QUERIES["radius_nn_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("MapInPandas")]                     # above the join of cells no pair is joined or grouped
    assert "Aggregate" not in top and "Join" not in top
