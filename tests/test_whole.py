"""Series that fit a chunk are finished in one task; the chunked way gives the same."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlane.operators import inference, lags, rolls, sequences


def shuffled_bytes(spark):
    """Shuffle bytes written by the session's stages so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    it, total = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator(), 0
    while it.hasNext():
        total += it.next().shuffleWriteBytes()
    return total


def pair(spark, clips, seed=0, gaps=True):
    g, rows = np.random.default_rng(seed), []
    for c in range(clips):
        n = int(g.integers(90, 140))
        a, b = np.cumsum(g.normal(size=(2, n)), axis=1)
        rows += [(c, t, None if gaps and g.random() < 0.1 else float(a[t]), None if gaps and g.random() < 0.1 else float(b[t]), bool(t % 17 > 2)) for t in range(n) if not gaps or g.random() > 0.05]
    return spark.createDataFrame(rows, "clip long, frame int, a double, b double, mask boolean").repartition(3)


def test_shift_summary_whole_and_in_chunks(spark):
    d, shifts = pair(spark, 4).cache(), lags.shift_table(60, 5, 80)
    want = {r["clip"]: r for r in lags.null_summary(lags.shift_null_join(d, ["clip"], 1.0, 3, shifts, 30), ["clip"]).collect()}
    for size in (None, 32, 115):                                        # 115: some series fit, some do not
        got = {r["clip"]: r for r in lags.shift_summary(d, ["clip"], 1.0, 3, shifts, 30, size=size).collect()}
        assert got.keys() == want.keys() == set(range(4))
        for c, r in got.items():
            assert all(r[x] == pytest.approx(want[c][x], abs=1e-9) for x in ("r_obs", "r_lag0", "lag_obs", "n_null", "p", "z", "null_95"))


def test_shift_summary_sends_no_row_for_a_shift(spark):
    """500 shifts shuffle the series once: a few bytes a row."""
    d = pair(spark, 60, gaps=False).localCheckpoint()
    before = shuffled_bytes(spark)
    assert lags.shift_summary(d, ["clip"], 1.0, 3, lags.shift_table(500, 5, 255), 30).count() == 60
    assert shuffled_bytes(spark) - before < 100 * d.count()


def bodies(spark, clips, seed=1):
    g, rows = np.random.default_rng(seed), []
    for c in range(clips):
        for t in range(int(g.integers(90, 140))):
            v = [float("nan") if g.random() < 0.1 else float(x) for x in g.normal(size=4)]
            rows.append((c, t, None if g.random() < 0.05 else v[:2], None if g.random() < 0.05 else v[2:], int(g.integers(0, 4))))
    return spark.createDataFrame(rows, "clip long, frame int, a array<double>, b array<double>, mask int").repartition(3)


def alike(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and want
    for k, row in want.items():
        assert all(got[k][c] == (v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-9)) for c, v in row.items()), (k, got[k], row)


def test_similarity_excess_whole_and_in_chunks(spark):
    d, sets = bodies(spark, 4).cache(), {"shift": rolls.Spread(40, 5), "local": rolls.Fixed([3, -4, 200])}
    want = rolls.null_excess(rolls.rolled_similarity(d, ["clip"], sets, 2, 1), ["clip", "mask"])
    for size in (None, 115):
        alike(rolls.similarity_excess(d, ["clip"], sets, 2, 1, size), want, ["clip", "mask", "set"])


def test_window_tests_whole_and_in_chunks(spark):
    d, sets, sides = pair(spark, 4, seed=2, gaps=False).cache(), {"shift": rolls.Spread(50, 5)}, {"r0": "two", "rmin": "less", "frac_neg": "greater", "frac_pos": "greater"}
    want = rolls.null_tests(rolls.rolled_windows(d, ["clip"], sets, 3, 8, 2, 0.5, 30), ["clip"], sides)
    for size in (None, 115):
        alike(rolls.window_tests(d, ["clip"], sets, 3, 8, 2, 0.5, 30, sides, size=size), want, ["clip"])


def test_rolled_spearman_whole_and_by_joins(spark):
    d, shifts = pair(spark, 4, seed=3).withColumn("a", F.round("a", 0)).cache(), [0, 7, -9, 130]
    want = inference.spearman(lags.rolled(d, ["clip"], F.array(*[F.lit(k) for k in shifts]), keep=("a",)), ["clip", "shift"], "a", "b", 30)
    for size in (None, 115):
        alike(rolls.rolled_spearman(d, ["clip"], shifts, 30, size), want, ["clip", "shift"])


def test_rolled_spearman_copies_no_row_for_a_shift(spark):
    d = pair(spark, 60, gaps=False).localCheckpoint()
    before = shuffled_bytes(spark)
    assert rolls.rolled_spearman(d, ["clip"], list(range(0, 80, 5)), 30).count() == 60 * 16
    assert shuffled_bytes(spark) - before < 100 * d.count()


def test_equal_signatures_are_compared_once(spark, monkeypatch):
    g = np.random.default_rng(5)
    p, q = g.dirichlet(np.ones(4), 12), g.dirichlet(np.ones(4), 12)
    rows = [(c, p[c % 12].tolist(), q[c % 12].tolist()) for c in range(600)]
    h, staged, sizes = spark.createDataFrame(rows, "clip long, p array<double>, q array<double>"), sequences.staged, {}

    def watched(df, name):
        out = staged(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(sequences, "staged", watched, raising=False)
    d = np.stack([sequences.divergences(x[None], q) for x in p])
    for r in sequences.nearest_signature(h, "clip", 5).collect():
        i = r.clip % 12
        assert r.best == d[i].argmin() and r.best_jsd == pytest.approx(d[i].min()) and r.self_jsd == pytest.approx(d[i, i])
    assert sizes["first-halves"] == sizes["second-halves"] == 12


def test_stream_rows_of_a_batch_stay_columns():
    """The tracker's state function makes records of one frame at a time, so a large micro-batch needs little more than its columns."""
    import tracemalloc
    from types import SimpleNamespace
    import pandas as pd
    from pairlane.streaming import twins
    found = []
    grouped = SimpleNamespace(applyInPandasWithState=lambda step, *rest: found.append(step))
    twins.two_slots(SimpleNamespace(groupBy=lambda key: grouped))
    state = SimpleNamespace(exists=False, update=lambda value: None)
    n = 100_000
    x = np.random.default_rng(1).uniform(0, 100, n)
    pdf = pd.DataFrame({"clip": "a", "frame": np.arange(n) // 1000, "track_id": np.arange(n) % 1000, "cx": x, "cy": x, "x1": x - 4, "y1": x - 4, "x2": x + 4, "y2": x + 4})
    tracemalloc.start()
    out = pd.concat(found[0](("a",), [pdf], state))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["frame"].tolist() == list(range(99)) and peak < 45e6, peak
