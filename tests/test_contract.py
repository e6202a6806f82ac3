"""The entry points, and a sample of queries against their SQL at the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as E
from check import TABLES, norm

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert E.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) >= 232


@pytest.mark.parametrize("name", ["lagged_corr", "valid_runs", "window_corr", "state_runs", "transitions", "interval_join", "cond_entropy", "contact_regions", "mann_whitney", "proximity_edges", "scan_intervals", "stream_states"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(norm(v) for _, v in sorted(zip(cols, r))) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["compensate_camera", "episodes", "hysteresis", "normal_scores"])
def test_chunked_plans_match_sql(spark, name, monkeypatch):
    """The same answers when every series is far longer than a chunk."""
    import pairlane.operators.ordered as O
    monkeypatch.setattr(O, "CHUNK", 100)
    test_query_matches_sql(spark, name)


def test_stream_tracker_equals_batch(spark):
    """Over all frames, the last one of each clip included."""
    q = E.queries()
    rows = lambda n: {(r.clip, r.frame): (r.track_a, r.track_b) for r in q[n](spark, SF).collect()}
    batch = rows("two_slot_assign")
    assert len(batch) > 100 and rows("stream_two_slot_assign") == batch


def test_stream_states_release_the_tail_over_micro_batches(spark, tmp_path):
    """Events one file, and so one micro-batch, a quarter; every event has its state once the closing row has come."""
    from pairlane.streaming import twins as T
    table = spark.read.parquet(f"{SF}/events.parquet")
    rows = table.toPandas().sort_values(["ts", "event_id"])
    for i in range(4):
        spark.createDataFrame(rows.iloc[i * len(rows) // 4:(i + 1) * len(rows) // 4], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    ev = spark.readStream.schema(T.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    ev = ev.withColumn("ts", ev.ts.cast("timestamp"))
    ev, end = T.with_closing_row(ev, table)
    got = T.run_to_files(T.states(ev).where("user_id IS NOT NULL"), "states", end=end).collect()
    on, want = {}, {}
    for r in rows.itertuples():
        on[r.user_id] = True if r.value < 10 else False if r.value > 40 else on.get(r.user_id, False)
        want[r.event_id] = on[r.user_id]
    assert len(got) == len(want) and {r.event_id: r.on for r in got} == want


def test_stream_tracker_does_not_depend_on_micro_batches(spark, tmp_path):
    """Files, one a micro-batch, cut rows in frame order without regard to frames."""
    from pairlane.sources import views as V
    from pairlane.streaming import twins as T
    d = V.detections(spark, SF).select("clip", "frame", "track_id", "cx", "cy", "x1", "y1", "x2", "y2")
    rows = d.where("frame < 40").toPandas().sort_values(["frame", "clip", "track_id"])
    got = []
    for n in (1, 5):
        path = str(tmp_path / f"d{n}")
        for i in range(n):
            spark.createDataFrame(rows.iloc[i * len(rows) // n:(i + 1) * len(rows) // n], d.schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got.append(sorted(map(str, T.run_to_files(T.two_slots(stream), "slots").collect())))
    assert got[0] == got[1] and len(got[0]) > 20
