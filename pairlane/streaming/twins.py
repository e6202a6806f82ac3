"""Streaming versions of the windowed and stateful operators.

Each takes a streaming (or batch) DataFrame of events and returns a DataFrame of the same kind, so the
batch result can be compared with the stream on finished input.  `run_to_files` drives a stream over
everything available and writes to files, with checkpoint and output in the shared folder.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlane.operators.tracking import TwoSlots
from pairlane.sources.scratch import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a file stream."""
    d = spark.readStream.schema(EVENTS).parquet(f"{sf}/events.parquet*")
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def with_closing_row(ev: DataFrame, table: DataFrame, delay="10 minutes") -> tuple[DataFrame, Callable]:
    """The event stream of a bounded table with a second file source behind it, and the `end` for `run_to_files` that writes one row there.

    The row's time lies `delay` and a second past the table's last, so the watermark passes every event and states and windows
    release their tails.  It names no user or event, so results drop it by `user_id IS NOT NULL`.
    """
    path = scratch(ev.sparkSession, "closing")
    last = table.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).where("ts IS NOT NULL").select((F.col("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    row = last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(ev.schema[c].dataType).alias(c) for c in ev.columns])
    row.limit(0).write.parquet(path)                       # the source must exist before its row does
    return ev.union(ev.sparkSession.readStream.schema(ev.schema).parquet(path)), lambda: row.write.mode("append").parquet(path)


def closing_frames(det: DataFrame) -> DataFrame:
    """One row a clip, in the frame after its last and without track or box, that closes the clip's last frame in a stream."""
    end = det.groupBy("clip").agg((F.max("frame") + 1).cast(det.schema["frame"].dataType).alias("frame"))
    return end.select(*[F.col(c) if c in ("clip", "frame") else F.lit(None).cast(det.schema[c].dataType).alias(c) for c in det.columns])


def run_to_files(df: DataFrame, name: str, mode: str = "append", end: Callable | None = None) -> DataFrame:
    """Run a stream over all that is there and read its output back.  `end` is called when everything has been read; it writes closing
    rows to a source of the stream, which then goes on from its checkpoint and meets them last, whatever the micro-batches were."""
    spark = df.sparkSession
    out = scratch(spark, name)
    for before in (None, end) if end else (None,):
        if before:
            before()
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
             .outputMode(mode).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def window_table(ev: DataFrame, length="4 hours", step="1 hour", delay="10 minutes") -> DataFrame:
    """Sliding windows per event type; a window is emitted once the watermark has passed its end, and rows
    later than the watermark are dropped."""
    g = ev.withWatermark("ts", delay).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "event_type", "n", "mean")


def episodes(ev: DataFrame, gap="2 hours", delay="10 minutes") -> DataFrame:
    """Sessions per user: events joined while the pause is shorter than the merge gap."""
    g = ev.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return g.select("user_id", "t0", "t1", "n")


def states(ev: DataFrame, on_below=10.0, off_above=40.0, delay="10 minutes") -> DataFrame:
    """Hysteresis per user kept in the state store.

    Rows wait in the state until the watermark has passed them and are then taken in (ts, event_id) order, whatever
    micro-batch they came in; rows later than the watermark are dropped and counted by the query's progress
    (numRowsDroppedByWatermark).  At the end of the input the last `delay` stays unreleased; `with_closing_row` ends a bounded input.
    """
    def step(key, batches, state):
        on, held = pickle.loads(state.get[0]) if state.exists else (False, [])
        new = [] if state.hasTimedOut else [row for pdf in batches for row in zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["value"].tolist())]
        held = sorted(held + new, key=lambda r: r[:2])
        passed = state.getCurrentWatermarkMs()
        ready = [r for r in held if r[0] <= 1000 * passed]
        held, out = held[len(ready):], []
        for _, event, v in ready:
            on = (v < on_below) if not on else not (v > off_above)
            out.append((event, key[0], bool(on)))
        state.update((pickle.dumps((on, held)),))
        if held:
            state.setTimeoutTimestamp(max(passed + 1, held[0][0] // 1000 + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "on"])
    rows = ev.select("event_id", "ts", "user_id", "value", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, on boolean", "s binary", "append", "EventTimeTimeout")


def two_slots(det: DataFrame, max_dist=60.0, fps=1.0) -> DataFrame:
    """The two-identity tracker with its state in the state store: clip, frame, track_a, track_b, n_late.

    A frame is closed, and tracked, when a later frame of its clip arrives; until then its rows wait in the state, so a frame
    that is split over micro-batches is tracked once and whole.  Rows of a frame already closed are counted in n_late.
    A bounded input ends with `closing_frames`, which are held and never tracked.
    """
    def step(key, batches, state):
        tr, last, held, late = pickle.loads(state.get[0]) if state.exists else (TwoSlots(max_dist, 1 / fps), None, [], 0)
        # the rows of a micro-batch stay columns; only those of one frame at a time become records
        rows = pd.concat([pd.DataFrame(held), *(pdf.drop(columns="clip") for pdf in batches)], ignore_index=True)
        if len(rows) and last is not None:
            late += int((rows["frame"] <= last).sum())
            rows = rows[rows["frame"] > last]
        rows = rows.sort_values(["frame", "track_id"], kind="stable", ignore_index=True) if len(rows) else rows
        number = rows["frame"].to_numpy(np.int64) if len(rows) else np.empty(0, np.int64)
        cut = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(rows) else [], len(rows)).astype(int)
        of = lambda i: rows.iloc[cut[i]:cut[i + 1]].to_dict("records")
        out = []
        for i in range(len(cut) - 2):
            f = int(number[cut[i]])
            tr.skip(f - last - 1 if last is not None else 0)
            last = f
            a, b = tr.step(of(i))
            out.append((key[0], f, None if a is None else a["track_id"], None if b is None else b["track_id"], late))
        state.update((pickle.dumps((tr, last, of(len(cut) - 2) if len(rows) else [], late)),))
        yield pd.DataFrame(out, columns=["clip", "frame", "track_a", "track_b", "n_late"]).astype({"track_a": "Int64", "track_b": "Int64", "frame": "int32", "n_late": "int64"})
    return det.groupBy("clip").applyInPandasWithState(step, "clip string, frame int, track_a long, track_b long, n_late long", "s binary", "append", "NoTimeout")


def frame_nodes(ev: DataFrame, delay="10 minutes") -> DataFrame:
    """Nodes of every finished hour (tumbling window): clip, frame, track_id, cx, cy, n."""
    k = F.get_json_object("props", "$.k").cast("double")
    g = ev.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("clip"), F.col("user_id").alias("track_id")).agg(F.avg("value").alias("cx"), F.avg(k).alias("cy"), F.count("*").alias("n"))
    return g.select("clip", F.floor((F.unix_timestamp("w.start") - 1704067200) / 3600).cast("int").alias("frame"), "track_id", "cx", "cy", "n")
