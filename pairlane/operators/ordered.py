"""Ordered computation that survives one giant series.

A plain ``Window.partitionBy(clip)`` puts a whole clip into one task.  Here a series is cut into
chunks of consecutive order values.  Functions with bounded reach see their neighbours through a
halo of copied rows (`over_neighbours`); functions with unbounded memory (running sums, last seen
value, island starts) get the state of all earlier chunks from one small row per chunk
(`running`).  Both give exactly the result of the unchunked window.

`running` reads its input twice, rows and chunk sums, so it stages it first: a chain of them reads and computes each level
once.  Row numbers, ranks and quantiles split series by their length (`split_long`): those that fit a chunk take one plain
window, and only longer ones are cut.  Inside `layout(whole=True)` the same operators build plain windows; that is for a
caller who knows that every series is short, and for the tests, which compare both.
"""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairlane.sources.scratch import staged

CHUNK = 1 << 16
_LAYOUT = {"whole": False}


@contextmanager
def layout(whole: bool):
    """Plans built inside use plain windows if `whole`, chunked ones otherwise."""
    old, _LAYOUT["whole"] = _LAYOUT["whole"], whole
    try:
        yield
    finally:
        _LAYOUT["whole"] = old


def _whole(size) -> bool:
    return size is None and _LAYOUT["whole"]


def _order(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size))


def halo(df: DataFrame, back: int, fwd: int, order: str = "frame", size: int = CHUNK) -> DataFrame:
    """Copy each row into the chunks that can see it; `_core` marks the copy that is kept."""
    size = max(size, back + fwd + 1)
    o = F.col(order)
    if back == 0 and fwd == 0:
        return df.select("*", _order(order, size).alias("_c"), F.lit(True).alias("_core"))
    lo, hi = F.floor((o - fwd) / size), F.floor((o + back) / size)
    return df.select("*", F.explode(F.sequence(lo, hi)).alias("_c")).withColumn(
        "_core", F.col("_c") == _order(order, size))


def over_neighbours(df: DataFrame, keys: list[str], stages, back: int = 0, fwd: int = 0,
                    order: str = "frame", size: int | None = None) -> DataFrame:
    """Evaluate bounded window expressions.  `stages` is one dict or a list of dicts of
    name -> function(WindowSpec) -> Column; later stages may use columns of earlier ones, so
    `back`/`fwd` must cover the summed reach.  One shuffle for all stages."""
    if _whole(size):
        w, out = W.partitionBy(*keys).orderBy(order), df
    else:
        w, out = W.partitionBy(*keys, "_c").orderBy(order), halo(df, back, fwd, order, size or CHUNK)
    for stage in stages if isinstance(stages, list) else [stages]:
        out = out.withColumns({name: fn(w) for name, fn in stage.items()})
    return out if _whole(size) else out.where("_core").drop("_c", "_core")


def split_long(df: DataFrame, keys: list[str], size: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `size` rows, rows of the others or None without any).  `df` is read for its counts first."""
    more = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > (size or CHUNK)).select(*keys)
    if more.isEmpty():
        return df, None
    more = staged(more, "long-keys")
    same = lambda how: df.join(more.select(*[F.col(k).alias(f"_long_{k}") for k in keys]), _same(keys), how)
    return same("left_anti"), same("left_semi")


def _same(keys: list[str]) -> Column:
    """Equality of keys with their `_long_` twins; null keys are keys too."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_long_{k}"))
    return out


_SUMMARY = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], spec: dict, order: str = "frame", size: int | None = None,
            reverse: bool = False, chunk: Column | None = None, exclusive: bool = False) -> DataFrame:
    """Cumulative sum / max / min / last-non-null from the start of each series (or, with
    `reverse`, from its end).  spec: name -> (kind, Column).  `chunk` may be any column that is
    monotone in `order`; default is fixed-length chunks.  `exclusive` leaves out the row itself."""
    if _whole(size):
        w = W.partitionBy(*keys).orderBy(F.col(order).desc() if reverse else F.col(order)).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        return df.withColumns({n: (F.last(c, ignorenulls=True) if k == "last" else _SUMMARY[k](c)).over(w) for n, (k, c) in spec.items()})
    size = size or CHUNK
    base = staged(df.withColumn("_c", _order(order, size) if chunk is None else chunk), "running")      # read twice below
    o = F.col(order)
    aggs = []
    for name, (kind, col) in spec.items():
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            aggs.append(pick(col, F.when(col.isNotNull(), o)).alias(f"_s_{name}"))
        else:
            aggs.append(_SUMMARY[kind](col).alias(f"_s_{name}"))
    c_ord = F.col("_c").desc() if reverse else F.col("_c")
    cw = W.partitionBy(*keys).orderBy(c_ord).rowsBetween(W.unboundedPreceding, -1)
    summary = base.groupBy(*keys, "_c").agg(*aggs)
    carry = summary.select(*keys, "_c", *[
        (F.last(f"_s_{n}", ignorenulls=True) if k == "last" else _SUMMARY[k](f"_s_{n}")).over(cw).alias(f"_k_{n}")
        for n, (k, _) in spec.items()])
    w = W.partitionBy(*keys, "_c").orderBy(o.desc() if reverse else o)
    w = w.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    joined = base.join(carry, [*keys, "_c"], "left")
    cols = {}
    for name, (kind, col) in spec.items():
        k = F.col(f"_k_{name}")
        if kind == "last":
            cols[name] = F.coalesce(F.last(col, ignorenulls=True).over(w), k)
        elif kind == "sum":
            cols[name] = F.coalesce(F.sum(col).over(w) + F.coalesce(k, F.lit(0)), k)
        elif kind == "max":
            cols[name] = F.greatest(F.max(col).over(w), k)
        else:
            cols[name] = F.least(F.min(col).over(w), k)
    return joined.withColumns(cols).drop("_c", *[f"_k_{n}" for n in spec])


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str, size: int | None = None) -> DataFrame:
    """0-based row number per key.  Keys of at most `size` rows are numbered by one window.  For longer ones `bucket`, monotone
    in the first order column, cuts the rows; counts per bucket are accumulated, so no task sorts more than one (key, bucket)."""
    plain = lambda d: d.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))
    if _whole(size):
        return plain(df)
    short, long = split_long(df, keys, size)
    if long is None:
        return plain(short)
    b = staged(long.withColumn("_b", bucket), "numbered")                                               # read twice below
    n = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = n.select(*keys, "_b", F.coalesce(F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = W.partitionBy(*keys, "_b").orderBy(*order)
    numbered = (b.join(before, [*keys, "_b"]).withColumn(name, (F.col("_before") + F.row_number().over(w) - 1).cast("int"))
                .drop("_b", "_before"))
    return plain(short).unionByName(numbered.select(*df.columns, name))


def island_start(df: DataFrame, keys: list[str], flag: Column, gap: int = 0, order: str = "frame",
                 name: str = "start", size: int | None = None) -> DataFrame:
    """Rows where `flag` holds, with the order value that opens their island.  Islands stay joined
    over at most `gap` missing order values."""
    rows = df.where(flag)
    marked = over_neighbours(rows, keys, {"_open": lambda w: F.lag(order).over(w).isNull()
                                          | (F.col(order) - F.lag(order).over(w) > gap + 1)},
                             back=gap + 1, order=order, size=size)
    return running(marked, keys, {name: ("max", F.when(F.col("_open"), F.col(order)))}, order=order,
                   size=size).drop("_open")


def islands(df: DataFrame, keys: list[str], flag: Column, gap: int = 0, min_len: int = 1,
            order: str = "frame", size: int | None = None) -> DataFrame:
    """One row per island: start, end (exclusive); islands shorter than `min_len` are dropped."""
    s = island_start(df, keys, flag, gap, order, "start", size)
    return (s.groupBy(*keys, "start").agg((F.max(order) + 1).alias("end"))
            .where(F.col("end") - F.col("start") >= min_len))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank", buckets: int = 256,
                  split: bool | None = None, size: int | None = None) -> DataFrame:
    """Counts and tie-averaged ranks per (key, distinct value): columns value, ties, before, rank, n.
    Ties collapse before the shuffle.  Keys of at most `size` distinct values take one window; the values of
    others (of all with `split`) are cut into ranges, so one key spreads over tasks."""
    if not keys:
        return average_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, name, buckets, True).drop("_all")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))

    def plain(c):
        cum = F.sum("ties").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
        return _rank_columns(c.withColumn("_cum", cum).withColumn("n", F.sum("ties").over(W.partitionBy(*keys))), keys, value, name)
    if not split and _whole(size):
        return plain(counts)
    counts, short = staged(counts, "ties"), None
    if not split:
        short, counts = split_long(counts, keys, size)
        if counts is None:
            return plain(short)
    span = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("ties").alias("n"))
    c = counts.join(span, keys).withColumn("_vb", F.when(F.col("_hi") > F.col("_lo"), F.floor(
        (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)).otherwise(F.lit(0)))
    r = running(c, keys, {"_cum": ("sum", F.col("ties"))}, order=value, chunk=F.col("_vb"), size=CHUNK)
    r = _rank_columns(r, keys, value, name)
    return r if short is None else plain(short).unionByName(r)


def _rank_columns(r, keys, value, name):
    return r.select(*keys, value, "ties", (F.col("_cum") - F.col("ties")).alias("before"),
                    (F.col("_cum") - F.col("ties") + (F.col("ties") + 1) / 2).alias(name), "n")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], split: bool | None = None, size: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key without holding a large group in one task.  Keys of at most `size` values
    are sorted by one window; others (all with `split`) go by ranks of value ranges."""
    if not split and keys and _whole(size):
        q = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(*[F.lit(p) for p in probs.values()])).alias("_q"))
        return q.select(*keys, "n", *[F.get("_q", F.lit(i)).alias(m) for i, m in enumerate(probs)])
    if split or not keys:
        return _at_ranks(average_ranks(df, keys, value, split=split), keys, value, probs)
    short, long = split_long(staged(df.where(F.col(value).isNotNull()).select(*keys, value), "values"), keys, size)
    each = W.partitionBy(*keys)
    placed = short.withColumns({"before": F.row_number().over(each.orderBy(value)).cast("long") - 1, "ties": F.lit(1).cast("long"), "n": F.count("*").over(each)})
    q = _at_ranks(placed, keys, value, probs)
    return q if long is None else q.unionByName(_at_ranks(average_ranks(long, keys, value, split=True), keys, value, probs))


def _at_ranks(r: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles per key from rows (keys, value, ties, before, n)."""
    aggs, n1 = [], F.col("n") - 1
    lo_, hi_ = F.col("before"), F.col("before") + F.col("ties") - 1
    wanted = F.lit(False)
    for name, p in probs.items():
        k = F.floor(n1 * p)
        k2 = F.least(k + 1, n1)
        wanted = wanted | ((lo_ <= k2) & (k <= hi_))
        aggs += [F.max(F.when((lo_ <= k) & (k <= hi_), F.col(value))).alias(f"_a_{name}"),
                 F.max(F.when((lo_ <= k2) & (k2 <= hi_), F.col(value))).alias(f"_b_{name}")]
    g = r.where(wanted).groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    return g.select(*keys, "n", *[
        (F.col(f"_a_{m}") + (F.col(f"_b_{m}") - F.col(f"_a_{m}")) * (n1 * p - F.floor(n1 * p))).alias(m)
        for m, p in probs.items()])


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table by way of the shared folder that spark.checkpoint.dir names."""
    return staged(df, "cut")
