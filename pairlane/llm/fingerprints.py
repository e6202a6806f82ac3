"""Homomorphic multiset hash: wide counter vectors summed over paragraphs, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stage

#: Three lanes of 21 bits in each 64-bit number, 21 numbers from each hash of a unit, two hashes: 126 lanes.
SUMS, SEEDS, LANE_BITS = 21, (0, 1), 21
LANES = 3 * SUMS * len(SEEDS)
_MASK = (1 << LANE_BITS) - 1
SUM_NAMES = [f"s{seed}_{i}" for seed in SEEDS for i in range(SUMS)]


def units(text: str) -> str:
    """SQL array of 64-bit hashes of a text: for each paragraph (a line with a word in it) the hash of its words and those
    of its runs of three words.  No run leaves its paragraph, so the array is a multiset sum over paragraphs."""
    words = r"filter(split(translate(p, '\u0009\u000B\u000C\u000D', '    '), ' '), w -> w <> '')"
    runs = "zip_with(w, zip_with(slice(w, 2, 1073741824), slice(w, 3, 1073741824), (b, c) -> xxhash64(b, c)), (a, h) -> xxhash64(a, h))"
    return f"flatten(transform(filter(transform(split({text}, '\\n'), p -> {words}), w -> size(w) > 0), w -> concat(array(xxhash64(concat_ws(' ', w))), {runs})))"


#: While units are summed, lanes j and j + 32 of a hash share a number, so that no lane carries into another below 2^31 units,
#: which is more than an array of one text's units holds.
WIDE = 32


def lanes(h: str, seed: int) -> list[Column]:
    """What one unit adds to each wide sum: bits j and j + 32 of its hash, each at the foot of a lane."""
    x = F.col(h) if seed == 0 else F.when(F.col(h).isNotNull(), F.xxhash64(h, F.lit(seed)))
    return [F.shiftrightunsigned(x, j).bitwiseAND(F.lit(1 + (1 << WIDE if j + WIDE < 3 * SUMS else 0))) for j in range(WIDE)]


def vectors(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, copies, n_units and the sums of every distinct key of `texts` (rows with one key have one text).

    Lanes are counts modulo 2^21, each by itself, so vectors of paragraphs can be added and subtracted (`combine`).
    Repeated rows of a key are counted and collapsed before any unit is made.
    """
    once = texts.groupBy(*keys).agg(F.first(text).alias("_t"), F.count("*").alias("copies"))
    return _summed(once, [*keys, "copies"], "_t")


def _summed(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_units and the sums of each row of `texts`, whose keys are distinct; a marker unit keeps rows without units."""
    exploded = texts.select(*keys, F.explode(F.expr(f"concat(array(CAST(NULL AS BIGINT)), {units(f'coalesce({text}, {chr(39)}{chr(39)})')})")).alias("h"))
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(f"w{seed}_{j}") for seed in SEEDS for j, c in enumerate(lanes("h", seed))]
    got = exploded.groupBy(*keys).agg(F.count("h").alias("n_units"), *sums)
    lane = lambda seed, n: F.shiftrightunsigned(f"w{seed}_{n % WIDE}", n // WIDE * WIDE).bitwiseAND(F.lit(_MASK))
    return got.select(*keys, "n_units", *(_packed(lambda j: lane(seed, 3 * i + j)).alias(f"s{seed}_{i}") for seed in SEEDS for i in range(SUMS)))


def _lane(c: str, j: int) -> Column:
    return F.shiftrightunsigned(c, j * LANE_BITS).bitwiseAND(F.lit(_MASK))


def _packed(lane) -> Column:
    return lane(0) + F.shiftleft(lane(1), LANE_BITS) + F.shiftleft(lane(2), 2 * LANE_BITS)


def combine(a: str, b: str, sign: int = 1) -> list[Column]:
    """Sums of prefixed columns a_*, b_* added (or, with sign -1, removed) lane by lane modulo 2^21."""
    return [_packed(lambda j, c=c: (_lane(f"{a}{c}", j) + sign * _lane(f"{b}{c}", j)).bitwiseAND(F.lit(_MASK))).alias(c) for c in SUM_NAMES]


def digest(n: Column, prefix: str = "") -> Column:
    """The vector as text: number of units and every sum in hexadecimal."""
    return F.concat_ws(".", F.hex(n), *(F.hex(f"{prefix}{c}") for c in SUM_NAMES))


def likeness(a: str, b: str) -> Column:
    """Share of units in common, 2 * common / (units of both), estimated from two vectors.

    With lanes read as sums of signs (+1 or -1 by a unit's bit), the mean square of their differences is the size of the
    multisets' symmetric difference in expectation, with a relative error of sqrt(2 / 126).  Differences are taken modulo
    2^21, nearest to none.  Equal vectors give 1, and two texts without units are alike.
    """
    na, nb = F.col(f"{a}n_units"), F.col(f"{b}n_units")
    half = 1 << LANE_BITS
    apart = lambda c, j: ((_lane(f"{a}{c}", j) - _lane(f"{b}{c}", j)) * 2 - (na - nb) + half).bitwiseAND(F.lit(2 * half - 1)) - half
    diff = sum(apart(c, j) * apart(c, j) for c in SUM_NAMES for j in range(3))
    value = F.lit(1.0) - diff / F.lit(float(LANES)) / (na + nb)
    return F.when(na + nb == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def _range_number(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id, by steps of about their square root; null ids come first."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda ends: F.size(F.filter(ends, lambda e: e <= F.col("doc_id")))
    coarse = below(F.lit(cuts[step - 1::step])) * step
    return F.when(F.col("doc_id").isNull(), 0).otherwise(coarse + below(F.slice(F.lit(cuts), coarse + 1, F.lit(step))))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, place (hash of id and text), next_id, next_place, next_text, copies: each row with its follower in
    ascending (doc_id, place), nulls first, and the first row after the last; a lone row follows itself.  Equal rows with equal
    followers are one row, and `copies` tells how many.

    Rows are cut into ranges by quantiles of the id, and each range also gets a copy of the first row of the next
    range in use, so that one exchange carries the texts and no window spans the table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("place"))
    cuts = docs.select("doc_id").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    rows = rows.withColumn("_r", _range_number(sorted(set(cuts))))
    heads = rows.groupBy("_r").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "place")).alias("f")).select("_r", "f.doc_id", "f.place")
    heads = sorted(heads.collect(), key=lambda r: r._r)                     # one row a range, at most `parts`
    before = dict(zip((r._r for r in heads), [r._r for r in heads[-1:] + heads[:-1]]))
    ids = [r.doc_id for r in heads if r.doc_id is not None]
    ghosts = rows.where((F.col("doc_id").isNull() | F.col("doc_id").isin(ids)) & F.col("place").isin([r.place for r in heads])).dropDuplicates(["_r"])
    to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    both = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts.withColumns({"_r": to[F.col("_r")], "_ghost": F.lit(1)}))
    order = W.partitionBy("_r").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "place")
    both = both.select("*", *(F.lead(c).over(order).alias(f"next_{n}") for c, n in (("doc_id", "id"), ("place", "place"), ("text", "text"))))
    # of a run of equal rows all but perhaps the last are followed by themselves; the run is sorted already
    run = W.partitionBy("_r", "_ghost", "doc_id", "place")
    own = F.col("next_id").eqNullSafe(F.col("doc_id")) & F.col("next_place").eqNullSafe(F.col("place"))
    both = both.withColumn("_own", own.cast("long")).withColumns({"_n": F.row_number().over(run.orderBy("place")), "_k": F.count("*").over(run), "_same": F.sum("_own").over(run)})
    kept = both.where("_ghost = 0 AND (_n = 1 OR _n = _k AND _own = 0)")
    return kept.withColumn("copies", F.when(F.col("_n") == 1, F.greatest("_same", F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long"))).drop("_r", "_ghost", "_own", "_n", "_k", "_same")


def edited(text: str, follower: str) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of its follower."""
    n = F.char_length(F.col(text))
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), (n - half).cast("int")), F.substring(F.col(follower), F.lit(1), half))


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Null text counts as empty.  Equal texts have equal fingerprints, and so do texts with the same paragraphs in
    another order.  Rows that share a doc_id are ordered by a hash of their text; equal rows follow one another.  Empty tables
    give no rows; other columns are not read.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, parts).withColumns({"n_chars": F.char_length("text").cast("long"), "_e": edited("text", "next_text")})
    rows = rows.select("doc_id", "place", "next_id", "next_place", "copies", "n_chars", F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"), "text", "_e")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("_e").alias("t"))))
    both = rows.select("doc_id", "place", "next_id", "next_place", "copies", "n_chars", "edited_sha256", kinds.alias("x")).select("*", "x.kind", "x.t").drop("x")
    key = ["doc_id", "place", "next_id", "next_place", "copies", "n_chars", "edited_sha256", "kind"]
    prints = stage(_summed(both, key, "t"), "vectors")

    def side(kind: int, prefix: str) -> DataFrame:
        return prints.where(F.col("kind") == kind).select(*(F.col(c).alias(f"{prefix}{c}") for c in prints.columns if c != "kind"))

    own, other = side(0, "a_"), side(1, "b_").drop("b_n_chars", "b_copies")
    after = side(0, "c_").drop("c_next_id", "c_next_place", "c_n_chars", "c_edited_sha256", "c_copies").dropDuplicates(["c_doc_id", "c_place"])
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in key[:4]] + [F.col("a_edited_sha256") == F.col("b_edited_sha256")]
    joined = own.join(other, same).join(after, F.col("a_next_id").eqNullSafe(F.col("c_doc_id")) & (F.col("a_next_place") == F.col("c_place")))
    out = joined.select(F.col("a_doc_id").alias("doc_id"), F.col("a_n_chars").alias("n_chars"), F.col("a_edited_sha256").alias("edited_sha256"),
                        digest(F.col("a_n_units"), "a_").alias("fingerprint"), digest(F.col("b_n_units"), "b_").alias("edited_fingerprint"),
                        likeness("a_", "b_").alias("near_edited"), likeness("a_", "c_").alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("a_copies"))).alias("copy"))
    return out.drop("copy")
