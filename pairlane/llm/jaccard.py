"""Grouped prefix join: word-shingle sets at a Jaccard likeness, and the components of their links."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WordHash, chunks, components, drop_staged, hashes, mix, shingle_set, stage, stage_dropping, words_of

BUCKETS = 1 << 16
BLOCK = 256
CROWD_BIT = 58
SKETCH = ["s0", "s1", "s2", "s3"]
_WORDS = WordHash(1 << 16)


def _set(text: str | None, k: int) -> np.ndarray:
    return shingle_set(hashes(words_of(text, lower=True), _WORDS), k)


def pieces(frames):
    """(doc_ids, texts) of consecutive rows that hold about a million characters: sets of a whole Arrow batch are never held at once."""
    for pdf in frames:
        at = 0
        for texts in chunks(pdf.text, 1_000_000):
            yield pdf.doc_id.iloc[at:at + len(texts)].to_numpy(), texts
            at += len(texts)


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Shingle occurrences (one a document) by the top 16 bits of the shingle, over all documents."""

    def count(frames):
        total = np.zeros(BUCKETS, np.int64)
        for pdf in frames:
            for part in chunks(pdf.text):
                total += np.bincount(np.concatenate([_set(t, k) >> np.uint64(48) for t in part]).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def order_key(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Global order of shingles: those in crowded buckets last, else by hash.  Any order that all documents share
    gives the same links; this one keeps very common passages out of the prefixes."""
    return (heavy[(s >> np.uint64(48)).astype(np.int64)] << np.uint64(CROWD_BIT)) | (mix(s) >> np.uint64(64 - CROWD_BIT))


def prefixes(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (hash of the set), p (hash of the prefix), s0 .. s3 (256 parity bits),
    prefix (the first shingles in the global order).  Keeps every row; null text is empty.

    Of n shingles at most `slack` = n - ceil(threshold * n) can be missing from a linked set, so two linked sets share the
    first l of their common shingles within their first slack + l.  With l half the slack (1 at least), a linked
    pair shares l prefix shingles, not just one, which sets that only quote the same passage seldom do."""
    counts = bucket_counts(docs, k)
    crowd = np.maximum(counts, 1) / max(1.0, float(counts.sum()) / BUCKETS)
    heavy = np.clip(np.floor(np.log2(np.maximum(crowd, 1))), 0, 30).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(heavy)       # 65,536 numbers, whatever the corpus

    def signed(x) -> int:
        return int(np.uint64(x).astype(np.int64))

    def sketch(frames):
        order = shared.value
        for ids, texts in pieces(frames):
            rows = []
            for d, t in zip(ids, texts):
                s = _set(t, k)
                n = len(s)
                keys = np.sort(order_key(s, order))
                slack = n - -(-threshold * n // 100)
                pre = keys[:slack + max(1, (slack + 1) // 2)]
                parity = np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64).tolist()
                whole = mix(s)
                rows.append((d, n, signed(s.sum() if n else 0), signed(whole.sum() if n else 0), signed(mix(pre + np.arange(len(pre), dtype=np.uint64)).sum() if n else 0), *parity, pre.astype(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "h1", "h2", "p", *SKETCH, "prefix"])

    return docs.select("doc_id", "text").mapInPandas(sketch, "doc_id long, n long, h1 long, h2 long, p long, " + "".join(f"{c} long, " for c in SKETCH) + "prefix array<long>")


class _Rules:
    """Exact conditions that two sets at the threshold meet; T is in percent."""

    def __init__(self, threshold: int):
        self.t = threshold

    def sizes(self, a: str, b: str) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.t

    def parity(self, na: str, nb: str, a: str, b: str) -> Column:
        """Every element of the symmetric difference flips one of 256 parity bits, so more differing bits rule a pair out.
        `a` and `b` end the names of the two sketches' columns; without a sketch nothing is ruled out."""
        flips = sum((F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b))) for c in SKETCH), F.lit(0))
        return F.coalesce(flips * (100 + self.t) <= (F.col(na) + F.col(nb)) * (100 - self.t), F.lit(True))

    def positions(self, na: str, nb: str, ia: str, ib: str) -> Column:
        """A shared element at places ia and ib bounds the overlap from both sides of it."""
        most = F.least(ia, ib) + 1 + F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib)) - 1
        return most * (100 + self.t) >= (F.col(na) + F.col(nb)) * self.t

    def shared(self, na: str, nb: str) -> Column:
        """How many prefix shingles two linked sets of these sizes share at least."""
        return self._half_slack(F.least(na, nb))

    def shared_with_any(self, n: str) -> Column:
        """How many prefix shingles a set of this size shares at least with whatever links with it: the smallest such set decides."""
        return self._half_slack(F.floor((F.col(n) * self.t + 99) / 100))

    def _half_slack(self, n: Column) -> Column:
        slack = n - F.floor((n * self.t + 99) / 100)
        return F.greatest(F.lit(1), F.floor((slack + 1) / 2))


def sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc_id, x: the shingle sets of the documents named in `ids`; no other document is read into a set."""

    def collect(frames):
        for ids, texts in pieces(frames):
            yield pd.DataFrame({"doc_id": ids, "x": [_set(t, k).astype(np.int64) for t in texts]})

    return stage(docs.select("doc_id", "text").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").mapInPandas(collect, "doc_id long, x array<long>"), "sets")


def shared_postings(prefixed: DataFrame) -> DataFrame:
    """gid, n, i, tok: each prefix shingle that more than one row of `prefixed` (gid, n, prefix) has.

    A shingle tells by its first bits how crowded its bucket is.  One from a bucket of less than twice the mean count is in
    few documents (at most 2 / 65,536 of all shingles), so its postings meet in one task and travel once; others, of any
    count, are counted first, which no single task does alone."""
    crowd = lambda tok: F.shiftrightunsigned(tok, CROWD_BIT) > 0
    spread = lambda df: df.select("gid", "n", F.posexplode("prefix").alias("i", "tok"))
    rare = spread(prefixed).where(~crowd("tok")).withColumn("c", F.count("*").over(W.partitionBy("tok"))).where("c > 1").drop("c")
    common = spread(prefixed.where(crowd(F.try_element_at("prefix", F.lit(-1))))).where(crowd("tok"))     # the crowded come last
    several = common.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    return rare.unionByName(common.join(several, "tok", "left_semi"))


def able(posts: DataFrame, rules: _Rules) -> DataFrame:
    """The postings (gid, n, tok, ...) of groups that have as many of them as any link needs.  Given postings of shingles that
    more than one group has, the others share too few with any group, so no link is lost."""
    enough = posts.groupBy("gid", "n").agg(F.count("*").alias("c")).where(F.col("c") >= rules.shared_with_any("n"))
    enough = stage(enough.select("gid"), "able")
    return stage_dropping(posts.join(enough, "gid", "left_semi"), "postings", posts, enough)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets meet the threshold."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("x").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.where(common * (100 + threshold) >= (F.size("xa") + F.size("xb")) * threshold).select("a", "b").distinct()


def linked_places(sets: list[np.ndarray], threshold: int, columns: int = 4096) -> np.ndarray:
    """Pairs (i, j), i < j, of sets that meet the threshold, by products of 0/1 matrices over the elements that occur twice."""
    size = np.array([len(x) for x in sets])
    names, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    slot = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    row, col = np.repeat(np.arange(len(sets)), size)[keep], slot[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        at = slice(*np.searchsorted(col, (lo, lo + columns)))
        m = np.zeros((len(sets), columns), np.float32)
        m[row[at], col[at] - lo] = 1
        common += m @ m.T
    meets = common * (100 + threshold) >= (size[:, None] + size) * threshold
    return np.argwhere(np.triu(meets, 1))


def block_links(members: DataFrame, sets: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components inside each cluster of `members` (cluster, doc_id, comp), enough of them
    to join whatever is linked.

    A cluster is cut into blocks of about `block` documents by a hash; a component larger than that has blocks of its own.
    Two blocks meet in one task, unless both are of one component, which needs no more links.  So a task holds two blocks,
    and a large component with a few strangers costs its size times the strangers' blocks.
    """
    comps = members.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    open_ = comps.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.when(F.col("c") <= block, F.col("c")).otherwise(0)).alias("small")).where("n > 1").drop("n")
    own = F.col("c") > block
    sized = members.join(open_, "cluster").join(comps, ["cluster", "comp"])
    number = F.pmod(F.xxhash64("doc_id"), F.ceil(F.when(own, F.col("c")).otherwise(F.col("small")) / block)).cast("int")
    placed = stage(sized.select("cluster", "doc_id", "comp", F.when(own, F.col("comp")).alias("big"), number.alias("k")), "blocks")
    blocks = placed.select("cluster", "big", "k").distinct()
    one, two = (blocks.select("cluster", F.struct("big", "k").alias(x)) for x in "xy")
    meet = one.join(two, "cluster").where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("x.big") == F.col("y.big"), F.lit(False)))
    meet = meet.select("cluster", F.xxhash64("cluster", "x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).select("cluster", "pair", F.col("z.big").alias("big"), F.col("z.k").alias("k"))
    same = placed["cluster"].eqNullSafe(meet["cluster"]) & placed["big"].eqNullSafe(meet["big"]) & (placed["k"] == meet["k"])
    dealt = placed.join(meet, same).select(meet["pair"], placed["doc_id"], placed["comp"]).join(sets, "doc_id")

    def meet_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)
        root = {c: c for c in pdf.comp.unique()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out, comp, ids = [], pdf.comp.to_numpy(), pdf.doc_id.to_numpy()
        for i, j in linked_places([np.asarray(x, np.int64) for x in pdf.x], threshold):
            a, b = find(comp[i]), find(comp[j])
            if a != b:
                root[b] = a
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("pair").applyInPandas(meet_all, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    A row's set is its distinct k-word shingles of A-Z-folded words (fewer words: their whole sequence; none or null: the
    empty set, which links with nothing).  Rows link when 100 * intersection >= threshold * union, and a component is
    named by its smallest doc_id.  Repeated rows and rows that share a doc_id are one node; a row with a null id takes
    its set's component.  An empty table gives no rows; other columns are not read.

    Equal sets collapse into one class, classes with equal size and equal prefix into one group, and groups meet
    on prefix shingles.  A group that shares fewer of them with all others together than a link needs meets no one (`able`).
    A component needs no more links than join it, so no list of all pairs of a group is made:

    1. Stars: each group meets the smallest group on each of its shingles, and each class its group's leader; that is
       linear in the postings.  Verified pairs are links and give components; all pairs, verified or not, give
       clusters.  A group whose shared shingles lie too far from the smallest group's to link with it, but are enough,
       is in its cluster too: it may link with other members, and left outside it would meet each of them in step 3.
    2. Inside a cluster with more than one component, blocks of documents meet in a task (`block_links`).
    3. Groups of different clusters that still share enough prefix shingles meet in pairs, member by member.  Only shingles
       of more than one cluster count, and groups left with too few of those are out here too: most only quote a passage.

    Every pair that the rules on sizes, positions and shared prefix shingles admit lies in a component, in a cluster or
    between two clusters, so the components are those of all links.
    """
    rules = _Rules(threshold)
    rows = stage(prefixes(docs, k, threshold).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    full = rows.where("n > 0")
    classes = full.where("doc_id IS NOT NULL").groupBy("h1", "h2", "n", "p", *SKETCH).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = classes.select("*", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"))
    leaders = classes.groupBy("n", "p").agg(F.min("rep").alias("gid"))
    classes = stage(classes.join(leaders, ["n", "p"]).select("h1", "h2", "n", *SKETCH, "rep", "row", "gid"), "classes")
    heads = full.join(classes.where("rep = gid").select("row"), "row", "left_semi").select(F.col("doc_id").alias("gid"), "n", "prefix")
    posts = able(stage(shared_postings(heads), "postings"), rules)
    # the end needs no prefixes: they are the bulk of the rows
    rows = stage_dropping(rows.select("doc_id", "n", "h1", "h2"), "ids", rows)

    hubs = posts.groupBy("tok").agg(F.min(F.struct("gid", "n", "i")).alias("hub")).select("tok", F.col("hub.gid").alias("hid"), F.col("hub.n").alias("hn"), F.col("hub.i").alias("hi"))
    star = posts.join(hubs, "tok").where((F.col("gid") > F.col("hid")) & rules.sizes("n", "hn")).groupBy(F.col("hid").alias("a"), F.col("gid").alias("b"), "n", "hn")
    star = star.agg(F.count("*").alias("c"), F.count_if(rules.positions("n", "hn", "i", "hi")).alias("near"))
    needed = rules.shared("n", "hn")
    star = star.select("a", "b", (F.col("near") * 4 >= needed).alias("near"), (F.col("c") >= needed).alias("far")).where("near OR far").select("a", "b", "near")
    inner = classes.where(F.col("rep") != F.col("gid")).select(F.col("gid").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("near"))
    star = stage(star.union(inner).groupBy("a", "b").agg(F.max("near").alias("near")), "stars")
    sets = sets_of(ends_of(star), docs, k)
    links = stage(verified(star.where("near").drop("near"), sets, threshold), "links")
    comp, cluster = components(links), components(star)

    members = cluster.select(F.col("comp").alias("cluster"), F.col("id").alias("doc_id")).join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("cluster", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    links = stage_dropping(links.union(block_links(members, sets, threshold)), "links", links, sets, star)

    posts = stage_dropping(posts.join(cluster.select(F.col("id").alias("gid"), F.col("comp").alias("cl")), "gid", "left").withColumn("cl", F.coalesce("cl", "gid")), "postings", posts)
    mixed = posts.groupBy("tok").agg(F.min("cl").alias("x"), F.max("cl").alias("y")).where("x <> y").select("tok")
    posts = able(stage_dropping(posts.join(mixed, "tok", "left_semi"), "postings", posts), rules)
    alone = F.count("*") == 1                              # a leader's sketch speaks for its group only if it is alone
    sketches = classes.groupBy("gid", "n").agg(*(F.when(alone, F.min(c)).alias(c) for c in SKETCH))
    sketched = posts.join(sketches, ["gid", "n"])
    left = sketched.select("tok", *(F.col(c).alias(f"{c}_a") for c in ("gid", "n", "i", "cl", *SKETCH)))
    right = sketched.select("tok", *(F.col(c).alias(f"{c}_b") for c in ("gid", "n", "i", "cl", *SKETCH)))
    met = left.join(right, "tok").where((F.col("gid_a") < F.col("gid_b")) & (F.col("cl_a") != F.col("cl_b")) & rules.sizes("n_a", "n_b") & rules.positions("n_a", "n_b", "i_a", "i_b") & rules.parity("n_a", "n_b", "_a", "_b"))
    met = met.groupBy(F.col("gid_a").alias("ga"), F.col("gid_b").alias("gb"), "n_a", "n_b").agg(F.count("*").alias("c")).where(F.col("c") >= rules.shared("n_a", "n_b"))
    member = lambda x: classes.select(F.col("gid").alias(f"g{x}"), F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in SKETCH))
    pairs = met.select("ga", "gb").join(member("a"), "ga").join(member("b"), "gb").where(rules.parity("n_a", "n_b", "_a", "_b"))
    pairs = stage_dropping(pairs.select("a", "b").distinct(), "pairs", posts)
    sets = sets_of(ends_of(pairs), docs, k)
    final = components(links.union(verified(pairs, sets, threshold)))
    drop_staged(links, pairs, sets)

    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("component_id"))
    named = named.dropDuplicates(["h1", "h2", "n"])
    out = rows.join(named, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """`docs` with one document of each component: the one it is named by.  Repeated rows collapse to one; rows without
    an id, which cannot name a component, stay."""
    kept = jaccard_components(docs, k, threshold).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))
