"""Conversation prefix trie: ROLLUP over positional turn-id columns, block by block of columns."""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stage, stage_dropping

#: Turn-id columns of one block; a longer conversation goes on in further blocks.
WIDTH = 8
#: Conversation ids of one text of ends, and blocks of one conversation that one task orders.
ENDS, CHUNK = 4096, 4096
_SLOTS = [f"t{j}" for j in range(WIDTH)]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (1, 2, ...), id, size of every turn, in the order of turn (null first), equal turns in that of their ids.

    A turn's id is a 128-bit hash of role and text (null: empty), size the text's UTF-8 bytes.  Rows are dealt out by ranges of
    (conv_id, turn, id), and a range's rows are numbered on from those of earlier ranges, so that no conversation has to fit a task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), "id"]
    ranged = stage(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    before = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("c")).select(
        "conv_id", "range", F.coalesce(F.sum("c").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(*order))
    return ranged.join(before, ["conv_id", "range"]).select("conv_id", (F.col("before") + rank).alias("p"), "id", "size")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations and the list of their ids: conversation c takes the first h turns of conversation c - c % 5, then its own
    turns after its first h, h = crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    turns = stage(turns.withColumns({"h": h, "base": base}), "numbered")
    convs = turns.select("conv_id", "h", "base").distinct()
    donor = turns.where("conv_id = base AND p <= 8")
    lengths = donor.groupBy("base").agg(F.count("*").alias("given"))
    itself = turns.where("conv_id = base").select("conv_id", "p", "id", "size")
    own = turns.where("conv_id <> base AND p > h").join(lengths, "base", "left").select("conv_id", (F.least(F.col("h"), F.coalesce("given", F.lit(0))) + F.col("p") - F.col("h")).alias("p"), "id", "size")
    given = convs.where("conv_id <> base").join(donor.select("base", "p", "id", "size"), "base").where("p <= h").select("conv_id", "p", "id", "size")
    return itself.unionByName(own).unionByName(given), convs.select("conv_id")


def _lane(place: Column, turn_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), place, turn_id)


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and block of WIDTH turns: conv_id, block, the block's turns as columns t0, t1, ..., and (k1, k2), the node
    of the prior block's last turn.

    A node's id is the exclusive or of two hashes of each (place, turn id) on its path, so the ids of all blocks come from sums over
    earlier blocks, and no block waits for another.  Every conversation has block 0, if only an empty one.
    """
    rows = turns.unionByName(convs.select("conv_id", F.lit(None).cast("long").alias("p"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("size")))
    rows = rows.withColumn("block", F.coalesce(F.floor((F.col("p") - 1) / WIDTH), F.lit(0))).withColumn("slot", (F.col("p") - 1) % WIDTH)
    lane = lambda seed: F.coalesce(F.bit_xor(F.when(F.col("p").isNotNull(), _lane(F.col("p"), F.col("id"), seed))), F.lit(0))
    got = rows.groupBy("conv_id", "block").agg(lane(1).alias("x1"), lane(2).alias("x2"), *(F.max(F.when(F.col("slot") == j, F.struct("id", "size"))).alias(t) for j, t in enumerate(_SLOTS)))
    got = stage(got.withColumn("chunk", F.floor(F.col("block") / CHUNK)), "blocks")
    earlier = lambda w, c: F.coalesce(F.bit_xor(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = got.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    over = W.partitionBy("conv_id").orderBy("chunk")
    chunks = chunks.select("conv_id", "chunk", earlier(over, "x1").alias("c1"), earlier(over, "x2").alias("c2"))
    within = W.partitionBy("conv_id", "chunk").orderBy("block")
    keyed = got.withColumns({"k1": earlier(within, "x1"), "k2": earlier(within, "x2")}).join(chunks, ["conv_id", "chunk"])
    return keyed.select("conv_id", "block", *(F.col(f"k{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"k{i}") for i in (1, 2)), "x1", "x2", *_SLOTS)


def _rollup(rows: DataFrame, sums: str) -> DataFrame:
    """All prefixes of the blocks in one aggregation; `level` is how many of a block's turns a row keeps, from grouping_id."""
    found = rows.sparkSession.sql(f"SELECT block, k1, k2, {', '.join(_SLOTS)}, CAST({WIDTH} - bit_count(grouping_id()) AS INT) AS level, {sums} "
                                  f"FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({', '.join(_SLOTS)})", rows=rows)
    last = F.get(F.array(*_SLOTS), F.col("level") - 1)
    return found.withColumn("last", last).where("level = 0 OR last IS NOT NULL")             # a shorter block has nothing on deeper levels


def _node_id(i: int) -> Column:
    node = F.col(f"k{i}")
    for j, t in enumerate(_SLOTS):
        node = node.bitwiseXOR(F.when(F.col(t).isNotNull(), _lane(F.col("block") * WIDTH + j + 1, F.col(f"{t}.id"), i)).otherwise(F.lit(0)))
    return node


def _nodes(rows: DataFrame) -> DataFrame:
    """A row per node with its id (n1, n2), its parent's (p1, p2), and what prefixes aggregate."""
    found = _rollup(rows, "count(*) AS n_convs, min(conv_id) AS conv_id").where("level > 0 OR block = 0")
    found = found.withColumns({f"n{i}": _node_id(i) for i in (1, 2)}).withColumn("depth", (F.col("block") * WIDTH + F.col("level")).cast("long"))
    up = lambda i: F.when(F.col("level") > 0, F.col(f"n{i}").bitwiseXOR(_lane(F.col("depth"), F.col("last.id"), i))).alias(f"p{i}")
    return found.select("block", "k1", "k2", *_SLOTS, "level", "depth", "n1", "n2", up(1), up(2), "n_convs", "conv_id",
                        ((F.col("n_convs") - 1) * F.coalesce("last.size", F.lit(0))).alias("own"))


def _below_blocks(nodes: DataFrame) -> DataFrame | None:
    """k1, k2, saved, leaves: sums over all nodes below the last node of a block that goes on, by doubling steps over the tree of
    blocks, so that a conversation of b blocks takes log2(b) rounds.  None where no block goes on."""
    totals = nodes.groupBy("block", "k1", "k2").agg(F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    if totals.where("block > 0").isEmpty():
        return None
    ends = nodes.where(f"level = {WIDTH}").select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.when(F.col("block") > 0, F.col("k1")).alias("u1"), F.when(F.col("block") > 0, F.col("k2")).alias("u2"))
    tree = stage(totals.where("block > 0").drop("block").join(ends, ["k1", "k2"]), "tree")
    while not tree.where("u1 IS NOT NULL").isEmpty():
        gains = tree.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        jumps = tree.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        step = tree.join(gains, ["k1", "k2"], "left").join(jumps, ["u1", "u2"], "left")
        tree = stage_dropping(step.select("k1", "k2", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                                          F.col("v1").alias("u1"), F.col("v2").alias("u2")), "tree", tree)
    return tree.select("k1", "k2", "saved", "leaves")


def _ends(rows: DataFrame) -> DataFrame:
    """n1, n2, ends: SHA-256 of the ids of the conversations that end at a node.

    Ids are put in order in pieces of at most ENDS ids; where a node has several pieces, they stream through one digest in
    order, whatever their number."""
    whole = rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("n1"), F.bit_xor("x2").alias("n2"))
    pieces = whole.groupBy("n1", "n2", F.floor(F.col("conv_id") / ENDS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    pieces = stage(pieces, "ends")
    counted = pieces.groupBy("n1", "n2").agg(F.count("*").alias("c"), F.min("ids").alias("ids"))
    short = counted.where("c = 1").select("n1", "n2", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))

    def digest(frames):
        at, sha = None, None
        for pdf in frames:
            out = []
            for n1, n2, ids in zip(pdf.n1, pdf.n2, pdf.ids):
                if at != (n1, n2):
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (n1, n2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["n1", "n2", "ends"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=["n1", "n2", "ends"])

    long = pieces.join(counted.where("c > 1").select("n1", "n2"), ["n1", "n2"], "left_semi").repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece")
    return short.unionByName(long.mapInPandas(digest, "n1 long, n2 long, ends string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of conversations: turns (conv_id, p = 1, 2, ..., id, size) and the ids of all conversations, also of those without turns.

    One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 as the query
    `op11_prefix_trie` states them.  No conversations give no rows.
    """
    rows = stage(blocks(turns, convs), "keyed")
    nodes = stage(_nodes(rows), "nodes")
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = stage_dropping(nodes.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "nodes", nodes)
    below = _below_blocks(nodes)
    weighted = nodes.select("block", "k1", "k2", *_SLOTS, "n1", "n2", "level", F.col("own").alias("saved"), F.col("leaf").alias("leaves"))
    if below is not None:
        deep = below.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("saved").alias("s"), F.col("leaves").alias("l"))
        weighted = weighted.join(deep, ["n1", "n2"], "left").withColumns({"saved": F.when(F.col("level") == WIDTH, F.col("saved") + F.coalesce("s", F.lit(0))).otherwise(F.col("saved")),
                                                                          "leaves": F.when(F.col("level") == WIDTH, F.col("leaves") + F.coalesce("l", F.lit(0))).otherwise(F.col("leaves"))})
    sums = _rollup(weighted.drop("n1", "n2", "level", "s", "l"), "sum(saved) AS saved_tokens, sum(leaves) AS n_leaves").where("level > 0 OR block = 0")
    sums = sums.select(*(_node_id(i).alias(f"n{i}") for i in (1, 2)), "saved_tokens", "n_leaves")
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, ["n1", "n2"]).join(_ends(rows), ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations of a table (conv_id, turn, role, text); other columns are not read.

    Turns are ordered by turn, null first; turns of one number, repeated rows among them, all count and stand in the order of a
    hash of role and text.  Null role or text is empty.  Rows with a null conv_id belong to no conversation and
    have no part.  Empty and very long texts are turns like others: only hash and length of a text travel.  An
    empty table gives no rows.
    """
    return trie(*rebuilt_turns(ordered_turns(conversations.select("conv_id", "turn", "role", "text"))))
