"""Proximity graphs per frame."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .joins import grid_join
from .ordered import cut_lineage, quantiles


def proximity_edges(det: DataFrame, edge_bl: float, min_conf: float = 0.3) -> DataFrame:
    """Edges (clip, frame, id_a < id_b) between centres closer than edge_bl * median(box height) / 3.3 of the
    clip; the radius is joined on, so each clip's grid has its own cell size."""
    d = det.where((F.col("conf") >= min_conf) & (F.col("track_id") >= 0)).withColumn("h", F.col("y2") - F.col("y1"))
    rad = quantiles(d, ["clip"], "h", {"m": 0.5}).select("clip", (F.col("m") / 3.3 * edge_bl).alias("radius"))
    d = d.join(rad, "clip")
    side = lambda x: d.select("clip", "frame", F.col("track_id").alias(f"id_{x}"), ((F.col("x1") + F.col("x2")) / 2).alias(f"x_{x}"), ((F.col("y1") + F.col("y2")) / 2).alias(f"y_{x}"), "radius")
    return grid_join(side("a"), side("b"), ["clip", "frame"], F.col("radius")).where(F.col("id_a") < F.col("id_b")).select("clip", "frame", "id_a", "id_b", "d")


def _onward(moves: DataFrame, keys: list[str]) -> DataFrame:
    """Each move (comp to _to) followed by the move of the label that it leads to."""
    then = moves.select(*keys, F.col("comp").alias("_to"), F.col("_to").alias("_on"))
    return moves.join(then, [*keys, "_to"], "left").select(*keys, "comp", F.coalesce("_on", "_to").alias("_to"))


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components inside each key group: keys, id, comp (smallest id).

    Each round every label moves as a whole to the smallest label that one of its members or their neighbours has, and all
    moves are followed to their end.  Labels with a smaller neighbour thus vanish, so labels halve in two rounds and
    rounds, like the steps that follow the moves, grow with the logarithm of a path.  Rounds end when nothing moves;
    groups are never gathered in one task.
    """
    both = edges.select(*keys, F.col("id_a").alias("id"), F.col("id_b").alias("nb")).unionByName(edges.select(*keys, F.col("id_b").alias("id"), F.col("id_a").alias("nb")))
    both = cut_lineage(both)
    # only nodes with an edge take part in the rounds
    lab = cut_lineage(both.groupBy(*keys, "id").agg(F.min("nb").alias("_m")).select(*keys, "id", F.least("id", "_m").alias("comp")))
    while True:
        near = both.join(lab.withColumnRenamed("id", "nb"), [*keys, "nb"]).groupBy(*keys, "id").agg(F.min("comp").alias("_m"))
        moves = cut_lineage(lab.join(near, [*keys, "id"]).groupBy(*keys, "comp").agg(F.min(F.least("comp", "_m")).alias("_to")))
        if moves.where("_to <> comp").isEmpty():
            return nodes.select(*keys, "id").join(lab, [*keys, "id"], "left").withColumn("comp", F.coalesce("comp", "id"))
        while True:
            ends = cut_lineage(_onward(_onward(moves, keys), keys))
            settled = ends.join(moves, [*keys, "comp", "_to"], "left_anti").isEmpty()
            moves = ends
            if settled:
                break
        lab = cut_lineage(lab.join(moves, [*keys, "comp"]).select(*keys, "id", F.col("_to").alias("comp")))


def frame_metrics(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Per frame: nodes, edges, components, largest component, mean degree."""
    k = ["clip", "frame"]
    size = comp.groupBy(*k, "comp").agg(F.count("*").alias("s")).groupBy(*k).agg(F.count("*").alias("n_components"), F.max("s").alias("largest_component"), F.sum("s").alias("n_nodes"))
    e = edges.groupBy(*k).agg(F.count("*").alias("n_edges"))
    n = F.coalesce("n_edges", F.lit(0))
    return size.join(e, k, "left").select(*k, "n_nodes", n.alias("n_edges"), "n_components", "largest_component", (2 * n / F.col("n_nodes")).alias("mean_degree"))
