"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.lineage import ONE_TASK, cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of the component for every node that has an edge.

    Alternating large-star and small-star steps, each a minimum by node (with
    map-side minima, so a node with very many edges is one row for each task)
    and a join back.  Every round is cut in the shared folder; the rounds grow
    with the logarithm of the longest path, and a star takes one.  A graph of at
    most ONE_TASK edges is labelled in one task, in one job.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = _state(e)
    if before[0] <= ONE_TASK:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_labelled, f"node {kind}, label {kind}")
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    labelled = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labelled.union(labelled.select(F.col("label").alias("node"), "label").distinct())


def _labelled(batches):
    """Least nodes of the components of at most ONE_TASK edges: minima over edges, from end to end and from label to label, with short cuts."""
    edges = list(batches)
    if not sum(len(x) for x in edges):
        return
    ends = pa.chunked_array([x[k] for k in ("u", "v") for x in edges]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
    label = np.arange(len(order))
    while True:
        low = label.copy()
        for x, y in ((u, v), (v, u)):
            np.minimum.at(low, x, label[y])
            np.minimum.at(low, label[x], label[y])
        low = low[low]
        if (low == label).all():
            break
        label = low
    nodes = ends.dictionary.take(order)
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "label"])


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
