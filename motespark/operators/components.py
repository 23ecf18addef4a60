"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motespark.common import cut, release

#: edges that a task contracts at once
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of ``n`` numbers that the edges ``a``, ``b`` connect."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of every id in each chunk of edges: the least id that the chunk's edges connect it to."""

    def one(rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rest)
        both = pa.concat_arrays([*t["v"].chunks, *t["u"].chunks])
        ids, code = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
        root = roots(code[: t.num_rows], code[t.num_rows :], len(ids))
        yield from pa.table([pa.array(ids, both.type), pa.array(ids[root], both.type)], names=["id", "root"]).to_batches(max_chunksize=65_536)

    rest, held = [], 0
    for b in batches:
        rest.append(b)
        held += b.num_rows
        if held >= CHUNK:
            yield from one(rest)
            rest, held = [], 0
    if held:
        yield from one(rest)


def _stars(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` by alternating large-star and small-star rounds over (u, v), u > v."""
    e = cut(edges)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, e = e, cut(small.where("u <> v").distinct())
        release(old)
        # done when all edges lead from an id to a root: every id has one edge, and no root has any
        inner = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if inner.unionByName(e.groupBy("u").count().where("count > 1").select("u")).isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def connected_components(edges: DataFrame, a: str = "id_a", b: str = "id_b", near: Sequence[str] = ()) -> DataFrame:
    """``id`` and ``component`` (the least id in it) of every id that has an edge.

    Each task first contracts its edges to one root for each id; edges equal in the columns ``near``, such as a region
    of space, meet in one task. Only roots that share an id with other tasks go on to alternating large-star and
    small-star rounds (aggregations and joins on single ids, checkpointed, logarithmic in number), which end when all
    edges lead to roots. Nothing is collected. Self-loops and repeated edges don't matter; an edge with a NULL end is
    none. Ids are numbers or strings.
    """
    e = edges.select(*near, F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    kind = e.schema["u"].dataType
    if near:
        e = e.repartition(*near)
    local = cut(e.select("v", "u").mapInArrow(_contract, T.StructType([T.StructField("id", kind), T.StructField("root", kind)])))
    low = local.withColumn("low", F.min("root").over(W.partitionBy("id"))).where("root <> low").select(F.col("root").alias("u"), F.col("low").alias("v"))
    shared = cut(low.distinct())
    member = local.groupBy("id").agg(F.min("root").alias("component"))
    if shared.isEmpty():
        return member
    top = _stars(shared).select(F.col("id").alias("component"), F.col("component").alias("_top"))
    return member.join(top, "component", "left").select("id", F.coalesce("_top", "component").alias("component"))
