"""Connected components of an edge table, without collecting any part of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.llm.shared import discard, same_stash, stash

#: Edges up to which one task follows them all (4 MB); rounds over more take a dozen jobs each.
ONE_TASK = 1 << 18


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: each node of all the edges, but the roots, and its root."""
    table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    under = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[under]), pa.array(nodes[root[under]])], names=["u", "v"])


def _least(pairs: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges a, b but the roots themselves.

    Alternates large-star and small-star steps, which need a number of rounds
    logarithmic in the size of components (Kiveris et al. 2014); each round is
    written to the shared folder.  Up to ``ONE_TASK`` edges are followed in one
    task instead.  Loops and repeated edges do no harm.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= ONE_TASK:
        before, now = now, stash(now.coalesce(1).mapInArrow(_rooted, "u bigint, v bigint"), "edges")
        discard(before)
        return same_stash(now.select(F.col("u").alias("node"), F.col("v").alias("root")), now)
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least(large)
        before = now
        now = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)), F.coalesce(F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as bigint))"), F.lit(0))).first()
        discard(before)
        if mark == new or new[0] == 0:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return same_stash(now.select(F.col("u").alias("node"), F.col("v").alias("root")), now)
