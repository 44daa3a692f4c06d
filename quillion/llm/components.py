"""Connected components, and the search for links inside buckets of candidates without all pairs of a bucket.

Everything stays distributed; each round's edges are a table in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import store

#: Nodes of a bucket up to which what its hub leaves open is compared as pairs.
SMALL = 16
#: Rows of either side of a cell, about.
CELL = 256
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

#: Payloads of pairs, in two lists -> whether each pair is near.
NearPairs = Callable[[list[bytes], list[bytes]], list[bool]]
#: Payloads of rows and of columns, and which of all their pairs are asked for -> matrix of whether those are near.
NearCells = Callable[[list[bytes], list[bytes], np.ndarray], np.ndarray]


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and to none that points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("back")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("back").alias("back"))
    return not store.has_rows(each.where((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("back") == 1))))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b), where component is its smallest node.

    Alternates large-star and small-star steps until only stars are left: a logarithmic number of rounds, whatever the
    links' shape. Self-links and repeated links are allowed.
    """
    edges = links.where("a != b").select("a", "b").distinct()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store.materialise(small.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "components")
        if _stars(edges):
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _hubs(members: DataFrame) -> DataFrame:
    """(bucket, hub): of each bucket's nodes the one that meets most others in all its buckets, which is likely to be their original."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    met = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("met"), F.collect_list("bucket").alias("buckets"))
    return met.select("node", "met", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))


def _verified(pairs: DataFrame, payloads: DataFrame, near_pairs: NearPairs) -> DataFrame:
    """Those of the distinct pairs (a, b) whose payloads are near."""

    def run(batches):
        for batch in batches:
            near = near_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    a, b = (payloads.select(F.col("node").alias(c), F.col("payload").alias(f"payload_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "payload_a", "payload_b").mapInArrow(run, LINKS)


def _met_before(left: list[list[int]], right: list[list[int]], bucket: int) -> np.ndarray:
    """Which pairs of rows and columns share a bucket of a smaller number too, from the buckets of each."""
    own = [[x for x in xs if x < bucket] for xs in (*left, *right)]
    ids = np.unique(np.array([x for xs in own for x in xs], np.int64))
    there = np.zeros((len(own), max(1, len(ids))), np.float32)
    row = np.repeat(np.arange(len(own)), [len(xs) for xs in own])
    there[row, np.searchsorted(ids, np.array([x for xs in own for x in xs], np.int64))] = 1
    return there[: len(left)] @ there[len(left) :].T > 0


def _cells(large: DataFrame, payloads: DataFrame, near_cells: NearCells) -> DataFrame:
    """Links of large's (bucket, node, c, out, n_out, n_in) between rows that are ``out`` and rows of other components, bucket by bucket, in cells of bounded size.

    Each side is cut into blocks of about ``CELL`` rows by a hash, n_out and n_in of them; a cell is a block of either. It gives links that span
    what it joins, not all links. A pair is compared in the first bucket that both are in, and once there. A node's
    buckets, as many as its payload makes at most, are a list until its payload has joined them.
    """
    in_ = F.collect_list(F.struct("bucket", "out", "n_out", "n_in")).alias("in_")
    nodes = large.groupBy("node", "c").agg(in_, F.collect_list("bucket").alias("buckets")).join(payloads, "node")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.select("node", "c", "buckets", "payload", F.explode("in_").alias("in_")).select("in_.*", "node", "c", "buckets", "payload")
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own)
        return rows.select("bucket", "node", "c", "out", "buckets", "payload", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            cl, cr, nl, nr = (x.to_numpy() for x in (left["c"], right["c_"], left["node"], right["node_"]))
            open_ = (cl[:, None] != cr[None, :]) & ~(right["out_"].to_numpy()[None, :] & (nl[:, None] > nr[None, :]))
            open_ &= ~_met_before(left["buckets"].to_pylist(), right["buckets_"].to_pylist(), left["bucket"][0].as_py())
            near = near_cells(left["payload"].to_pylist(), right["payload_"].to_pylist(), open_) if open_.any() else open_
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(near & open_), strict=True):
                x, y = find(int(cl[i])), find(int(cr[j]))
                if x != y:
                    root[x] = y
                    found.append((int(nl[i]), int(nr[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    keys = ["bucket", "n_out", "n_in"]
    outside = nodes.withColumn("in_", F.filter("in_", lambda x: x["out"])).where(F.size("in_") > 0)
    right = dealt(nodes, "n_in", "n_out").select("bucket", "n_out", "n_in", "node", "c", "out", "buckets", "payload").toDF("bucket_", "n_out_", "n_in_", "node_", "c_", "out_", "buckets_", "payload_")
    return dealt(outside, "n_out", "n_in").groupBy(*keys).cogroup(right.groupBy(*(f"{k}_" for k in keys))).applyInArrow(join, LINKS)


def linked(members: DataFrame, payloads: DataFrame, near_pairs: NearPairs, near_cells: NearCells, more: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that links connect; nodes without a link are absent.

    members has distinct (bucket, node), ``more`` distinct pairs (a, b) with a below b; both are read several times.
    payloads (node, payload) has what a comparison needs. A pair is a candidate if a bucket holds both or ``more`` has it;
    every candidate pair is compared unless its nodes are in one component already, so the components are those of all
    links.

    - First, each bucket's hub is compared with all its members: a pair a member.
    - Then, in buckets that still hold several components, the nodes outside the hub's component are compared with
      those of other components: as pairs in buckets of ``SMALL`` nodes at most, and otherwise in cells, which read
      each node once for each block of the other side and emit no pairs but links. A pair that shares many buckets, as
      near ones do, is compared in one of them.
    """
    with store.scratch(members.sparkSession) as kept:
        hubs = store.materialise(_hubs(members), "hubs")
        hubbed = store.materialise(members.join(hubs, "bucket"), "hubbed")
        pairs = hubbed.where("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        pairs = pairs.distinct() if more is None else pairs.distinct().join(more, ["a", "b"], "left_anti").unionByName(more)
        pairs = store.materialise(pairs, "pairs")
        links = store.materialise(_verified(pairs, payloads, near_pairs), "links")
        if not store.has_rows(members):
            return kept(components(links), "comps")
        comps = store.materialise(components(links), "comps")

        placed = store.materialise(hubbed.join(comps, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"), (F.col("node") == F.col("hub")).alias("is_hub")), "placed")
        each = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.max("is_hub").alias("is_hub"))
        own = lambda x: F.max(F.when(F.col("is_hub"), F.col(x)))
        heads = each.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), own("c").alias("head"), own("n").alias("n_head")).where("comps > 1")
        heads = heads.select("bucket", "size", "head", F.ceil((F.col("size") - F.col("n_head")) / CELL).cast("int").alias("n_out"), F.ceil(F.col("size") / CELL).cast("int").alias("n_in"))
        unresolved = store.materialise(placed.drop("is_hub").join(heads, "bucket"), "unresolved")
        outside = unresolved.where("c != head")
        small, other = outside.where(F.col("size") <= SMALL), unresolved.where(F.col("size") <= SMALL).select("bucket", F.col("node").alias("x"), F.col("c").alias("cx"))
        rest = small.join(other, "bucket").where("c != cx").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        rest = store.materialise(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
        large = unresolved.where(F.col("size") > SMALL).select("bucket", "node", "c", (F.col("c") != F.col("head")).alias("out"), "n_out", "n_in")
        cells = _cells(large, payloads, near_cells)
        new = store.materialise(_verified(rest, payloads, near_pairs).unionByName(cells), "links")
        return kept(components(links.unionByName(new)), "comps")
