"""Graphs of nets and devices: components, pairs, chains of endpoints and their JSON form."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import ordered

#: Tasks for each shuffle partition in which pairs are made, and pairs that one makes at a time.
SHARE, PAIRS = 4, 500_000


def _apart(rows: DataFrame) -> DataFrame:
    """``rows``, one a key, dealt out evenly, so that the join that follows shuffles both its sides and can split the links of one node."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(_apart(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(_apart(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node long, component long) for each node of ``edges`` (a long, b long): the smallest node it reaches.

    Alternating large and small stars (Kiveris et al., 2014): rounds grow with the logarithm of a component's
    size. Every round is a table in the shared folder; only counts reach the driver. Links may repeat, point
    either way or join a node to itself. Links with null ends are ignored. No links, no rows.
    """
    links = edges.filter("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = materialise(links.distinct(), "links")
    now = links.filter("a <> b")
    for _ in range(most_rounds):
        now = materialise(_small_star(_large_star(now)), "stars")
        # Settled: every node hangs on one root, and no root hangs on another node.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.max("holds").alias("holds")).filter("n > 1 or (n > 0 and holds > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    alone = links.filter("a = b").select(F.col("a").alias("node")).join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def _pairs(batch: pa.RecordBatch, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of devices, the last column, of each net, the one before it; those of up to PAIRS pairs at a time are distinct."""
    width = batch.num_columns - 2
    batch = batch.filter(pa.array(new := fresh | ordered.changes([batch.column(width + 1)])))
    start = np.flatnonzero(fresh[new])
    size = np.diff(np.r_[start, len(batch)])
    later = np.repeat(start + size, size) - np.arange(len(batch)) - 1  # devices behind each in its net
    cut = np.cumsum(later) // PAIRS
    edges = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
    for s, e in zip(edges, np.r_[edges[1:], len(batch)], strict=True):
        u, v = ordered.paired(np.arange(s, e) + 1, later[s:e])
        if len(u):
            u = pa.array(u + s)
            device = batch.column(width + 1)
            columns = [*[batch.column(k).take(u) for k in range(width)], device.take(u), device.take(pa.array(v))]
            names = [*batch.schema.names[:width], "u", "v"]
            yield from pa.table(columns, names=names).group_by(names, use_threads=False).aggregate([]).combine_chunks().to_batches()


def shared_net_pairs(members: DataFrame, net_col: str = "net", device_col: str = "device", within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., u, v), u < v, distinct: devices that share a net. ``within`` names columns that keep graphs apart.

    Members are dealt by net and pairs by themselves, each sorted and swept: nothing is joined or held in a table of
    hashes, so a task holds its sort, which spills, and one net.
    """
    own = members.select(*within, F.col(net_col).alias("_net"), F.col(device_col).alias("u"))
    own = own.filter(reduce(and_, [F.col(c).isNotNull() for c in own.columns]))
    kinds = T.StructType([*[T.StructField(c, own.schema[c].dataType) for c in (*within, "u")], T.StructField("v", own.schema["u"].dataType)])
    pairs = ordered.by_line(own, [*within, "_net"], ["u"], _pairs, kinds, SHARE)
    return ordered.by_line(pairs, [*within, "u", "v"], [], lambda rows, fresh: rows.filter(pa.array(fresh)), kinds, SHARE)


def chain_edges(points: DataFrame, chain_col: str, order_cols: list[str], node_col: str) -> DataFrame:
    """(chain, place, source, target): each point with the next of its chain; chains of one point give none."""
    w = Window.partitionBy(chain_col).orderBy(*order_cols)
    rows = points.select(F.col(chain_col), F.row_number().over(w).alias("place"), F.col(node_col).alias("source"), F.lead(node_col).over(w).alias("target"), F.lead(F.lit(1)).over(w).alias("_more"))
    return rows.filter("_more = 1").drop("_more")


def collapsed(edges: DataFrame, within: str, label_col: str, order_col: str) -> DataFrame:
    """(within, u, v, label, parts): parallel edges as one; the label of the last by ``order_col`` stays."""
    ends = edges.select(within, F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), label_col, order_col)
    return ends.groupBy(within, "u", "v").agg(F.max_by(label_col, order_col).alias("label"), F.count(F.lit(1)).alias("parts"))


def graph_json(nodes: DataFrame, edges: DataFrame, graph_col: str = "cabinet") -> DataFrame:
    """(cabinet, json): ``{"nodes": [{id, class}], "edges": [{u, v}]}`` in order of ids, empty edges included."""
    n = nodes.groupBy(graph_col).agg(F.array_sort(F.collect_list(F.struct("id", "class"))).alias("nodes"))
    e = edges.groupBy(graph_col).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges"))
    none = F.array().cast("array<struct<u:bigint,v:bigint>>")
    joined = n.join(e, graph_col, "left").withColumn("edges", F.coalesce(F.col("edges").cast("array<struct<u:bigint,v:bigint>>"), none))
    return joined.select(graph_col, F.to_json(F.struct("nodes", "edges")).alias("json"))


def circuit_edges(panels: DataFrame) -> DataFrame:
    """(panel, component, type, label, place, source, target) from panels with nested components.

    A component links each of its connections with the next; with fewer than two it gives none.
    """
    c = panels.select(F.col("name").alias("panel"), F.posexplode("components").alias("at", "c"))
    pairs = F.expr("transform(sequence(1, size(c.connections) - 1), i -> struct(i as place, c.connections[i - 1] as source, c.connections[i] as target))")
    rows = c.filter(F.size("c.connections") > 1).select("panel", "at", F.col("c.id").alias("component"), F.col("c.type").alias("type"), F.explode(pairs).alias("p"))
    label = F.concat("component", F.lit(" ("), "type", F.lit(")"))
    return rows.select("panel", "at", "component", "type", label.alias("label"), F.col("p.place").alias("place"), F.col("p.source").alias("source"), F.col("p.target").alias("target"))
