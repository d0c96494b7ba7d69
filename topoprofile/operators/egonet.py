"""Weight inside and across the border of each node's closed neighbourhood.

For a node v with neighbours N (out-neighbours if directed), w without loops, l
loop weights, s out-strength without loops:

* undirected: internal = l(v) + s(v) + sum of l(u) + T(v),
  external = sum of s(u) - s(v) - 2 T(v), u in N, T the weight that closes triangles at v;
* directed: internal = l(v) + s(v) + sum of (w(u,v) + l(u)) + T(v),
  external = (s + l)(v) + sum of (s + l)(u) - internal.

All sums are whole numbers in limbs of the weights' common unit
(``functions.spans``), so the differences are exact. Triangles are listed once,
each edge pointing from the end of fewer neighbours to the other, which bounds
the wedges at hubs. A vertex without edges has 0 and 0.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoprofile.functions import Span, as_double, carried, limbs_of
from topoprofile.runtime import materialize
from topoprofile.sources.property_graph import PropertyGraph

#: Edges of a part of the triangle search, about; groups of nodes at least; wedges that a task looks up at once.
PART, LEAST_GROUPS, WEDGES = 1_000_000, 4, 1_000_000


def triangle_sums(graph: PropertyGraph, span: Span) -> DataFrame:
    """``id, t0, ...``: limb sums of the weights that close triangles at each node, a row per node and part.

    Nodes are dealt into groups, and a triangle is found in the one part that is
    made of its nodes' groups. Each edge goes to the parts that hold its two
    groups: as many as there are groups, whose number follows the square root of
    the edges. Wedges (some thousands at a time) never leave their task.
    """
    plain = graph.edges.where("src != dst")
    lo, hi, forward = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.col("src") < F.col("dst")
    limbs = [x.alias(f"v{j}") for j, x in enumerate(limbs_of(F.col("weight"), span))]
    pairs = plain.select(lo, hi, *limbs, (F.when(forward, 1).otherwise(2) if graph.directed else F.lit(3)).alias("ways"))
    names = [f"v{j}" for j in range(span.limbs)]
    if graph.directed:
        pairs = pairs.groupBy("lo", "hi").agg(*(F.sum(n).alias(n) for n in names), F.sum("ways").alias("ways"))
    pairs = materialize(pairs.withColumn("ways", F.col("ways").cast("int")), "pairs")
    groups = max(LEAST_GROUPS, math.isqrt(6 * pairs.count() // PART) + 1)
    count = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ranked = pairs.join(count.select(F.col("id").alias("lo"), F.col("n").alias("nl")), "lo").join(count.select(F.col("id").alias("hi"), F.col("n").alias("nh")), "hi")
    swap = F.struct("nh", "hi") < F.struct("nl", "lo")
    x, y = F.when(swap, F.col("hi")).otherwise(F.col("lo")), F.when(swap, F.col("lo")).otherwise(F.col("hi"))
    ways = F.when(swap & (F.col("ways") < 3), 3 - F.col("ways")).otherwise(F.col("ways"))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    arcs = ranked.select(x.alias("x"), y.alias("y"), *names, ways.alias("ways")).withColumns({"gx": group("x"), "gy": group("y")})
    third = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("gz")
    dealt = arcs.select("*", third).withColumn("g", F.array_sort(F.array("gx", "gy", "gz")))
    part = ((F.col("g")[0] * groups + F.col("g")[1]) * groups + F.col("g")[2]).alias("part")
    tag = (F.col("ways") + 4 * (F.col("gx") + groups * F.col("gy"))).alias("tag")
    kind = graph.edges.schema["src"].dataType.simpleString()
    directed = graph.directed

    def close(table: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*table["x"].chunks, *table["y"].chunks]).combine_chunks().dictionary_encode()
        ids, codes = ends.dictionary, ends.indices.to_numpy().astype(np.int64)
        x, y = np.split(codes, 2)
        tag, of = table["tag"].to_numpy().astype(np.int64), sum(_digits(table["part"][0].as_py(), groups))
        member = np.zeros(len(ids), np.int64)
        member[x], member[y] = tag // 4 % groups, tag // 4 // groups
        weights = [table[n].to_numpy() for n in names]
        order = np.argsort(x, kind="stable")
        x, y, ways, weights = x[order], y[order], tag[order] % 4, [w[order] for w in weights]
        keys = np.minimum(x, y) * len(ids) + np.maximum(x, y)
        by_key = np.argsort(keys)
        keys = keys[by_key]
        follow = np.searchsorted(x, x, "right") - np.arange(len(x)) - 1
        upto = np.cumsum(follow)
        sums = np.zeros((len(names), len(ids)), np.int64)
        reached = np.zeros(len(ids), bool)

        def add(node, weight_of, where) -> None:
            reached[node[where]] = True
            for total, w in zip(sums, weights, strict=True):
                np.add.at(total, node[where], w[weight_of[where]])

        def goes(edge, start) -> np.ndarray:
            """Whether the edge leads away from ``start``."""
            return np.where(x[edge] == start, ways[edge] & 1, ways[edge] & 2) > 0

        at = 0
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WEDGES, "right")))
            m = follow[at:end]
            one = np.repeat(np.arange(at, end), m)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(m) - m, m)
            at = end
            right = member[x[one]] + member[y[one]] + member[y[two]] == of
            one, two = one[right], two[right]
            b, c = y[one], y[two]
            key = np.minimum(b, c) * len(ids) + np.maximum(b, c)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            one, two, three, a, b, c = one[hit], two[hit], by_key[place[hit]], x[one[hit]], b[hit], c[hit]
            for node, left, right, across in ((a, one, two, three), (b, one, three, two), (c, two, three, one)):
                add(node, across, goes(left, node) & goes(right, node) if directed else np.ones(len(node), bool))
        return pa.table([ids.filter(pa.array(reached)), *(pa.array(total[reached]) for total in sums)], names=["id", *(f"t{j}" for j in range(len(names)))])

    schema = ", ".join([f"id {kind}", *(f"t{j} bigint" for j in range(span.limbs))])
    return dealt.select("x", "y", *names, tag, part).groupBy("part").applyInArrow(close, schema)


def _digits(number: int, base: int) -> tuple[int, int, int]:
    return number // base // base, number // base % base, number % base


def ego_features(graph: PropertyGraph) -> DataFrame:
    """``id, internal_edges, external_edges`` of every vertex."""
    span = graph.weight_span
    limbs = range(span.limbs)
    zero = F.lit(0.0)
    named = lambda values: [x.alias(f"{n}{j}") for n, v in values.items() for j, x in enumerate(limbs_of(v, span))]

    def summed(rows: DataFrame, names: str) -> DataFrame:
        """Limb sums by ``id``, carried, so that sums of them stay small too."""
        sums = rows.groupBy("id").agg(*(F.sum(f"{n}{j}").alias(f"{n}{j}") for n in names for j in limbs))
        return sums.select("id", *(x.alias(f"{n}{j}") for n in names for j, x in enumerate(carried([F.col(f"{n}{j}") for j in limbs]))))

    loop = F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(zero)
    plain = F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(zero)
    ends = [F.struct(F.col("src").alias("id"), *named({"l": loop, "s": plain}))]
    if not graph.directed:
        ends.append(F.struct(F.col("dst").alias("id"), *named({"l": zero, "s": plain})))
    own = summed(graph.edges.select(F.inline(F.array(*ends))), "ls")

    arcs = graph.adjacency.where("id != neighbor")
    near = own.select(F.col("id").alias("neighbor"), *(F.col(f"{a}{j}").alias(f"{b}{j}") for a, b in ("lm", "sn") for j in limbs))
    around = summed(arcs.join(near, "neighbor"), "mn")

    parts = [own, around, summed(triangle_sums(graph, span), "t")]
    if graph.directed:  # edges that come back from an out-neighbour
        back = graph.edges.where("src != dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "weight")
        back = back.join(arcs.select("id", "neighbor"), ["id", "neighbor"], "left_semi")
        parts.append(summed(back.select("id", *named({"r": F.col("weight")})), "r"))
    joined = reduce(lambda d, p: d.join(p, "id", "left"), parts, graph.nodes())
    v = lambda n, j: F.coalesce(F.col(f"{n}{j}"), F.lit(0).cast("bigint"))
    if graph.directed:
        internal = [v("l", j) + v("s", j) + v("r", j) + v("m", j) + v("t", j) for j in limbs]
        external = [v("n", j) - v("r", j) - v("t", j) for j in limbs]
    else:
        internal = [v("l", j) + v("s", j) + v("m", j) + v("t", j) for j in limbs]
        external = [v("n", j) - v("s", j) - v("t", j) - v("t", j) for j in limbs]
    return joined.select("id", as_double(internal, span).alias("internal_edges"), as_double(external, span).alias("external_edges"))
