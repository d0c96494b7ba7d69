"""The graph queries over the driver's tables, and their SQL.

The default graph: parts bought together in an order with quantity 40 or more,
weighted by the number of orders. The directed one: which user acts after which,
with loops. Features that SQL recomputes are rounded to six places on both sides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topoprofile.functions import aggregations
from topoprofile.operators.binning import bin_cuts, log_bin
from topoprofile.operators.components import connected_components
from topoprofile.operators.egonet import ego_features
from topoprofile.operators.factor import nmf, quantize_table
from topoprofile.operators.local import AttributeOptions, degrees, local_features
from topoprofile.operators.mdl import cheapest, divergence, encoding_cost, reconstructed, rescale
from topoprofile.operators.prune import chebyshev, feature_groups, oldest, survivors
from topoprofile.plans.profile import ProfileExtractor, aggregate_neighbors
from topoprofile.plans.profile import neighborhood_features as generation_zero
from topoprofile.plans.roles import RoleFinder, role_of, shares_of
from topoprofile.runtime import materialize
from topoprofile.sources.property_graph import PropertyGraph

#: Coarse enough that the three features fall into one group.
THRESHOLD = 12
GEN0 = ("degree", "internal_edges", "external_edges")
BORN = {"external_edges": 0, "degree": 1, "internal_edges": 1}


def co_purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part pairs of an order; dealt by order, so each order's few lines pair up locally."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 40").select("l_orderkey", "l_partkey").distinct()
    baskets = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("p")).where("size(p) > 1")  # an order's lines are few
    pairs = baskets.select(F.explode(F.expr("flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> struct(a AS src, b AS dst))))")).alias("e"))
    return pairs.groupBy("e.src", "e.dst").agg(F.count("*").cast("double").alias("weight"))


def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events' users. The order is global: event times are dealt by ranges, and each range hands its last user on."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id").where("user_id IS NOT NULL")
    ranged = materialize(events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn("p", F.spark_partition_id()), "events")
    inside = ranged.withColumn("prev", F.lag("user_id").over(Window.partitionBy("p").orderBy("ts", "event_id")))
    ends = ranged.groupBy("p").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    seams = ends.select(F.lag("last").over(Window.orderBy("p")).alias("src"), F.col("first").alias("dst"))  # a row per range
    pairs = inside.select(F.col("prev").alias("src"), F.col("user_id").alias("dst")).unionByName(seams).where("src IS NOT NULL")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def co_purchase(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.from_edges(co_purchase_edges(spark, sf_dir), weight="weight").persist()


def with_parts(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return PropertyGraph.from_edges(co_purchase_edges(spark, sf_dir), weight="weight", vertices=parts, id_col="p_partkey").persist()


def transition(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.from_edges(transition_edges(spark, sf_dir), weight="weight", directed=True).persist()


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") if c in keys else F.round(F.col(f"`{c}`"), 6).alias(c) for c in df.columns))


def _long(df: DataFrame, key: str = "id") -> DataFrame:
    names = [c for c in df.columns if c != key]
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), F.round(F.col(f"`{n}`").cast("double"), 6).alias("value")) for n in names))
    return df.select(key, F.inline(rows))


def degree(spark, sf_dir):
    return _rounded(degrees(co_purchase(spark, sf_dir)), "id")


def in_out_total_degree(spark, sf_dir):
    return _rounded(degrees(transition(spark, sf_dir)), "id")


def neighbors(spark, sf_dir):
    return co_purchase(spark, sf_dir).neighbors()


def neighbors_directed(spark, sf_dir):
    return transition(spark, sf_dir).neighbors()


def ego(spark, sf_dir):
    return _rounded(ego_features(co_purchase(spark, sf_dir)), "id")


def ego_directed(spark, sf_dir):
    return _rounded(ego_features(transition(spark, sf_dir)), "id")


def neighborhood_features(spark, sf_dir):
    return _rounded(generation_zero(co_purchase(spark, sf_dir)), "id")


def attribute_features(spark, sf_dir):
    return _rounded(local_features(with_parts(spark, sf_dir), AttributeOptions(attributes=True, include=("p_size", "p_retailprice", "p_name"), exclude=("p_name",))), "id")


def attribute_features_all(spark, sf_dir):
    return _rounded(local_features(with_parts(spark, sf_dir), AttributeOptions(attributes=True)), "id")


def edge_count(spark, sf_dir):
    graph = co_purchase(spark, sf_dir)
    nodes = F.lit(graph.nodes().count()).cast("long")
    return graph.edges.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"), F.max(nodes).alias("n_nodes"))


def _gen0(spark, sf_dir) -> tuple[PropertyGraph, DataFrame]:
    graph = co_purchase(spark, sf_dir)
    return graph, materialize(generation_zero(graph), "generation0")


def next_features_gen1(spark, sf_dir):
    graph, features = _gen0(spark, sf_dir)
    return _long(aggregate_neighbors(graph.neighbors(), features, list(GEN0), aggregations(None)))


def next_features_custom(spark, sf_dir):
    graph, features = _gen0(spark, sf_dir)
    spread = ("spread", lambda c: F.max(c) - F.min(c))
    return _long(aggregate_neighbors(graph.neighbors(), features, list(GEN0), aggregations(["min", "max", "count", "nunique", spread])))


def log_binning(spark, sf_dir):
    _, features = _gen0(spark, sf_dir)
    binned = log_bin(features, GEN0)
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in GEN0))
    return binned.select("id", F.inline(rows))


def _distances(features: DataFrame) -> dict:
    cuts = bin_cuts(features, GEN0)
    return chebyshev(features, {n: cuts[n] for n in GEN0})


def chebyshev_pairs(spark, sf_dir):
    rows = [(*sorted(p), int(d)) for p, d in _distances(_gen0(spark, sf_dir)[1]).items()]
    return spark.createDataFrame(rows, "f1 string, f2 string, distance int")


def groups(spark, sf_dir):
    found = feature_groups(_distances(_gen0(spark, sf_dir)[1]), THRESHOLD)
    return spark.createDataFrame([(min(g), f) for g in found for f in sorted(g)], "group string, feature string")


def oldest_feature(spark, sf_dir):
    found = feature_groups(_distances(_gen0(spark, sf_dir)[1]), THRESHOLD)
    return spark.createDataFrame([(min(g), oldest(g, BORN)) for g in found], "group string, oldest string")


def prune_gen0(spark, sf_dir):
    distances = _distances(_gen0(spark, sf_dir)[1])
    return spark.createDataFrame([(f,) for f in survivors(GEN0, distances, THRESHOLD, BORN)], "feature string")


def components(spark, sf_dir):
    return connected_components(co_purchase(spark, sf_dir).edges)


def reachable(spark, sf_dir):
    return transition(spark, sf_dir).reachable(1)


def _fixed_table(spark, sf_dir) -> DataFrame:
    """A table and factors that SQL can make too: functions of the part key."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    v = F.array(*(((F.col("p_partkey") * m) % 7).cast("double") for m in (1, 2, 3)))
    g = F.array(*(((F.col("p_partkey") * m) % 4 + b).cast("double") for m, b in ((1, 0), (3, 1))))
    return part.select(F.col("p_partkey").alias("id"), v.alias("v"), g.alias("g"))


FIXED_F = ((1.0, 0.5, 2.0), (0.25, 1.0, 0.5))


def _approx(g: Column) -> Column:
    return reconstructed(g, np.array(FIXED_F))


def encoding_costs(spark, sf_dir):
    row = _fixed_table(spark, sf_dir).select(F.explode("g").alias("x")).agg(F.count_distinct("x"), F.count("*")).first()
    cost = encoding_cost(row[0], len({x for r in FIXED_F for x in r}), row[1], 6)
    return spark.createDataFrame([(cost,)], "encoding_cost long")


def error_cost(spark, sf_dir):
    return _fixed_table(spark, sf_dir).agg(F.round(F.sum(divergence(F.col("v"), _approx(F.col("g")))), 6).alias("error_cost"))


def reconstruct(spark, sf_dir):
    rows = F.arrays_zip(F.array(F.lit(0), F.lit(1), F.lit(2)).alias("k"), _approx(F.col("g")).alias("x"))
    return _fixed_table(spark, sf_dir).select("id", F.inline(rows)).select("id", "k", F.round("x", 6).alias("x"))


def _cell_costs(spark, sf_dir) -> dict[tuple[int, int], tuple[float] | None]:
    """Costs by cell, summed over the whole part table; some cells are missing."""
    roles, bits = F.col("p_partkey") % 4, F.floor(F.col("p_partkey") / 4) % 11
    cells = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(roles.alias("n_roles"), bits.alias("n_bits")).agg(F.sum(F.col("p_partkey") * 13 % 11).alias("cost"))
    # 44 at most
    return {(r.n_roles, r.n_bits): None if (r.n_roles + r.n_bits) % 5 == 0 else (r.cost,) for r in cells.collect()}


def rescale_costs(spark, sf_dir):
    present = _cell_costs(spark, sf_dir)
    costs = np.full((4, 11), np.nan)
    for (r, b), cost in present.items():
        costs[r, b] = cost[0] if cost else np.nan
    scaled = rescale(costs)
    rows = [(r, b, None if np.isnan(scaled[r, b]) else round(float(scaled[r, b]), 6)) for r, b in sorted(present)]
    return spark.createDataFrame(rows, "n_roles int, n_bits int, rescaled double")


def best_cell(spark, sf_dir):
    n_roles, n_bits = cheapest(_cell_costs(spark, sf_dir))
    return rescale_costs(spark, sf_dir).where((F.col("n_roles") == n_roles) & (F.col("n_bits") == n_bits))


def quantize_fixed(spark, sf_dir):
    """Three levels for entries that SQL can make: whole squares, 97 distinct ones."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    g = F.array(*(F.pow(F.col("p_partkey") * m % 97, 2).cast("double") for m in (5, 31)))
    out = quantize_table(part.select(F.col("p_partkey").alias("id"), g.alias("g")), 3)
    return out.select("id", *(F.round(F.col("g")[k], 6).alias(f"g{k}") for k in (0, 1)))


def role_argmax(spark, sf_dir):
    return _fixed_table(spark, sf_dir).select("id", role_of(F.col("g")).alias("role"))


def role_percentage(spark, sf_dir):
    shares = _fixed_table(spark, sf_dir).select("id", shares_of(F.col("g")).alias("p"))
    return shares.select("id", *(F.round(F.col("p")[k], 6).alias(f"role_{k}") for k in (0, 1)))


def adjacency_json(spark, sf_dir):
    edges = co_purchase_edges(spark, sf_dir)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    inner = both.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dst").cast("string"), F.struct("weight")))).alias("near"))
    texts = inner.select(F.to_json(F.create_map(F.col("src").cast("string"), "near")).alias("value"))
    return _rounded(PropertyGraph.from_adjacency_json(texts).edges, "src", "dst")


def _profile(spark, sf_dir) -> DataFrame:
    return ProfileExtractor(co_purchase(spark, sf_dir)).extract()


def profile_full(spark, sf_dir):
    return _long(_profile(spark, sf_dir))


def profile_directed(spark, sf_dir):
    return _long(ProfileExtractor(transition(spark, sf_dir)).extract())


def _table(features: DataFrame) -> DataFrame:
    names = [c for c in features.columns if c != "id"]
    return materialize(features.select("id", F.array(*(F.col(f"`{c}`") for c in names)).alias("v")), "features")


def nmf_factors(spark, sf_dir):
    return nmf(_table(_profile(spark, sf_dir)), 3)[0]


def quantize(spark, sf_dir):
    return quantize_table(materialize(nmf(_table(_profile(spark, sf_dir)), 3)[0], "factor"), 8)


def roles_fixed(spark, sf_dir):
    return RoleFinder(n_roles=3).fit(_profile(spark, sf_dir)).roles


def role_model_selection(spark, sf_dir):
    finder = RoleFinder().fit(_profile(spark, sf_dir))
    rows = [(r, b, None if c is None else float(c[0]), None if c is None else c[1], (r, b) == (finder.n_roles, finder.bits)) for (r, b), c in finder.costs.items()]
    return spark.createDataFrame(rows, "n_roles int, n_bits int, encoding_cost double, error_cost double, chosen boolean")


QUERIES = {
    "degree": degree,
    "in_out_total_degree": in_out_total_degree,
    "neighbors": neighbors,
    "neighbors_directed": neighbors_directed,
    "ego": ego,
    "ego_directed": ego_directed,
    "neighborhood_features": neighborhood_features,
    "attribute_features": attribute_features,
    "attribute_features_all": attribute_features_all,
    "edge_count": edge_count,
    "next_features_gen1": next_features_gen1,
    "next_features_custom": next_features_custom,
    "log_binning": log_binning,
    "chebyshev_pairs": chebyshev_pairs,
    "feature_groups": groups,
    "oldest_feature": oldest_feature,
    "prune_gen0": prune_gen0,
    "connected_components": components,
    "reachable": reachable,
    "encoding_cost": encoding_costs,
    "error_cost": error_cost,
    "reconstruct": reconstruct,
    "rescale_costs": rescale_costs,
    "best_cell": best_cell,
    "quantize_fixed": quantize_fixed,
    "role_argmax": role_argmax,
    "role_percentage": role_percentage,
    "adjacency_json": adjacency_json,
    "profile_full": profile_full,
    "profile_directed": profile_directed,
    "nmf_factors": nmf_factors,
    "quantize": quantize,
    "roles_fixed": roles_fixed,
    "role_model_selection": role_model_selection,
}

_EDGES = """l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 40),
e AS (SELECT a.p AS s, b.p AS t, CAST(count(*) AS DOUBLE) AS w FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2),
d AS (SELECT s, t, w FROM e UNION ALL SELECT t, s, w FROM e)"""
_STEPS = """u AS (SELECT user_id AS t, lag(user_id) OVER (ORDER BY ts, event_id) AS s FROM events WHERE user_id IS NOT NULL),
e AS (SELECT s, t, CAST(count(*) AS DOUBLE) AS w FROM u WHERE s IS NOT NULL GROUP BY 1, 2),
v AS (SELECT s AS id FROM e UNION SELECT t FROM e)"""
_EGO = """nb AS (SELECT s AS v, t AS u FROM d UNION SELECT s, s FROM d),
i AS (SELECT nb.v, sum(d.w) / 2 AS x FROM nb JOIN d ON nb.u = d.s JOIN nb b ON b.v = nb.v AND b.u = d.t GROUP BY 1),
x AS (SELECT nb.v, sum(d.w) AS x FROM nb JOIN d ON nb.u = d.s LEFT JOIN nb b ON b.v = nb.v AND b.u = d.t WHERE b.u IS NULL GROUP BY 1),
g AS (SELECT z.id, z.degree, coalesce(i.x, 0.0) AS internal_edges, coalesce(x.x, 0.0) AS external_edges
  FROM (SELECT s AS id, sum(w) AS degree FROM d GROUP BY 1) z LEFT JOIN i ON i.v = z.id LEFT JOIN x ON x.v = z.id)"""
_LONG = " UNION ALL ".join(f"SELECT id, '{f}' AS feature, {f} AS value FROM g" for f in GEN0)
_BINS = f"""q AS ({_LONG}),
c AS (SELECT feature, value, count(*) AS m, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) AS c, sum(count(*)) OVER (PARTITION BY feature) AS n FROM q GROUP BY feature, value),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) AS k FROM c),
f AS (SELECT feature, k, value, c, n, greatest(CAST(floor(0.5 * n) AS BIGINT), 1) AS t, 0 AS bin FROM r WHERE k = 1
  UNION ALL SELECT r.feature, r.k, r.value, r.c, r.n,
    CASE WHEN f.c >= f.t THEN f.c + greatest(CAST(floor(0.5 * (f.n - f.c)) AS BIGINT), 1) ELSE f.t END,
    CASE WHEN f.c >= f.t THEN f.bin + 1 ELSE f.bin END FROM f JOIN r ON r.feature = f.feature AND r.k = f.k + 1),
b AS (SELECT q.id, q.feature, f.bin FROM q JOIN f USING (feature, value))"""
_PAIRS = """p AS (SELECT a.feature AS f1, b.feature AS f2, max(abs(a.bin - b.bin)) AS distance FROM b a JOIN b ON a.id = b.id AND a.feature < b.feature GROUP BY 1, 2)"""
_GROUPS = f"""h AS (SELECT f1 AS a, f2 AS b FROM p WHERE distance <= {THRESHOLD} UNION SELECT f2, f1 FROM p WHERE distance <= {THRESHOLD}),
y AS (SELECT a, b FROM h UNION SELECT h.a, y.b FROM h JOIN y ON h.b = y.a),
m AS (SELECT a AS feature, least(a, min(b)) AS "group" FROM y GROUP BY a)"""
_ORDER = "CASE feature WHEN 'external_edges' THEN 0 ELSE 1 END"
_ALL = f"WITH RECURSIVE {_EDGES}, {_EGO}, {_BINS}, {_PAIRS}, {_GROUPS}"
_G = "g AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS DOUBLE) AS g0, CAST(p_partkey * 3 % 4 + 1 AS DOUBLE) AS g1, [CAST(p_partkey * m % 7 AS DOUBLE) FOR m IN [1, 2, 3]] AS v FROM part)"
_HAT = [f"(g0 * {FIXED_F[0][k]} + g1 * {FIXED_F[1][k]})" for k in range(3)]
_AGGS = lambda fns: " UNION ALL ".join(f"SELECT d.s AS id, '{f}({n})' AS feature, round(CAST({sql.format(f)} AS DOUBLE), 6) AS value FROM d JOIN g ON g.id = d.t GROUP BY d.s" for f in GEN0 for n, sql in fns)
_GRID = "k AS (SELECT CAST(p_partkey % 4 AS INT) AS n_roles, CAST(floor(p_partkey / 4.0) % 11 AS INT) AS n_bits, sum(p_partkey * 13 % 11) AS total FROM part GROUP BY ALL), r AS (SELECT n_roles, n_bits, CASE WHEN (n_roles + n_bits) % 5 <> 0 THEN CAST(total AS DOUBLE) END AS cost FROM k), z AS (SELECT n_roles, n_bits, round(cost / nullif(sqrt(sum(cost * cost) OVER (PARTITION BY n_roles)), 0), 6) AS rescaled FROM r)"

_SQUARES = "pow(p_partkey * 5 % 97, 2) AS g0, pow(p_partkey * 31 % 97, 2) AS g1"
_MEAN = "(SELECT sum(x * n) / sum(n) FROM h WHERE {})"
_LOW, _HIGH = "x <= (a + b) / 2", "x > (b + c) / 2"
_NEAR = "round(CASE WHEN {0} <= (a + b) / 2 THEN a WHEN {0} <= (b + c) / 2 THEN b ELSE c END, 6) AS {0}"
#: Lloyd steps from the first, middle and last distinct value; sixty are more than these entries take to settle.
_LLOYD = f"""
WITH RECURSIVE g AS (SELECT p_partkey AS id, {_SQUARES} FROM part),
h AS (SELECT x, count(*) AS n FROM (SELECT g0 AS x FROM g UNION ALL SELECT g1 FROM g) GROUP BY x),
steps AS (
  SELECT 0 AS k, min(x) AS a, quantile_disc(x, 0.5) AS b, max(x) AS c FROM h
  UNION ALL
  SELECT k + 1, {_MEAN.format(_LOW)}, {_MEAN.format(f"NOT ({_LOW}) AND NOT ({_HIGH})")}, {_MEAN.format(_HIGH)} FROM steps WHERE k < 60)
SELECT id, {_NEAR.format("g0")}, {_NEAR.format("g1")} FROM g, steps WHERE k = 60"""


ORACLE_SQL = {
    "degree": f"WITH {_EDGES} SELECT s AS id, sum(w) AS degree FROM d GROUP BY 1",
    "in_out_total_degree": f"""WITH {_STEPS} SELECT v.id, coalesce(i.w, 0.0) AS in_degree, coalesce(o.w, 0.0) AS out_degree, coalesce(i.w, 0.0) + coalesce(o.w, 0.0) AS total_degree FROM v
        LEFT JOIN (SELECT t AS id, sum(w) AS w FROM e GROUP BY 1) i USING (id) LEFT JOIN (SELECT s AS id, sum(w) AS w FROM e GROUP BY 1) o USING (id)""",
    "neighbors": f"WITH {_EDGES} SELECT s AS id, t AS neighbor FROM d",
    "neighbors_directed": f"WITH {_STEPS} SELECT s AS id, t AS neighbor FROM e",
    "ego": f"WITH {_EDGES}, {_EGO} SELECT id, round(internal_edges, 6) AS internal_edges, round(external_edges, 6) AS external_edges FROM g",
    "ego_directed": f"""WITH {_STEPS}, nb AS (SELECT s AS v, t AS u FROM e UNION SELECT id, id FROM v),
        i AS (SELECT nb.v, sum(e.w) AS x FROM nb JOIN e ON nb.u = e.s JOIN nb b ON b.v = nb.v AND b.u = e.t GROUP BY 1),
        x AS (SELECT nb.v, sum(e.w) AS x FROM nb JOIN e ON nb.u = e.s LEFT JOIN nb b ON b.v = nb.v AND b.u = e.t WHERE b.u IS NULL GROUP BY 1)
        SELECT id, coalesce(i.x, 0.0) AS internal_edges, coalesce(x.x, 0.0) AS external_edges FROM v LEFT JOIN i ON i.v = id LEFT JOIN x ON x.v = id""",
    "neighborhood_features": f"WITH {_EDGES}, {_EGO} SELECT id, degree, internal_edges, external_edges FROM g",
    "attribute_features": f"""WITH {_EDGES} SELECT p_partkey AS id, coalesce(sum(w), 0.0) AS degree, coalesce(CAST(any_value(p_size) AS DOUBLE), 0.0) AS attribute_p_size,
        round(coalesce(any_value(p_retailprice), 0.0), 6) AS attribute_p_retailprice FROM part LEFT JOIN d ON s = p_partkey GROUP BY 1""",
    "edge_count": f"WITH {_EDGES} SELECT (SELECT count(*) FROM e) AS n_edges, (SELECT sum(w) FROM e) AS weight, (SELECT count(DISTINCT s) FROM d) AS n_nodes",
    "next_features_gen1": f"WITH {_EDGES}, {_EGO} " + _AGGS([("sum", "sum({})"), ("mean", "avg({})")]),
    "next_features_custom": f"WITH {_EDGES}, {_EGO} " + _AGGS([("min", "min({})"), ("max", "max({})"), ("count", "count({})"), ("nunique", "count(DISTINCT {})"), ("spread", "max({0}) - min({0})")]),
    "log_binning": f"WITH RECURSIVE {_EDGES}, {_EGO}, {_BINS} SELECT id, feature, CAST(bin AS INT) AS bin FROM b",
    "chebyshev_pairs": f"WITH RECURSIVE {_EDGES}, {_EGO}, {_BINS}, {_PAIRS} SELECT f1, f2, CAST(distance AS INT) AS distance FROM p",
    "feature_groups": f'{_ALL} SELECT "group", feature FROM m',
    "oldest_feature": f'{_ALL} SELECT "group", min_by(feature, ({_ORDER}) || feature) AS oldest FROM m GROUP BY 1',
    "prune_gen0": f"""{_ALL} SELECT x.feature FROM (SELECT unnest(['degree', 'internal_edges', 'external_edges']) AS feature) x LEFT JOIN m USING (feature)
        WHERE m."group" IS NULL OR x.feature IN (SELECT min_by(feature, ({_ORDER}) || feature) FROM m GROUP BY "group")""",
    "connected_components": f"""WITH RECURSIVE {_EDGES}, c AS (SELECT s AS id, s AS component FROM d UNION SELECT d.t, c.component FROM c JOIN d ON d.s = c.id WHERE c.component < d.t)
        SELECT id, min(component) AS component FROM (SELECT * FROM c) GROUP BY 1""",
    "reachable": f"WITH RECURSIVE {_STEPS}, r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.t FROM r JOIN e ON e.s = r.id) SELECT id FROM r",
    "encoding_cost": f"WITH {_G} SELECT CAST(ceil(log2(greatest((SELECT count(DISTINCT x) FROM (SELECT g0 AS x FROM g UNION ALL SELECT g1 FROM g)), 4))) * (2 * count(*) + 6) AS BIGINT) AS encoding_cost FROM g",
    "error_cost": f"WITH {_G} SELECT round(sum(" + " + ".join(f"CASE WHEN v[{k + 1}] = 0 THEN 0 ELSE v[{k + 1}] * (ln(v[{k + 1}]) - ln({h})) - v[{k + 1}] + {h} END" for k, h in enumerate(_HAT)) + "), 6) AS error_cost FROM g",
    "reconstruct": f"WITH {_G} " + " UNION ALL ".join(f"SELECT id, {k} AS k, round({h}, 6) AS x FROM g" for k, h in enumerate(_HAT)),
    "rescale_costs": f"WITH {_GRID} SELECT * FROM z",
    "quantize_fixed": _LLOYD,
    "best_cell": f"WITH {_GRID} SELECT * FROM z WHERE rescaled IS NOT NULL ORDER BY rescaled, n_roles, n_bits LIMIT 1",
    "role_argmax": f"WITH {_G} SELECT id, CASE WHEN g0 >= g1 THEN 'role_0' ELSE 'role_1' END AS role FROM g",
    "role_percentage": f"WITH {_G} SELECT id, round(g0 / (g0 + g1), 6) AS role_0, round(g1 / (g0 + g1), 6) AS role_1 FROM g",
    "adjacency_json": f"WITH {_EDGES} SELECT s AS src, t AS dst, w AS weight FROM e",
}
ORACLE_SQL["attribute_features_all"] = ORACLE_SQL["attribute_features"]
