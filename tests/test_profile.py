"""Binning, pruning and the recursive plan against golden tables."""

import pytest
from pyspark.sql import functions as F

from topoprofile import ProfileExtractor, PropertyGraph
from topoprofile.functions import aggregations
from topoprofile.operators import binning
from topoprofile.operators.prune import chebyshev, feature_groups, oldest, survivors
from topoprofile.plans.profile import aggregate_neighbors, neighborhood_features

TEN = list(range(10))
BINNING = [
    ([0], 0.5, [0]),
    ([1], 0.5, [0]),
    ([1, 1], 0.5, [0, 0]),
    ([1, 2], 0.5, [0, 1]),
    ([1, 2, 1], 0.5, [0, 1, 0]),
    ([1, 2, 2], 0.5, [0, 1, 1]),
    ([-1, 0, 0], 0.5, [0, 1, 1]),
    ([1, 2, 3, 4], 0.5, [0, 0, 1, 2]),
    ([1, 2, 3, 4, 5], 0.5, [0, 0, 1, 2, 3]),
    ([1, 2, 3, 4, 5, 6], 0.5, [0, 0, 0, 1, 2, 3]),
    (TEN, 0.5, [0, 0, 0, 0, 0, 1, 1, 2, 3, 4]),
    ([-x for x in TEN], 0.5, [4, 3, 2, 1, 1, 0, 0, 0, 0, 0]),
    ([-x / 10 for x in TEN], 0.5, [4, 3, 2, 1, 1, 0, 0, 0, 0, 0]),
    (TEN, 0.1, TEN),
    (TEN, 0.25, [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]),
]


@pytest.mark.parametrize("fold", [100_000, 0])
def test_binning(spark, monkeypatch, fold):
    monkeypatch.setattr(binning, "FOLD", fold)
    for frac in (0.5, 0.1, 0.25):
        cases = [(v, b) for v, f, b in BINNING if f == frac]
        for values, bins in cases if fold else cases[-2:]:
            table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id long, x double")
            assert [r.x for r in binning.log_bin(table, ["x"], frac).orderBy("id").collect()] == bins


def test_binning_of_nothing_and_bad_share(spark):
    empty = spark.createDataFrame([], "id long, x double")
    assert binning.log_bin(empty, ["x"]).collect() == []
    for frac in (0, 1, -0.5):
        with pytest.raises(ValueError):
            binning.bin_cuts(empty, ["x"], frac)


def distances(spark, columns):
    table = spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))
    return chebyshev(table, dict.fromkeys(columns))


def test_groups(spark):
    found = distances(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "c": [2, 1, 1], "d": [1, 1, 1]})
    assert feature_groups(found, -1) == []
    assert feature_groups(found, 0) == [{"a", "b"}]
    assert feature_groups(found, 1) == [{"a", "b"}, {"c", "d"}]
    assert feature_groups(found, 2) == [{"a", "b", "c", "d"}]


def test_prune(spark):
    columns = {"a": [1, 2, 3, 10], "b": [1, 2, 3, 1], "c": [2, 1, 1, 4], "d": [1, 1, 1, 1], "e": [1, 1, 2, 0]}
    table = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(zip(*columns.values(), strict=True))], "id long, a double, b double, c double, d double, e double")
    cuts = binning.bin_cuts(table, list(columns))
    found = chebyshev(table, cuts)
    binned = binning.log_bin(table, list(columns)).toPandas()
    assert found == {(a, b): (binned[a] - binned[b]).abs().max() for a, b in found}
    born = {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}
    dropped = lambda threshold: set(columns) - set(survivors(columns, found, threshold, born))
    assert dropped(0) == set()
    assert dropped(1) == {"c", "d", "e"}
    assert dropped(2) == {"b", "c", "d", "e"}


def test_oldest():
    born = {"b": 0, "a": 0, "c": 1, "d": 1}
    assert [oldest(g, born) for g in (["a", "c", "f"], ["a", "b", "f"], ["x", "d", "f", "aa"], ["y", "x", "z"])] == ["a", "a", "d", "x"]


def path(spark):
    return PropertyGraph.from_edges(spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "src string, dst string"))


def test_first_generation(spark):
    graph = path(spark)
    got = aggregate_neighbors(graph.neighbors(), neighborhood_features(graph), ["external_edges", "degree", "internal_edges"], aggregations(None))
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {"a": (2, 3, 3, 1, 1.5, 1.5), "b": (1, 2, 2, 1, 2, 2), "c": (2, 3, 3, 1, 1.5, 1.5), "d": (1, 2, 2, 1, 2, 2)}


def test_empty_values_of_nodes_without_neighbors(spark):
    nodes = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "id string, x double")
    pairs = spark.createDataFrame([("a", "b")], "id string, neighbor string")
    got = aggregate_neighbors(pairs, nodes, ["x"], aggregations(["sum", "prod", ("spread", lambda c: F.max(c) - F.min(c))]))
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {"a": (3.0, 3.0, 0.0), "b": (0.0, 1.0, 0.0)}
    with pytest.raises(ValueError):
        aggregations(["nothing"])


def test_neighbor_values_are_dealt_before_they_are_summed(spark):
    nodes = spark.createDataFrame([("a", 2.5), ("b", 3.0)], "id string, x double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, neighbor string")
    plan = aggregate_neighbors(pairs, nodes, ["x"], aggregations(None))._jdf.queryExecution().executedPlan().toString()
    whole, partial = plan.index("Aggregate(keys=[id"), plan.index("partial_sum")
    assert "Exchange" not in plan[whole:partial]


def test_live_and_final_features_differ(spark):
    graph = path(spark)
    plan = ProfileExtractor(graph)
    first = neighborhood_features(plan.graph)
    table = plan.grown(None, first)
    names = lambda features: sorted(f.name for f in features)
    assert names(plan.catalogue.live) == ["degree", "external_edges"]
    # a feature that a later generation drops stays in the result; a copy of a live one adds nothing
    plan.generation_count = 1
    plan.grown(table, first.select("id", F.col("degree").alias("degree2"), (10.0 - F.col("external_edges") * 3).alias("a")))
    assert "degree2" not in names(plan.catalogue.live)
    assert names(plan.catalogue.kept(0)) == ["degree", "external_edges"]


SEVEN = [(0, 1, 2.0), (0, 2, 1.5), (0, 3, 3.0), (3, 6, 0.25), (4, 5, 0.75), (4, 6, 2.5), (5, 6, 1.0)]


@pytest.mark.parametrize(
    "edges, options, generations, names",
    [
        (SEVEN, {}, 1, ["degree", "external_edges", "internal_edges"]),
        (SEVEN, {"directed": True, "weight": "w"}, 2, ["in_degree(mean)", "internal_edges(mean)", "external_edges", "in_degree", "internal_edges", "total_degree"]),
        ([("a", "b", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], {}, 1, ["degree", "external_edges"]),
    ],
)
def test_end_to_end(spark, edges, options, generations, names):
    kind = "string" if isinstance(edges[0][0], str) else "long"
    graph = PropertyGraph.from_edges(spark.createDataFrame(edges, f"a {kind}, b {kind}, w double"), "a", "b", **options)
    plan = ProfileExtractor(graph)
    got = plan.extract()
    assert plan.generation_count == generations
    assert got.columns == ["id", *names]
    assert plan.extract() is got
    if options:
        values = {r.id: r["in_degree(mean)"] for r in got.collect()}
        assert values == pytest.approx({0: 13 / 6, 1: 0, 2: 0, 3: 3.75, 4: 2.25, 5: 3.75, 6: 0})


def test_dangling_nodes_stay(spark):
    vertices = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = ProfileExtractor(PropertyGraph.from_edges(spark.createDataFrame([("a", "c")], "src string, dst string"), vertices=vertices)).extract()
    assert {r.id for r in got.collect()} == {"a", "b", "c", "d"}
    assert got.columns == ["id", "degree", "external_edges"]


def test_errors(spark):
    with pytest.raises(TypeError):
        ProfileExtractor([(1, 2)])
    with pytest.raises(ValueError):
        ProfileExtractor(PropertyGraph.from_edges(spark.createDataFrame([], "src long, dst long")))
    with pytest.raises(TypeError):
        ProfileExtractor(path(spark), nothing=True)
