"""Sources, degrees, ego-nets, attributes, components and reachability on hand-made graphs."""

import json
import random

import pytest

from topoprofile import PropertyGraph
from topoprofile.operators import egonet
from topoprofile.operators.components import connected_components
from topoprofile.operators.egonet import ego_features
from topoprofile.operators.local import AttributeOptions, local_features
from topoprofile.plans.profile import neighborhood_features
from topoprofile.sources.property_graph import supported_sources

SEVEN = [(0, 1, 2.0), (0, 2, 1.5), (0, 3, 3.0), (3, 6, 0.25), (4, 5, 0.75), (4, 6, 2.5), (5, 6, 1.0)]


def seven(spark, directed=False, weighted=False, attributes=True):
    edges = spark.createDataFrame(SEVEN, "a long, b long, w double")
    nodes = [(k, 1.0 if k == 0 else None, float(k), "x") for k in range(7)]
    vertices = spark.createDataFrame(nodes, "id long, attr1 double, attr2 double, label string") if attributes else None
    return PropertyGraph.from_edges(edges, "a", "b", "w" if weighted else None, directed, vertices)


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_undirected_generation_zero(spark):
    got = neighborhood_features(seven(spark))
    assert got.columns == ["id", "degree", "internal_edges", "external_edges"]
    assert rows(got) == {0: (3, 3, 1), 1: (1, 1, 2), 2: (1, 1, 2), 3: (2, 2, 4), 4: (2, 3, 1), 5: (2, 3, 1), 6: (3, 4, 1)}


def test_directed_weighted_generation_zero(spark):
    got = rows(neighborhood_features(seven(spark, True, True)))
    assert got == {
        0: (0, 6.5, 6.5, 6.5, 0.25),
        1: (2, 0, 2, 0, 0),
        2: (1.5, 0, 1.5, 0, 0),
        3: (3, 0.25, 3.25, 0.25, 0),
        4: (0, 3.25, 3.25, 4.25, 0),
        5: (0.75, 1, 1.75, 1, 0),
        6: (3.75, 0, 3.75, 0, 0),
    }


def test_neighbors(spark):
    near = {}
    for a, b in seven(spark).neighbors().collect():
        near.setdefault(a, set()).add(b)
    assert near == {0: {1, 2, 3}, 1: {0}, 2: {0}, 3: {0, 6}, 4: {5, 6}, 5: {4, 6}, 6: {3, 4, 5}}


@pytest.mark.parametrize(
    "options, kept",
    [
        ({"attributes": True}, ["attr1", "attr2"]),
        ({}, []),
        ({"include": ["attr1"]}, []),
        ({"attributes": True, "include": ["attr1", "attr2"]}, ["attr1", "attr2"]),
        ({"attributes": True, "include": ["attr1"]}, ["attr1"]),
        ({"attributes": True, "exclude": ["attr1", "attr2"]}, []),
        ({"attributes": True, "exclude": ["attr2"]}, ["attr1"]),
        ({"attributes": True, "include": ["attr1"], "exclude": ["attr2"]}, ["attr1"]),
        ({"attributes": True, "include": ["attr1", "attr2"], "exclude": ["attr2"]}, ["attr1"]),
        ({"attributes": True, "include": ["attr2"], "exclude": ["attr2"]}, []),
        ({"attributes": True, "include": ["none", "label"]}, ["none", "label"]),
    ],
)
def test_attribute_options(spark, options, kept):
    got = local_features(seven(spark), AttributeOptions(**options))
    assert got.columns == ["id", "degree", *(f"attribute_{k}" for k in kept)]
    for node, values in rows(got).items():
        expected = {"attr1": 1.0 if node == 0 else 0.0, "attr2": float(node)}
        assert list(values[1:]) == [expected.get(k, 0.0) for k in kept]


def test_no_attributes_on_graph(spark):
    assert local_features(seven(spark, attributes=False), AttributeOptions(attributes=True)).columns == ["id", "degree"]


def brute_ego(edges, directed):
    arcs = [(a, b, w) for a, b, w in edges] if directed else edges
    nodes = {x for a, b, _ in edges for x in (a, b)}
    out = {}
    for v in nodes:
        near = {v} | {b for a, b, _ in arcs if a == v}
        if not directed:
            near |= {a for a, b, _ in arcs if b == v}
        inside = sum(w for a, b, w in arcs if a in near and b in near)
        border = sum(w for a, b, w in arcs if a in near and b not in near)
        if not directed:
            border += sum(w for a, b, w in arcs if b in near and a not in near)
        out[v] = (inside, border)
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_ego_against_definition(spark, directed):
    rng = random.Random(5)
    edges = {}
    for _ in range(160):
        a, b = rng.randrange(30), rng.randrange(30)
        key = (a, b) if directed else (min(a, b), max(a, b))
        edges[key] = float(rng.randint(1, 9))
    edges = [(*k, w) for k, w in edges.items()]
    graph = PropertyGraph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), weight="weight", directed=directed)
    assert rows(ego_features(graph)) == brute_ego(edges, directed)


@pytest.mark.parametrize("directed", [False, True])
def test_triangles_are_found_once_over_many_parts(spark, monkeypatch, directed):
    """No table of wedges is made: parts get edges only, and look up a few wedges at a time."""
    monkeypatch.setattr(egonet, "PART", 40)
    monkeypatch.setattr(egonet, "WEDGES", 7)
    rng = random.Random(6)
    edges = {}
    for _ in range(300):
        a, b = f"v{rng.randrange(5 if rng.random() < 0.3 else 40)}", f"v{rng.randrange(40)}"
        edges[(a, b) if directed else (min(a, b), max(a, b))] = rng.randint(1, 9) * 2.0 ** rng.choice([-25, 0, 9])
    edges = [(*k, w) for k, w in edges.items()]
    graph = PropertyGraph.from_edges(spark.createDataFrame(edges, "src string, dst string, weight double"), weight="weight", directed=directed)
    assert graph.weight_span.limbs > 1
    assert egonet.math.isqrt(6 * len(edges) // egonet.PART) >= egonet.LEAST_GROUPS
    assert rows(ego_features(graph)) == brute_ego(edges, directed)


def test_loops_count_twice_in_degree_and_once_inside(spark):
    graph = PropertyGraph.from_edges(spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long"))
    assert rows(neighborhood_features(graph)) == {1: (3, 2, 0), 2: (1, 2, 0)}


def test_duplicates(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 4.0), (2, 3, None)], "src long, dst long, weight double")
    total = lambda how: {tuple(r) for r in PropertyGraph.from_edges(edges, weight="weight", on_duplicate=how).edges.collect()}
    assert total("sum") == {(1, 2, 5.0), (2, 3, 1.0)}
    assert total("max") == {(1, 2, 4.0), (2, 3, 1.0)}
    with pytest.raises(ValueError):
        PropertyGraph.from_edges(edges, weight="weight", on_duplicate="error")


def test_bad_inputs(spark):
    with pytest.raises(TypeError):
        PropertyGraph.from_edges([(1, 2)])
    with pytest.raises(TypeError):
        PropertyGraph.from_edges(spark.createDataFrame([(1, "a")], "src long, dst string"))
    assert supported_sources()


def test_string_ids_and_json(spark):
    text = json.dumps({"0": {"1": {"weight": 2}}, "1": {"0": {"weight": 2}, "2": {}}, "2": {"1": {}}, "3": {}})
    docs = spark.createDataFrame([(text,)], "value string")
    graph = PropertyGraph.from_adjacency_json(docs)
    assert {tuple(r) for r in graph.edges.collect()} == {(0, 1, 2.0), (1, 2, 1.0)}
    assert {r.id for r in graph.nodes().collect()} == {0, 1, 2, 3}
    assert graph.num_edges() == 2 and not graph.is_empty()
    assert PropertyGraph.from_adjacency_json(docs, numeric=False).edges.schema["src"].dataType.simpleString() == "string"


def test_parquet_source(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "src long, dst long").write.parquet(str(tmp_path / "e"))
    assert PropertyGraph.from_parquet(spark, str(tmp_path / "e")).num_edges() == 1


@pytest.mark.parametrize(
    "edges, expected",
    [
        ([(0, 1), (2, 3)], [{0, 1}, {2, 3}]),
        ([(0, 1), (1, 2), (2, 0)], [{0, 1, 2}]),
        ([(0, 7), (0, 8), (8, 2), (8, 5), (1, 3), (6, 2), (6, 4)], [{0, 2, 4, 5, 6, 7, 8}, {1, 3}]),
        ([(0, 0), (1, 2)], [{0}, {1, 2}]),
        ([(k, k + 1) for k in range(40)], [set(range(41))]),
        ([], []),
    ],
)
def test_components(spark, edges, expected):
    found = {}
    for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect():
        found.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected))
    assert all(min(v) == k for k, v in found.items())


def test_reachable(spark):
    graph = PropertyGraph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (4, 1)], "src long, dst long"), directed=True)
    assert {r.id for r in graph.reachable(1).collect()} == {1, 2, 3}
    with pytest.raises(KeyError):
        graph.reachable(9)
