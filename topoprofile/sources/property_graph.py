"""A graph as two DataFrames: vertices (id and attributes) and canonical edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoprofile.functions import Span, exact_sum, spans

_sources: dict[str, Callable[..., PropertyGraph]] = {}


def register_source(name: str, build: Callable[..., PropertyGraph]) -> None:
    """Make ``graph_from(name, ...)`` call ``build``, which returns a ``PropertyGraph``: where own formats are added."""
    if not callable(build):
        raise TypeError("a source is a function that returns a PropertyGraph")
    _sources[name] = build


def supported_sources() -> list[str]:
    return list(_sources)


def graph_from(name: str, *args, **options) -> PropertyGraph:
    """A graph from a registered source."""
    if name not in _sources:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(_sources)}")
    graph = _sources[name](*args, **options)
    if not isinstance(graph, PropertyGraph):
        raise TypeError(f"source {name!r} returned {type(graph).__name__}, not a PropertyGraph")
    return graph


class PropertyGraph:
    """Vertices ``id, ...`` and edges ``src, dst, weight``; build it with a ``from_`` constructor.

    Edges are unique per pair (ordered if directed; undirected ones are stored
    with ``src <= dst``), a missing weight is 1, and every end point is a vertex.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, directed: bool):
        self.vertices, self.edges, self.directed = vertices, edges, directed

    @classmethod
    def from_edges(
        cls,
        edges: DataFrame,
        src: str = "src",
        dst: str = "dst",
        weight: str | None = None,
        directed: bool = False,
        vertices: DataFrame | None = None,
        id_col: str = "id",
        on_duplicate: str = "sum",
        order: str | None = None,
    ) -> PropertyGraph:
        """``on_duplicate``: parallel edges are summed, the largest or the ``last`` by the column ``order`` is taken (``max``), or they are an ``error``.

        Weights must be finite. Summing reads the weights once beforehand, for their span.
        """
        if not isinstance(edges, DataFrame) or not (vertices is None or isinstance(vertices, DataFrame)):
            raise TypeError(f"a graph is made of DataFrames; supported sources: {', '.join(supported_sources())}")
        if on_duplicate not in ("sum", "max", "last", "error"):
            raise ValueError("on_duplicate is 'sum', 'max', 'last' or 'error'")
        if (on_duplicate == "last") != (order is not None):
            raise ValueError("'last' needs a column to order by, and only it does")
        kinds = {edges.schema[c].dataType.simpleString() for c in (src, dst)} | ({vertices.schema[id_col].dataType.simpleString()} if vertices is not None else set())
        kind = "string" if kinds == {"string"} else "bigint"
        if kind == "bigint" and not kinds <= {"tinyint", "smallint", "int", "bigint"}:
            raise TypeError(f"node ids must all be whole numbers or all be strings, not {sorted(kinds)}")
        value = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
        rank = F.col(order) if order else F.lit(0)
        rows = edges.select(F.col(src).cast(kind).alias("src"), F.col(dst).cast(kind).alias("dst"), value.alias("weight"), rank.alias("rank"))
        rows = rows.where("src IS NOT NULL AND dst IS NOT NULL")
        if not directed:
            rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "rank")
        if on_duplicate == "error":
            if not rows.groupBy("src", "dst").count().where("count > 1").isEmpty():
                raise ValueError("parallel edges")
            rows = rows.drop("rank")
        else:
            if on_duplicate == "max":
                one = F.max("weight")
            elif on_duplicate == "last":  # ties: the larger weight
                one = F.max_by("weight", F.struct("rank", "weight"))
            else:
                one = exact_sum(F.col("weight"), spans(rows, {"weight": F.col("weight")})["weight"]) if weight else F.count("*").cast("double")
            rows = rows.groupBy("src", "dst").agg(one.alias("weight"))
        ends = rows.select(F.col("src").alias("id")).unionByName(rows.select(F.col("dst").alias("id"))).distinct()
        if vertices is None:
            nodes = ends
        else:
            nodes = vertices.withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast(kind)).where("id IS NOT NULL").dropDuplicates(["id"])
            nodes = nodes.join(ends, "id", "full_outer")
        return cls(nodes, rows, directed)

    @classmethod
    def from_parquet(cls, spark: SparkSession, edges: str, vertices: str | None = None, **options) -> PropertyGraph:
        nodes = spark.read.parquet(vertices) if vertices else None
        return cls.from_edges(spark.read.parquet(edges), vertices=nodes, **options)

    @classmethod
    def from_adjacency_json(cls, documents: DataFrame, column: str = "value", directed: bool = False, numeric: bool = True) -> PropertyGraph:
        """From JSON text ``{"node": {"neighbour": {"weight": w}}}``; an undirected edge may be listed from both ends."""
        inner = T.MapType(T.StringType(), T.StructType([T.StructField("weight", T.DoubleType())]))
        parsed = documents.select(F.from_json(column, T.MapType(T.StringType(), inner)).alias("nodes"))
        nodes = parsed.select(F.explode("nodes").alias("a", "near"))
        edges = nodes.select("a", F.explode("near").alias("b", "data")).select("a", "b", F.col("data.weight").alias("weight"))
        alone = nodes.select("a")
        if numeric:
            edges, alone = (d.withColumns({c: F.col(c).cast("bigint") for c in d.columns if c != "weight"}) for d in (edges, alone))
        return cls.from_edges(edges, "a", "b", "weight", directed, alone.withColumnRenamed("a", "id"), on_duplicate="max")

    def persist(self) -> PropertyGraph:
        """The same graph over written tables: derived edges are then computed once."""
        from topoprofile.runtime import materialize

        return PropertyGraph(materialize(self.vertices, "vertices"), materialize(self.edges, "edges"), self.directed)

    def nodes(self) -> DataFrame:
        return self.vertices.select("id")

    def num_edges(self) -> int:
        return self.edges.count()

    def is_empty(self) -> bool:
        return self.edges.isEmpty()

    @cached_property
    def weight_span(self) -> Span:
        """What exact sums of weights need to know of them."""
        return spans(self.edges, {"weight": F.col("weight")})["weight"]

    @cached_property
    def adjacency(self) -> DataFrame:
        """``id, neighbor, weight``: out-neighbours, or both ways if undirected; a loop once."""
        out = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "weight")
        if self.directed:
            return out
        back = self.edges.where("src != dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "weight")
        return out.unionByName(back)

    def neighbors(self) -> DataFrame:
        """``id, neighbor``, weights dropped."""
        return self.adjacency.select("id", "neighbor")

    def component_labels(self) -> DataFrame:
        """``id, component`` of nodes that occur in an edge."""
        from topoprofile.operators.components import connected_components

        return connected_components(self.edges)

    def reachable(self, start) -> DataFrame:
        """Nodes that can be reached from ``start``, itself included; an unknown start is a ``KeyError``."""
        from topoprofile.runtime import materialize

        if self.vertices.where(F.col("id") == F.lit(start)).isEmpty():
            raise KeyError(start)
        pairs = materialize(self.neighbors(), "pairs")
        layers = [materialize(self.vertices.select("id").where(F.col("id") == F.lit(start)), "reached")]
        while True:
            seen = reduce(DataFrame.unionByName, layers)
            found = layers[-1].join(pairs, "id").select(F.col("neighbor").alias("id")).distinct().join(seen, "id", "left_anti")
            found = materialize(found, "reached")
            if found.isEmpty():
                return seen
            layers.append(found)
            if len(layers) > 16:  # keeps the union short on long paths
                layers = [materialize(seen, "reached"), found]


register_source("dataframe", PropertyGraph.from_edges)
register_source("parquet", PropertyGraph.from_parquet)
register_source("adjacency_json", PropertyGraph.from_adjacency_json)
