"""Recursive structural features: local and ego-net features, then neighbour aggregates of what pruning retains.

Defined cases. Vertices without edges stay, with 0 (or an aggregation's empty
value). A graph without edges is a ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoprofile.functions import Aggregation, aggregations, spans
from topoprofile.operators.binning import bin_cuts
from topoprofile.operators.egonet import ego_features
from topoprofile.operators.local import AttributeOptions, local_features
from topoprofile.operators.prune import chebyshev, survivors
from topoprofile.runtime import materialize
from topoprofile.sources.property_graph import PropertyGraph


def neighborhood_features(graph: PropertyGraph, options: AttributeOptions | None = None) -> DataFrame:
    """Generation 0: degrees, attributes, ego-net weights; one row per vertex."""
    return local_features(graph, options).join(ego_features(graph), "id")


def aggregate_neighbors(neighbors: DataFrame, features: DataFrame, columns: Sequence[str], aggs: Sequence[Aggregation]) -> DataFrame:
    """``id`` and ``column(agg)`` over each node's neighbours (unweighted): one join, one exchange, one combined aggregation.

    Nodes of ``features`` without neighbours get each aggregation's empty value.
    Aggregations by Python functions run apart from the others, a node's
    neighbour values together: what they need, but a hub's are then in one task.
    """
    values = features.select(F.col("id").alias("neighbor"), *(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    # dealt by id as plain values: partial sums of them, some limbs for each column, would be several times as large
    joined = neighbors.join(values, "neighbor").drop("neighbor").repartition("id")
    inputs = {f"c{k}": F.col(f"c{k}") for k in range(len(columns))}
    span = spans(values, inputs) if any(a.exact for a in aggs) else {}
    outs = [(f"{c}({a.name})", f"a{n}_{k}", a.empty) for n, a in enumerate(aggs) for k, c in enumerate(columns)]
    plain = [(n, a) for n, a in enumerate(aggs) if not a.python]
    reduced = [(a.reduce(v, span[c]) if a.exact else a.reduce(v)).cast("double").alias(f"a{n}_{c[1:]}") for n, a in plain for c, v in inputs.items()]
    found = joined.groupBy("id").agg(*reduced, F.lit(True).alias("_any"))
    if own := [(n, a.python) for n, a in enumerate(aggs) if a.python]:

        def reduce(frame: pd.DataFrame) -> pd.DataFrame:
            numbers = {f"a{n}_{c[1:]}": [float(call(frame[c]))] for n, call in own for c in inputs}
            return pd.DataFrame({"id": frame["id"].iloc[:1]} | numbers)

        names = [f"a{n}_{c[1:]} double" for n, _ in own for c in inputs]
        kind = joined.schema["id"].dataType.simpleString()
        found = found.join(joined.groupBy("id").applyInPandas(reduce, ", ".join([f"id {kind}", *names])), "id")
    filled = features.select("id").join(found, "id", "left")
    return filled.select("id", *(F.when(F.col("_any"), F.col(short)).otherwise(F.lit(float(empty))).alias(name) for name, short, empty in outs))


@dataclass
class Feature:
    """A column ``key`` of the working table; ``name`` is shown."""

    key: str
    name: str
    generation: int
    cuts: list[float] = field(default_factory=list)
    #: Compared with the features of later generations; part of the result.
    live: bool = True
    kept: bool = False


class Catalogue:
    """All features so far, and the distances of those that were compared."""

    def __init__(self):
        self.features: list[Feature] = []
        self._distances: dict[tuple[str, str], float] = {}

    def add(self, names: Sequence[str], generation: int) -> list[Feature]:
        known = len(self.features)
        self.features += [Feature(f"f{known + k}", name, generation) for k, name in enumerate(names)]
        return self.features[known:]

    @property
    def live(self) -> list[Feature]:
        return [f for f in self.features if f.live]

    def kept(self, generation: int) -> list[Feature]:
        """What a generation adds to the result, by name."""
        return sorted((f for f in self.features if f.kept and f.generation == generation), key=lambda f: f.name)

    def prune(self, table: DataFrame, added: Sequence[Feature], generation: int) -> None:
        """Compare the new features with all live ones; of each near group the oldest stays live."""
        live = self.live
        pairs = [(a, b) for k, a in enumerate(live) for b in live[k + 1 :]]
        new = [(a.key, b.key) for a, b in pairs if (a.key, b.key) not in self._distances]
        self._distances |= chebyshev(table, {f.key: f.cuts for f in live}, new)
        near = {(a.name, b.name): self._distances[a.key, b.key] for a, b in pairs}
        born = {f.name: f.generation for f in self.features if f.kept}
        stay = set(survivors([f.name for f in live], near, generation, born))
        for f in live:
            f.live = f.name in stay
        for f in added:
            f.kept = f.live


class ProfileExtractor:
    """``extract()`` gives the node-by-feature table of a graph.

    ``aggs``: aggregation names, (name, column function) pairs or ``Aggregation``s.
    Attribute options: ``attributes``, ``attributes_include``, ``attributes_exclude``.
    """

    def __init__(self, graph: PropertyGraph, max_generations: int = 10, aggs: Sequence | None = None, frac: float = 0.5, **options):
        if not isinstance(graph, PropertyGraph):
            raise TypeError(f"unsupported graph {type(graph).__name__}: build a PropertyGraph")
        if graph.is_empty():
            raise ValueError("the graph has no edges")
        names = {"attributes": "attributes", "attributes_include": "include", "attributes_exclude": "exclude", "attributes_reserved": "reserved"}
        if unknown := set(options) - set(names):
            raise TypeError(f"unknown options {sorted(unknown)}")
        self.graph, self.max_generations, self.frac = graph.persist(), max_generations, frac
        self.aggs = aggregations(aggs)
        self.options = AttributeOptions(**{names[k]: v for k, v in options.items()})
        self.catalogue = Catalogue()
        #: Of the last generation that was made.
        self.generation_count = 0
        self._result: DataFrame | None = None

    def extract(self) -> DataFrame:
        """``id`` and the features, newest generation first, by name inside one. A second call returns the same table."""
        if self._result is None:
            table = self.grown(None, neighborhood_features(self.graph, self.options))
            neighbors = materialize(self.graph.neighbors().repartition("id"), "neighbors") if self.max_generations > 1 else None
            while (parents := self.catalogue.kept(self.generation_count)) and self.generation_count + 1 < self.max_generations:
                self.generation_count += 1
                named = table.select("id", *(F.col(f.key).alias(f.name) for f in parents))
                table = self.grown(table, aggregate_neighbors(neighbors, named, [f.name for f in parents], self.aggs))
            newest_first = [f for g in range(self.generation_count, -1, -1) for f in self.catalogue.kept(g)]
            self._result = table.select("id", *(F.col(f.key).alias(f.name) for f in newest_first))
        return self._result

    def grown(self, table: DataFrame | None, found: DataFrame) -> DataFrame:
        """The written table of what is still needed and a generation's new features, which are pruned."""
        added = self.catalogue.add([c for c in found.columns if c != "id"], self.generation_count)
        found = found.toDF("id", *(f.key for f in added))
        if table is not None:
            needed = [f.key for f in self.catalogue.features if (f.live or f.kept) and f not in added]
            found = table.select("id", *needed).join(found, "id", "left").na.fill(0.0)
        found = materialize(found, f"generation{self.generation_count}")
        # bins depend on a column's own values only: those of earlier features are known
        cuts = bin_cuts(found, [f.key for f in added], self.frac)
        for f in added:
            f.cuts = cuts[f.key]
        self.catalogue.prune(found, added, self.generation_count)
        return found
