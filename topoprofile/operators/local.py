"""Degrees and numeric node attributes.

Defined cases. A null or NaN attribute is 0; a column of nulls only is no
attribute unless it is named in ``include``; a named column that is missing or not
numeric is 0 throughout. A graph without edges has degree 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoprofile.functions import as_double, limbs_of
from topoprofile.sources.property_graph import PropertyGraph

PREFIX = "attribute_"


@dataclass(frozen=True)
class AttributeOptions:
    """``include`` empty means all; ``exclude`` wins; both mean nothing unless ``attributes`` is set."""

    attributes: bool = False
    include: Sequence[str] = field(default_factory=tuple)
    exclude: Sequence[str] = field(default_factory=tuple)
    reserved: Sequence[str] = field(default_factory=tuple)


def degrees(graph: PropertyGraph) -> DataFrame:
    """Weighted degrees of every vertex: ``degree``, or in, out and total. A loop counts at both its ends.

    Sums are exact (``functions.spans``). One exploded pass over the edges and one
    combined aggregation; a vertex without edges has degree 0.
    """
    span = graph.weight_span
    ends = F.expr("inline(array(named_struct('id', src, 'o', weight, 'i', 0.0D), named_struct('id', dst, 'o', 0.0D, 'i', weight)))")
    parts = {f"{c}{j}": part for c in "io" for j, part in enumerate(limbs_of(F.col(c), span))}
    sums = graph.edges.select(ends).groupBy("id").agg(*(F.sum(part).alias(n) for n, part in parts.items()))
    ins, outs = ([F.col(f"{c}{j}") for j in range(span.limbs)] for c in "io")
    both = [i + o for i, o in zip(ins, outs, strict=True)]
    named = {"in_degree": ins, "out_degree": outs, "total_degree": both} if graph.directed else {"degree": both}
    found = sums.select("id", *(as_double(c, span).alias(n) for n, c in named.items()))
    return graph.nodes().join(found, "id", "left").na.fill(0.0)


def attribute_columns(graph: PropertyGraph, options: AttributeOptions) -> dict[str, object]:
    """Feature name to column, in vertex order (or in the order of ``include``)."""
    if not options.attributes:
        return {}
    numeric = {f.name for f in graph.vertices.schema if f.name != "id" and isinstance(f.dataType, T.NumericType | T.BooleanType)}
    barred = {*options.exclude, *options.reserved, "id"}
    zero = F.lit(0.0)
    value = lambda n: F.coalesce(F.nanvl(F.col(f"`{n}`").cast("double"), zero), zero)
    if options.include:
        return {PREFIX + n: value(n) if n in numeric else zero for n in dict.fromkeys(options.include) if n not in barred}
    names = [c for c in graph.vertices.columns if c in numeric and c not in barred]
    if not names:
        return {}
    present = graph.vertices.agg(*(F.count(F.col(f"`{n}`")).alias(f"n{k}") for k, n in enumerate(names))).first()
    return {PREFIX + n: value(n) for n, count in zip(names, present, strict=True) if count}


def local_features(graph: PropertyGraph, options: AttributeOptions | None = None) -> DataFrame:
    """Degrees, then attributes, one row per vertex."""
    columns = attribute_columns(graph, options or AttributeOptions())
    found = degrees(graph)
    if not columns:
        return found
    return found.join(graph.vertices.select("id", *(c.alias(n) for n, c in columns.items())), "id")
