"""Structural node profiles and roles for graphs held in Spark DataFrames."""

from topoprofile.plans.profile import ProfileExtractor
from topoprofile.plans.roles import RoleFinder
from topoprofile.sources.property_graph import PropertyGraph

__all__ = ["ProfileExtractor", "PropertyGraph", "RoleFinder"]
