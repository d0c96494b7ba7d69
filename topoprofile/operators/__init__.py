"""Operators over graphs and feature tables."""
