"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import shared_folder


def components(links: DataFrame, a: str, b: str, lane: int = graph.LANE) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable. No task holds
    all links of a node; nulls and a node linked with itself make no node."""
    shared_folder(links.sparkSession)
    return graph.components(links.filter(f"{a} <> {b}"), a, b, lane)
