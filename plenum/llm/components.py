"""Connected components of an edge table by the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plenum.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id in edges (a, b): the smallest id that it reaches.

    Rounds go on until no edge is left between two labels. Nothing but the
    answer to that comes to the driver.
    """
    return graph.components(edges.select("a", "b").filter("a <> b")).toDF("id", "component_id")
