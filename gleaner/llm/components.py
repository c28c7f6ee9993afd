"""Connected components of links: union-find in one task up to a bounded number of links, star contraction beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.operators.groups import connected
from gleaner.session import Steps


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b): root is the smallest node reached."""
    return connected(edges, steps)
