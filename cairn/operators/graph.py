"""Control flow as a graph: edges from instructions to their targets, and what is reachable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.tables import written


def goto_edges(rows: DataFrame, node: str, true: Column, false: Column) -> DataFrame:
    """src, dst, on_true for each target that is an instruction; null targets end the flow."""
    both = F.array(F.struct(true.alias("dst"), F.lit(True).alias("on_true")), F.struct(false.alias("dst"), F.lit(False).alias("on_true")))
    return rows.select(F.col(node).alias("src"), F.inline(both)).where("dst is not null")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Every node on a path from `start` (node), itself included.

    Each round joins only what the last one found; found nodes are written to the shared checkpoint folder, so
    that neither lineage nor a lost executor makes a round run twice.
    """
    seen = new = written(start.select("node").distinct())
    while not new.isEmpty():
        step = edges.join(new, edges["src"] == new["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        new = written(step.join(seen, "node", "left_anti"))
        seen = written(seen.unionByName(new))
    return seen
