"""Connected components of an edge table; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.staging import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node hangs itself on the least neighbour of that node."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).select(F.col("high").alias("node"), F.col("low").alias("near"))
    least = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.join(least, "node").where("near > node").select(F.col("near").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it hang themselves on the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """Number of edges and two digests of them that no size of ids can overflow."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")), F.sum(F.pmod(F.xxhash64("low", "high"), F.lit(1_000_003)))).first())


#: Edges, by their counted number, that one task may close by itself; 16 bytes each.
TASK_EDGES = 1 << 20


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def top(node: int) -> int:
        root = node
        while (up := above.setdefault(root, root)) != root:
            root = up
        while (up := above[node]) != root:
            above[node], node = root, up
        return root

    for batch in batches:
        for high, low in zip(batch.column("high").to_pylist(), batch.column("low").to_pylist(), strict=True):
            a, b = top(high), top(low)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """`node`, `component` (least node) for every node of `edges` (`high` > `low`, longs, no nulls).

    Up to `task_edges` edges, which are counted first, are closed by one task.  More are closed by
    alternating stars: each round is two aggregations and two joins over the edges, cut by a
    checkpoint, and the number of rounds grows with the logarithm of the number of nodes.  No edges
    give no rows.
    """
    now = cut(edges.select("high", "low").distinct())
    mark = _print(now)
    if mark[0] <= task_edges:
        return cut(now.coalesce(1).mapInArrow(_closed, "node long, component long"))
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        was, mark = mark, _print(now)
        if was == mark:
            break
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
