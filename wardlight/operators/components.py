"""Connected components by repeated random contraction.

Each round every node moves to the neighbour (or itself) with the smallest random
priority, and once more from there; the next round works on the graph of the nodes
that were chosen.  Mapping nodes never disconnects a component, so the maps only have
to be composed at the end.  Nodes that nobody chose disappear, which leaves a small
fraction of the nodes after each round whatever the diameter.  Once at most
``TAIL_LINKS`` links are left, one task joins them up.  Every round, and every step of
the way back, is a written table, so no plan grows with the rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlight.operators import joins
from wardlight.shipping import ship_package
from wardlight.workspace import Workspace

#: So many links (16 bytes each) may meet in one task.
TAIL_LINKS = 100_000


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    workspace: Workspace | None = None,
    hot_rows: int = joins.HOT_ROWS,
    tail_links: int = TAIL_LINKS,
) -> DataFrame:
    """Label every node with the smallest node of its component.

    ``nodes`` has one ``node`` column, ``edges`` has ``src`` and ``dst``.
    Returns ``node, label``.
    """
    ship_package(nodes.sparkSession)
    ws = workspace or Workspace(nodes.sparkSession)
    links = ws.write(_undirected(edges.select("src", "dst")), "links")
    lows = nodes.selectExpr("node", "node AS low").distinct()
    rounds: list[tuple[DataFrame, DataFrame, _Attach]] = []
    while (size := links.count()) > tail_links:
        # Only a graph with more links than ``hot_rows`` can have a hot node.
        attach = _Attach(hot_rows if size > hot_rows else None)
        first = ws.write(_hook(links, len(rounds)), "first")
        moves = attach(first, first.toDF("parent", "above"), "parent").selectExpr("node", "above AS parent")
        step = ws.write(moves.join(lows.hint("merge"), "node"), "hook")
        links = ws.write(_contract(links, step, attach), "links")
        rounds.append((step, lows, attach))
        lows = ws.write(step.groupBy("parent").agg(F.min("low").alias("low")).toDF("node", "low"), "lows")

    labels = ws.write(_finish(links, lows, ws), "labels")
    for step, lows, attach in reversed(rounds):
        deep = attach(step.select("node", "parent"), labels.toDF("parent", "deep"), "parent").select("node", "deep")
        labels = ws.write(lows.join(deep.hint("merge"), "node", "left").selectExpr("node", "coalesce(deep, low) AS label"), "labels")
    return labels


class _Attach:
    """Join to a table with unique keys, splitting hot keys if the graph can have any.

    Tables of nodes are shuffled even where Spark would broadcast them: broadcasts of every
    round would all pass through the driver.
    """

    def __init__(self, hot_rows: int | None):
        self.hot_rows = hot_rows

    def __call__(self, left: DataFrame, dim: DataFrame, key: str) -> DataFrame:
        dim = dim.hint("merge")
        if self.hot_rows is None:
            return left.join(dim, key)
        return joins.lookup(left, dim, key, hot_rows=self.hot_rows)


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").selectExpr("least(src, dst) AS src", "greatest(src, dst) AS dst").distinct()


def _hook(links: DataFrame, round_no: int) -> DataFrame:
    """Map every linked node one step towards smaller priorities."""

    def priority(name: str) -> str:
        return f"struct(xxhash64({name}, {round_no}) AS p, {name} AS n)"

    both = links.union(links.select("dst", "src")).toDF("node", "other")
    return both.groupBy("node").agg(F.expr(f"min({priority('other')})").alias("best")).selectExpr(
        "node", f"least(best, {priority('node')}).n AS parent"
    )


def _contract(links: DataFrame, step: DataFrame, attach: _Attach) -> DataFrame:
    """Replace both ends of each link by the nodes they moved to."""
    for end in ("src", "dst"):
        moved = attach(links, step.select("node", "parent").toDF(end, "_to"), end)
        links = moved.drop(end).withColumnRenamed("_to", end)
    return _undirected(links)


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first node of each linked node's component."""
    names, ends = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
    src, dst = ends.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[src], root[dst])
        before = root.copy()
        for end in (src, dst):
            np.minimum.at(root, before[end], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return pd.DataFrame({"node": names, "root": names[root]})


def _finish(links: DataFrame, lows: DataFrame, ws: Workspace) -> DataFrame:
    """Labels of a graph whose few links one task holds; the table of their ends is as small."""
    kind = links.schema["src"].dataType.simpleString()
    roots = F.broadcast(ws.write(links.groupBy().applyInPandas(_roots, f"node {kind}, root {kind}"), "roots"))
    lowest = lows.join(roots, "node").groupBy("root").agg(F.min("low").alias("label"))
    linked = lows.join(roots, "node", "left")
    return linked.join(F.broadcast(lowest), "root", "left").selectExpr("node", "coalesce(label, low) AS label")
