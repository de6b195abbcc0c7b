"""A grid of small cells, the unit of work of the clustering operators.

The cell edge is the radius chord divided by the square root of three, so any two
points of one cell lie within the radius of each other.  Points are reduced to one
summary per cell before anything is joined; a place that holds a third of all rows is
then a single row, and no operator ever forms the pairs inside a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from wardlight.functions import geo
from wardlight.operators import joins
from wardlight.operators.components import connected_components
from wardlight.workspace import Workspace

#: Absolute slack on unit-sphere lengths that covers floating-point error (0.06 micrometres).
SLACK = 1e-14
AXES = ("x", "y", "z")
CELL = ["cx", "cy", "cz"]
#: log2 of the cells per block edge in neighbour joins.
BLOCK_BITS = 3
#: Cells whose edge is this many steps away or less can hold points within the radius.
REACH = 2
#: Cell pairs with at most this many point pairs are compared point by point.
DIRECT_PAIRS = 64


@dataclass
class Grid:
    """Radius, grouping keys and exact test shared by one clustering run."""

    radius_m: float
    near: Callable[[str, str], str]
    keys: list[str] = field(default_factory=list)
    hot_rows: int = joins.HOT_ROWS
    direct_pairs: int = DIRECT_PAIRS

    @property
    def chord(self) -> float:
        return geo.chord(self.radius_m)

    @property
    def edge(self) -> float:
        return max(self.chord - SLACK, SLACK) / math.sqrt(3.0)

    @property
    def cell_keys(self) -> list[str]:
        return self.keys + CELL

    def place(self, df: DataFrame) -> DataFrame:
        """Slim point rows: ``ord``, keys, coordinates, unit vector and cell."""
        vector = [f"{v} AS {a}" for v, a in zip(geo.unit_vector_sql("lat", "lng"), AXES)]
        slim = df.select("ord", *self.keys, df.lat.cast("double").alias("lat"), df.lng.cast("double").alias("lng"))
        return slim.selectExpr("*", *vector).selectExpr("*", *_cell_sql(self.edge))

    def summarise(self, points: DataFrame, extra: str = "") -> DataFrame:
        """One row per cell: lowest ``ord`` as ``node``, count, bounding box, coordinate sums."""
        box = ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in AXES)
        keys = ", ".join(self.cell_keys)
        return points.sparkSession.sql(
            f"""SELECT {keys}{extra}, min(ord) AS node, count(*) AS n, {box},
                       min_by(lat, ord) AS lat, min_by(lng, ord) AS lng,
                       sum(lat) AS sum_lat, sum(lng) AS sum_lng
                FROM {{points}} GROUP BY {keys}{extra}""",
            points=points,
        )

    def hot_cells(self, cells: DataFrame) -> DataFrame | None:
        hot = cells.filter(F.col("n") > self.hot_rows).select(*self.cell_keys)
        return hot if joins.has_rows(hot) else None

    # -- box tests between columns with prefixes, as SQL text ------------------------

    def gap_sq(self, a: str, b: str) -> str:
        """Squared distance between two boxes."""
        return " + ".join(
            f"pow(greatest(0D, {a}_lo_{x} - {b}_hi_{x}, {b}_lo_{x} - {a}_hi_{x}), 2D)" for x in AXES
        )

    def span_sq(self, a: str, b: str) -> str:
        """Largest squared distance between a point of one box and a point of the other."""
        return " + ".join(f"pow(greatest({a}_hi_{x} - {b}_lo_{x}, {b}_hi_{x} - {a}_lo_{x}), 2D)" for x in AXES)

    def single(self, a: str) -> str:
        """True if the box is one point (to rounding), so its sample stands for all its rows."""
        return " AND ".join(f"{a}_hi_{x} - {a}_lo_{x} <= {SLACK / 10!r}D" for x in AXES)

    def possible(self, a: str, b: str) -> str:
        return f"{self.gap_sq(a, b)} <= {(self.chord + SLACK) ** 2!r}D"

    def verdict(self, a: str, b: str) -> str:
        """True or false where two boxes decide that all or no points are near, else null."""
        return (
            f"CASE WHEN {self.span_sq(a, b)} <= {max(self.chord - SLACK, 0.0) ** 2!r}D THEN true "
            f"WHEN {self.single(a)} AND {self.single(b)} THEN {self.near(a, b)} END"
        )


def _cell_sql(edge: float) -> list[str]:
    return [f"CAST(floor({a} / {edge!r}D) AS BIGINT) AS {c}" for c, a in zip(CELL, AXES)]


def prefixed(df: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def point_boxes(points: DataFrame) -> DataFrame:
    """Give single points the box columns of a summary."""
    return points.selectExpr("*", *[f"{a} AS {n}_{a}" for a in AXES for n in ("lo", "hi")])


def near_by_haversine(radius_m: float) -> Callable[[str, str], str]:
    return lambda a, b: geo.haversine_sql(f"{a}_lat", f"{a}_lng", f"{b}_lat", f"{b}_lng") + f" <= {float(radius_m)!r}D"


def near_by_chord(radius_m: float) -> Callable[[str, str], str]:
    limit = geo.chord(radius_m) ** 2
    return lambda a, b: geo.chord_sq_sql(f"{a}_lat", f"{a}_lng", f"{b}_lat", f"{b}_lng") + f" <= {limit!r}D"


def neighbour_pairs(grid: Grid, left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
    """Pairs of rows in different cells whose boxes come within the radius.

    ``once`` keeps the pairs whose left cell comes first, in the order of cells.

    Rows meet in blocks of cells: the left side lies in its own block, the right side
    is copied to the one or two blocks per axis that its reach touches.  A block holds
    a bounded number of cells, so blocks cannot be skewed by dense places.  They are
    sorted by one hash; the copies of a row lie in adjacent blocks, so the last bits of
    a block's numbers tell them apart even if two blocks have the same hash.
    """
    blocks = [f"_b{c}" for c in CELL]
    on = ["_block", *grid.keys]
    block = f"xxhash64({', '.join(blocks)}) AS _block"
    bits = " + ".join(f"{1 << i} * ({b} & 1)" for i, b in enumerate(blocks))
    lhs = prefixed(left, "a", grid.keys).selectExpr(
        "*", *[f"shiftright(a_{c}, {BLOCK_BITS}) AS {b}" for b, c in zip(blocks, CELL)]
    )
    rhs = prefixed(right, "b", grid.keys)
    for i, (b, c) in enumerate(zip(blocks, CELL)):
        low = f"shiftright(b_{c} - {REACH}, {BLOCK_BITS})"
        # No left cell that comes first is further on along the first axis.
        high = f"shiftright(b_{c} + {0 if once and i == 0 else REACH}, {BLOCK_BITS})"
        rhs = rhs.selectExpr("*", f"explode(sequence({low}, {high})) AS {b}")
    lhs = lhs.selectExpr("*", block, f"CAST({bits} AS TINYINT) AS _a_bits").drop(*blocks)
    rhs = rhs.selectExpr("*", block, f"CAST({bits} AS TINYINT) AS _b_bits").drop(*blocks)
    close = " AND ".join(f"abs(a_{c} - b_{c}) <= {REACH}" for c in CELL)
    kept = f"NOT ({' AND '.join(f'a_{c} = b_{c}' for c in CELL)})"
    if once:
        kept = "false"
        for c in reversed(CELL):
            kept = f"(a_{c} < b_{c} OR (a_{c} = b_{c} AND {kept}))"
    # The box tests are the heavy part, so they run spread by block even if Spark would
    # broadcast the other side.
    return (
        lhs.repartition(*on)
        .join(rhs, on)
        .filter(f"_a_bits - _b_bits = 0 AND {close} AND {kept} AND {grid.possible('a', 'b')}")
        .drop("_block", "_a_bits", "_b_bits")
    )


def labelled_cells(grid: Grid, points: DataFrame, cells: DataFrame, ws: Workspace) -> DataFrame:
    """``node, label``: cells joined where they hold a pair of points within the radius, by their smallest node.

    Samples decide most pairs, and small ones are compared point by point.  A large one
    matters only if its cells are not joined by then: those are split into quarter cells
    until the boxes decide.
    """
    edges, large = _links(grid, points, cells, ws)
    labels = connected_components(cells.select("node"), edges, ws, grid.hot_rows)
    if not joins.has_rows(large):
        return labels
    ends = {s: labels.toDF(f"{s}_node", f"{s}_label") for s in "ab"}
    apart = large.join(ends["a"], "a_node").join(ends["b"], "b_node").filter("a_label <> b_label")
    apart = ws.write(apart, "apart")
    if not joins.has_rows(apart):
        return labels
    found = _split_until_decided(grid, points, apart.drop("a_label", "b_label"), ws).toDF("a_node", "b_node")
    met = apart.join(found, ["a_node", "b_node"], "left_semi")
    groups = labels.filter("node = label").select("node")
    merged = connected_components(groups, met.selectExpr("a_label AS src", "b_label AS dst"), ws, grid.hot_rows)
    return ws.write(joins.lookup(labels, merged.toDF("label", "_to"), "label", hot_rows=grid.hot_rows).selectExpr("node", "_to AS label"), "merged")


def _links(grid: Grid, points: DataFrame, cells: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pairs ``src, dst`` of cells that surely hold a near pair of points, and the large pairs still undecided."""
    slim = cells.drop("sum_lat", "sum_lng")
    # One near pair is enough, and the samples may be one; where boxes say that all pairs are near, they are.
    pairs = neighbour_pairs(grid, slim, slim, once=True).selectExpr(
        *grid.keys, "a_node", "b_node", "a_n", "b_n", *[f"{s}_{c}" for s in "ab" for c in CELL],
        f"CASE WHEN {grid.near('a', 'b')} THEN true WHEN {grid.single('a')} AND {grid.single('b')} THEN false END AS near",
    )
    pairs = ws.write(pairs, "cellpairs")
    edges = pairs.filter("near").select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))

    undecided = pairs.filter("near is null")
    is_direct = F.col("a_n") * F.col("b_n") <= grid.direct_pairs
    ends = grid.keys + ["a_node", "b_node"]
    direct = undecided.filter(is_direct).select(*ends, *[f"{s}_{c}" for s in "ab" for c in CELL])
    small = _points_of_small_cells(grid, points, cells)
    found = direct
    for side in "ab":
        mine = prefixed(small.select(*grid.cell_keys, "lat", "lng"), side, grid.keys)
        found = found.join(mine, grid.keys + [f"{side}_{c}" for c in CELL])
    found = found.filter(grid.near("a", "b")).select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    return edges.union(found), undecided.filter(~is_direct)


def _points_of_small_cells(grid: Grid, points: DataFrame, cells: DataFrame) -> DataFrame:
    """Leave out the rows of hot cells, which no point-by-point comparison needs."""
    hot = grid.hot_cells(cells)
    return points if hot is None else points.join(F.broadcast(hot), grid.cell_keys, "left_anti")


def _split_until_decided(grid: Grid, points: DataFrame, pairs: DataFrame, ws: Workspace) -> DataFrame:
    spark = points.sparkSession
    ends = ["a_node", "b_node"]
    open_pairs = pairs.select(
        *grid.keys, *ends,
        *[F.col(f"{s}_{c}").alias(f"{s}_p{c}") for s in "ab" for c in CELL],
    )
    found: DataFrame | None = None
    level = 0
    while joins.has_rows(open_pairs):
        level += 1
        parts = ws.write(_parts(grid, points, open_pairs, level), f"parts{level}")
        rows = open_pairs
        for side in "ab":
            mine = prefixed(parts, side, grid.keys)
            rows = rows.join(mine, grid.keys + [f"{side}_p{c}" for c in CELL]).drop(*[f"{side}_p{c}" for c in CELL])
        rows = rows.filter(grid.possible("a", "b")).selectExpr("*", grid.verdict("a", "b") + " AS near")
        rows = ws.write(rows.filter("near is null or near"), f"splits{level}")
        yes = ws.write(rows.filter("near").select(*ends).distinct(), f"found{level}")
        found = yes if found is None else found.union(yes)
        open_pairs = ws.write(
            rows.filter("near is null").join(yes, ends, "left_anti").select(
                *grid.keys, *ends,
                *[F.col(f"{s}_{c}").alias(f"{s}_p{c}") for s in "ab" for c in CELL],
            ),
            f"open{level}",
        )
    if found is None:
        return spark.createDataFrame([], "src long, dst long")
    return found.toDF("src", "dst")


def _parts(grid: Grid, points: DataFrame, open_pairs: DataFrame, level: int) -> DataFrame:
    """Summaries of the quarter cells (at ``level``) of every part that is still open."""
    edge = grid.edge / 4.0**level
    parent = [f"p{c}" for c in CELL]
    # Dividing by an edge scaled by a power of four is exact, so a shift finds the parent.
    parents = {p: F.shiftright(c, 2) for p, c in zip(parent, CELL)}
    fine = points.drop(*CELL).selectExpr("*", *_cell_sql(edge))
    wanted = None
    for side in "ab":
        part = open_pairs.select(*grid.keys, *[F.col(f"{side}_p{c}").alias(f"p{c}") for c in CELL])
        wanted = part if wanted is None else wanted.union(part)
    wanted = wanted.distinct()
    if joins.is_small(wanted):
        # Only the points of open parts are summed up.
        fine = fine.withColumns(parents).join(F.broadcast(wanted), grid.keys + parent, "left_semi")
    summary = grid.summarise(fine).drop("sum_lat", "sum_lng", "node").withColumns(parents)
    return summary.join(wanted, grid.keys + parent, "left_semi")
