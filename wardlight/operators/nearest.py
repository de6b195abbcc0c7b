"""Exact nearest-district search by narrowing pairs of nodes down a grid tree.

Points and districts are reduced to the cells of one grid that they occupy, each with the
bounding box of what it holds.  From coarse to fine, a point cell keeps only the district
nodes that can hold the nearest district of some point of it: those whose lower distance
bound does not exceed the best upper bound.  The children of kept pairs are the pairs of
the next level, so a cell meets a bounded number of nodes at each level however many
districts there are.  At the end nodes give way to their districts, and a point compares
only its own cell's short list, inside one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardlight.functions import geo
from wardlight.operators import joins
from wardlight.workspace import Workspace

#: A cell with more candidates than this is split further.
SHORT_LIST = 64
#: Bits per axis added from one level to the next.
STEP = 2
#: Districts in all short lists together that may be broadcast (some 150 bytes each).
BROADCAST_ENTRIES = 200_000
#: At this depth a cell is far below a millimetre and its list is compared as it is.
DEEPEST = 36


@dataclass(frozen=True)
class Metric:
    """Grid axes in [-1, 1], cost of a point and a district, and bounds on it over two boxes."""

    axes: Callable[[str, str], tuple[str, ...]]
    cost: Callable[[str, str, str, str], str]
    lower: Callable[[int], str]
    upper: Callable[[int], str]


def _gap(i: int) -> str:
    return f"greatest(0D, lo{i} - dhi{i}, dlo{i} - hi{i})"


def _span(i: int) -> str:
    return f"greatest(hi{i} - dlo{i}, dhi{i} - lo{i})"


SPHERE = Metric(
    axes=geo.unit_vector_sql,
    cost=geo.chord_sq_sql,
    lower=lambda n: " + ".join(f"pow({_gap(i)}, 2D)" for i in range(n)),
    upper=lambda n: " + ".join(f"pow({_span(i)}, 2D)" for i in range(n)),
)


def _planar_cost(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    d_lng = f"(({lng1} - {lng2}) * cos(radians({lat1})))"
    return f"({lat1} - {lat2}) * ({lat1} - {lat2}) + {d_lng} * {d_lng}"


# The two axes are degrees over 180; the longitude scale lies between its values at the
# box's largest and smallest distance from the equator.
_FAR = "greatest(abs(lo0), abs(hi0)) * 180D"
_CLOSE = "CASE WHEN lo0 <= 0D AND hi0 >= 0D THEN 0D ELSE least(abs(lo0), abs(hi0)) * 180D END"
PLANE = Metric(
    axes=lambda lat, lng: (f"{lat} / 180D", f"{lng} / 180D"),
    cost=_planar_cost,
    lower=lambda n: f"32400D * (pow({_gap(0)}, 2D) + pow({_gap(1)} * greatest(0D, cos(radians({_FAR}))), 2D))",
    upper=lambda n: f"32400D * (pow({_span(0)}, 2D) + pow({_span(1)} * cos(radians({_CLOSE})), 2D))",
)


def nearest_district(
    points: DataFrame, districts: DataFrame, point_id: str = "id", workspace: Workspace | None = None
) -> DataFrame:
    """The nearest district on the sphere, for rows ``<point_id>, lat, lng``.

    Ties go to the lowest district id.  Points without finite coordinates get nulls.  Returns ``<point_id>, districtId, districtName,
    state, districtLat, districtLng, distanceMeters``.
    """
    found = _with_unlocated(points.select(point_id, "lat", "lng"), districts, workspace)
    metres = geo.haversine_sql("lat", "lng", "best.lat", "best.lng")
    return found.selectExpr(
        point_id, "best.id AS districtId", "best.name AS districtName", "best.state AS state",
        "best.lat AS districtLat", "best.lng AS districtLng", f"{metres} AS distanceMeters",
    )


def nearest_district_planar(
    points: DataFrame, districts: DataFrame, point_id: str = "clusterId", workspace: Workspace | None = None
) -> DataFrame:
    """The nearest district by equirectangular degrees scaled at the point's latitude.

    Ties go to the lowest ``ord`` of ``districts``.  Returns ``<point_id>, districtId,
    districtName, country, infraScore``.
    """
    found = _with_unlocated(points.select(point_id, "lat", "lng"), districts, workspace, PLANE, "ord")
    return found.selectExpr(
        point_id, "best.id AS districtId", "best.name AS districtName",
        "best.country AS country", "best.infraScore AS infraScore",
    )


def _with_unlocated(points: DataFrame, districts: DataFrame, *how) -> DataFrame:
    """:func:`attach_nearest` for all rows; those without finite coordinates get a null ``best``."""
    located = geo.located("lat", "lng")
    return attach_nearest(points.filter(located), districts, *how).unionByName(
        points.filter(~located), allowMissingColumns=True
    )


def attach_nearest(
    points: DataFrame, districts: DataFrame, workspace: Workspace | None = None,
    metric: Metric = SPHERE, tie: str = "id",
) -> DataFrame:
    """All columns of ``points`` and ``best``, a struct of the nearest district's columns.

    ``points`` is read twice: for the cells it occupies and for the answer.  Its rows
    are only shuffled if the table of occupied cells is too large to broadcast.
    """
    spark = points.sparkSession
    ws = workspace or Workspace(spark)
    n = len(metric.axes("lat", "lng"))
    places = ws.write(_places(districts, metric, tie), "places")
    size = places.count()
    if size == 0:
        raise ValueError("nearest district search needs at least one district")

    axes = metric.axes("_plat", "_plng")
    columns = points.columns
    rows = points.selectExpr("*", "CAST(lat AS DOUBLE) AS _plat", "CAST(lng AS DOUBLE) AS _plng")
    # Few districts: one level of some thousand cells.  Many: several levels down to
    # cells that are small against the spacing of districts.
    levels = [4] if size <= SHORT_LIST else list(range(2, max(3, size.bit_length() // 2 + 3), STEP))
    level = levels[-1]
    boxes = ws.write(_boxes(rows, metric, n, level), "boxes")
    pairs = None
    for before, at in zip([0, *levels], levels):
        pairs = ws.write(_narrow(_coarser(boxes, n, level - at), _nodes(places, n, at), pairs, metric, n, at - before), "pairs")
    grid = [f"g{i}" for i in range(n)]
    answers = []
    while True:
        placed = rows.selectExpr("*", *[f"{_index(a, level)} AS {g}" for a, g in zip(axes, grid)])
        # A list can only be too long if there are that many districts at all.
        if size <= SHORT_LIST or level >= DEEPEST:
            answers.append(_pick(placed, _lists(pairs, places, metric, n, level, ws), grid, metric, tie, columns))
            break
        crowded = pairs.groupBy(*grid).agg(F.sum("m").alias("m")).filter(F.col("m") > SHORT_LIST).select(*grid)
        calm = pairs.join(crowded, grid, "left_anti")
        answers.append(_pick(placed, _lists(calm, places, metric, n, level, ws), grid, metric, tie, columns))
        if not joins.has_rows(crowded):
            break
        rows = ws.write(joins.lookup(placed, crowded, grid).select(*columns, "_plat", "_plng"), "crowded")
        deeper = min(level + STEP, DEEPEST)
        open_ = pairs.join(crowded, grid, "left_semi")
        pairs = ws.write(_narrow(_boxes(rows, metric, n, deeper), _nodes(places, n, deeper), open_, metric, n, deeper - level), "pairs")
        level = deeper
    result = answers[0]
    for more in answers[1:]:
        result = result.unionByName(more)
    return result


class NearestIndex:
    """Short lists for every cell of the sphere, written once for a table of districts.

    :func:`attach_nearest` derives its lists from the points at hand; this derives them
    from the districts alone, so that any number of batches can use them.  A cell whose
    list would be long gives way to its finer cells, down to cells that are small against
    the mean spacing of districts; around denser crowds lists stay longer.
    """

    FIRST = 4

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _levels(self) -> list[int]:
        """Levels that have lists; empty if the index is not complete."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("level=")) if "_SUCCESS" in names else []

    def exists(self) -> bool:
        return bool(self._levels())

    def build(self, districts: DataFrame, workspace: Workspace | None = None, tie: str = "id") -> NearestIndex:
        ws = workspace or Workspace(self.spark)
        places, n, level, parents, lists = ws.write(_places(districts, SPHERE, tie), "places"), 3, self.FIRST, None, []
        if not joins.has_rows(places):
            raise ValueError("nearest district search needs at least one district")
        grid = [f"g{i}" for i in range(n)]
        cells = self.spark.range(1)
        for g in grid:
            cells = cells.withColumn(g, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**level).cast("long"))))
        finest = max(level, places.count().bit_length() // 2 + 3)
        while True:
            bits = level if parents is None else STEP
            pairs = ws.write(_narrow(_on_sphere(cells, level), _nodes(places, n, level), parents, SPHERE, n, bits), "pairs")
            crowded = pairs.groupBy(*grid).agg(F.sum("m").alias("m")).filter(F.col("m") > SHORT_LIST).select(*grid)
            crowded = ws.write(crowded if level < finest else crowded.limit(0), "crowded")
            calm = pairs.join(crowded, grid, "left_anti")
            lists.append(_lists(calm, places, SPHERE, n, level, ws).withColumn("level", F.lit(level)))
            if not joins.has_rows(crowded):
                break
            level, parents, cells = level + STEP, pairs.join(crowded, grid, "left_semi"), crowded
            for g in grid:
                inside = F.sequence(F.shiftleft(g, STEP), F.shiftleft(g, STEP) + (2**STEP - 1))
                cells = cells.withColumn(g, F.explode(inside))
        whole = lists[0]
        for more in lists[1:]:
            whole = whole.unionByName(more)
        whole.write.mode("overwrite").partitionBy("level").parquet(self.path)
        return self

    def attach(self, points: DataFrame, tie: str = "id") -> DataFrame:
        """All columns of ``points`` (with finite coordinates) and ``best``, as :func:`attach_nearest`."""
        grid, axes = [f"g{i}" for i in range(3)], SPHERE.axes("_plat", "_plng")
        rows = points.selectExpr("*", "CAST(lat AS DOUBLE) AS _plat", "CAST(lng AS DOUBLE) AS _plng")
        answer = None
        for level in self._levels():
            placed = rows.selectExpr("*", *[f"{_index(a, level)} AS {g}" for a, g in zip(axes, grid)])
            found = _pick(placed, self.spark.read.parquet(f"{self.path}/level={level}"), grid, SPHERE, tie, points.columns)
            answer = found if answer is None else answer.unionByName(found)
        if answer is None:
            raise ValueError(f"there is no complete index at {self.path}")
        return answer


def _on_sphere(cells: DataFrame, level: int) -> DataFrame:
    """The cells that hold points of the sphere, with their bounds as boxes."""
    step, near, far = 2.0 ** (1 - level), [], []
    for i in range(3):
        cells = cells.selectExpr("*", f"g{i} * {step!r}D - 1D AS lo{i}", f"(g{i} + 1) * {step!r}D - 1D AS hi{i}")
        near.append(f"pow(greatest(0D, lo{i}, -hi{i}), 2D)")
        far.append(f"pow(greatest(abs(lo{i}), abs(hi{i})), 2D)")
    return cells.filter(f"{' + '.join(near)} <= 1D + 1e-9D AND {' + '.join(far)} >= 1D - 1e-9D").select(
        *[f"g{i}" for i in range(3)], *[f"{b}{i}" for i in range(3) for b in ("lo", "hi")]
    )


def _places(districts: DataFrame, metric: Metric, tie: str) -> DataFrame:
    """``district, d0 …``: of districts at one place the first in tie order, as only that can ever win."""
    carried = [c for c in ("ord", "id", "name", "state", "country", "infraScore") if c in districts.columns]
    places = districts.groupBy("lat", "lng").agg(F.min_by(F.struct(*carried), tie).alias("d"))
    return places.selectExpr(
        "struct(lat, lng, d.*) AS district", *[f"{a} AS d{i}" for i, a in enumerate(metric.axes("lat", "lng"))]
    )


def _index(axis: str, level: int) -> str:
    return f"CAST(floor(({axis} + 1D) * {2.0 ** (level - 1)!r}D) AS BIGINT)"


def _boxes(rows: DataFrame, metric: Metric, n: int, level: int) -> DataFrame:
    """Occupied cells with the bounding box of their points."""
    placed = rows.selectExpr(*[f"{a} AS p{i}" for i, a in enumerate(metric.axes("_plat", "_plng"))])
    placed = placed.selectExpr("*", *[f"{_index(f'p{i}', level)} AS g{i}" for i in range(n)])
    box = [f(f"p{i}").alias(f"{b}{i}") for i in range(n) for b, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy(*[f"g{i}" for i in range(n)]).agg(*box)


def _coarser(boxes: DataFrame, n: int, bits: int) -> DataFrame:
    """Boxes of the cells ``bits`` levels up."""
    if bits == 0:
        return boxes
    merged = [f(f"{b}{i}").alias(f"{b}{i}") for i in range(n) for b, f in (("lo", F.min), ("hi", F.max))]
    return boxes.groupBy(*[F.shiftright(f"g{i}", bits).alias(f"g{i}") for i in range(n)]).agg(*merged)


def _nodes(places: DataFrame, n: int, level: int) -> DataFrame:
    """Cells that hold districts: ``e0 …`` with the districts' bounding box and number ``m``."""
    placed = places.selectExpr(*[f"d{i}" for i in range(n)], *[f"{_index(f'd{i}', level)} AS e{i}" for i in range(n)])
    box = [f(f"d{i}").alias(f"d{b}{i}") for i in range(n) for b, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy(*[f"e{i}" for i in range(n)]).agg(F.count("*").alias("m"), *box)


def _narrow(boxes, nodes, parents, metric, n, bits) -> DataFrame:
    """Pairs of a point cell and a district node below a pair of ``parents`` (None: the root) that may hold a nearest pair."""
    grid, ends = [f"g{i}" for i in range(n)], [f"e{i}" for i in range(n)]
    if parents is None:
        # At the first level a fixed number of cells meets as many nodes.
        pairs = boxes.withColumn("root", F.lit(0)).join(F.broadcast(nodes.withColumn("root", F.lit(0))), "root").drop("root")
    else:
        ups = parents.select(*[F.col(c).alias(f"u{c}") for c in grid + ends])
        inner = boxes.selectExpr("*", *[f"shiftright({g}, {bits}) AS u{g}" for g in grid])
        below = nodes.selectExpr("*", *[f"shiftright({e}, {bits}) AS u{e}" for e in ends])
        pairs = inner.join(ups, [f"u{g}" for g in grid]).join(below, [f"u{e}" for e in ends])
        pairs = pairs.drop(*[f"u{c}" for c in grid + ends])
    return _possible(pairs, metric, n)


def _possible(pairs: DataFrame, metric: Metric, n: int) -> DataFrame:
    """Drop the pairs of a cell that another pair's upper bound rules out."""
    cell = Window.partitionBy(*[f"g{i}" for i in range(n)])
    pairs = pairs.selectExpr("*", f"{metric.lower(n)} AS low", f"{metric.upper(n)} AS high")
    pairs = pairs.withColumn("bound", F.min("high").over(cell))
    return pairs.filter("low <= bound * (1D + 1e-9D) + 1e-18D").drop("low", "high", "bound")


def _lists(pairs, places, metric, n, level, ws) -> DataFrame:
    """``g0 …, list``: the districts of each cell that may be nearest to one of its points."""
    grid, ends = [f"g{i}" for i in range(n)], [f"e{i}" for i in range(n)]
    inside = places.selectExpr("*", *[f"{_index(f'd{i}', level)} AS {e}" for i, e in enumerate(ends)])
    box = [f"{b}{i}" for i in range(n) for b in ("lo", "hi")]
    each = pairs.select(*grid, *ends, *box).join(inside, ends)
    each = each.selectExpr(*grid, *box, "district", *[f"d{i} AS d{b}{i}" for i in range(n) for b in ("lo", "hi")])
    return ws.write(_possible(each, metric, n).groupBy(*grid).agg(F.collect_list("district").alias("list")), "lists")


def _pick(placed, listed, grid, metric, tie, columns) -> DataFrame:
    """Compare a point with its cell's short list inside the row."""
    cost = metric.cost("_plat", "_plng", "c.lat", "c.lng")
    entries = listed.agg(F.coalesce(F.sum(F.size("list")), F.lit(0)).alias("n")).first()["n"]
    if entries <= BROADCAST_ENTRIES:
        rows = placed.join(F.broadcast(listed), grid)
    else:
        rows = joins.lookup(placed, listed, grid, broadcast_rows=0)
    return rows.selectExpr(
        *columns,
        f"array_min(transform(list, c -> struct({cost} AS cost, c.{tie} AS tie, c AS best))).best AS best",
    )
