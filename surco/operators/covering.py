"""Cells that a shrunk polygon or a disc touches, without a geometry library.

A polygon shrunk by ``b`` is the set of its points at least ``b`` from its outline. A cell whose centre it doesn't hold
is touched where the outline of the shrunk polygon enters it, or lies in it whole. That outline runs along lines parallel to
the edges and circles around the corners, so it is enough to look at the points where these curves meet each other or a grid line, and to
keep those that really are inside and deep enough. Edges are cut into short pieces and dealt over square bins, so a curve is only
compared with those next to it, and every join is on equal bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surco.session import written_once

#: Pieces of an edge are at most so many bins long.
PIECE_BINS = 4
SLACK = 1e-7


def _bins(df: DataFrame, size: float, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """One row per bin that the box meets."""
    def over(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))

    return df.select("*", over(x0, x1).alias("bi")).select("*", over(y0, y1).alias("bj"))


def _boxed(df: DataFrame, size: float, more: float = 0.0) -> DataFrame:
    return _bins(df, size, F.least("x1", "x2") - more, F.greatest("x1", "x2") + more, F.least("y1", "y2") - more, F.greatest("y1", "y2") + more)


def _pieces(edge_rows: DataFrame, size: float) -> DataFrame:
    """Edges cut into pieces; ``head`` and ``tail`` tell the ends that are corners."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / (PIECE_BINS * size)).cast("int"))
    cut = edge_rows.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))

    def at(a: str, b: str, k: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * k / F.col("n")

    return cut.select(
        "field_ord", at("x1", "x2", F.col("i")).alias("x1"), at("y1", "y2", F.col("i")).alias("y1"),
        F.when(F.col("i") == F.col("n") - 1, F.col("x2")).otherwise(at("x1", "x2", F.col("i") + 1)).alias("x2"),
        F.when(F.col("i") == F.col("n") - 1, F.col("y2")).otherwise(at("y1", "y2", F.col("i") + 1)).alias("y2"),
        (F.col("i") == 0).alias("head"), (F.col("i") == F.col("n") - 1).alias("tail"))


def _curves(pieces: DataFrame, buffer: float) -> tuple[DataFrame, DataFrame]:
    """The parallels of the pieces on both sides, and the corners."""
    corners = pieces.filter("head").select("field_ord", F.col("x1").alias("cx"), F.col("y1").alias("cy")).distinct()
    if not buffer:
        return pieces, corners
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    both = pieces.filter(length > 0).withColumns({"nx": -(F.col("y2") - F.col("y1")) / length, "ny": (F.col("x2") - F.col("x1")) / length}).select(
        "*", F.explode(F.array(F.lit(buffer), F.lit(-buffer))).alias("s"))
    return both.select("field_ord", *[(F.col(c) + F.col("s") * F.col(f"n{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")], "head", "tail"), corners


def _meetings(lines: DataFrame, corners: DataFrame, buffer: float, size: float) -> DataFrame:
    """Points where two curves of a field meet, and the ends of its parallels."""
    ends = lines.filter("head").select("field_ord", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(
        lines.filter("tail").select("field_ord", F.col("x2").alias("x"), F.col("y2").alias("y")))
    if not buffer:
        return ends
    binned = _boxed(lines.drop("head", "tail"), size)
    a, b = binned.alias("a"), binned.alias("b")
    together = ["field_ord", "bi", "bj"]
    first = F.struct("a.x1", "a.y1", "a.x2", "a.y2") < F.struct("b.x1", "b.y1", "b.x2", "b.y2")
    pair = a.join(b, together).filter(first).select(
        "field_ord", *[F.col(f"{t}.{c}").alias(f"{t}{c}") for t in "ab" for c in ("x1", "y1", "x2", "y2")])
    dx, dy, ex, ey = (F.col(f"{t}{c}2") - F.col(f"{t}{c}1") for t in "ab" for c in "xy")
    across = dx * ey - dy * ex
    wx, wy = F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    t, u = (wx * ey - wy * ex) / across, (wx * dy - wy * dx) / across
    crossing = pair.filter(across != 0).withColumns({"t": t, "u": u}).filter(
        F.col("t").between(-SLACK, 1 + SLACK) & F.col("u").between(-SLACK, 1 + SLACK)).select(
        "field_ord", (F.col("ax1") + F.col("t") * dx).alias("x"), (F.col("ay1") + F.col("t") * dy).alias("y"))
    # a line and a circle
    rings = _bins(corners, size, F.col("cx") - buffer, F.col("cx") + buffer, F.col("cy") - buffer, F.col("cy") + buffer)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    wx, wy = F.col("x1") - F.col("cx"), F.col("y1") - F.col("cy")
    qa, qb, qc = dx * dx + dy * dy, 2 * (wx * dx + wy * dy), wx * wx + wy * wy - buffer * buffer
    root = F.sqrt(qb * qb - 4 * qa * qc)
    cut = binned.join(rings, together).filter((qa > 0) & (qb * qb - 4 * qa * qc >= 0)).select(
        "field_ord", "x1", "y1", dx.alias("dx"), dy.alias("dy"), F.explode(F.array((-qb - root) / (2 * qa), (-qb + root) / (2 * qa))).alias("t"))
    cut = cut.filter(F.col("t").between(-SLACK, 1 + SLACK)).select(
        "field_ord", (F.col("x1") + F.col("t") * F.col("dx")).alias("x"), (F.col("y1") + F.col("t") * F.col("dy")).alias("y"))
    # two circles of one radius
    two = rings.alias("a").join(rings.alias("b"), together).filter(F.struct("a.cx", "a.cy") < F.struct("b.cx", "b.cy"))
    dx, dy = F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")
    gap = F.hypot(dx, dy)
    high = F.sqrt(buffer * buffer - gap * gap / 4)
    apart = two.filter(gap <= 2 * buffer).select(
        "field_ord", ((F.col("a.cx") + F.col("b.cx")) / 2).alias("mx"), ((F.col("a.cy") + F.col("b.cy")) / 2).alias("my"),
        (-dy / gap * high).alias("ox"), (dx / gap * high).alias("oy"), F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s")).select(
        "field_ord", (F.col("mx") + F.col("s") * F.col("ox")).alias("x"), (F.col("my") + F.col("s") * F.col("oy")).alias("y"))
    return ends.unionByName(crossing).unionByName(cut).unionByName(apart)


def _grid_crossings(lines: DataFrame, corners: DataFrame, buffer: float, res: float) -> DataFrame:
    """Points where a curve meets a grid line, once for each of the two cells beside the line."""
    out = None
    for along, other in (("x", "y"), ("y", "x")):
        a1, a2, o1, o2 = (F.col(c) for c in (f"{along}1", f"{along}2", f"{other}1", f"{other}2"))
        first, last = F.ceil(F.least(a1, a2) / res), F.floor(F.greatest(a1, a2) / res)
        on_line = lines.filter((a1 != a2) & (first <= last)).select("field_ord", a1.alias("p"), a2.alias("q"), o1.alias("r"), o2.alias("s"), F.explode(F.sequence(first, last)).alias("k"))
        found = on_line.select("field_ord", "k", (F.col("r") + (F.col("k") * res - F.col("p")) * (F.col("s") - F.col("r")) / (F.col("q") - F.col("p"))).alias("v"))
        if buffer:
            c, o = F.col(f"c{along}"), F.col(f"c{other}")
            first, last = F.ceil((c - buffer) / res), F.floor((c + buffer) / res)
            ring = corners.filter(first <= last).select("field_ord", c.alias("c"), o.alias("o"), F.explode(F.sequence(first, last)).alias("k"))
            side = F.sqrt(F.greatest(F.lit(0.0), buffer * buffer - F.pow(F.col("k") * res - F.col("c"), 2)))
            found = found.unionByName(ring.select("field_ord", "k", F.explode(F.array(F.col("o") - side, F.col("o") + side)).alias("v")))
        line, cell = (F.col("k") * res).alias(along), F.floor(F.col("v") / res)
        names = ("col", "fila") if along == "x" else ("fila", "col")
        each = found.select("field_ord", line, F.col("v").alias(other), F.explode(F.array(F.col("k") - 1, F.col("k"))).alias(names[0]), cell.alias(names[1]))
        out = each if out is None else out.unionByName(each)
    return out


def touched_by_polygons(edge_rows: DataFrame, res: float, buffer: float) -> DataFrame:
    """(field_ord, fila, col) of the cells that the outline of each polygon, shrunk by ``buffer``, enters or lies in.

    ``edge_rows``: field_ord, x1, y1, x2, y2. A polygon that shrinks to nothing gives no row. Cells wholly inside are not listed.
    """
    size = max(res, 2 * buffer)
    pieces = written_once(_pieces(edge_rows.select("field_ord", "x1", "y1", "x2", "y2"), size))
    lines, corners = _curves(pieces, buffer)
    met = _meetings(lines, corners, buffer, size).select("field_ord", "x", "y", F.floor(F.col("y") / res).alias("fila"), F.floor(F.col("x") / res).alias("col"))
    found = met.unionByName(_grid_crossings(lines, corners, buffer, res)).distinct()
    if buffer:
        # the point is the key of the two checks: worked out anew it could differ in its last bits
        found = written_once(found)
        points = found.select("field_ord", "x", "y").distinct()
        near = points.withColumns({"bi": F.floor(F.col("x") / size), "bj": F.floor(F.col("y") / size)}).join(_boxed(pieces, size, buffer), ["field_ord", "bi", "bj"])
        x, y = F.col("x"), F.col("y")
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        along = ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy)
        t = F.when(dx * dx + dy * dy == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
        away = F.hypot(x - F.col("x1") - t * dx, y - F.col("y1") - t * dy)
        shallow = near.filter(away < buffer - SLACK * (1 + buffer)).select("field_ord", "x", "y").distinct()
        # crossings of the ray to the right with the pieces of the same strip
        strips = pieces.filter("y1 <> y2").select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))).alias("bj"))
        ray = points.withColumn("bj", F.floor(y / size)).join(strips, ["field_ord", "bj"]).filter(
            ((F.col("y1") > y) != (F.col("y2") > y)) & (x < F.col("x1") + (y - F.col("y1")) * dx / dy))
        inside = ray.groupBy("field_ord", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")
        found = found.join(inside.join(shallow, ["field_ord", "x", "y"], "left_anti"), ["field_ord", "x", "y"], "left_semi")
    return found.select("field_ord", F.col("fila").cast("int").alias("fila"), F.col("col").cast("int").alias("col")).distinct()


def touched_by_discs(points: DataFrame, res: float, radius: float, far_borders: bool = False) -> DataFrame:
    """(field_ord, fila, col) of the cells that a disc around each point (field_ord, x, y) touches.

    A border line belongs to the cell that begins there; with ``far_borders`` also to the one that ends there.
    """
    def reach(c: str) -> Column:
        first = (F.col(c) - radius) / res
        return F.explode(F.sequence(F.ceil(first) - 1 if far_borders else F.floor(first), F.floor((F.col(c) + radius) / res)))

    around = points.select("field_ord", "x", "y", reach("y").alias("fila")).select("*", reach("x").alias("col"))

    def off(c: str, cell: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(cell) * res - F.col(c), F.col(c) - (F.col(cell) + 1) * res)

    return around.filter(F.hypot(off("x", "col"), off("y", "fila")) <= radius).select(
        "field_ord", F.col("fila").cast("int").alias("fila"), F.col("col").cast("int").alias("col")).distinct()
