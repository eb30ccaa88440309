"""Touched cells of shrunk polygons and discs against fine sampling, and the sample report."""

import math
import random

import pytest
from pyspark.sql import functions as F

from surco.operators import covering
from surco.operators import samples as SM
from surco.operators import zones as Z

RES, STEP = 20.0, 0.25


def depth(x, y, ring):
    """Distance to the outline, negative outside."""
    inside, near = False, math.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        near = min(near, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return near if inside else -near


def deepest(ring):
    """The largest sampled depth in each cell of the polygon's box, borders included."""
    out = {}
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    for col in range(math.floor(min(xs) / RES), math.floor(max(xs) / RES) + 1):
        for fila in range(math.floor(min(ys) / RES), math.floor(max(ys) / RES) + 1):
            n = int(RES / STEP)
            out[fila, col] = max(depth(col * RES + i * STEP, fila * RES + j * STEP, ring) for i in range(n + 1) for j in range(n + 1))
    return out


def rings():
    r = random.Random(12)
    out = []
    for k in range(14):  # small stars, some with corners that point inwards
        cx, cy, n = r.uniform(0, 60), r.uniform(0, 60), r.randint(3, 8)
        out.append([(cx + math.cos(2 * math.pi * i / n + k) * s, cy + math.sin(2 * math.pi * i / n + k) * s) for i in range(n) for s in [r.uniform(6, 22)]])
    out.append([(1.0, 9.0), (75.0, 9.5), (75.0, 18.0), (1.0, 17.0)])  # a long strip between rows of centres
    out.append([(3.0, 3.0), (17.0, 3.0), (17.0, 8.0), (8.0, 8.0), (8.0, 17.0), (3.0, 17.0)])  # an angle around a centre
    return out


def vertices(spark, fields):
    rows = [(k, f"F{k}", "polygon", "maiz", 0, i, float(x), float(y)) for k, ring in fields.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "field_ord int, grupo string, kind string, etiqueta string, ring_id int, v_ord int, x double, y double")


@pytest.mark.parametrize("buffer", [0.0, 2.5, 6.0])
def test_touched_cells_of_shrunk_polygons(spark, buffer):
    fields = dict(enumerate(rings()))
    outline = Z.edges(vertices(spark, fields), ("field_ord",))
    got = {}
    for row in covering.touched_by_polygons(outline, RES, buffer).collect():
        got.setdefault(row["field_ord"], set()).add((row["fila"], row["col"]))
    for k, ring in fields.items():
        found = deepest(ring)
        own = got.get(k, set())
        centre = {c for c in found if depth((c[1] + .5) * RES, (c[0] + .5) * RES, ring) >= buffer}
        sure = {c for c, d in found.items() if d > buffer + 1e-6}
        assert sure - centre <= own, (k, sure - own)
        # a point of the shrunk polygon lies in the cell: a sample next to it is nearly as deep
        assert all(found.get(c, -math.inf) >= buffer - STEP * 1.5 for c in own), k


def test_touched_cells_of_discs(spark):
    r = random.Random(4)
    spots = [(k, r.uniform(-30, 70), r.uniform(-30, 70)) for k in range(40)]
    df = spark.createDataFrame(spots, "field_ord int, x double, y double")
    for radius in (0.2, 9.0, 31.0):
        got = {tuple(x) for x in covering.touched_by_discs(df, RES, radius).collect()}
        want = set()
        for k, x, y in spots:
            for fila in range(-6, 8):
                for col in range(-6, 8):
                    px, py = min(max(x, col * RES), col * RES + RES), min(max(y, fila * RES), fila * RES + RES)
                    if math.hypot(px - x, py - y) <= radius:
                        want.add((k, fila, col))
        assert got == want


def test_a_disc_touches_the_cells_of_which_it_meets_only_the_border(spark):
    places = [(35.0, 66.25), (45.0, 50.0), (50.0, 35.0), (50.0, 45.0), (15.0, 15.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "field_ord int, x double, y double")
    got = {tuple(x) for x in covering.touched_by_discs(df, RES, 15.0, far_borders=True).select("field_ord", "fila", "col").collect()}
    off = lambda c, k: max(0.0, k * RES - c, c - (k + 1) * RES)
    assert got == {(i, f, c) for i, (x, y) in enumerate(places) for f in range(-3, 8) for c in range(-3, 8) if math.hypot(off(x, c), off(y, f)) <= 15}


def test_fields_without_a_centre_take_free_cells(spark):
    pixels = spark.range(100).select(F.col("id").alias("px_id"), (F.col("id") / 10).cast("int").alias("fila"), (F.col("id") % 10).cast("int").alias("col")).withColumns(
        {"x": (F.col("col") + 0.5) * RES, "y": (F.col("fila") + 0.5) * RES})
    fields = {
        1: [(41, 41), (59, 41), (59, 59), (41, 59)],  # holds the centre of (2, 2)
        2: [(52, 43), (68, 43), (68, 48), (52, 48)],  # no centre: touches (2, 2), which is taken, and (2, 3)
        3: [(100, 100), (103, 100), (103, 103), (100, 103)],  # nothing is left after shrinking
        4: [(900, 900), (960, 900), (960, 960), (900, 960)],  # off the grid
        5: [(41, 41), (59, 41), (59, 59), (41, 59)],  # overwrites 1, which then has no centre and no free cell
    }
    df = vertices(spark, fields).union(spark.createDataFrame([(6, "F6", "point", "maiz", 0, 0, 119.9, 21.0), (7, "F7", "point", "soya", 0, 0, 9.0, 9.0)], "field_ord int, grupo string, kind string, etiqueta string, ring_id int, v_ord int, x double, y double"))
    mapping = spark.createDataFrame([("maiz", "maiz"), ("soya", "")], "value string, clase string")
    got = SM.extract(pixels, df, mapping, RES, 2.0, 1.0)
    assert {(x["grupo"], x["fila"], x["col"]) for x in got.collect()} == {("F5", 2, 2), ("F2", 2, 3), ("F6", 1, 5), ("F6", 1, 6)}
    report = SM.extract_report(df, mapping, got, RES, 2.0, 1.0).first().asDict()
    assert report == {"features": 7, "ignored_class": 1, "empty_after_buffer": 1, "outside": 2}
