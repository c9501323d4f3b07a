"""Nearest cells and polygon areas against brute force; plans without cartesian products; holes."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import spatial as G
from loomgraph.sources import records

CELLS = "cell_id int, south double, north double, west double, east double, kind string"


def cells_of(spark, centres, half=0.001):
    return spark.createDataFrame([(i, y - half, y + half, x - half, x + half, k) for i, (y, x, k) in enumerate(centres)], CELLS)


def agents_of(spark, places):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "agent_id int, lat double, lng double")


def nearest(places, cells, kind=None):
    out = {}
    for i, (lat, lng) in enumerate(places):
        found = [(math.sqrt((lat - (r["north"] + r["south"]) / 2) ** 2 + (lng - (r["east"] + r["west"]) / 2) ** 2), r["cell_id"]) for r in cells if kind in (None, r["kind"])]
        out[i] = min(found)[1]
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0, 170.0])
def test_nearest_cells_equal_brute_force(spark, monkeypatch, spread):
    rnd = random.Random(1)
    at = lambda s: (rnd.uniform(-s, s) / 2, rnd.uniform(-s, s))
    # clusters with wide gaps, agents within, between and far outside of them, and cells on the edges of buckets
    hearts = [at(spread) for _ in range(5)]
    centres = [(round(y + rnd.gauss(0, 0.01), 2 if rnd.random() < 0.2 else 6), x + rnd.gauss(0, 0.01), rnd.choice("ab")) for y, x in hearts for _ in range(12)]
    places = [at(spread) for _ in range(60)] + [at(3 * spread) for _ in range(20)] + [(y, x) for y, x, _ in centres[:5]]
    cells, agents = cells_of(spark, centres), agents_of(spark, places)
    rows = cells.collect()
    for few in (50_000, 0):
        monkeypatch.setattr(G, "FEW", few)
        assert {r["agent_id"]: r["cell_id"] for r in G.nearest_cells(agents, cells).collect()} == nearest(places, rows)
    got = {(r["agent_id"], r["kind"]): r["cell_id"] for r in G.nearest_cells(agents, cells, by="kind").collect()}
    assert got == {(i, k): c for k in "ab" for i, c in nearest(places, rows, k).items()}


def test_nearest_cells_of_odd_rows(spark):
    cells = cells_of(spark, [(1.0, 1.0, "a"), (1.0, 3.0, "a")])
    broken = cells.union(spark.createDataFrame([(9, None, 1.0, 1.0, 1.0, "a")], CELLS))
    agents = agents_of(spark, [(1.0, 2.0), (1.0, None), (50.0, 2.0)])
    # equals: the first cell
    assert {r["agent_id"]: r["cell_id"] for r in G.nearest_cells(agents, broken).collect()} == {0: 0, 2: 0}
    assert G.nearest_cells(agents, cells.limit(0)).count() == 0 and G.nearest_cells(agents.limit(0), cells).count() == 0
    assert G.nearest_cells(agents, cells.limit(0), by="kind").count() == 0


def test_far_agents_meet_few_cells(spark):
    """Agents far from 4,000 cells: the plan has no cartesian product and the last join gives some rows an agent, not thousands."""
    rnd = random.Random(2)
    cells = cells_of(spark, [(rnd.uniform(0, 1), rnd.uniform(0, 1), "a") for _ in range(4000)])
    places = [(rnd.uniform(20, 21), rnd.uniform(20, 21)) for _ in range(50)]
    seen = []
    best = G._best
    try:
        G._best = lambda met, group: (seen.append(met), best(met, group))[1]
        found = G.nearest_cells(agents_of(spark, places), cells)
        assert {r["agent_id"]: r["cell_id"] for r in found.collect()} == nearest(places, cells.collect())
    finally:
        G._best = best
    assert seen[-1].count() < 50 * 60
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# Polygons


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                hit = not hit
    return hit


def strips(rings, west, south, east, north, n=4000):
    """Area by n horizontal lines."""
    total = 0.0
    for k in range(n):
        y = south + (k + 0.5) * (north - south) / n
        xs = sorted(ax + (y - ay) / (by - ay) * (bx - ax) for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True) if (ay > y) != (by > y))
        total += sum(max(0.0, min(b, east) - max(a, west)) for a, b in zip(xs[::2], xs[1::2], strict=True))
    return total * (north - south) / n


def star(rnd, x, y, low, high, points):
    """A ring around a point whose radius changes from corner to corner."""
    return [(x + (r := rnd.uniform(low, high)) * math.cos(2 * math.pi * k / points), y + r * math.sin(2 * math.pi * k / points)) for k in range(points)]


def as_rows(polygons):
    return [(z, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for z, rings in polygons]


def test_areas_equal_strips(spark):
    rnd = random.Random(3)
    polygons = []
    for z in range(6):
        x, y = rnd.uniform(-0.05, 0.05), rnd.uniform(-0.05, 0.05)
        outer = star(rnd, x, y, 0.03, 0.06, rnd.randint(5, 20))
        holes = [star(rnd, x - 0.008, y, 0.002, 0.006, 7), star(rnd, x + 0.008, y, 0.002, 0.006, 5)[::-1]] if z % 2 else []
        polygons.append((z, [outer, *holes]))
    boxes = [(c, *sorted((rnd.uniform(-0.1, 0.1), rnd.uniform(-0.1, 0.1))), *sorted((rnd.uniform(-0.1, 0.1), rnd.uniform(-0.1, 0.1)))) for c in range(25)]
    cells = spark.createDataFrame(boxes, "cell_id int, south double, north double, west double, east double")
    df = spark.createDataFrame(as_rows(polygons), "zone_id int, rings array<array<struct<x:double,y:double>>>")
    for step in (0.01, 0.003, 1.0):
        got = {(r["cell_id"], r["zone_id"]): r["area"] for r in G.overlap_areas(cells, df, step).collect()}
        for c, south, north, west, east in boxes:
            for z, rings in polygons:
                assert got.get((c, z), 0.0) == pytest.approx(strips(rings, west, south, east, north), abs=2e-6)


def test_an_annulus_has_its_true_area(spark):
    circle = lambda r: [(r * math.cos(2 * math.pi * k / 720), r * math.sin(2 * math.pi * k / 720)) for k in range(720)]
    geo = json.dumps({"features": [{"properties": {"name": "ring"}, "geometry": {"type": "Polygon", "coordinates": [circle(0.05), circle(0.03)]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [0.01, 0], [0.01, 0.01], [0, 0.01]]], [[[0.02, 0], [0.03, 0], [0.03, 0.01], [0.02, 0.01]]]]}}]})
    zones = records.parse_geojson(spark.createDataFrame([("z", geo)], "g string, text string"))
    cells = spark.createDataFrame([(0, -0.1, 0.1, -0.1, 0.1), (1, -0.02, 0.02, -0.02, 0.02), (2, 0.0, 0.1, 0.0, 0.1)], "cell_id int, south double, north double, west double, east double")
    areas = {(r["cell_id"], r["zone_id"]): r["area"] for r in G.overlap_areas(cells, zones).collect()}
    true = math.pi * (0.05**2 - 0.03**2)
    assert areas[0, 0] == pytest.approx(true, rel=1e-4) and areas[2, 0] == pytest.approx(true / 4, rel=1e-4) and (1, 0) not in areas
    # the parts of one zone count together
    assert areas[0, 1] == pytest.approx(2e-4) and areas[1, 1] == pytest.approx(1e-4)
    best = {r["cell_id"]: r["zone_id"] for r in G.polygon_overlap(cells, zones).collect()}
    assert best == {0: 0, 1: 1, 2: 0}


def test_a_large_polygon_is_cut_along_buckets(spark):
    rings = [[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]]
    index = G.polygon_index(spark.createDataFrame(as_rows([(7, rings)]), "zone_id int, rings array<array<struct<x:double,y:double>>>"), 0.1)
    rows = index.collect()
    # 300 buckets are covered, and those that touch an edge are cut
    assert 180 <= sum(r["pieces"] is None for r in rows) <= 300 and all(len(ring) <= 8 for r in rows if r["pieces"] for ring in r["pieces"])
    for r in rows:
        if r["pieces"] is None:
            assert inside(rings, (r["__bx"] + 0.5) * 0.1, (r["__by"] + 0.5) * 0.1)


def test_odd_polygons(spark):
    df = spark.createDataFrame(as_rows([(1, [[(0.0, 0.0), (1.0, 0.0)]]), (2, []), (3, [[(0.0, 0.0), (0.02, 0.0), (0.02, 0.02), (0.0, 0.02)]]), (4, [[(0.0, 0.0), (0.02, 0.0), (0.02, 0.02), (0.0, 0.02)]])]) + [(5, None)], "zone_id int, rings array<array<struct<x:double,y:double>>>")
    cells = spark.createDataFrame([(0, 0.0, 0.02, 0.0, 0.02), (1, None, 1.0, 0.0, 1.0), (2, 0.02, 0.04, 0.0, 0.02)], "cell_id int, south double, north double, west double, east double")
    got = G.polygon_overlap(cells, df).collect()
    assert [(r["cell_id"], r["zone_id"]) for r in got] == [(0, 3)] and got[0]["area"] == pytest.approx(4e-4)
    assert G.clipped_area([(0, 0), (2, 0), (2, 2), (0, 2)], 1, 1, 3, 3) == 1 and G.clipped_area([(5, 5), (6, 5), (6, 6)], 0, 0, 1, 1) == 0
    assert G.polygon_overlap(cells.limit(0), df).count() == 0 and G.polygon_overlap(cells, df.limit(0)).count() == 0
    assert df.where(F.col("zone_id") == 5).count() == 1


def test_zones_over_a_whole_cell_tie(spark):
    # far from the origin, so that products of whole degrees would round by as much as zones are told apart
    west, south, east, north = -122.47, 37.7225, -122.4644, 37.7270
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    assert abs(G.ring_area(box(west, south, east, north)) - (east - west) * (north - south)) < 1e-18
    rnd = random.Random(5)
    zones = [(n, [[{"x": x, "y": y} for x, y in box(west - rnd.random() * 0.01, south - rnd.random() * 0.01, east + rnd.random() * 0.01, north + rnd.random() * 0.01)]]) for n in range(40)]
    polygons = spark.createDataFrame(zones, "zone_id long, rings array<array<struct<x:double,y:double>>>")
    cells = spark.createDataFrame([("c", north, south, east, west)], "cell_id string, north double, south double, east double, west double")
    assert {abs(r.area - (east - west) * (north - south)) < 1e-17 for r in G.overlap_areas(cells, polygons).collect()} == {True}
    assert [r.zone_id for r in G.polygon_overlap(cells, polygons).collect()] == [0]


def test_agents_in_one_part_are_dealt_before_they_meet_cells(spark, monkeypatch):
    # lists of three, so that a bucket's cells come in several, and agents that stand twice
    monkeypatch.setattr(G, "LISTED", 3)
    rnd = random.Random(7)
    centres = [(rnd.random() * 0.05, rnd.random() * 0.05, "a") for _ in range(60)]
    cells = cells_of(spark, centres)
    places = [(rnd.random() * 0.05, rnd.random() * 0.05) for _ in range(50)]
    agents = agents_of(spark, places).coalesce(1)
    got = {r.agent_id: r.distance for r in G.nearest_cells(agents.union(agents), cells).collect()}
    assert len(got) == 50 and all(abs(got[r.agent_id] - min(math.hypot(r.lat - y, r.lng - x) for y, x, _ in centres)) < 1e-9 for r in agents.collect())
    read = []
    monkeypatch.setattr(G, "materialize", lambda df, name: read.append((name, df._jdf.queryExecution().executedPlan().toString())) or df)
    G.nearest_cells(agents, cells).count()
    name, plan = read[0]
    assert name == "near-agents" and "REPARTITION_BY_COL" in plan
