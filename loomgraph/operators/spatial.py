"""Nearest cells and areas of polygons, by buckets of degrees; nothing meets everything.

``nearest_cells`` first looks into the buckets around an agent. Agents that find nothing near go down a pyramid of buckets, each
level of which has sides twice as long as the one below: of the buckets that hold cells, those stay whose nearest point is no
further than the furthest corner of another one, and only the last few buckets' cells are met. However far an agent is, it sees
some buckets of each level and some cells.

``polygon_overlap`` cuts polygons along the buckets' edges first: a bucket wholly inside needs no polygon any more, and one on the
boundary gets the pieces of the rings that lie in it. Cells are cut likewise, so a cell's area in a polygon is a sum over buckets,
and a large polygon is not held against each of its cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize

STEP = 0.01
#: Tables of buckets of up to so many rows are broadcast.
FEW = 50_000
#: Cells that one row lists, of those around a bucket.
LISTED = 256
#: Levels of the pyramid after which the candidates are written.
LEVELS_HELD = 4


# Nearest cells


def _bucket(x, step):
    return F.floor(x / step).cast("bigint")


def nearest_cells(agents: DataFrame, cells: DataFrame, step: float = STEP, by: str | None = None) -> DataFrame:
    """(agent_id, cell_id, distance): the cell whose centre is nearest in degrees, the first of equals; with ``by``, of each value of it.

    Agents and cells without coordinates are left out, and so are all agents where there are no cells.
    """
    group = [by] if by else []
    centres = cells.select(*group, "cell_id", ((F.col("north") + F.col("south")) / 2).alias("cy"), ((F.col("east") + F.col("west")) / 2).alias("cx")).where("cy IS NOT NULL AND cx IS NOT NULL")
    centres = centres.withColumns({"__by": _bucket(F.col("cy"), step), "__bx": _bucket(F.col("cx"), step)})
    # agents are dealt by id first, as a table of them may be one part of one file, and keep that place until each has its best
    asked = agents.select("agent_id", "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL").repartition("agent_id")
    # an agent is asked to have a cell of each group, so these rows are as many as the result's
    every = asked.crossJoin(F.broadcast(centres.select(by).distinct())) if by else asked
    here = every.withColumns({"__by": _bucket(F.col("lat"), step), "__bx": _bucket(F.col("lng"), step)})
    lists = _around(centres, group).withColumnsRenamed({c: f"__of{c}" for c in [*group, "__by", "__bx"]})
    same = [F.col("__by") == F.col("__of__by"), F.col("__bx") == F.col("__of__bx"), *(F.col(c).eqNullSafe(F.col(f"__of{c}")) for c in group)]
    met = here.join(lists, same, "left")
    distance = lambda c: F.sqrt((F.col("lat") - c["cy"]) ** 2 + (F.col("lng") - c["cx"]) ** 2)
    nearest = F.array_min(F.transform("__cells", lambda c: F.struct(distance(c).alias("distance"), c["cell_id"].alias("cell_id"))))
    best = met.select("agent_id", "lat", "lng", *group, nearest.alias("x")).groupBy("agent_id", *group).agg(F.min("x").alias("x"), F.collect_set(F.struct("lat", "lng")).alias("__at"))
    held = materialize(best, "near-agents")
    near = held.where(F.col("x.distance") <= step).select("agent_id", *group, "x")
    rest = held.where(F.col("x").isNull() | (F.col("x.distance") > step)).select("agent_id", *group, F.inline("__at"))
    found = near if rest.isEmpty() else near.union(_from_afar(rest.select("agent_id", "lat", "lng", *group), centres, step, group))
    return found.select("agent_id", *group, "x.cell_id", "x.distance")


def _around(centres: DataFrame, group: list[str]) -> DataFrame:
    """(*group, __by, __bx, __cells): the cells in and around a bucket, in lists of at most LISTED."""
    shifts = F.array(*(F.struct(F.lit(i).alias("__i"), F.lit(j).alias("__j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = centres.select("*", F.inline(shifts)).withColumns({"__by": F.col("__by") + F.col("__i"), "__bx": F.col("__bx") + F.col("__j")})
    key = [*group, "__by", "__bx"]
    part = F.floor((F.row_number().over(W.partitionBy(*key).orderBy("cell_id")) - 1) / LISTED)
    return spread.withColumn("__part", part).groupBy(*key, "__part").agg(F.collect_list(F.struct("cy", "cx", "cell_id")).alias("__cells")).drop("__part")


def _best(met: DataFrame, group: list[str]) -> DataFrame:
    distance = F.sqrt((F.col("lat") - F.col("cy")) ** 2 + (F.col("lng") - F.col("cx")) ** 2)
    return met.groupBy("agent_id", *group).agg(F.min(F.struct(distance.alias("distance"), "cell_id")).alias("x"))


def _from_afar(rest: DataFrame, centres: DataFrame, step: float, group: list[str]) -> DataFrame:
    """The best cell of each agent by descent through the levels of buckets that hold cells."""
    held = materialize(centres.select(*group, "__by", "__bx").distinct(), "buckets")
    extent = held.agg(F.min("__by"), F.max("__by"), F.min("__bx"), F.max("__bx"), F.count("*")).first()
    y0, y1, x0, x1, buckets = extent
    if not buckets:
        return _best(rest.join(centres, group) if group else rest.limit(0).crossJoin(centres.limit(0)), group)
    top = max(y1 - y0, x1 - x0).bit_length()
    roots = [(y, x) for y in range(y0 >> top, (y1 >> top) + 1) for x in range(x0 >> top, (x1 >> top) + 1)]  # four at most
    kept = rest.select("agent_id", "lat", "lng", *group, F.inline(F.array(*(F.struct(F.lit(y).alias("__py"), F.lit(x).alias("__px")) for y, x in roots))))
    for level in range(top, -1, -1):
        at = lambda c, n=level: F.shiftright(c, n)
        parent = (lambda c, n=level: F.shiftright(c, n + 1)) if level < top else at
        below = held.select(*group, parent("__by").alias("__py"), parent("__bx").alias("__px"), at("__by").alias("__by"), at("__bx").alias("__bx")).distinct()
        below = F.broadcast(below) if buckets <= FEW or not group and 4 ** (top - level + 1) <= FEW else below
        size = step * 2**level
        near = lambda v, b: F.greatest(F.lit(0.0), b * size - v, v - (b + 1) * size)  # noqa: E731, B023
        far = lambda v, b: F.greatest(F.abs(b * size - v), F.abs(v - (b + 1) * size))  # noqa: E731, B023
        span = lambda f: F.sqrt(f(F.col("lat"), F.col("__by")) ** 2 + f(F.col("lng"), F.col("__bx")) ** 2)
        met = kept.join(below, [*group, "__py", "__px"]).withColumn("__far", F.min(span(far)).over(W.partitionBy("agent_id", *group)))
        # a little more than the bound, as points at a bucket's edge are rounded
        kept = met.where(span(near) <= F.col("__far") * (1 + 1e-9) + 1e-12).select("agent_id", "lat", "lng", *group, F.col("__by").alias("__py"), F.col("__bx").alias("__px"))
        if level and (top - level) % LEVELS_HELD == LEVELS_HELD - 1:
            kept = materialize(kept, "nearer")
    return _best(kept.withColumnsRenamed({"__py": "__by", "__px": "__bx"}).join(centres, [*group, "__by", "__bx"]), group)


# Polygons


def clip(ring: list, west: float, south: float, east: float, north: float) -> list:
    """The ring cut at a rectangle's four sides; where it is cut in pieces they hang together along the sides."""
    for axis, limit, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            break
    return ring


def ring_area(ring: list) -> float:
    """By products of distances from the ring's first point: those of whole degrees are some thousands, and a cell's area would drown in their rounding."""
    if not ring:
        return 0.0
    x, y = ring[0]
    seen = [(a - x, b - y) for a, b in ring]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(seen, seen[1:] + seen[:1], strict=True))) / 2


def clipped_area(ring: list, west: float, south: float, east: float, north: float) -> float:
    """Area of the part of a ring inside a rectangle."""
    return ring_area(clip(ring, west, south, east, north))


def cover(rings: list, step: float):
    """(by, bx, pieces) of the buckets that a polygon touches: the rings' pieces on the boundary, None for a bucket wholly inside."""
    edge: set = set()
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            for row in range(math.floor(min(ay, by) / step), math.floor(max(ay, by) / step) + 1):
                cut = [y for y in (max(min(ay, by), row * step), min(max(ay, by), (row + 1) * step))]
                xs = [ax, bx] if ay == by else [ax + (y - ay) / (by - ay) * (bx - ax) for y in cut]
                # a hair to both sides, as crossings are rounded; a bucket too many does no harm
                edge.update((row, x) for x in range(math.floor(min(xs) / step - 1e-9), math.floor(max(xs) / step + 1e-9) + 1))
    for row, x in sorted(edge):
        pieces = [clip(ring, x * step, row * step, (x + 1) * step, (row + 1) * step) for ring in rings]
        if any(pieces):
            yield row, x, pieces
    for row in range(min(r for r, _ in edge), max(r for r, _ in edge) + 1):
        y = (row + 0.5) * step
        crossings = sorted(ax + (y - ay) / (by - ay) * (bx - ax) for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True) if (ay > y) != (by > y))
        for left, right in zip(crossings[::2], crossings[1::2], strict=True):
            for x in range(math.ceil(left / step - 0.5), math.floor(right / step - 0.5) + 1):
                if (row, x) not in edge:
                    yield row, x, None


def polygon_index(polygons: DataFrame, step: float = STEP) -> DataFrame:
    """(zone_id, __by, __bx, pieces) of polygons(zone_id, rings): the outer ring first, then its holes; pieces is null inside."""
    kind = dict(polygons.dtypes)["zone_id"]
    point = "struct<x:double,y:double>"

    def run(batches):
        import pyarrow as pa

        schema = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                rings = [[(p["x"], p["y"]) for p in ring or []] for ring in one.column("rings").to_pylist()[0] or []]
                rings = [r for r in rings if len(r) > 2]
                made = list(cover(rings, step)) if rings else []
                zone = pa.array(one.column("zone_id").to_pylist() * len(made), one.schema.field("zone_id").type)
                pieces = [None if p is None else [[{"x": x, "y": y} for x, y in ring] for ring in p] for *_, p in made]
                yield pa.RecordBatch.from_arrays([zone, pa.array([r for r, *_ in made], pa.int64()), pa.array([x for _, x, _ in made], pa.int64()), pa.array(pieces, schema)], names=["zone_id", "__by", "__bx", "pieces"])

    return polygons.select("zone_id", "rings").mapInArrow(run, f"zone_id {kind}, __by bigint, __bx bigint, pieces array<array<{point}>>")


def overlap_areas(cells: DataFrame, polygons: DataFrame, step: float = STEP) -> DataFrame:
    """(cell_id, zone_id, area) of all cells and polygons(zone_id, rings) that share an area; rows of one zone are its parts.

    Rings are as GeoJSON has them: the outer one first, then holes that lie in it and apart. A cell without one of its bounds, or
    a polygon without a ring of three points, shares nothing.
    """
    span = lambda lo, hi: F.sequence(_bucket(F.col(lo), step), _bucket(F.col(hi), step))
    whole = cells.select("cell_id", "north", "south", "east", "west").where("north > south AND east > west")
    dealt = whole.withColumn("__by", F.explode(span("south", "north"))).withColumn("__bx", F.explode(span("west", "east")))
    low = lambda c, b: F.greatest(F.col(c), F.col(b) * step)
    high = lambda c, b: F.least(F.col(c), (F.col(b) + 1) * step)
    dealt = dealt.select("cell_id", "__by", "__bx", low("south", "__by").alias("south"), high("north", "__by").alias("north"), low("west", "__bx").alias("west"), high("east", "__bx").alias("east")).where("north > south AND east > west")
    met = dealt.join(polygon_index(polygons, step), ["__by", "__bx"]).drop("__by", "__bx")
    types = dict(met.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            box = zip(*(batch.column(c).to_pylist() for c in ("west", "south", "east", "north")), strict=True)
            areas = []
            for pieces, sides in zip(batch.column("pieces").to_pylist(), box, strict=True):
                parts = [clipped_area([(p["x"], p["y"]) for p in ring], *sides) if ring else 0.0 for ring in pieces]
                areas.append(parts[0] - sum(parts[1:]))
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), batch.column("zone_id"), pa.array(areas, pa.float64())], names=["cell_id", "zone_id", "area"])

    inside = met.where("pieces IS NULL").select("cell_id", "zone_id", ((F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))).alias("area"))
    edge = met.where("pieces IS NOT NULL").mapInArrow(run, f"cell_id {types['cell_id']}, zone_id {types['zone_id']}, area double")
    return inside.union(edge).groupBy("cell_id", "zone_id").agg(F.sum("area").alias("area")).where(F.col("area") > 1e-15)


def polygon_overlap(cells: DataFrame, polygons: DataFrame, step: float = STEP) -> DataFrame:
    """(cell_id, zone_id, area): the zone that covers most of each cell, the first of equals; cells without any are left out.

    polygons(zone_id, rings), or (zone_id, ring) where no polygon has holes.
    """
    rings = polygons if "rings" in polygons.columns else polygons.withColumn("rings", F.array("ring"))
    areas = overlap_areas(cells, rings, step)
    best = areas.groupBy("cell_id").agg(F.min_by(F.struct("zone_id", "area"), F.struct(-F.round("area", 12), "zone_id")).alias("x"))
    return best.select("cell_id", "x.zone_id", "x.area")
