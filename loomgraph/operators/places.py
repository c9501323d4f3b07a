"""Grids, cells, zones, proposals and census tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
ACRES_PER_SQUARE_METRE = 0.000247105
#: Bounds of a grid when a proposal gives none.
DEFAULT_BOUNDS = {"north": 37.8120, "south": 37.7080, "east": -122.3549, "west": -122.5157}
#: Patterns of heights that mock proposals change, and the heights they change them to.
PATTERNS = ((1, 65, 300), (2, 85, 300), (3, 240, 300))
VARIANTS = ((1, 80), (2, 140), (3, 300))
#: Scenarios of proposals, and the one of any other.
SCENARIOS = {
    "proposal_000": "1.1",
    "proposal_001": "1.2",
    "proposal_002": "1.3",
    "proposal_003": "2.1",
    "proposal_004": "2.2",
    "proposal_005": "2.3",
    "proposal_006": "3.1",
    "proposal_007": "3.2",
    "proposal_008": "3.3",
}
SCENARIO_DEFAULT = "1.1"


def grid(spark: SparkSession, bounds: dict, cell_metres: float) -> DataFrame:
    """(row, col, cell_id, north, south, east, west): whole cells from the south-west corner."""
    height = (bounds["north"] - bounds["south"]) * METRES_PER_DEGREE
    per_degree = METRES_PER_DEGREE * math.cos(math.radians((bounds["north"] + bounds["south"]) / 2))
    width = (bounds["east"] - bounds["west"]) * per_degree
    rows, cols = int(height // cell_metres), int(width // cell_metres)
    d_lat, d_lng = cell_metres / METRES_PER_DEGREE, cell_metres / per_degree
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return cells.select(
        "row",
        "col",
        F.concat_ws("_", F.col("row").cast("string"), F.col("col").cast("string")).alias("cell_id"),
        (bounds["south"] + (F.col("row") + 1) * d_lat).alias("north"),
        (bounds["south"] + F.col("row") * d_lat).alias("south"),
        (bounds["west"] + (F.col("col") + 1) * d_lng).alias("east"),
        (bounds["west"] + F.col("col") * d_lng).alias("west"),
    )


def overlap_cells(cells: DataFrame, zones: DataFrame, step: float = 0.01) -> DataFrame:
    """(cell_id, zone_id, area): the zone (a rectangle) that covers most of each cell, the first of equals; cells without any are left out.

    Both sides are dealt into buckets of ``step`` degrees that they touch, so only neighbours meet.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    dealt = lambda df: df.withColumn("by", F.explode(span("south", "north"))).withColumn("bx", F.explode(span("west", "east")))
    c, z = dealt(cells).alias("c"), dealt(zones).alias("z")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"c.{hi}"), F.col(f"z.{hi}")) - F.greatest(F.col(f"c.{lo}"), F.col(f"z.{lo}")))
    met = c.join(z, ["by", "bx"]).select("cell_id", "zone_id", (side("south", "north") * side("west", "east")).alias("area")).where("area > 0").distinct()
    best = met.groupBy("cell_id").agg(F.max(F.struct("area", (-F.col("zone_id")).alias("z"))).alias("x"))
    return best.select("cell_id", (-F.col("x.z")).alias("zone_id"), "x.area")


def zone_summary(cells: DataFrame, cell_size: float) -> DataFrame:
    """(proposal_id, category, height_limit, n, lat, lng, acres, rank): zones in the order in which they first stand."""
    z = cells.groupBy("proposal_id", "category", "height_limit").agg(
        F.count("*").alias("n"), F.avg((F.col("north") + F.col("south")) / 2).alias("lat"), F.avg((F.col("east") + F.col("west")) / 2).alias("lng"), F.min(F.struct("row", "col")).alias("__first")
    )
    rank = F.row_number().over(W.partitionBy("proposal_id").orderBy("__first", "category", "height_limit"))
    return z.withColumns({"acres": F.col("n") * cell_size * cell_size * ACRES_PER_SQUARE_METRE, "rank": rank}).drop("__first")


def proposal_text(zones: DataFrame, shown: int = 3) -> DataFrame:
    """(proposal_id, text): the first three zones in words, and how many there are besides."""
    line = F.concat(F.col("n").cast("string"), F.lit(" blocks of "), F.replace("category", F.lit("_"), F.lit(" ")), F.lit(" up to "), F.col("height_limit").cast("string"), F.lit(" feet"))
    listed = zones.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", line.alias("l"))))).alias("ls"), F.count("*").alias("zones"), F.sum("n").alias("blocks"))
    more = F.when(F.col("zones") > shown, F.concat(F.lit("; and "), (F.col("zones") - shown).cast("string"), F.lit(" more zones"))).otherwise("")
    return listed.select("proposal_id", F.concat(F.col("blocks").cast("string"), F.lit(" blocks: "), F.array_join(F.transform("ls", lambda x: x["l"]), "; "), more).alias("text"))


def height_patterns(cells: DataFrame) -> DataFrame:
    """Cells with each pattern whose range holds their height; the ranges overlap, so a cell can stand in several."""
    rows = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for p, lo, hi in PATTERNS))
    fits = F.filter(rows, lambda r: (F.col("height_limit") >= r["lo"]) & (F.col("height_limit") <= r["hi"]))
    return cells.withColumn("pattern", F.explode(F.transform(fits, lambda r: r["pattern"])))


def mock_proposals(cells: DataFrame) -> DataFrame:
    """Nine proposals: each pattern's cells with each variant's height."""
    variants = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(h).alias("height")) for v, h in VARIANTS)))
    made = height_patterns(cells).withColumn("__v", variants)
    return made.withColumns({"height_limit": F.col("__v.height"), "scenario": F.concat_ws(".", F.col("pattern").cast("string"), F.col("__v.variant").cast("string"))}).drop("__v", "pattern")


def scenario_of(proposal: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SCENARIOS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, proposal), F.lit(SCENARIO_DEFAULT))


def first_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def census_long(rows: DataFrame) -> DataFrame:
    """(zipcode, codes map) -> (zipcode, table_code, sub_code, value); values that are no integers count as 0."""
    entries = rows.select("zipcode", F.explode("codes").alias("code", "raw"))
    return entries.select("zipcode", F.split_part("code", F.lit("_"), F.lit(1)).alias("table_code"), F.split_part("code", F.lit("_"), F.lit(2)).alias("sub_code"), F.coalesce(F.col("raw").try_cast("bigint"), F.lit(0)).alias("value"))


def census_ratios(census: DataFrame, total: str = "001E") -> DataFrame:
    """census(zipcode, table_code, sub_code, value) with ratio = value by the table's total; null where that is missing or 0."""
    w = W.partitionBy("zipcode", "table_code")
    whole = F.max(F.when(F.col("sub_code") == total, F.col("value"))).over(w)
    return census.withColumn("ratio", F.try_divide(F.col("value"), F.nullif(whole, F.lit(0))))


def census_ratio_map(ratios: DataFrame, total: str = "001E") -> DataFrame:
    """(zipcode, ratios map of table_sub_ratio), without totals and nulls; a zipcode has a bounded number of codes."""
    kept = ratios.where((F.col("sub_code") != total) & F.col("ratio").isNotNull())
    entry = F.struct(F.concat_ws("_", "table_code", "sub_code", F.lit("ratio")).alias("k"), F.col("ratio").alias("v"))
    return kept.groupBy("zipcode").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ratios"))
