"""Surveys, transcripts, forum files, census and zoning records, proposals, protocols, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_transcript, slug
from .graphs import read_texts


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """A survey's CSV; line breaks in the header become blanks."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(" ".join(c.split()) for c in df.columns))


def read_interviews(spark: SparkSession, path: str) -> DataFrame:
    """(g, text) of subtitles files, without time stamps."""
    return read_texts(spark, path, "*_en_subs.txt").withColumn("text", clean_transcript(F.col("text")))


_MCQ = "array<struct<question_id:string,question:string,tag:string,options:map<string,string>,ground_truth:string,explanation:string,source:string,question_type:string>>"


def read_forum(spark: SparkSession, path: str) -> DataFrame:
    """(username, split, topics) of participants' JSON files, <participant>-train.json and -test.json; split_log.json is none of them."""
    docs = read_texts(spark, path).where("g <> 'split_log'")
    topics = F.from_json(F.get_json_object("text", "$.topics"), f"array<struct<post_id:string,title:string,body:string,stance:string,subreddit:string,mcqs:{_MCQ}>>")
    return docs.select(F.coalesce(F.get_json_object("text", "$.username"), F.regexp_replace("g", "[-_](train|test)$", "")).alias("username"), F.nullif(F.regexp_extract("g", "[-_](train|test)$", 1), F.lit("")).alias("split"), topics.alias("topics"))


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """(zipcode, codes) of a JSON object by zipcode."""
    docs = read_texts(spark, path)
    return docs.select(F.explode(F.from_json("text", "map<string,map<string,string>>")).alias("zipcode", "codes"))


def census_requests(zips: DataFrame, base: str, variables: list[str], size: int = 100) -> DataFrame:
    """(batch, url) of at most ``size`` zipcodes each; the caller fetches them."""
    from ..operators.surveys import batches

    grouped = batches(zips.select("zipcode").distinct(), "zipcode", size).groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("zipcode")), ",").alias("zs"))
    return grouped.select("batch", F.concat(F.lit(f"{base}?get={','.join(variables)}&for=zip%20code%20tabulation%20area:"), "zs").alias("url"))


def parse_census_response(rows: DataFrame) -> DataFrame:
    """rows(body), arrays whose first row is the header with the zipcode last -> (zipcode, codes)."""
    table = F.from_json("body", "array<array<string>>")
    r = rows.select(table.alias("t")).select(F.get("t", 0).alias("h"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("r"))
    entries = F.filter(F.map_entries(F.map_from_arrays("h", "r")), lambda e: e["key"] != "zip code tabulation area")
    return r.select(F.element_at("r", -1).alias("zipcode"), F.map_from_entries(entries).alias("codes"))


def parse_geojson(docs: DataFrame) -> DataFrame:
    """(g, text) -> (g, zone_id, properties, rings of struct(x, y), ring): a row of every polygon, its outer ring first, then its holes."""
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    f = docs.select("g", F.posexplode(F.from_json(F.get_json_object("text", "$.features"), f"array<{feature}>")).alias("zone_id", "f"))
    coordinates = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")))
    rings = f.select("g", "zone_id", F.col("f.properties").alias("properties"), F.explode(coordinates).alias("p"))
    made = F.transform("p", lambda ring: F.transform(ring, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    return rings.select("g", "zone_id", "properties", made.alias("rings"), F.get(made, 0).alias("ring"))


def zoning_heights(features: DataFrame, fields: tuple[str, str]) -> DataFrame:
    """Features with a value in either field, and the first integer of it above 0 as height."""
    raw = F.coalesce(F.try_element_at("properties", F.lit(fields[0])), F.try_element_at("properties", F.lit(fields[1])))
    height = F.regexp_extract(raw, r"(\d+)", 1).try_cast("int")
    return features.where(raw.isNotNull()).withColumn("height", height).where("height > 0")


def parse_proposals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, text) -> proposals (proposal_id, cell_size, default_height) and cells; keys in camel or snake case."""
    either = lambda *paths: F.coalesce(*(F.get_json_object("text", p) for p in paths))
    heads = docs.select(F.col("g").alias("proposal_id"), either("$.gridConfig.cellSize", "$.grid_config.cell_size").cast("double").alias("cell_size"), either("$.heightLimits.default", "$.height_limits.default").cast("int").alias("default_height"))
    bbox = "struct<north:double,south:double,east:double,west:double>"
    cell = f"struct<heightLimit:int,height_limit:int,category:string,bbox:{bbox}>"
    c = docs.select(F.col("g").alias("proposal_id"), F.explode(F.from_json(F.get_json_object("text", "$.cells"), f"map<string,{cell}>")).alias("cell_id", "c"))
    at = F.split("cell_id", "_")
    cells = c.select("proposal_id", "cell_id", F.get(at, 0).try_cast("int").alias("row"), F.get(at, 1).try_cast("int").alias("col"), F.coalesce("c.heightLimit", "c.height_limit").alias("height_limit"), F.coalesce("c.category", F.lit("unknown")).alias("category"), "c.bbox.*")
    return heads, cells.join(heads.select("proposal_id", "default_height"), "proposal_id").withColumn("height_limit", F.coalesce("height_limit", "default_height")).drop("default_height")


def read_protocol(spark: SparkSession, path: str) -> dict:
    """A run's YAML, by Spark's own file access."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"])


def write_by_category(rows: DataFrame, category: str, path: str) -> None:
    """JSON files in a folder for each category's slug."""
    rows.withColumn("category_slug", slug(F.col(category))).write.partitionBy("category_slug").json(path)


def write_run(path: str, model: str, opinions: DataFrame, truth: DataFrame | None = None, metadata: dict | None = None) -> str:
    """opinions(agent_id, proposal_id, code, score) by proposal, the truth, and one row of metadata with the duration in seconds."""
    import time

    spark, began = opinions.sparkSession, time.time()
    home = f"{path.rstrip('/')}/{model}_{time.strftime('%Y%m%d_%H%M%S')}_{int(began * 1000) % 1000:03d}"
    opinions.write.partitionBy("proposal_id").parquet(f"{home}/output")
    if truth is not None:
        truth.write.parquet(f"{home}/ground_truth")
    row = {"model": model, "started": began, "seconds": time.time() - began} | (metadata or {})
    spark.createDataFrame([(k, str(v)) for k, v in row.items()], "key string, value string").coalesce(1).write.json(f"{home}/metadata")
    return home


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, agent_id, code, score, proposal_id) of all runs below path."""
    # runs are no partitions of one table, so what their folders are called is read from the files' paths
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/*/output")
    at = lambda pattern: F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    # a folder's name is escaped when it is written, and again in a path
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return df.select(plain(at(r"/([^/]+)/output/")).alias("run"), "*", plain(plain(at(r"/output/proposal_id=([^/]+)/"))).alias("proposal_id"))


def pair_outputs(outputs: DataFrame, truths: DataFrame) -> DataFrame:
    """outputs(name) with the smallest truth name that each name begins with."""
    met = outputs.join(F.broadcast(truths.withColumnRenamed("name", "truth")) if truths.limit(10_001).count() <= 10_000 else truths.withColumnRenamed("name", "truth"), F.col("name").startswith(F.col("truth")))
    return met.groupBy("name").agg(F.min("truth").alias("truth"))
