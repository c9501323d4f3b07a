"""Participants: interview transcripts with their metadata, and survey answers turned into agents with a place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.surveys import place_agents
from .graphs import read_texts
from .records import read_survey

# Transcripts

#: A record of a CSV text: runs without quotes or line ends, and quoted runs, which may hold both.
RECORD = r'(?:[^"\r\n]++|"[^"]*+")++'
#: A cell of a record with the comma behind it.
CELL = r'((?:[^",]++|"[^"]*+")*+)(?:,|$)'
HEADER_MARK = "Question Number"
METADATA_LINES = 8


def csv_records(text: Column) -> Column:
    """The records of a CSV text that are not blank, whole where a quoted cell goes over several lines."""
    return F.filter(F.regexp_extract_all(text, F.lit(RECORD), F.lit(0)), lambda r: F.trim(r) != "")


def csv_cells(record: Column) -> Column:
    """The cells of a record, without their quotes; doubled quotes within are one."""
    found = F.regexp_extract_all(record, F.lit(CELL), F.lit(1))
    # at the record's end the pattern matches nothing once more, unless a comma stands there
    found = F.when(F.endswith(record, F.lit(",")), found).otherwise(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(1))))
    bare = lambda c: F.replace(F.regexp_replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), '""', "\x00"), F.lit("\x00"), F.lit('"'))
    return F.transform(found, lambda c: F.when(F.trim(c).rlike(r'(?s)^".*"$'), bare(c)).otherwise(c))


def parse_transcripts(docs: DataFrame, id_field: str = "Prolific ID", question: str = "Question", answer: str = "Answer", least: int = 2, metadata_lines: int = METADATA_LINES, header_mark: str = HEADER_MARK) -> dict[str, DataFrame]:
    """(g, text) of CSV transcripts -> transcripts (g, participant, metadata), answers (g, participant, n, question, answer) and failed (g, fault).

    A transcript has lines ``key,value`` of metadata first, then a header that names the mark, the question and the answer column,
    wherever they stand in it, then a record for each question. Quoted cells may hold commas, line ends and doubled quotes. Kept
    are records with a question and an answer of ``least`` characters or more, numbered by their places. A text without the
    participant's id or without a header fails, as does one whose quotes don't close behind the header; it gives no answers. An
    empty file has no row when Spark reads it.
    """
    lines = F.slice(F.split("text", r"\r?\n"), 1, metadata_lines)
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(","))), lambda x: F.struct(F.trim(F.substring_index(x, ",", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, "(?s)^[^,]*,(.*)$", 1)), '^"+|"+$', "").alias("v")))
    sound = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    keys = F.array_distinct(F.transform(sound, lambda p: p["k"]))
    # of repeated keys the last counts
    metadata = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(sound, lambda p: p["k"] == k), -1)["v"]))
    is_header = lambda x: F.contains(x, F.lit(header_mark)) & F.contains(x, F.lit(question)) & F.contains(x, F.lit(answer))
    held = docs.select("g", F.coalesce("text", F.lit("")).alias("text")).withColumns({"metadata": metadata, "header": F.get(F.filter(F.split("text", r"\r?\n"), is_header), 0)})
    body = F.substr("text", F.instr("text", F.col("header")))
    held = held.withColumns({"participant": F.col("metadata")[id_field], "body": F.when(F.col("header").isNotNull(), body)})
    open_quote = F.length(F.regexp_replace("body", '[^"]', "")) % 2 == 1
    columns = F.transform(csv_cells(F.col("header")), lambda c: F.trim(c))
    q, a = (F.array_position(columns, F.lit(c)).cast("int") for c in (question, answer))
    held = held.withColumns({"q": q, "a": a})
    fault = F.when(F.col("participant").isNull(), F.lit(f"no {id_field}")).when(F.col("header").isNull() | (F.col("q") == 0) | (F.col("a") == 0), "no header").when(open_quote, "open quote")
    held = held.withColumn("fault", fault)
    whole = held.where("fault IS NULL")
    records = whole.select("g", "participant", "q", "a", F.posexplode(csv_records(F.col("body"))).alias("n", "record")).where("n > 0").withColumn("cells", csv_cells(F.col("record")))
    cell = lambda at: F.regexp_replace(F.coalesce(F.get("cells", F.col(at) - 1), F.lit("")), r"^\s+|\s+$", "")
    answers = records.select("g", "participant", "n", cell("q").alias("question"), cell("a").alias("answer"))
    kept = answers.where((F.col("question") != "") & (F.length("answer") >= least) & ~F.startswith(F.lower("question"), F.lit(header_mark.lower())))
    return {"transcripts": whole.select("g", "participant", "metadata"), "answers": kept, "failed": held.where("fault IS NOT NULL").select("g", "fault")}


def read_transcripts(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """``parse_transcripts`` of every CSV file below path."""
    return parse_transcripts(read_texts(spark, path, "*.csv"), **options)


def transcript_json(parsed: dict[str, DataFrame]) -> DataFrame:
    """(participant, json) of parsed transcripts: prolific_id, metadata and the questions with their answers in order."""
    listed = parsed["answers"].groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "question", "answer"))), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"))).alias("transcript"))
    both = parsed["transcripts"].join(listed, "g", "left")
    none = F.array().cast("array<struct<question:string,answer:string>>")
    return both.select("participant", F.to_json(F.struct(F.col("participant").alias("prolific_id"), "metadata", F.coalesce("transcript", none).alias("transcript"))).alias("json"))


# Surveys to agents

#: The survey's questions by the agents' attributes. A header's line breaks count as blanks.
QUESTIONS = {
    "age": "What is your age?",
    "Geo Mobility": "Have you moved in the past year?",
    "householder type": "What best describes your housing status?",
    "Gross rent": "If you rent, what is your approximate monthly rent as a percentage of your income?",
    "means of transportation": "What is your primary mode of transportation? (Please select all that apply)",
    "income": "What is your annual household income?",
    "occupation": "Which of the following best describes your occupation?",
    "marital status": "What's your marital status?",
    "has children under 18": "Do you have any children under the age of 18 living with you?",
    "children age range": "What is the age range of your children under 18 years old? (You may select more than one option.)",
    "family type": "Which of the following best describes your household and family situation?",
}
ZIP_QUESTION, ADDRESS_QUESTION = "What is your ZIP code?", "What's your home address?"
#: What a row of a CSV and an entry of a JSON survey give.
CSV_FIELDS = ("age", "Geo Mobility", "householder type", "Gross rent", "means of transportation", "income", "occupation", "marital status", "has children under 18", "children age range")
JSON_FIELDS = ("age", "Geo Mobility", "householder type", "Gross rent", "means of transportation", "income", "occupation", "family type")
#: Centres of San Francisco's ZIP codes, and the place of all others.
ZIP_CENTRES = (
    ("94102", 37.7786, -122.4156),
    ("94103", 37.7752, -122.4144),
    ("94104", 37.7915, -122.4022),
    ("94105", 37.7866, -122.3890),
    ("94107", 37.7621, -122.3971),
    ("94108", 37.7929, -122.4079),
    ("94109", 37.7916, -122.4223),
    ("94110", 37.7485, -122.4158),
    ("94111", 37.7976, -122.4004),
    ("94112", 37.7200, -122.4369),
    ("94114", 37.7599, -122.4346),
    ("94115", 37.7857, -122.4358),
    ("94116", 37.7435, -122.4892),
    ("94117", 37.7692, -122.4449),
    ("94118", 37.7811, -122.4617),
    ("94121", 37.7786, -122.4892),
    ("94122", 37.7599, -122.4828),
    ("94123", 37.7991, -122.4340),
    ("94124", 37.7299, -122.3854),
    ("94127", 37.7362, -122.4577),
    ("94129", 37.7983, -122.4701),
    ("94130", 37.8232, -122.3693),
    ("94131", 37.7436, -122.4375),
    ("94132", 37.7219, -122.4783),
    ("94133", 37.8002, -122.4091),
    ("94134", 37.7149, -122.4130),
    ("94158", 37.7704, -122.3880),
)
DEFAULT_PLACE = (37.778250, -122.419944)


def _placed(rows: DataFrame, centres, default) -> DataFrame:
    spark = rows.sparkSession
    zips = centres if isinstance(centres, DataFrame) else spark.createDataFrame(list(centres), "zip string, lat double, lng double")
    return place_agents(rows, zips, default)


def agents_from_answers(answers: DataFrame, id_column: str = "Prolific ID", centres=ZIP_CENTRES, default: tuple[float, float] = DEFAULT_PLACE) -> dict[str, DataFrame]:
    """A survey's rows, as ``read_survey`` gives them -> agents (agent_id, zip, lat, lng, agent) and bad (agent_id, fault).

    agent is a map of the attributes' texts. A row whose age or ZIP code is no whole number is bad and gives no agent; a ZIP code
    without a centre is placed at the default. A survey that lacks a question raises.
    """
    plain = lambda q: " ".join(q.replace("’", "'").split())
    by_question = {plain(c): c for c in answers.columns}
    if missing := [q for q in (id_column, ZIP_QUESTION, *(QUESTIONS[f] for f in CSV_FIELDS)) if plain(q) not in by_question]:
        raise ValueError(f"the survey has no {'; '.join(missing)}")
    column = lambda q: F.col("`" + by_question[plain(q)].replace("`", "``") + "`")
    whole = lambda q: F.trim(column(q)).try_cast("bigint")
    values = {f: column(QUESTIONS[f]) for f in CSV_FIELDS} | {"age": whole(QUESTIONS["age"]).cast("string"), "ZIP code": whole(ZIP_QUESTION).cast("string")}
    values["has children under 18"] = F.contains(column(QUESTIONS["has children under 18"]), F.lit("Yes")).cast("string")
    if address := next((c for q, c in by_question.items() if q.startswith(ADDRESS_QUESTION)), None):
        values["approximate address"] = F.col("`" + address.replace("`", "``") + "`")
    fault = F.when(values["ZIP code"].isNull(), "ZIP code").when(values["age"].isNull(), "age")
    agent = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))))
    rows = answers.select(column(id_column).alias("agent_id"), values["ZIP code"].alias("zip"), agent.alias("agent"), fault.alias("fault"))
    return {"agents": _placed(rows.where("fault IS NULL").drop("fault"), centres, default), "bad": rows.where("fault IS NOT NULL").select("agent_id", "fault")}


def agents_from_csv(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    return agents_from_answers(read_survey(spark, path), **options)


def agents_from_json(docs: DataFrame, centres=ZIP_CENTRES, default: tuple[float, float] = DEFAULT_PLACE) -> DataFrame:
    """(g, text) of JSON objects {participant: {question: answer}} -> (agent_id, zip, lat, lng, agent).

    No row is bad here: ages stay texts, absent answers are empty, and what stands behind a colon in a ZIP code goes.
    """
    people = docs.select(F.explode(F.from_json("text", "map<string,map<string,string>>")).alias("agent_id", "answers"))
    answer = lambda q: F.coalesce(F.col("answers")[q], F.lit(""))
    agent = F.create_map(*(x for f in JSON_FIELDS for x in (F.lit(f), answer(QUESTIONS[f]))))
    return _placed(people.select("agent_id", F.substring_index(answer(ZIP_QUESTION), ":", 1).alias("zip"), agent.alias("agent")), centres, default)


def agent_json(agents: DataFrame) -> DataFrame:
    """(agent_id, json): id, coordinates and the agent's attributes; age, ZIP code and children as number and boolean where they are."""
    texts = F.to_json(F.map_filter("agent", lambda k, v: ~k.isin("age", "ZIP code", "has children under 18")))
    number = lambda k: F.when(F.col("agent")[k].rlike(r"^\d+$"), F.concat(F.lit(f',"{k}":'), F.col("agent")[k]))
    kids = F.when(F.col("agent")["has children under 18"].isin("true", "false"), F.concat(F.lit(',"has children under 18":'), F.col("agent")["has children under 18"]))
    as_text = F.when(~F.col("agent")["age"].rlike(r"^\d+$"), F.concat(F.lit(","), F.regexp_extract(F.to_json(F.struct(F.col("agent")["age"].alias("age"))), r"(?s)^\{(.*)\}$", 1)))
    inner = F.concat(F.regexp_replace(texts, r"\}$", ""), F.coalesce(number("age"), as_text, F.lit("")), F.coalesce(number("ZIP code"), F.lit("")), F.coalesce(kids, F.lit("")), F.lit("}"))
    head = F.regexp_replace(F.to_json(F.struct(F.col("agent_id").alias("id"), F.struct("lat", "lng").alias("coordinates"))), r"\}$", "")
    return agents.select("agent_id", F.concat(head, F.lit(',"agent":'), inner, F.lit("}")).alias("json"))
