"""Transcripts whose cells go over lines, in any column order, with failures; surveys of either layout to agents."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.surveys import JITTER
from loomgraph.sources import participants as P


def frame(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "g string, text string")


def as_csv(rows, **options):
    out = io.StringIO()
    csv.writer(out, **options).writerows(rows)
    return out.getvalue()


def test_records_and_cells_equal_the_csv_module(spark):
    rnd = random.Random(1)
    cell = lambda: "".join(rnd.choices(['"', ",", "\n", "a", "é b", ""], k=rnd.randint(0, 8)))
    for end in ("\n", "\r\n"):
        tables = [[[cell() for _ in range(rnd.randint(2, 4))] + ["end"] for _ in range(rnd.randint(1, 6))] for _ in range(40)]
        docs = spark.createDataFrame([(str(i), as_csv(t, lineterminator=end, quoting=rnd.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))) for i, t in enumerate(tables)], "g string, text string")
        records = docs.select("g", F.posexplode(P.csv_records(F.col("text"))).alias("n", "r")).select("g", "n", P.csv_cells(F.col("r")).alias("cells"))
        got = {}
        for r in records.orderBy("n").collect():
            got.setdefault(r["g"], []).append(r["cells"])
        assert got == {str(i): t for i, t in enumerate(tables)}
    odd = spark.createDataFrame([("a,,b,",), (",",), ("x",), ('"",1',)], "r string").select(P.csv_cells(F.col("r"))).collect()
    assert [r[0] for r in odd] == [["a", "", "b", ""], ["", ""], ["x"], ["", "1"]]


def test_transcripts(spark, tmp_path):
    meta = 'Prolific ID,p1\nDate,"May 5, 2025"\nNote,\nDate,"May 6, 2025"\n\n'
    table = [["Question Number", "Question", "Answer"], ["1", "Why, then?", 'First line\nsecond, "quoted" line\n\nlast'], ["2", "How?", "a"], ["Question Number", "Question number 3", "yes"], ["3", "", "no question"], ["4", "Where?", "  Here \n"]]
    swapped = [["Answer", "Extra", "Question Number", "Question"], ["Because\nof it", "x", "1", "Why?"]]
    texts = {
        "one": meta + as_csv(table),
        "two": "Prolific ID,p2\n" + as_csv(swapped, lineterminator="\n", quoting=csv.QUOTE_ALL),
        "nobody": "Name,x\n" + as_csv(table),
        "headless": "Prolific ID,p4\nWhy?,Because\n",
        "open": "Prolific ID,p5\n" + as_csv(table) + '5,"Why?,no end\n',
        "empty": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    parsed = P.read_transcripts(spark, str(tmp_path))
    answers = [(r["g"], r["participant"], r["n"], r["question"], r["answer"]) for r in parsed["answers"].orderBy("g", "n").collect()]
    assert answers == [
        ("one", "p1", 1, "Why, then?", 'First line\nsecond, "quoted" line\n\nlast'),
        ("one", "p1", 5, "Where?", "Here"),
        ("two", "p2", 1, "Why?", "Because\nof it"),
    ]
    assert {r["g"]: r["fault"] for r in parsed["failed"].collect()} == {"nobody": "no Prolific ID", "headless": "no header", "open": "open quote"}
    assert {r["g"]: r["metadata"].get("Date") for r in parsed["transcripts"].collect()} == {"one": "May 6, 2025", "two": None}
    made = {r["participant"]: json.loads(r["json"]) for r in P.transcript_json(parsed).collect()}
    assert made["p1"]["metadata"]["Date"] == "May 6, 2025" and [x["question"] for x in made["p1"]["transcript"]] == ["Why, then?", "Where?"]
    assert P.parse_transcripts(frame(spark, x=None).limit(0))["answers"].count() == 0
    assert [r["fault"] for r in P.parse_transcripts(frame(spark, x=None))["failed"].collect()] == ["no Prolific ID"]


def test_long_transcripts(spark):
    table = [["Question Number", "Question", "Answer"]] + [[str(i), f"Question {i}", f'line one\nline "two" {"x" * 200}\n' * 20] for i in range(500)]
    parsed = P.parse_transcripts(frame(spark, long="Prolific ID,p\n" + as_csv(table)))
    got = parsed["answers"].orderBy("n").collect()
    assert [r["answer"] for r in got] == [r[2].strip() for r in table[1:]]


def survey(rows):
    header = ["Prolific ID", P.ZIP_QUESTION, *(P.QUESTIONS[f] for f in P.CSV_FIELDS), "What's your home address?\nIf you are not comfortable, just\nsomething nearby."]
    line = lambda pid, zipcode, age, kids: [pid, zipcode, age, "No", "Renter", "30%", "Bus", "$50,000", "Arts", "Single", kids, "0-5", "Main St,\ncorner"]
    return as_csv([header, *(line(*r) for r in rows)])


def test_agents_from_csv(spark, tmp_path):
    rows = [("a", "94102", "31", "Yes, two"), ("b", " 94999 ", "45", "No"), ("c", "94102.5", "20", "No"), ("d", "n/a", "x", "No"), ("e", "94110", "", "No"), ("f", "94110", "thirty", "Yes")]
    (tmp_path / "s.csv").write_text(survey(rows), newline="")
    found = P.agents_from_csv(spark, str(tmp_path / "s.csv"))
    agents = {r["agent_id"]: r for r in found["agents"].collect()}
    assert set(agents) == {"a", "b"}
    assert {r["agent_id"]: r["fault"] for r in found["bad"].collect()} == {"c": "ZIP code", "d": "ZIP code", "e": "age", "f": "age"}
    near = lambda r, lat, lng: abs(r["lat"] - lat) <= JITTER and abs(r["lng"] - lng) <= JITTER
    assert near(agents["a"], 37.7786, -122.4156) and near(agents["b"], *P.DEFAULT_PLACE)
    assert (agents["a"]["agent"]["has children under 18"], agents["b"]["agent"]["has children under 18"]) == ("true", "false")
    assert agents["a"]["agent"]["approximate address"] == "Main St,\ncorner" and agents["b"]["zip"] == "94999"
    made = {r["agent_id"]: json.loads(r["json"]) for r in P.agent_json(found["agents"]).collect()}
    assert made["a"]["agent"]["age"] == 31 and made["a"]["agent"]["ZIP code"] == 94102 and made["a"]["agent"]["has children under 18"] is True and made["a"]["coordinates"]["lat"] == pytest.approx(agents["a"]["lat"])
    with pytest.raises(ValueError, match="occupation"):
        P.agents_from_answers(spark.createDataFrame([("a", "b")], "`Prolific ID` string, `What is your ZIP code?` string"))


def test_agents_from_json(spark):
    people = {"p": {"What is your ZIP code?": "94103:", "What is your age?": "25-34", "What is your annual household income?": 'a "b"'}, "q": {}, "r": {"What is your ZIP code?": "10001"}}
    got = {r["agent_id"]: r for r in P.agents_from_json(frame(spark, x=json.dumps(people), y="no json")).collect()}
    assert set(got) == {"p", "q", "r"} and got["p"]["zip"] == "94103" and abs(got["p"]["lat"] - 37.7752) <= JITTER
    assert all(abs(got[k]["lat"] - P.DEFAULT_PLACE[0]) <= JITTER for k in "qr") and got["q"]["agent"]["age"] == ""
    made = {r["agent_id"]: json.loads(r["json"]) for r in P.agent_json(P.agents_from_json(frame(spark, x=json.dumps(people)))).collect()}
    assert made["p"]["agent"]["age"] == "25-34" and made["p"]["agent"]["income"] == 'a "b"' and set(made["p"]["agent"]) == set(P.JSON_FIELDS)


def test_centres_lie_in_the_city():
    assert len({z for z, *_ in P.ZIP_CENTRES}) == len(P.ZIP_CENTRES) == 27
    assert all(37.70 < lat < 37.83 and -122.52 < lng < -122.36 for _, lat, lng in P.ZIP_CENTRES)
