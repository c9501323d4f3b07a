"""The census source against a local stub of the service: batches, retries, cache, faults."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import places as P
from loomgraph.sources import census

VARIABLES = ["B1_001E", "B1_002E"]


class Service:
    """Answers with rows for all ZIP codes but 00000; how many times a batch fails first is set by its first ZIP code."""

    def __init__(self):
        self.asked, self.fails, self.keys = Counter(), {}, set()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
                zips = query["for"][0].removeprefix("zip code tabulation area:").split(",")
                service.asked[tuple(zips)] += 1
                service.keys.update(query.get("key", []))
                status, body = 200, None
                kind, times = service.fails.get(zips[0], (None, 0))
                if service.asked[tuple(zips)] <= times:
                    status, body = (kind, "busy") if isinstance(kind, int) else (200, kind)
                if body is None:
                    names = query["get"][0].split(",")
                    rows = [[f"ZCTA {z}", *(None if z.endswith("9") else str(len(n) + int(z)) for n in names[1:]), z] for z in zips if z != "00000"]
                    body = json.dumps([[*names, "zip code tabulation area"], *rows])
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}/data/2023/acs/acs5"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def read(spark, service, zips, tmp_path, **options):
    return census.read_census_api(spark, service.base, VARIABLES, zips, **({"cache": f"{tmp_path}/cache", "wait": 0.01} | options))


def test_batches_and_cache(spark, service, tmp_path):
    zips = [f"{94000 + i}" for i in range(25)] + ["94003", " ", "00000"]
    df = read(spark, service, zips, tmp_path, size=10)
    assert df.rdd.getNumPartitions() == 3
    got = {r["zipcode"]: r for r in df.collect()}
    assert set(got) == set(zips[:25]) and got["94001"]["codes"] == {"B1_001E": "94008", "B1_002E": "94008"} and got["94009"]["codes"] == {"B1_001E": None, "B1_002E": None}
    assert len(service.asked) == 3 and set(service.asked.values()) == {1}
    # again, and by another plan: nothing is fetched twice
    assert df.count() == read(spark, service, zips, tmp_path, size=10).count() == 25
    assert set(service.asked.values()) == {1}
    # an entry that is too old is
    assert read(spark, service, zips, tmp_path, size=10, max_age=-1).count() == 25 and set(service.asked.values()) == {2}


def test_failed_batches_are_tried_again(spark, service, tmp_path):
    service.fails = {"94000": (503, 2), "94002": (429, 1), "94004": ("<html>", 1), "94006": ('[["NAME"]]', 1)}
    got = read(spark, service, [f"{94000 + i}" for i in range(8)], tmp_path, size=2).collect()
    assert len(got) == 8 and all(r["fault"] is None for r in got)
    assert sorted(service.asked.values()) == [2, 2, 2, 3]


def test_batches_that_never_succeed(spark, service, tmp_path):
    service.fails = {"94000": (500, 99), "94002": (400, 99)}
    zips = [f"{94000 + i}" for i in range(6)]
    got = read(spark, service, zips, tmp_path, size=2, attempts=3, failures="report").collect()
    faults = {r["batch"]: r["fault"] for r in got if r["fault"]}
    assert set(faults) == {0, 1} and "500" in faults[0] and "400" in faults[1] and {r["zipcode"] for r in got if not r["fault"]} == {"94004", "94005"}
    assert service.asked["94000", "94001"] == 3 and service.asked["94002", "94003"] == 1
    with pytest.raises(Exception, match="status [45]00"):
        read(spark, service, zips, tmp_path, size=2, attempts=2).collect()
    # what failed was not kept, and is asked for when the service is well again; what succeeded is not
    service.fails = {}
    assert read(spark, service, zips, tmp_path, size=2).count() == 6 and service.asked["94004", "94005"] == 1


def test_options(spark, service, tmp_path):
    df = read(spark, service, ["94000"], tmp_path, key="secret")
    assert df.count() == 1 and service.keys == {"secret"}
    read(spark, service, ["94000"], tmp_path, key="other").collect()
    assert sum(service.asked.values()) == 1
    assert read(spark, service, [], tmp_path).count() == 0
    with pytest.raises(Exception, match="variables"):
        census.read_census_api(spark, service.base, [], ["94000"]).collect()


def test_filters_leave_requests_out(spark, service, tmp_path):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        zips = [f"{94000 + i}" for i in range(30)]
        got = read(spark, service, zips, tmp_path, size=10).where(F.col("zipcode").isin("94001", "94025", "95000")).collect()
        assert {r["zipcode"] for r in got} == {"94001", "94025"} and sum(map(len, service.asked)) == 2
    finally:
        spark.conf.set(name, before)


def test_configuration_and_ratios(spark, service, tmp_path):
    protocol = {"year": 2022, "variables": {"family": [{"code": "B11004_001E"}, {"code": "B11004_004E"}]}, "Zipcode": [{"code": 94102}]}
    config = census.census_config(protocol)
    assert config == {"base": "https://api.census.gov/data/2022/acs/acs5", "variables": ["B11004_001E", "B11004_004E"], "zips": ["94102"]}
    found = census.read_census_api(spark, service.base, config["variables"], config["zips"], cache=str(tmp_path))
    ratios = P.census_ratios(P.census_long(found.select("zipcode", "codes"))).collect()
    assert [(r["table_code"], r["sub_code"], r["ratio"]) for r in ratios if r["sub_code"] == "004E"] == [("B11004", "004E", pytest.approx(1.0))]
