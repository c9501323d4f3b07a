"""A census REST service as a Spark data source: a partition for each batch of ZIP codes, retries, and a cache in the shared folder.

    spark.dataSource.register(CensusSource)
    spark.read.format("census_api").options(base=url, variables="B11004_001E,B11004_004E", zips="94102,94103", cache=folder).load()

The service answers ``base?get=NAME,<variables>&for=zip code tabulation area:<zips>`` with an array of rows, the first of which is
the header. Each partition is one request. An answer that is no success, a connection that breaks and a body that is no table are
tried again, after waits that double; requests that the service calls wrong (400 to 499 but for 408 and 429) are not. Bodies that
are whole tables with all variables are kept under a hash of the request without its key, written beside and moved into place, so
that a task that runs again, or a later read, fetches nothing twice while the entry is younger than ``max_age`` seconds.

Options: base, variables and zips (comma-separated), cache (a folder on any file system that all executors reach; none: no cache),
size (ZIP codes in a request, 100), attempts (4), wait (seconds before the second attempt, 0.5), timeout (30), max_age (3600), key
(sent along, never part of the cache's names), failures: ``raise`` stops the read, ``report`` gives the batch one row with the fault.

Filters ``zipcode = ...`` and ``zipcode IN (...)`` leave out the requests that they make needless, with the option filters set, which
spark.sql.python.filterPushdown.enabled must allow (``read_census_api`` does as the session says). Blank and repeated ZIP codes are asked for once or not at all; no ZIP codes give an
empty table; ZIP codes that the service does not know have no row.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "batch int, zipcode string, codes map<string,string>, fault string"
ZIP_COLUMN = "zip code tabulation area"
BATCH_ZIPS = 100
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Client errors that may pass.
TRANSIENT = (408, 429)


class ZipBatch(InputPartition):
    def __init__(self, number: int, zips: list[str]) -> None:
        self.number, self.zips = number, zips


class _Cache:
    """Bodies by name in a folder of any file system that Arrow knows."""

    def __init__(self, folder: str | None, max_age: float) -> None:
        self.folder, self.max_age = folder, max_age

    def _at(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.folder.rstrip('/')}/{name}" if "://" in self.folder or ":/" in self.folder else f"file://{self.folder.rstrip('/')}/{name}")

    def get(self, name: str) -> str | None:
        if not self.folder:
            return None
        from pyarrow import fs

        system, path = self._at(name)
        info = system.get_file_info(path)
        if info.type != fs.FileType.File or info.mtime is not None and time.time() - info.mtime.timestamp() > self.max_age:
            return None
        with system.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, name: str, body: str) -> None:
        if not self.folder:
            return
        import uuid

        system, path = self._at(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as f:
            f.write(body.encode())
        system.move(beside, path)


def parse_table(body: str, variables: list[str]) -> list[tuple[str, dict]]:
    """(zipcode, codes) of each row; ValueError for a body that is no table, or lacks a column."""
    data = json.loads(body)
    if not isinstance(data, list) or not data or not all(isinstance(r, list) and len(r) == len(data[0]) for r in data):
        raise ValueError("the answer is no table")
    header = data[0]
    if missing := [c for c in (ZIP_COLUMN, *variables) if c not in header]:
        raise ValueError(f"the answer has no {', '.join(missing)}")
    at, columns = header.index(ZIP_COLUMN), [(v, header.index(v)) for v in variables]
    return [(row[at], {v: None if row[i] is None else str(row[i]) for v, i in columns}) for row in data[1:]]


class CensusReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        for name in ("base", "variables"):
            if not options.get(name):
                raise ValueError(f"census_api needs the option {name}")
        split = lambda x: [p.strip() for p in (x or "").split(",") if p.strip()]
        self.base, self.key = options["base"], options.get("key")
        self.variables, self.zips = split(options["variables"]), sorted(set(split(options.get("zips"))))
        self.size, self.attempts = int(options.get("size", BATCH_ZIPS)), int(options.get("attempts", 4))
        self.wait, self.timeout = float(options.get("wait", 0.5)), float(options.get("timeout", 30))
        self.cache = _Cache(options.get("cache"), float(options.get("max_age", 3600)))
        self.report = options.get("failures", "raise") == "report"

    def partitions(self) -> list[ZipBatch]:
        return [ZipBatch(n, self.zips[at : at + self.size]) for n, at in enumerate(range(0, len(self.zips), self.size))] or [ZipBatch(0, [])]

    def url(self, zips: list[str]) -> str:
        place = urllib.parse.quote(f"{ZIP_COLUMN}:{','.join(zips)}", safe=":,")
        return f"{self.base}?get={','.join(['NAME', *self.variables])}&for={place}"

    def fetch(self, url: str) -> list[tuple[str, dict]]:
        name = hashlib.sha256(url.encode()).hexdigest() + ".json"
        if (held := self.cache.get(name)) is not None:
            return parse_table(held, self.variables)
        why = None
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                with urllib.request.urlopen(url + (f"&key={self.key}" if self.key else ""), timeout=self.timeout) as answer:
                    # the service answers without a body where it knows none of the places
                    body = answer.read().decode() or json.dumps([[ZIP_COLUMN, *self.variables]])
                rows = parse_table(body, self.variables)
                self.cache.put(name, body)
                return rows
            except urllib.error.HTTPError as e:
                why = f"status {e.code}"
                if 400 <= e.code < 500 and e.code not in TRANSIENT:
                    break
            except (OSError, ValueError) as e:
                why = str(e)
        raise ConnectionError(f"{url}: {why}")

    def read(self, partition: ZipBatch) -> Iterator[tuple]:
        if not partition.zips:
            return
        try:
            rows = self.fetch(self.url(partition.zips))
        except ConnectionError as e:
            if not self.report:
                raise
            yield partition.number, None, None, str(e)
            return
        for zipcode, codes in rows:
            yield partition.number, zipcode, codes, None


class FilteringCensusReader(CensusReader):
    """Asks for no ZIP codes that the plan's filters rule out."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("zipcode",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.zips = [z for z in self.zips if z in wanted]
            yield f  # Spark filters again: a service may answer with more than was asked for


class CensusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "census_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CensusReader:
        # Spark refuses readers that take filters where it passes none on
        kind = FilteringCensusReader if self.options.get("filters") == "true" else CensusReader
        return kind(dict(self.options))


def read_census_api(spark: SparkSession, base: str, variables: list[str], zips: list[str], **options) -> DataFrame:
    """(batch, zipcode, codes, fault) of ZIP codes; the cache is in the shared folder unless ``cache`` names another."""
    from .shared import shared_dir

    spark.dataSource.register(CensusSource)
    given = {"cache": f"{shared_dir(spark).rstrip('/')}/census", "filters": spark.conf.get(PUSHDOWN)} | options
    return spark.read.format("census_api").options(base=base, variables=",".join(variables), zips=",".join(zips), **given).load()


def census_config(protocol: dict, host: str = "https://api.census.gov/data") -> dict:
    """base, variables and zips of a configuration with year, dataset, variables by category, and Zipcode."""
    codes = [v["code"] for listed in (protocol.get("variables") or {}).values() for v in listed]
    return {"base": f"{host}/{protocol.get('year', 2023)}/acs/{protocol.get('dataset', 'acs5')}", "variables": codes, "zips": [str(z["code"]) for z in protocol.get("Zipcode") or []]}
