"""Connectors to web services as data sources: a partition for each place or day, back-off where the service asks for it.

A request that fails for good leaves no rows of data, never an error: other places and days are not lost with it. URLs may
be http, https or file.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Requests at most for one answer, and the seconds before the second one, doubled each time.
TRIES, WAIT, TIMEOUT = 5, 2.0, 30.0


def fetched(url: str, tries: int = TRIES, wait: float = WAIT, timeout: float = TIMEOUT) -> tuple[dict, int]:
    """The JSON object at ``url`` ({} on failure) and the requests that it took. Only 429, too many requests, is tried again."""
    for attempt in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                found = json.loads(answer.read().decode("utf-8"))
            return found if isinstance(found, dict) else {}, attempt
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == tries:
                return {}, attempt
            time.sleep(wait * 2 ** (attempt - 1))
        except (urllib.error.URLError, TimeoutError, OSError, ValueError):
            return {}, attempt
    return {}, tries


class Place(InputPartition):
    def __init__(self, key: dict):
        super().__init__(0)
        self.key = key


class _Reader(DataSourceReader):
    """A partition for each entry of ``keys``; what it reads is up to the source."""

    def __init__(self, options: dict[str, str]):
        self.url, self.keys = options["url"], json.loads(options["keys"])
        self.how = {"tries": int(options.get("tries", TRIES)), "wait": float(options.get("wait", WAIT)), "timeout": float(options.get("timeout", TIMEOUT))}

    def partitions(self) -> list[InputPartition]:
        return [Place(k) for k in self.keys]

    def read(self, partition: Place) -> Iterator[tuple]:
        answer, tries = fetched(self.url.format(**partition.key), **self.how)
        yield from self.rows(partition.key, answer, tries)

    def rows(self, key: dict, answer: dict, tries: int) -> Iterator[tuple]:
        raise NotImplementedError


class Documents(DataSource):
    """JSON documents by key: key, the document as text ({} on failure), and the requests that it took."""

    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return "key string, value string, tries int"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options)


class _Documents(_Reader):
    def rows(self, key: dict, answer: dict, tries: int) -> Iterator[tuple]:
        yield "/".join(str(v) for v in key.values()), json.dumps(answer), tries


class Weather(DataSource):
    """Daily weather by place: a row for each day that the archive has; a place whose request fails has none."""

    @classmethod
    def name(cls) -> str:
        return "daily_weather"

    def schema(self) -> str:
        return "lat double, lon double, day date, temp_max double, temp_min double, wind double, rain double, tries int"

    def reader(self, schema) -> DataSourceReader:
        return _Weather(self.options)


class _Weather(_Reader):
    # Names of the archive's daily fields.
    FIELDS = ("temperature_2m_max", "temperature_2m_min", "wind_speed_10m_max", "precipitation_sum")

    def rows(self, key: dict, answer: dict, tries: int) -> Iterator[tuple]:
        import datetime

        daily = answer.get("daily") or {}
        days = daily.get("time") or []
        columns = [daily.get(f) or [None] * len(days) for f in self.FIELDS]
        for day, *values in zip(days, *columns, strict=False):
            yield float(key["lat"]), float(key["lon"]), datetime.date.fromisoformat(day), *(None if v is None else float(v) for v in values), tries


def url_of(path: str) -> str:
    """The URL of a folder that driver and executors share."""
    return re.sub("^file:/+", "file:///", path) if re.match(r"\w+:", path) else f"file://{path}"


def read(spark: SparkSession, source: type[DataSource], url: str, keys: list[dict], **how: float) -> DataFrame:
    """url: a template of the fields of ``keys``. how: tries, wait, timeout."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(url=url, keys=json.dumps(keys), **{k: str(v) for k, v in how.items()}).load()
