"""Readers with explicit schemas: CSV, header-less positional files, tagged-record files, feeds, logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions import rules


def csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A CSV with a header; bad values are null. Select columns after it: only those are parsed."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def positional(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """Header-less files, all columns text, empty text kept; with the file that each row is from."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("nullValue", "\u0000").option("emptyValue", "").csv(paths)
    return rows.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names], F.col("_metadata.file_path").alias("file"))


# Tags of the lines of an event file.
TAGS = ("version", "info", "start", "play", "sub", "com", "data", "badj", "padj", "ladj", "radj", "presadj")


def tagged_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, record_id and lines (each an array of fields) of each record of tagged-record files.

    A record begins with an ``id`` line, and files are split there: a file of any size is read by many tasks, a record is
    one row, and nothing is shuffled. Lines before the first record are left out; commas within quotes don't part fields.
    """
    rows = spark.read.option("lineSep", "\nid,").text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^id,", "").alias("value"))
    lines = F.filter(F.split("value", r"\r?\n|\r$"), lambda x: F.trim(x) != "")
    quoted = lambda line: F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    # The pattern looks on to the end of the line at each comma: only lines with quotes need it.
    fields = lambda line: F.when(line.contains('"'), quoted(line)).otherwise(F.transform(F.split(line, ","), lambda x: F.trim(x)))
    rows = rows.select("file", F.transform(lines, fields).alias("lines")).withColumn("record_id", F.get(F.get("lines", F.lit(0)), F.lit(0)))
    return rows.where(F.col("record_id").isNotNull() & ~F.col("record_id").isin(*TAGS)).select("file", "record_id", F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))").alias("lines"))


def _at(line: Column, i: int) -> Column:
    return F.get(line, F.lit(i))


def starters(records: DataFrame) -> DataFrame:
    """One row per record: its id, info values, the starting pitcher of each side (position 1) and earned runs. Of a repeated key the last line counts."""
    infos = F.filter("lines", lambda x: _at(x, 0) == "info")
    info = F.map_from_entries(F.transform(F.array_distinct(F.transform(infos, lambda x: _at(x, 1))), lambda k: F.struct(k, _at(F.element_at(F.filter(infos, lambda x: _at(x, 1) == k), -1), 2))))
    rows = records.select("file", "record_id", "lines", info.alias("info"))
    for side, mark in (("home", "1"), ("away", "0")):
        began = F.filter("lines", lambda x: (_at(x, 0) == "start") & (_at(x, 5) == "1") & (_at(x, 3) == mark))  # noqa: B023
        rows = rows.withColumn(f"{side}_starter", F.array_max(F.transform(began, lambda x: _at(x, 1))))
        earned = F.filter("lines", lambda x: (_at(x, 0) == "data") & (_at(x, 1) == "er") & (_at(x, 2) == F.col(f"{side}_starter")))  # noqa: B023
        rows = rows.withColumn(f"{side}_er", rules.number(_at(F.try_element_at(earned, F.lit(-1)), 3)))
    return rows.drop("lines")


def appearances(records: DataFrame) -> DataFrame:
    """Many rows per record: every pitcher who starts or comes in, by side, in the order of lines."""
    rows = records.select("file", "record_id", F.posexplode("lines").alias("line", "x"))
    rows = rows.where(_at(F.col("x"), 0).isin("start", "sub") & (_at(F.col("x"), 5) == "1"))
    return rows.select("file", "record_id", "line", _at(F.col("x"), 1).alias("pitcher"), (_at(F.col("x"), 3) == "1").alias("is_home"), (_at(F.col("x"), 0) == "start").alias("is_start"))


_PRICE = "struct<open:struct<odds:string,line:string>,close:struct<odds:string,line:string>>"
#: The nested feed, declared: no inference over files.
FEED = f"""events array<struct<id:string, date:string, season:struct<type:int>,
 competitions:array<struct<neutralSite:boolean, status:struct<type:struct<completed:boolean>>,
  competitors:array<struct<homeAway:string, score:string, team:struct<abbreviation:string, displayName:string>,
   probables:array<struct<athlete:struct<displayName:string>>>>>,
  odds:array<struct<moneyline:struct<home:{_PRICE},away:{_PRICE}>,
   pointSpread:struct<home:{_PRICE},away:{_PRICE}>,
   total:struct<over:{_PRICE},under:{_PRICE}>>>>>>>"""


def feed_events(text: DataFrame, column: str = "value") -> DataFrame:
    """Events of scoreboard JSON, one row each: sides by their mark, first odds provider only, prices and lines as numbers."""
    event = text.select(F.explode(F.from_json(column, FEED)["events"]).alias("e")).withColumn("c", F.get("e.competitions", F.lit(0)))
    side = lambda s: F.get(F.filter("c.competitors", lambda x: x["homeAway"] == s), F.lit(0))
    quote = F.get("c.odds", F.lit(0))
    columns = {
        "event_id": F.col("e.id"),
        "starts": F.col("e.date").try_cast("timestamp"),
        "season_type": F.col("e.season.type"),
        "completed": F.coalesce(F.col("c.status.type.completed"), F.lit(False)),
        "is_neutral": F.coalesce(F.col("c.neutralSite"), F.lit(False)),
    }
    for s in ("home", "away"):
        columns |= {f"{s}_team": side(s)["team"]["abbreviation"], f"{s}_score": rules.number(side(s)["score"]), f"{s}_probable": F.get(side(s)["probables"], F.lit(0))["athlete"]["displayName"]}
        for at in ("open", "close"):
            columns |= {f"{s}_ml_{at}": rules.feed_price(quote["moneyline"][s][at]["odds"]), f"{s}_line_{at}": rules.feed_line(quote["pointSpread"][s][at]["line"]), f"{s}_line_odds_{at}": rules.feed_price(quote["pointSpread"][s][at]["odds"])}
    for at in ("open", "close"):
        columns |= {f"total_{at}": rules.feed_line(quote["total"]["over"][at]["line"]), **{f"{o}_odds_{at}": rules.feed_price(quote["total"][o][at]["odds"]) for o in ("over", "under")}}
    return event.select(*[v.alias(k) for k, v in columns.items()])


DEPTH = "depthchart array<struct<positions:map<string,struct<athletes:array<struct<id:string,displayName:string>>>>>>"
ROSTER = "athletes array<struct<items:array<struct<id:string, displayName:string, position:struct<abbreviation:string>, status:struct<type:string>, injuries:array<struct<status:string>>>>>>"


def starter_status(rosters: DataFrame, position: str, out: tuple[str, ...] = ("Out", "Injured Reserve", "Doubtful", "Suspension")) -> DataFrame:
    """rosters: team, roster (JSON), depth (JSON). Whether the first of the depth chart (else of the roster) is out."""
    people = F.filter(F.flatten(F.transform(F.from_json("roster", ROSTER)["athletes"], lambda g: g["items"])), lambda p: p["position"]["abbreviation"] == position)
    charts = F.transform(F.from_json("depth", DEPTH)["depthchart"], lambda d: F.get(F.try_element_at(d["positions"], F.lit(position.lower()))["athletes"], F.lit(0))["id"])
    rows = rosters.withColumn("_people", people).withColumn("_first", F.get(F.filter(charts, lambda x: x.isNotNull()), F.lit(0)))
    named = F.coalesce(F.get(F.filter("_people", lambda p: p["id"] == F.col("_first")), F.lit(0)), F.get("_people", F.lit(0)))
    rows = rows.withColumn("_starter", named)
    hurt = F.exists(F.col("_starter.injuries"), lambda i: i["status"].isin(*out))
    return rows.select("team", F.col("_starter.displayName").alias("starter"), F.coalesce(hurt, F.lit(False)).alias("is_out"))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(book: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Cells of a named sheet as text, row by row; missing cells are None."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        names = [s.get("name") for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{_SHEET}sheet")]
        for _, row in ElementTree.iterparse(z.open(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml")):
            if row.tag != f"{_SHEET}row":
                continue
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_SHEET}c"):
                at = 0
                for letter in re.match("[A-Z]+", c.get("r"))[0]:
                    at = at * 26 + ord(letter) - 64
                value = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            row.clear()
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def workbook(spark: SparkSession, path: str, schema: str, sheet: str) -> DataFrame:
    """Rows of a sheet of each workbook in ``path``, one task a file, by its header's names; bad values are null."""
    names = T.StructType.fromDDL(schema).names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book in batch.column("content").to_pylist():
                rows = sheet_rows(book, sheet)
                header = next(rows, [])
                at = [header.index(n) if n in header else None for n in names]
                found = [[r[i] if i is not None and i < len(r) else None for i in at] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string()) for _ in names], names)

    text = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInArrow(scan, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])
