"""Sinks: append-only JSON logs, refreshed caches, versioned tables, API records, a markdown report."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What an incremental refresh has to fetch."""
    return wanted.join(cache.select(key), key, "left_anti")


def refreshed(cache: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """The cache with newly fetched rows; cached rows win."""
    return cache.unionByName(missing_keys(fetched, cache, key), allowMissingColumns=True)


def write_version(rows: DataFrame, path: str, version: int) -> str:
    """A new version of a table in its own folder, so readers of an older one are never disturbed."""
    target = f"{path}/v={version}"
    rows.write.mode("overwrite").parquet(target)
    return target


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={version}")


def records(rows: DataFrame) -> DataFrame:
    """Rows as JSON for an API: NaN, infinities and nulls of number columns are 0."""
    numbers = [c for c, t in rows.dtypes if t in ("double", "float")]
    clean = rows.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)) for c in numbers})
    clean = clean.na.fill(0, [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint")])
    return clean.select(F.to_json(F.struct(*clean.columns)).alias("record"))


def manifest(run: str, facts: dict[str, object]) -> str:
    """A small manifest line for a run registry."""
    return json.dumps({"run": run, **facts}, sort_keys=True, default=str)


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A report of small summary tables, at most ``rows`` rows each."""
    out = [f"# {title}"]
    for name, table in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + " - |" * len(table.columns)]
        for r in table.limit(rows).collect():
            out.append("| " + " | ".join("–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(out) + "\n"


def workbook(rows: DataFrame, folder: str, sheet: str = "Data", most: int = 100_000) -> None:
    """A small table as one workbook in ``folder``, through Hadoop's file system; more than ``most`` rows raise."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a workbook takes {most} rows at most")

    def cell(v: object) -> str:
        return "" if v is None else f"<v>{v}</v>" if isinstance(v, int | float) else f"<is><t>{escape(str(v))}</t></is>"

    def row(i: int, values: list) -> str:
        cells = (f'<c r="{chr(65 + j)}{i}"{"" if v is None or isinstance(v, int | float) else ' t="inlineStr"'}>{cell(v)}</c>' for j, v in enumerate(values))
        return f'<row r="{i}">{"".join(cells)}</row>'

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="{escape(sheet)}" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(row(i + 1, list(r)) for i, r in enumerate([rows.columns, *found]))}</sheetData></worksheet>")
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/data.xlsx")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
