"""Sinks: CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.functions import csv_field, localized

#: Headers by language.
HEADERS = {"en": {"name": "Name", "path": "Path", "size": "Size(bytes)", "date": "Date"}, "ko": {"name": "이름", "path": "경로", "size": "크기(bytes)", "date": "날짜"}}
COLUMNS = ("name", "path", "size_bytes", "modified_text")


def csv_lines(rows: DataFrame) -> DataFrame:
    """A line of the export for each shown row, with fields quoted only where they must be."""
    return rows.select(F.concat_ws(",", csv_field(F.col("name")), csv_field(F.col("path")), F.col("size_bytes").cast("string"), csv_field(F.col("modified_text"))).alias("line"))


def header(language: str = "en") -> str:
    return ",".join(localized(HEADERS, k, language) for k in ("name", "path", "size", "date"))


def export_csv(rows: DataFrame, folder: str, language: str = "en") -> None:
    """A folder of CSV parts, each with the header; the form for exports of any size."""
    names = dict(zip(COLUMNS, header(language).split(","), strict=True))
    rows.select(*(F.col(c).alias(n) for c, n in names.items())).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def export_file(rows: DataFrame, path: str, language: str = "en") -> int:
    """One local file with a byte order mark. Rows pass the driver one partition at a time."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(header(language) + "\r\n")
        for row in csv_lines(rows).toLocalIterator():
            f.write(row[0] + "\r\n")
            n += 1
    return n


def export_selected(rows: DataFrame, selected: DataFrame, folder: str, language: str = "en") -> None:
    """The rows whose path is selected."""
    export_csv(rows.join(selected.select("path").distinct(), "path", "left_semi"), folder, language)
