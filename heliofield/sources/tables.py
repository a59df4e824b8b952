"""CSV, text and spreadsheet inputs and outputs with declared schemas."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from array import array
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliofield.operators.matrix import from_wide, to_wide
from heliofield.operators.pv import albedo


def read_observations(spark: SparkSession, path: str, values: dict[str, str]) -> DataFrame:
    """Weather-station CSV: ``-`` is null; the UTC time is made of Year, Month, Day and ``Time [UTC]``. ``values``: header -> name."""
    raw = spark.read.option("header", True).option("nullValue", "-").csv(path)
    hm = F.split("Time [UTC]", ":")
    ts = F.make_timestamp_ntz(F.col("Year").cast("int"), F.col("Month").cast("int"), F.col("Day").cast("int"), hm[0].cast("int"), hm[1].cast("int"), F.lit(0))
    return raw.select(ts.alias("ts"), *(F.col(f"`{k}`").try_cast("double").alias(v) for k, v in values.items()))


def read_cached_weather(spark: SparkSession, path: str, recompute_albedo: bool = True) -> DataFrame:
    """Cached weather: six columns rounded to two digits; the albedo may be made anew from each day's mean temperature."""
    raw = spark.read.option("header", True).schema("timestamp string, dni double, dhi double, ghi double, T double, wind double, albedo double").csv(path)
    out = raw.select(F.to_timestamp_ntz("timestamp").alias("ts"), *(F.round(c, 2).alias(c) for c in ("dni", "dhi", "ghi", "T", "wind", "albedo")))
    if recompute_albedo:
        day = F.to_date("ts")
        daily = out.groupBy(day.alias("__d")).agg(F.avg("T").alias("__t"))
        out = out.join(daily, day.eqNullSafe(F.col("__d"))).withColumn("albedo", albedo(F.col("__t"))).drop("__t", "__d")
    return out


def read_clear_minutes(spark: SparkSession, path: str) -> DataFrame:
    """day, n: lines a day of a text with one line a clear minute; the first ten characters are the day."""
    key = F.trim(F.substring("value", 1, 10))
    return spark.read.text(path).select(key.alias("day_key")).where("day_key <> ''").groupBy("day_key").agg(F.count("*").alias("n")).select(F.to_date("day_key", "yyyy MM dd").alias("day"), "n")


def pick_column(headers: list[str], wanted: int | str) -> str:
    """A header by index, or the first that contains a text; the error lists what there is."""
    if isinstance(wanted, int):
        return headers[wanted]
    for h in headers:
        if wanted in h:
            return h
    raise ValueError(f"no column contains {wanted!r}; columns: {headers}")


def read_inverter(spark: SparkSession, path: str, energy: int | str = 2, time_format: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """Inverter log exported as CSV: a header row, a row of units, the time first. t, e (Wh), unreadable energy null, rows without a time dropped."""
    raw = spark.read.option("header", True).csv(path)
    name = pick_column(raw.columns, energy)
    return raw.select(F.try_to_timestamp(F.col(f"`{raw.columns[0]}`"), F.lit(time_format)).cast("timestamp_ntz").alias("t"), F.trim(F.col(f"`{name}`")).try_cast("double").alias("e")).where("t is not null")


def read_inverter_all(spark: SparkSession, path: str, time_format: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """The same log with every column as a number."""
    raw = spark.read.option("header", True).csv(path)
    first, *rest = raw.columns
    return raw.select(F.try_to_timestamp(F.col(f"`{first}`"), F.lit(time_format)).cast("timestamp_ntz").alias("t"), *(F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) for c in rest)).where("t is not null")


class _Strings:
    """A workbook's shared strings, as bytes and their ends, read once through."""

    def __init__(self, source=None):
        self.data, self.ends = bytearray(), array("Q", [0])
        for element in _elements(source, "si") if source else ():
            for t in element.iter():
                if _tag(t) == "t" and t.text:
                    self.data += t.text.encode()
            self.ends.append(len(self.data))

    def __getitem__(self, k: int) -> str:
        return self.data[self.ends[k] : self.ends[k + 1]].decode()


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _elements(source, name: str):
    """The elements of a name as they end; each is let go before the next."""
    above = []
    for event, element in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if _tag(element) == name:
            yield element
            element.clear()
            if above:
                above[-1].clear()


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part of a sheet, by name or the first, through the workbook's relations; without them the only or first worksheet."""
    names = book.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheets = [(e.get("name"), next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter() if _tag(e) == "Relationship"}
        for name, number in sheets:
            if sheet in (None, name) and targets.get(number):
                target = targets[number]
                return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        raise ValueError(f"no sheet {sheet!r}; sheets: {[n for n, _ in sheets]}")
    if sheet is not None:
        raise ValueError("the workbook does not name its sheets")
    return min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))


def _sheet(raw: bytes, sheet: str | None = None):
    """The rows of a sheet, as lists of cells as text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = _Strings()
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as source:
                shared = _Strings(source)
        with book.open(_sheet_part(book, sheet)) as source:
            for row in _elements(source, "row"):
                cells: list[str | None] = []
                for c in (x for x in row if _tag(x) == "c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = len(cells) + 1  # a cell without a place follows the one before
                    if letters:
                        at = 0
                        for ch in letters:
                            at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - len(cells))
                    if c.get("t") == "inlineStr":
                        value = "".join(x.text or "" for x in c.iter() if _tag(x) == "t")
                    else:
                        value = next((x.text for x in c.iter() if _tag(x) == "v"), None)
                    cells[at - 1] = shared[int(value)] if c.get("t") == "s" and value is not None else value
                yield cells


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, row, cells: the rows of a sheet (its name, or the first) of every workbook, a workbook a task. Rows are read as they stand in the file and
    leave in batches, so a task holds the packed file, its shared strings and one batch."""

    def sheets(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, first = _sheet(raw.as_buffer().to_pybytes(), sheet), 0
                while held := list(islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["path", "row", "cells"])
                    first += len(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(sheets, "path string, row long, cells array<string>")


def _cell_time(cell: Column, time_format: str) -> Column:
    """A workbook's time: text in the given format, or a serial day number."""
    serial = F.make_dt_interval(secs=F.round(cell.try_cast("double") * 86400, 3).cast("decimal(18,6)"))
    return F.coalesce(F.try_to_timestamp(cell, F.lit(time_format)).cast("timestamp_ntz"), F.expr("timestamp_ntz '1899-12-30 00:00:00'") + serial)


def _workbook(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows below the header and the units, and the first workbook's headers; all workbooks have the same columns."""
    rows = read_workbooks(spark, path)
    first = rows.where("row = 0").orderBy("path").select("cells").first()
    if first is None:
        raise ValueError(f"no rows in {path}")
    return rows.where("row > 1"), [h or f"column_{k}" for k, h in enumerate(first["cells"])]


def read_inverter_workbook(spark: SparkSession, path: str, energy: int | str = 2, time_format: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """Inverter log in workbooks, laid out as the CSV export is: t, e (Wh)."""
    rows, headers = _workbook(spark, path)
    at = headers.index(pick_column(headers, energy)) if isinstance(energy, str) else energy
    return rows.select(_cell_time(F.get("cells", F.lit(0)), time_format).alias("t"), F.trim(F.get("cells", F.lit(at))).try_cast("double").alias("e")).where("t is not null")


def read_inverter_workbook_all(spark: SparkSession, path: str, time_format: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """The same log with every column as a number."""
    rows, headers = _workbook(spark, path)
    return rows.select(_cell_time(F.get("cells", F.lit(0)), time_format).alias("t"), *(F.trim(F.get("cells", F.lit(k))).try_cast("double").alias(h) for k, h in enumerate(headers) if k)).where("t is not null")


def read_shadow_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A wide shadow CSV as alt, az, shadow; empty and NaN cells are 0."""
    return from_wide(spark.read.option("header", True).csv(path))


def write_shadow_matrix(matrix: DataFrame, path: str) -> None:
    """Wide CSV, one row an altitude: a fixed 91 x 361 table, so one file."""
    to_wide(matrix).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def study_area(bounds: DataFrame) -> DataFrame:
    """WKT polygon of min_x, max_x, min_y, max_y."""
    corners = ["min_x", "min_y", "max_x", "min_y", "max_x", "max_y", "min_x", "max_y", "min_x", "min_y"]
    return bounds.select(F.format_string("POLYGON ((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))", *corners).alias("wkt"))


def polygon_of(wkt: str) -> list[tuple[float, float]]:
    """The outer ring of a WKT polygon, without its closing vertex, as ``crop`` takes it."""
    ring = re.fullmatch(r"\s*POLYGON\s*Z?\s*\(\s*\(([^()]*)\).*\)\s*", wkt, re.IGNORECASE | re.DOTALL)
    if not ring:
        raise ValueError(f"not a WKT polygon: {wkt[:60]!r}")
    points = [tuple(map(float, p.split()[:2])) for p in ring[1].split(",")]
    if len(points) < 4 or points[0] != points[-1]:
        raise ValueError("a polygon's ring needs three vertices and must be closed")
    return points[:-1]


def sample_metrics(spark: SparkSession, days: int = 20) -> DataFrame:
    """A synthetic metric table of consecutive days by a fixed rule (no random numbers)."""
    i = F.col("id")
    base = 500 + 10 * F.pmod(i * 37, F.lit(21))
    return spark.range(days).select(
        F.date_format(F.date_add(F.lit("2021-05-01").cast("date"), i.cast("int")), "yyyy-MM-dd").alias("Date"),
        base.cast("double").alias("rmse_base"),
        (base * (0.6 + F.pmod(i * 13, F.lit(7)) / 20.0)).alias("rmse_shaded"),
    )
