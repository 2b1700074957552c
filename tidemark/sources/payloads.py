"""Payloads of publishers: JSON, delimited and fixed text, feeds and HTML tables as long rows. Built-in readers where there is one."""

from __future__ import annotations

import io
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def series_json(payload: Column) -> Column:
    """Of ``{"properties": {"parameter": {P: {YYYYMMDD: value}}}}`` an array of (parameter, date, value)."""
    parsed = F.from_json(payload, "properties struct<parameter: map<string, map<string, double>>>")
    each = F.transform(F.map_entries(parsed["properties"]["parameter"]), lambda p: F.transform(F.map_entries(p["value"]), lambda d: F.struct(p["key"].alias("parameter"), F.to_date(d["key"], "yyyyMMdd").alias("date"), d["value"].alias("value"))))
    return F.flatten(each)


def rates_json(payload: Column) -> Column:
    """Of ``{"base": B, "rates": {date: {currency: rate}}}`` an array of (base, date, currency, rate)."""
    parsed = F.from_json(payload, "base string, rates map<string, map<string, double>>")
    each = F.transform(F.map_entries(parsed["rates"]), lambda d: F.transform(F.map_entries(d["value"]), lambda c: F.struct(parsed["base"].alias("base"), F.to_date(d["key"]).alias("date"), c["key"].alias("currency"), c["value"].alias("rate"))))
    return F.flatten(each)


def columns_and_data(payload: Column, columns: list[str]) -> Column:
    """Of ``{"columns": [names], "data": [[cells]]}`` an array of structs of ``columns``, strings; a name that isn't there gives null."""
    parsed = F.from_json(payload, "columns array<string>, data array<array<string>>")
    at = lambda name: F.array_position(parsed["columns"], F.lit(name)).cast("int")
    return F.transform(parsed["data"], lambda row: F.struct(*(F.when(at(c) > 0, F.get(row, at(c) - 1)).alias(c) for c in columns)))


def meta_and_rows(payload: Column, row: str) -> Column:
    """The rows of a two-part array ``[{meta}, [rows]]``, as structs of ``row``."""
    return F.from_json(F.get_json_object(payload, "$[1]"), f"array<struct<{row}>>")


def months_wide(lines: DataFrame, line: str = "value", missing: float | None = None) -> DataFrame:
    """Lines of a year and twelve values as (year, month, value); other lines, and the missing value, are left out."""
    cells = F.split(F.trim(F.col(line)), r"\s+")
    rows = lines.where(F.col(line).rlike(r"^\s*\d{4}(\s+[-+]?[\d.]+){12}\s*$")).select(F.get(cells, F.lit(0)).cast("int").alias("year"), F.posexplode(F.slice(cells, 2, 12)).alias("m", "v"))
    value = F.col("v").cast("double")
    rows = rows.select("year", (F.col("m") + 1).alias("month"), value.alias("value"))
    return rows if missing is None else rows.where(F.col("value") != missing)


def fixed_text(spark: SparkSession, path: str, header: list[str], schema: str) -> DataFrame:
    """White-space separated lines under a header (a line without digits) that must be ``header``; another one fails the job, for the columns may have moved."""
    lines = spark.read.text(path)
    cells = F.split(F.trim("value"), r"\s+")
    is_header = ~F.col("value").rlike("[0-9]")
    wanted = F.array(*map(F.lit, header))
    ok = F.assert_true(~is_header | (cells == wanted), F.concat(F.lit("unexpected header: "), F.col("value")))
    kinds = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    rows = lines.where(F.trim("value") != "").withColumn("__ok", ok).where(F.col("__ok").isNull() & ~is_header)
    return rows.select(*(F.get(cells, F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of ``schema`` from delimited text (also gzipped), and the lines that do not fit it with what could be read of them."""
    read = spark.read.option("sep", separator).option("header", str(header)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    df = read.schema(f"{schema}, _bad string").csv(path)
    return df.where(F.col("_bad").isNull()).drop("_bad"), df.where(F.col("_bad").isNotNull())


def feed_items(xml: Column) -> Column:
    """Items of an RSS feed as an array of (title, link, published)."""
    parsed = F.from_xml(xml, "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>")
    return F.transform(parsed["channel"]["item"], lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), F.try_to_timestamp(F.regexp_replace(i["pubDate"], r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")).alias("published")))


class _Tables(HTMLParser):
    """Cells of all tables with their spans."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = ["", max(1, int(attrs.get("rowspan") or 1)), max(1, int(attrs.get("colspan") or 1))]

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell and self.open and self.open[-1]:
            self.open[-1][-1].append((" ".join(self.cell[0].split()), self.cell[1], self.cell[2]))
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def html_tables(html: str) -> list[list[list[str]]]:
    """Grids of text of the tables of a page; a cell that spans rows or columns stands in each of them."""
    parser = _Tables()
    parser.feed(html or "")
    grids = []
    for table in parser.tables:
        taken: dict[tuple[int, int], str] = {}
        for r, row in enumerate(table):
            c = 0
            for text, down, across in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j): text for i in range(down) for j in range(across)}
                c += across
        rows, cols = 1 + max((r for r, _ in taken), default=-1), 1 + max((c for _, c in taken), default=-1)
        grids.append([[taken.get((r, c), "") for c in range(cols)] for r in range(rows)])
    return grids


def html_cells(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col``, ``table``, ``row``, ``column`` and ``cell`` of all tables of each page."""

    def run(frames):
        for frame in frames:
            rows = [(k, t, r, c, cell) for k, html in zip(frame["id"], frame["html"], strict=True) for t, grid in enumerate(html_tables(html)) for r, line in enumerate(grid) for c, cell in enumerate(line)]
            yield pd.DataFrame(rows, columns=["id", "table", "row", "column", "cell"])

    kind = df.schema[id_col].dataType.simpleString()
    cells = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, table int, row int, column int, cell string")
    return cells.withColumnRenamed("id", id_col)


def zipped_csv(content: bytes, name: str) -> pd.DataFrame:
    """A parser for ``scans.parse_files``: the first CSV of a ZIP file, all cells as text."""
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        inner = next(n for n in z.namelist() if n.lower().endswith(".csv"))
        return pd.read_csv(z.open(inner), dtype=str, keep_default_na=False)
