"""Sinks and spreadsheet rules (S06-S13), all as Column expressions so the
text of every line is produced in parallel, partition by partition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import JS_SPACE
from ..functions.text import named

_WS1 = JS_SPACE
CRLF = "\r\n"
BOM = "\ufeff"


def looks_like_formula(s: Column) -> Column:
    """Starts with = @ tab CR; or + / - unless the rest is only digits,
    whitespace, '.' and ','."""
    return s.rlike("^[=@\t\r]") | (s.rlike("^[+-]") & ~s.rlike("^[+-](?:[0-9.,]|" + _WS1 + ")*\\z"))


def guard(s: Column) -> Column:
    """Prefix formula-like text with an apostrophe."""
    s = F.coalesce(s.cast("string"), F.lit(""))
    return F.when(looks_like_formula(s), F.concat(F.lit("'"), s)).otherwise(s)


def csv_cell(v: Column, delimiter: str = ",") -> Column:
    """S06 cell: guard, then quote when it holds a quote, the delimiter, CR/LF
    or edge whitespace; quotes doubled; null -> ''."""
    s = guard(v)
    needs = (s.contains('"') | s.contains(delimiter) | s.rlike("[\r\n]") | s.rlike("^" + _WS1) | s.rlike(_WS1 + "\\z"))
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame, cols: list[str], delimiter: str = ",", keep: list[str] = ()) -> DataFrame:
    """One CSV line per row (no line break), plus ``keep`` columns."""
    return df.select(*keep, F.concat_ws(delimiter, *[csv_cell(named(c), delimiter) for c in cols]).alias("line"))


def _formula_name(name: str) -> bool:
    """S09 for a column name on the driver."""
    return bool(re.match(r"[=@\t\r]", name) or re.match(r"[+-]", name) and not re.fullmatch(r"[+-][\d\s.,]*", name))


def csv_header(cols: list[str], delimiter: str = ",") -> str:
    def cell(name: str) -> str:
        s = "'" + name if _formula_name(name) else name
        if '"' in s or delimiter in s or re.search(r"[\r\n]", s) or re.match(r"^\s|.*\s$", s, re.S):
            s = '"' + s.replace('"', '""') + '"'
        return s
    return delimiter.join(cell(c) for c in cols)


def write_csv(df: DataFrame, path: str, cols: list[str], delimiter: str = ",", bom: bool = True,
              order: list[str] | None = None) -> None:
    """CSV text files, CRLF after every line, header first (with the
    BOM), rows in ``order``. The header is a one-row frame unioned in front
    so the write stays a distributed text write."""
    spark = df.sparkSession
    body = csv_lines(df, cols, delimiter, keep=order or [])
    if order:
        body = body.orderBy(*map(named, order))
    head = spark.createDataFrame([((BOM if bom else "") + csv_header(cols, delimiter),)], "line string")
    head.select("line").union(body.select("line")).write.mode("overwrite").option("lineSep", CRLF).text(path)


def tsv_cell(v: Column) -> Column:
    """S07 cell: tab / CR / LF runs -> one space first, then the guard."""
    return guard(F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), "[\t\r\n]+", " "))


def tsv_lines(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Tab-joined lines (joined by '\\n' on output, no BOM); see ``tsv_header``."""
    return df.select(*keep, F.concat_ws("\t", *[tsv_cell(named(c)) for c in cols]).alias("line"))


def tsv_header(cols: list[str]) -> str:
    """The first line, names flattened and guarded as cells are."""
    flat = [re.sub("[\t\r\n]+", " ", c) for c in cols]
    return "\t".join("'" + c if _formula_name(c) else c for c in flat)


def write_tsv(df: DataFrame, path: str, cols: list[str], order: list[str] | None = None) -> None:
    """Header line, then the rows in ``order``."""
    body = tsv_lines(df, cols, keep=order or [])
    if order:
        body = body.orderBy(*map(named, order))
    head = df.sparkSession.createDataFrame([(tsv_header(cols),)], "line string")
    head.union(body.select("line")).write.mode("overwrite").text(path)


def json_objects(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """One JSON object per row keyed by column name; null -> ''."""
    st = F.struct(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in cols])
    return df.select(*keep, F.to_json(st).alias("json"))


def write_json(df: DataFrame, path: str, cols: list[str]) -> None:
    """JSON lines (one object per line)."""
    json_objects(df, cols).write.mode("overwrite").text(path)


def column_letter(i: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 702 -> AAA, and so on: base 26 without
    a zero, one letter for each digit that is left (14 hold any long)."""
    start = F.struct((i + 1).cast("bigint").alias("n"), F.lit("").alias("s"))

    def letter(acc: Column, _: Column) -> Column:
        rest = acc["n"] - 1
        return F.when(acc["n"] <= 0, acc).otherwise(F.struct(
            F.floor(rest / 26).cast("bigint").alias("n"), F.concat(F.char(F.pmod(rest, F.lit(26)) + 65), acc["s"]).alias("s")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, letter)["s"]


_INVALID_XML = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]"
NUMERIC = r"^-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?\z"


def sheet_cells(df: DataFrame, cols: list[str], row_col: str = "row_no") -> DataFrame:
    """Spreadsheet cells of the rows (header is row 1, data from row 2):
    '' -> no cell; numeric unless header; else inline string: cut at 32,767,
    style 0/1 (+2 when formula-like), preserve-space flag, XML-invalid
    characters stripped, & < > \" escaped.
    -> (row, col, ref, kind, style, preserve, text)"""
    arr = F.array(*[F.struct(F.lit(j).alias("j"), F.coalesce(named(c).cast("string"), F.lit("")).alias("v"))
                    for j, c in enumerate(cols)])
    x = df.select((F.col(row_col) + 1).alias("row"), F.explode(arr).alias("c")).select("row", "c.j", "c.v")
    head = df.sparkSession.createDataFrame([(1, j, c) for j, c in enumerate(cols)], "row long, j int, v string")
    x = head.unionByName(x.select(F.col("row").cast("long"), F.col("j").cast("int"), "v")).filter(F.col("v") != "")
    hdr = F.col("row") == 1
    text = F.substring(F.col("v"), 1, rules.CELL_MAX_CHARS)
    esc = F.regexp_replace(text, _INVALID_XML, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    numeric = ~hdr & F.col("v").rlike(NUMERIC)
    style = F.when(hdr, 1).otherwise(0) + F.when(looks_like_formula(text), 2).otherwise(0)
    return x.select(
        "row", F.col("j").alias("col"),
        F.concat(column_letter(F.col("j")), F.col("row").cast("string")).alias("ref"),
        F.when(numeric, "n").otherwise("inlineStr").alias("kind"),
        F.when(numeric, 0).otherwise(style).alias("style"),
        (~numeric & (text.rlike("^" + _WS1) | text.rlike(_WS1 + "\\z"))).alias("preserve"),
        F.when(numeric, F.col("v")).otherwise(esc).alias("text"),
    )


def column_widths(df: DataFrame, cols: list[str], order: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """Max length of the header and of all rows (or the first ``sample``
    rows in ``order``), +2, clamped to 8..60 -> (col, name, width)."""
    head = df if sample is None else df.orderBy(*map(named, order or [])).limit(sample)
    widths = F.array(*[F.struct(F.lit(j).alias("col"), F.lit(c).alias("name"), F.max(F.length(F.coalesce(named(c).cast("string"), F.lit("")))).alias("w"))
                       for j, c in enumerate(cols)])
    out = head.agg(widths.alias("x")).select(F.inline("x"))
    return out.select(F.col("col").cast("int"), "name",
                      F.least(F.lit(60), F.greatest(F.lit(8), F.greatest(F.coalesce("w", F.lit(0)), F.length("name")) + 2)).cast("int").alias("width"))


def export_stem(host: Column, ts: Column, prefix: str = "pagerel") -> Column:
    """Prefix-host-YYYYMMDD-HHMM; 'www.' dropped, other characters
    outside [a-z0-9.-] (case-insensitive) -> '-'; empty parts dropped."""
    h = F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("")), r"^www\.", ""), "(?i)[^a-z0-9.-]+", "-")
    stamp = F.date_format(ts, "yyyyMMdd-HHmm")
    return F.concat_ws("-", F.lit(prefix), F.when(h != "", h), stamp)
