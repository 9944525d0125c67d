import pytest
from pyspark.sql import functions as F

from pagerel.functions import classes as C
from pagerel.functions import text as TX
from pagerel.functions.selectors import css_escape
from pagerel.functions.urls import absolutize, host_of
from pagerel.sources import sinks as S


def one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_css_escape(spark):
    got = one(spark, css_escape, ["123-grid", "a:b.c", "w-1/2", "-5", "-"])
    assert got == ["\\31 23-grid", "a\\:b\\.c", "w-1\\/2", "-\\35 ", "\\-"]


def test_class_kinds(spark):
    toks = ["active", "is-open", "css-1q2w3e", "Card_title__a1B2c", "kQXRfa", "mt-4", "md:flex", "product-card", "price"]
    got = one(spark, C.class_kind, toks)
    assert got == ["state", "state", "dynamic", "dynamic", "dynamic", "utility", "utility", "semantic", "semantic"]


def test_stable_ids(spark):
    got = one(spark, C.is_stable_id, ["main", "123", "ember123", "a1b2c3d4-0000", "react-x", "app", "x9Kq2Lm"])
    assert got == [True, False, False, False, False, True, False]


def test_clean_and_match_text(spark):
    assert one(spark, TX.clean, ["  a  b​\tc  "]) == ["a b c"]
    assert one(spark, TX.match_text, ["  a  b \n c "]) == ["a  b c"]


def test_fnv(spark):
    assert one(spark, TX.fnv1a36, [""]) == ["ztntfp"]
    assert one(spark, TX.fnv1a36, ["abc"]) == ["7aigaz"]


def test_value_kinds(spark):
    got = one(spark, TX.value_kind, ["$10.00", "CHF 12", "a@b.co", "+1 (555) 123-4567", "4.5 / 5", "42%", "hello"])
    assert got == ["Price", "Price", "Email", "Phone", "Rating", "Number", "Text"]


def test_column_letters(spark):
    got = one(spark, S.column_letter, [0, 25, 26, 701, 702], "int")
    assert got == ["A", "Z", "AA", "ZZ", "AAA"]


def test_csv_and_guard(spark):
    df = spark.createDataFrame([("Widget, large", 'He said "hi"', "line1\nline2"), ("=SUM(A1)", "+1 (555)", "@home"),
                                ("-5", " padded ", None)], "a string, b string, c string")
    lines = [r.line for r in S.csv_lines(df, ["a", "b", "c"]).collect()]
    assert lines[0] == '"Widget, large","He said ""hi""","line1\nline2"'
    assert lines[1] == "'=SUM(A1),'+1 (555),'@home"
    assert lines[2] == '-5," padded ",'
    assert S.csv_header(["=Name", "Price"]) == "'=Name,Price"


def test_tsv(spark):
    df = spark.createDataFrame([("a\tb", "+42", "-SUM(A1)")], "a string, b string, c string")
    assert S.tsv_lines(df, ["a", "b", "c"]).first().line == "a b\t+42\t'-SUM(A1)"


def test_sheet_cells(spark):
    df = spark.createDataFrame([(1, "42", "007", " padded "), (2, "3.14", "=1+1", "x\u0001y")], "row_no long, a string, b string, c string")
    cells = {r.ref: r for r in S.sheet_cells(df, ["a", "b", "c"]).collect()}
    assert cells["A2"].kind == "n" and cells["A3"].kind == "n"
    assert cells["B2"].kind == "inlineStr" and cells["B2"].text == "007"
    assert cells["C2"].preserve
    assert cells["C3"].text == "xy"
    assert cells["B3"].style == 2 and cells["A1"].style == 1


def test_urls(spark):
    df = spark.createDataFrame([("../item/7?x=1", "https://shop.example/catalog/list"), ("/Ünï", "http://H.example/a"),
                                ("", "http://h/"), ("#top", "http://h/a/b?q=1"), ("//cdn.example/x", "https://h/")],
                               "h string, b string")
    got = [r[0] for r in df.select(absolutize(F.col("h"), F.col("b"))).collect()]
    assert got == ["https://shop.example/item/7?x=1", "http://h.example/%C3%9Cn%C3%AF", "", "http://h/a/b?q=1#top",
                   "https://cdn.example/x"]
    assert one(spark, host_of, ["https://www.Shop.example:8080/x", "nope"]) == ["shop.example", ""]
