"""Literal cases of the scalar rules, and the kernels against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import geometry as G
from folioscope.operators import kernels as K
from folioscope.operators import pages as P
from folioscope.sources import files
from folioscope.streaming import pages as stream

CASES = {
    T.escape_inline: [("a*b_c\\d", "a\\*b\\_c\\\\d"), ("# x [y] `z` | <", "# x [y] `z` | <"), ("", "")],
    T.title_key: [("Part one", "part one"), ("  1.2  Été -- (x) ", "12 été x"), ("--", "")],
    T.divider_kind: [("* * * *", True), ("———", True), ("-", False), ("•", False), ("===", None), ("~~~", None), ("- a -", None), ("", None), ("  ", None)],
    T.is_chrome_pattern: [
        ("Page 3 of 9", True), ("see page 3", False), ("Vol. 24 of it", True), ("revolt 24", False), ("12", True), ("12345", False), ("MS-2024-07", False),
        ("J. Things 2019, 101–119", True), ("2019, 7", False), ("Downloaded from x", True), ("plain prose", False), ("", False),
    ],
    T.is_caption: [("Figure 7: x", True), ("Fig. 12.", True), ("Figures of speech", False), ("Table (4)", True), ("FIGURE IV", True), ("figure iv", False), ("Eq. (4)", True), ("Photograph 3", False)],
    T.toc_number: [("Introduction 7", 7), ("Conclusion .... 127", 127), ("Chapter 7", None), ("Recall and 3 7 94.2", None), ("Summary of vol 5 12", None), ("Introduction 12345", None)],
    T.is_toc_entry: [("Author's Note ... ix", True), ("Introduction 7", True), ("A xi", False)],
    T.numbered_level: [("1.2.3 Title", 3), ("2. Scope", 1), ("4: x", 1), ("Section 9", 1), ("NZ/AS 3.1 x", 2), ("1.2.3.4.5.6.7 x", 7), ("1..2 x", None), ("A.1 x", None), ("", None)],
    T.is_section_number: [("1.5", True), ("A.2", True), ("Sec. 2", True), ("§4", True), ("§", True), ("IV", False), ("1..2", False), ("AB1", False), ("", False)],
    T.ends_hyphenated: [("architec-", True), ("5-", False), ("-", False), ("café- ", True)],
    T.ends_sentence: [("It ends.", True), ("“so.”", True), ("open (x)", False)],
    T.is_rtl: [("סך הכל 12.34", True), ("Total due 87.75 ILS", False), ("2026-07-27", False)],
    T.is_value_like: [("2.28", True), ("1,240", True), ("2024", False), ("--", True), ("$5", True), ("a.b", False)],
    T.is_page_ref: [("12", True), ("ix", True), ("civil war", False), ("mmmmmmm", False)],
    T.is_bullet_only: [("(1)", True), ("a)", True), ("ab.", False), ("12.", True), ("•", True), ("x", False)],
    T.heading_role: [("H1", 1), ("h6", 6), ("H7", None), ("P", None)],
    T.collapse: [(" a  b \t c ", "a b c"), ("", "")],
    T.code_language: [('{"a": 1}', "json"), ("#include <x>\nstd::y", "cpp"), ("def f():\n  self.x", "python"), ("plain text", None)],
}


@pytest.mark.parametrize("rule", CASES, ids=lambda f: f.__name__)
def test_cases(spark, rule):
    rows = [(k, text, want) for k, (text, want) in enumerate(CASES[rule])]
    got = dict(spark.createDataFrame([r[:2] for r in rows], "k int, line string").select("k", rule(F.col("line"))).collect())
    assert got == {k: want for k, _, want in rows}
    null = spark.createDataFrame([(None,)], "line string").select(rule(F.col("line")).alias("v")).first().v
    assert null in (None, False)


def test_list_markers(spark):
    lines = ["• x", "  12) y z ", "- x", "1234. x", "a. x", "7.", "\uf0b7 x", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, line string").select("k", T.list_marker(F.col("line")).alias("m")).collect()
    assert {r.k: r.m and tuple(r.m) for r in got} == {0: (False, "•", "x"), 1: (True, "12)", "y z"), 2: None, 3: None, 4: None, 5: None, 6: (False, "\uf0b7", "x"), 7: None}


def test_roman_values(spark):
    want = {"i": 1, "iv": 4, "ix": 9, "xiv": 14, "mcmxciv": 1994, "abc": None, "": None}
    got = spark.createDataFrame([(k,) for k in want], "r string").select("r", T.roman_value(F.col("r")).alias("v")).collect()
    assert dict(map(tuple, got)) == want


def test_phrases_in_items():
    one = lambda text, x, y=0.0, w=None: {"text": text, "x": x, "y": y, "width": w or 5.0 * len(text), "height": 10.0, "font_size": 10.0}
    items = [one("hel", 0), one("lo", 16), one("world", 60), one("again", 0, 40.0), one("hello", 50, 40.0)]
    assert [f[4] for f in K.find_phrase(items, "hello")] == [0, 4]
    assert K.find_phrase(items, "hello world") == [(0.0, 0.0, 85.0, 10.0, 0)]
    assert K.find_phrase(items, "WORLD again") == [(0.0, 0.0, 85.0, 50.0, 2)] and K.find_phrase(items, "WORLD", True) == []
    assert K.find_phrase(items, "") == [] and K.find_phrase([], "x") == []


def item(text, x, y, width=None, height=10.0):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width or 5 * len(text)), "height": height, "font_size": height}


def told(lines):
    return [[i["text"] for i in line] for line in lines]


def test_lines_of_items():
    assert told(K.form_lines([item("b", 40, 0), item("a", 0, 0), item("c", 0, 14)])) == [["a", "b"], ["c"]]
    assert told(K.form_lines([item("arch", 0, 0), item("itec", 20, 0), item("ture", 40.05, 0.05)])) == [["architecture"]]  # one run
    assert told(K.form_lines([item("low", 0, 4), item("high", 60, 0)])) == [["low", "high"]]  # tops within each other's line
    assert told(K.form_lines([item("a" * 10, 0, 0), item("over", 10, 4)])) == [["a" * 10], ["over"]]  # they overlap
    assert told(K.form_lines([item("small", 0, 0), item("Tall", 60, 0, height=30.0)])) == [["small"], ["Tall"]]
    assert told(K.form_lines([item("12", 0, 0), item("34", 10.5, 0), item("x", 30, 0), item(",", 35.5, 0)])) == [["12", "34", "x,"]]
    assert told(K.form_lines([item("a", 0, 0), item("b", 5.5, 0)])) == [["a", "b"]] and K.form_lines([]) == []


def test_text_grid():
    lines = K.form_lines([item("name", 10, 0), item("price", 110, 0), item("pen", 10, 12), item("2.50", 110, 12), item("end", 10, 60)])
    assert K.render_lines(lines, 5.0, 10.0) == "name                price\npen                 2.50\n\n\n\n\nend"
    assert K.render_lines(K.form_lines([item("one", 0, 0), item("two", 18, 0)]), 5.0, 10.0) == "one two" and K.render_lines([], 5.0, 10.0) == ""


def test_ordered_lists():
    a, i = "alpha-lower", "roman-lower"
    rows = [(0, 0.0, [(a, 1)]), (1, 20.0, [(a, 9), (i, 1)]), (2, 20.0, [(i, 2)]), (3, 0.0, [(a, 2)]), (4, 0.0, [("alpha-upper", 10)]), (20, 0.0, [(a, 3)]), (30, 0.0, [(a, 1)])]
    assert K.chain_markers(rows) == [0, 1, 2, 3]
    assert K.chain_markers([]) == [] and K.chain_markers([(0, 0.0, [(a, 2)]), (1, 0.0, [(a, 3)])]) == []


def test_best_cut_finds_the_gutter():
    left, right = [(36.0, 280.0, 40)] * 30, [(320.0, 570.0, 40)] * 30
    position, score = K.best_cut(left + right, 36.0, 534.0, 8.0)
    assert 280 <= position <= 320 and score > 15
    assert K.best_cut(left, 36.0, 244.0, 8.0) is None and K.best_cut([], 0.0, 10.0, 8.0) is None and K.best_cut(left, 0.0, 0.0, 8.0) is None
    rng = random.Random(5)
    for _ in range(50):
        spans = [(x, x + rng.uniform(1, 60), rng.randint(1, 9)) for x in (rng.uniform(0, 400) for _ in range(rng.randint(1, 12)))]
        n = int(-(-460 // 2))
        filled = [sum(w for a, b, w in spans if a // 2 <= k < max(-(-b // 2), a // 2 + 1)) for k in range(n)]
        median = sorted(d for d in filled if d)[len([d for d in filled if d]) // 2]
        low = [d <= 0.1 * median for d in filled]
        inside = [k for k in range(n) if not low[k]]
        want = [(a, b) for a, b in zip(inside, inside[1:], strict=False) if b - a - 1 >= 4]
        got = K.best_cut(spans, 0.0, 460.0, 8.0)
        assert (got is None) == (not want) and (got is None or got[0] in [(a + 1 + b) for a, b in want])


def test_page_lists(spark):
    lists = ["1-5,10", "3, 2,2", "5-3", "x", "", "1-100001", "1-2-3", " 7 - 8 ", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "k int, t string").select("k", P.target_pages(F.col("t")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {0: [1, 2, 3, 4, 5, 10], 1: [2, 3], 2: None, 3: None, 4: None, 5: None, 6: None, 7: [7, 8], 8: None}


def test_page_classes(spark):
    rows = [(39, 1, 0), (40, 1, 0), (40, 0, 0), (9, 1, 0), (10, 1, 1), (0, 0, 1), (0, 0, 0)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, p int, i int, t int").select("k", G.page_class(F.col("p"), F.col("i"), F.col("t")).alias("c")).collect()
    assert [r.c for r in sorted(got)] == ["mixed", "mixed", "vector", "raster", "text", "text", "mixed"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.PDF", b"%PDF-1.7"), ("b.txt", b"plain"), ("c", b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + b"pHYs" + (3780).to_bytes(4, "big") * 2 + b"\1")):
        (tmp_path / "in" / name).write_bytes(data)
    found = files.collect_files(spark, str(tmp_path / "in"))
    got = {r.name: r for r in found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), files.is_supported(F.col("path")).alias("ok"), files.guessed_extension(F.col("content")).alias("kind"), files.png_dpi(F.col("content")).alias("dpi")).collect()}
    assert (got["a.PDF"].ok, got["a.PDF"].kind, got["b.txt"].ok, got["b.txt"].kind) == (True, "pdf", False, None)
    assert got["c"].kind == "png" and (got["c"].dpi.x, got["c"].dpi.y) == (96.01, 96.01)
    assert files.collect_files(spark, str(tmp_path / "in"), pattern="*.txt").count() == 1


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(k, "a b\n" * (70 + k), "s") for k in range(4)], "doc_id long, text string, source string")
    docs.repartition(2).write.parquet(str(tmp_path / "docs"))
    query = stream.write_batches(stream.documents(spark, str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "state"), size=1)
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("doc_id").distinct().count() == 4 and out.where("last_page <> first_page").count() == 0
    lines = stream.line_counts(stream.documents(spark, str(tmp_path / "docs")))
    counts = lines.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counted").first().n_lines == sum(71 + k for k in range(4))


def test_late_events_are_left_out(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:05:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0)]
    make = lambda part, name: spark.createDataFrame(part, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / name))
    make(rows, "in/a")
    make([("2024-01-01 00:01:00", "a", 99.0), ("2024-01-01 05:00:00", "a", 8.0)], "in/b")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = stream.event_windows(events).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r.start): r.total for r in spark.table("windows").collect()}
    assert got["2024-01-01 00:00:00"] in (3.0, 102.0) and "2024-01-01 05:00:00" not in got
