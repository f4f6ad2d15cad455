"""Every registered layout query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.operators import layout as L
from folioscope.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(values):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in values)


def test_every_query_finds_something(spark):
    few = {"garbled_scope"}  # needs the larger tables
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - few):
        assert not catalog.QUERIES[name](spark, DATA).isEmpty(), name


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
    have = got.select(columns).collect()
    assert rows(have) == rows(want) and (have or name == "garbled_scope")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_planted_header_and_footer(spark):
    pages = [("s", k, f"Annual Report\nbody {'abcd'[k]}\nmore {'wxyz'[k]}\nlast {'klmn'[k]}\nPage {k + 1} of 4") for k in range(4)]
    docs = spark.createDataFrame(pages, "source string, doc_id long, text string")
    from folioscope.sources import typeset

    left = L.strip_chrome(typeset.lines(docs), 0.5)
    assert {r.line.split()[0] for r in left.collect()} == {"body", "more", "last"}


def test_letterhead_keeps_only_patterns(spark):
    text = "\n".join([f"head {c}" for c in "abcde"] + [f"line {{0}} {k}" for k in "lmnopqrstuvwxyzabcdefghijklmnopqrstuv"])
    docs = spark.createDataFrame([("s", k, text.format("qr"[k])) for k in range(2)], "source string, doc_id long, text string")
    from folioscope.sources import typeset

    keys = {r.key for r in L.header_footer_set(typeset.lines(docs)).where("band = 'header'").collect()}
    assert keys == set()


def test_phrases_behind_other_signs(spark):
    texts = ["say (The cat sat on it", "a\tThe cat sat on", "\u201cThe cat sat on", "xThe cat sat on, The cat sat on", "The cat  sat on", "The cat\nsat on", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "The cat sat on"), (2, "cat"), (3, "The cat"), (4, "t  s"), (5, "")], "item_id long, phrase string")
    got = {(r.doc_id, r.item_id, r.hits) for r in L.phrase_search(docs, phrases).collect()}
    assert got == {(d, i, t.count(p)) for d, t in enumerate(texts) if t for i, p in [(1, "The cat sat on"), (2, "cat"), (3, "The cat"), (4, "t  s")] if p in t}


def test_every_line_and_segment_is_asked(spark):
    assert catalog.QUERIES["nearest_labels"](spark, DATA).agg({"point": "max"}).first()[0] > 60
    assert catalog.QUERIES["assign_links"](spark, DATA).where("link_id % 4 <> 0").count() > 0
