"""Registered queries of the layout operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import layout as L
from folioscope.plans import more, pages, rest, shapes, styles  # noqa: F401  register their queries
from folioscope.plans import specimens as X
from folioscope.plans.registry import ORACLES, QUERIES, query
from folioscope.sources import typeset as S

#: A share low enough that running lines of these tables repeat often enough to count.
SHARE = 0.02


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.lines(S.read(spark, d, "documents"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return S.items(S.read(spark, d, "documents"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["strip_chrome"](spark, sf_dir)


L1, I1, G1 = ("WITH " + x.strip() for x in (S.LINES_SQL, S.ITEMS_SQL, S.SEGMENTS_SQL))
KEY = f"regexp_replace(lower({X.COLLAPSE}), '[0-9]+', '#', 'g')"
PATTERN = X.CHROME
KEYS = f"""{L1}, banded AS (
  SELECT *, {KEY} AS key, {PATTERN} AS p, 'header' AS band FROM lines WHERE line_no / n_lines <= 0.12
  UNION ALL SELECT *, {KEY}, {PATTERN}, 'footer' FROM lines WHERE (line_no + 1) / n_lines >= 0.88
), total AS (SELECT source, count(DISTINCT doc_id) AS all_pages FROM lines GROUP BY source
), keys AS (
  SELECT source, band, key, count(DISTINCT doc_id) AS pages, bool_or(p) AS is_pattern FROM banded JOIN total USING (source)
  WHERE key <> '' AND all_pages >= 2 GROUP BY source, band, key, all_pages HAVING count(DISTINCT doc_id) >= greatest(2, ceil(all_pages * {SHARE}))
), chosen AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN is_pattern THEN 0 ELSE 1 END) OVER (PARTITION BY source, band) AS others FROM keys) WHERE others <= 3 OR is_pattern
)"""
LETTERS = r"length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
VOWELS = r"length(regexp_replace(text, '[^AEIOUaeiou]', '', 'g'))"


@query(f"{L1} SELECT doc_id, line_no, length(line)::INT AS n_chars FROM lines")
def typeset_lines(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", F.length("line").alias("n_chars"))


@query(f"{I1} SELECT * FROM items")
def typeset_items(spark, d):
    return _items(spark, d)


@query(f"{KEYS} SELECT source, band, key, pages, is_pattern FROM keys")
def repetition_keys(spark, d):
    return L.repetition_keys(_lines(spark, d), SHARE)


@query(f"{KEYS} SELECT source, band, key, pages, is_pattern FROM chosen")
def header_footer_set(spark, d):
    return L.header_footer_set(_lines(spark, d), SHARE)


@query(f"""{KEYS} SELECT source, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines l
WHERE NOT ((line_no / n_lines <= 0.12 OR (line_no + 1) / n_lines >= 0.88)
  AND EXISTS (SELECT 1 FROM chosen c WHERE c.source = l.source AND c.key = {KEY})) GROUP BY source""")
def strip_chrome(spark, d):
    body = L.strip_chrome(_lines(spark, d), SHARE)
    return body.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"{L1} SELECT doc_id, line_no FROM lines WHERE {PATTERN}")
def chrome_pattern_lines(spark, d):
    return _lines(spark, d).where(T.is_chrome_pattern(F.col("line"))).select("doc_id", "line_no")


@query(f"{I1} SELECT doc_id, page_number, line_no, word_no, text FROM items WHERE {LETTERS} >= 10 AND {VOWELS} * 10 < {LETTERS}")
def garbled_items(spark, d):
    return L.garbled_items(_items(spark, d)).select("doc_id", "page_number", "line_no", "word_no", "text")


@query(f"""{I1}, fonts AS (SELECT doc_id, page_number, font_name, sum({LETTERS}) AS n, sum({VOWELS}) AS v FROM items GROUP BY ALL),
marked AS (SELECT *, sum(n) OVER w AS pn, sum(v) OVER w AS pv FROM fonts WINDOW w AS (PARTITION BY doc_id, page_number))
SELECT DISTINCT doc_id, page_number, CASE WHEN pn >= 30 AND pv * 5 < pn THEN 'page' ELSE font_name END AS scope FROM marked
WHERE (pn >= 30 AND pv * 5 < pn) OR (n >= 30 AND v * 5 < n AND n >= ceil(0.15 * pn))""")
def garbled_scope(spark, d):
    return L.garbled_scope(_items(spark, d))


BODY = f"""{I1}, sized AS (SELECT doc_id, round(font_size * 100) AS key, sum(length(text)) AS weight FROM items GROUP BY ALL),
body AS (SELECT doc_id, max(key) / 100 AS body_size FROM (SELECT *, max(greatest(weight, 1)) OVER (PARTITION BY doc_id) AS most FROM sized)
  WHERE weight >= floor(most * 0.5::DOUBLE) GROUP BY doc_id)"""


@query(f"{BODY} SELECT * FROM body")
def body_size(spark, d):
    return L.body_size(_items(spark, d))


@query(f"""{I1}, dup AS (SELECT *, line_no * 10000 + word_no * 2 AS idx FROM items UNION ALL BY NAME
  SELECT * REPLACE (x + 1 AS x, y + 1 AS y), line_no * 10000 + word_no * 2 + 1 AS idx FROM items WHERE word_no % 6 = 0)
SELECT doc_id, page_number, count(*) AS kept, sum(idx)::BIGINT AS idx_sum FROM dup a WHERE NOT EXISTS (
  SELECT 1 FROM dup b WHERE a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.idx > a.idx
    AND least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) AND least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y)
    AND (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) > 0.5 * least(a.width * a.height, b.width * b.height)
    AND (a.text = b.text OR greatest(a.width * a.height, b.width * b.height) <= 5 * least(a.width * a.height, b.width * b.height)))
GROUP BY doc_id, page_number""")
def overlap_dedup(spark, d):
    kept = L.overlap_dedup(S.shifted_copies(_items(spark, d).select("doc_id", "page_number", "line_no", "word_no", "text", "x", "y", "width", "height")), together=True)
    return kept.groupBy("doc_id", "page_number").agg(F.count("*").alias("kept"), F.sum("idx").cast("long").alias("idx_sum"))


@query(f"{I1} SELECT doc_id, page_number, line_no, word_no FROM items WHERE x >= 61.2::DOUBLE AND x + width <= 550.8::DOUBLE AND y >= 79.2::DOUBLE AND y + height <= 712.8::DOUBLE")
def crop_filter(spark, d):
    return L.crop(_items(spark, d), 612.0, 792.0, 0.1, 0.1, 0.1, 0.1).select("doc_id", "page_number", "line_no", "word_no")


LINKS = "SELECT doc_id, page_number, line_no AS link_id, min(x) AS lx, min(y) AS ly, 120.0 AS lw, 12.0 AS lh FROM items GROUP BY doc_id, page_number, line_no"


@query(f"""{I1}, links AS ({LINKS}) SELECT i.doc_id, i.page_number, i.line_no, i.word_no, min(link_id) AS link_id FROM items i JOIN links l
ON i.doc_id = l.doc_id AND i.page_number = l.page_number AND x + width / 2 BETWEEN lx AND lx + lw AND y + height / 2 BETWEEN ly AND ly + lh GROUP BY ALL""")
def assign_links(spark, d):
    """A link from every line."""
    items = _items(spark, d)
    links = items.groupBy("doc_id", "page_number", F.col("line_no").alias("link_id")).agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    return L.assign_links(items, links.withColumns({"lw": F.lit(120.0), "lh": F.lit(12.0)}))


@query(r"""WITH p AS (SELECT item_id, regexp_extract(text, '^[^\n]*') AS phrase FROM benchmark)
SELECT doc_id, item_id, ((length(d.text) - length(replace(d.text, phrase, ''))) // length(phrase))::BIGINT AS hits FROM documents d JOIN p ON contains(d.text, phrase)
WHERE phrase <> ''""")
def phrase_search(spark, d):
    """The whole first line of each item, wherever it is in a text."""
    phrases = S.read(spark, d, "benchmark").select("item_id", F.regexp_extract("text", "^[^\n]*", 0).alias("phrase"))
    return L.phrase_search(S.read(spark, d, "documents"), phrases)


@query(f"""{G1}, k AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM segments),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY length DESC, idx) AS place FROM k
  WHERE length >= 5 AND greatest(x1, x2) >= 0 AND least(x1, x2) <= 400 AND greatest(y1, y2) >= 0 AND least(y1, y2) <= 400)
SELECT page, idx, length FROM r WHERE place <= 50""")
def segments_preview_topk(spark, d):
    return L.segments_preview(S.segments(S.read(spark, d, "lineitem")))


@query(f"""{G1}, pts AS (SELECT page, idx AS point, (x1 + x2) / 2 + 3 AS px, (y1 + y2) / 2 + 2 AS py FROM segments),
n AS (SELECT p.page, point, idx, x1, y1, px, py, x2 - x1 AS dx, y2 - y1 AS dy FROM pts p JOIN segments s ON p.page = s.page
  AND px BETWEEN least(x1, x2) - 40 AND greatest(x1, x2) + 40 AND py BETWEEN least(y1, y2) - 40 AND greatest(y1, y2) + 40),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) ELSE 0.0::DOUBLE END AS t FROM n),
e AS (SELECT *, round(sqrt((px - x1 - t * dx) * (px - x1 - t * dx) + (py - y1 - t * dy) * (py - y1 - t * dy)), 6) AS distance FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY page, point ORDER BY distance, idx) AS k FROM e WHERE distance <= 40)
SELECT page, point, idx, distance, round(100 * (1 - distance / 40))::INT AS confidence FROM b WHERE k = 1""")
def nearest_labels(spark, d):
    """A point from every segment."""
    segments = S.segments(S.read(spark, d, "lineitem"))
    points = segments.selectExpr("page", "idx AS point", "(x1 + x2) / 2 + 3 AS px", "(y1 + y2) / 2 + 2 AS py")
    return L.nearest_segments(points, segments)
