"""Queries of styles, rules, uncovered paths, joined blocks, HTML tables and heading sources."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import kernels as K
from folioscope.operators import paged as G
from folioscope.operators import pages as P
from folioscope.plans import more as M
from folioscope.plans import pages as Q
from folioscope.plans import specimens as X
from folioscope.plans.registry import query, register
from folioscope.sources import typeset as S

FONTS = "array('Arial-Bold', 'Times-Italic', 'CourierNew', 'Helvetica-BoldOblique', 'Menlo', 'Georgia', 'Hackney', 'Semibold X')[CAST(id % 8 AS INT)]"
FONTS_SQL = "['Arial-Bold', 'Times-Italic', 'CourierNew', 'Helvetica-BoldOblique', 'Menlo', 'Georgia', 'Hackney', 'Semibold X'][id % 8 + 1]"
FLAGS = "CASE id % 9 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 262144 WHEN 3 THEN 65 ELSE 32 END"
WEIGHT = "CASE WHEN c % 3 = 0 THEN 400 WHEN c % 3 = 1 THEN 600 END"


def _has(names: list[str]) -> str:
    return "(" + " OR ".join(f"contains({FONTS_SQL}, '{n}')" for n in names) + ")"


font, flags, weight = (lambda: F.expr(FONTS)), (lambda: F.expr(FLAGS).cast("int")), (lambda: F.expr(WEIGHT))
M.small("is_bold_item", lambda: T.is_bold(font(), flags(), weight()), f"({_has(T.BOLD_NAMES)} OR id % 9 = 2 OR c % 3 = 1)")
M.small("is_italic_item", lambda: T.is_italic(font(), flags()), f"({_has(T.ITALIC_NAMES)} OR id % 9 IN (1, 3))")
M.small("is_mono_item", lambda: T.is_mono(font(), flags()), f"({_has(T.MONO_NAMES)} OR id % 9 IN (0, 3))")


def scalar(name, column, expression):
    register(name, lambda spark, d: X.specimens(spark, d).select("id", column().alias("value")), f"{X.SQL} SELECT id, {expression} AS value FROM s")


line, after = (lambda: F.col("line")), (lambda: F.col("after"))
scalar("apply_link", lambda: T.link(line(), after()), "'[' || line || CASE WHEN regexp_matches(after, '[ \t()]') THEN '](<' || after || '>)' ELSE '](' || after || ')' END")
scalar(
    "apply_style", lambda: T.style(F.when(F.col("n") % 5 == 0, F.concat(line(), F.lit("``x"))).otherwise(line()), F.col("n") % 2 == 0, F.col("n") % 3 == 0, F.col("n") % 5 < 2, F.col("n") % 7 == 0),
    """(SELECT CASE WHEN n % 7 = 0 THEN '~~' || t || '~~' ELSE t END FROM (SELECT CASE WHEN n % 5 = 0 THEN '``` ' || line || '``x ```' WHEN n % 5 = 1 THEN '`' || line || '`'
    ELSE repeat('*', (n % 2 = 0)::INT * 2 + (n % 3 = 0)::INT) || line || repeat('*', (n % 2 = 0)::INT * 2 + (n % 3 = 0)::INT) END AS t))""",
)
scalar("normalize_punct", lambda: T.plain_punctuation(F.concat(line(), F.lit("‘a’ “b” „c‟ −1 ‐2"))), """regexp_replace(regexp_replace(regexp_replace(line || '‘a’ “b” „c‟ −1 ‐2', '[‘’‚′]', chr(39), 'g'), '[“”„″]', '"', 'g'), '[\\x{2010}-\\x{2015}\\x{2212}]', '-', 'g')""")
scalar("compress_wide_spaces", lambda: T.narrow_spaces(F.replace(line(), F.lit(" "), F.lit("    ")), 3, 2), "regexp_replace(replace(line, ' ', '    '), ' {3,}', '  ', 'g')")
scalar(
    "clean_ocr_table_artifacts", lambda: T.clean_ocr(F.concat(F.when(F.col("n") % 2 == 0, "|(").otherwise("["), line(), F.when(F.col("n") % 3 == 0, ")|").otherwise("]"))),
    r"""(SELECT CASE WHEN core = '' THEN t WHEN num AND strpos(t, core) > 1 AND t[strpos(t, core) - 1] = '(' AND t[strpos(t, core) + length(core)] = ')' THEN '(' || core || ')' WHEN num THEN core ELSE t END
    FROM (SELECT *, regexp_full_match(core, '[-0-9,. %+*/]+') OR core IN ('N/A', 'Z', '-') AS num FROM (SELECT t, trim(regexp_replace(regexp_replace(t, '^[|\[\](){}]+', ''), '[|\[\](){}]+$', '')) AS core FROM
    (SELECT trim(CASE WHEN n % 2 = 0 THEN '|(' ELSE '[' END || line || CASE WHEN n % 3 = 0 THEN ')|' ELSE ']' END) AS t))))""",
)
scalar("parse_heading", lambda: T.markdown_heading(F.concat(F.expr("repeat('#', CAST(n % 9 AS INT))"), F.when(F.col("n") % 4 == 0, "").otherwise(" "), line()))["level"], "CASE WHEN n % 9 BETWEEN 1 AND 6 AND (n % 4 > 0 OR line[1] = ' ') AND NOT starts_with(line, '#') THEN (n % 9)::INT WHEN n % 9 BETWEEN 1 AND 5 AND starts_with(line, '#') AND n % 4 > 0 THEN (n % 9)::INT WHEN n % 9 = 6 AND starts_with(line, '#') AND n % 4 > 0 THEN 6 END")
scalar("content_length", lambda: T.content_length(F.concat(line(), F.lit("\n```text\n-----\n a b\n```"))), f"length(regexp_replace(replace(line, '-----', ''), '{T.WS}', '', 'g')) + 2")
scalar("normalize_outline_text", lambda: F.lower(T.collapse(line())), f"lower({X.COLLAPSE})")

STROKES = "strokes AS (SELECT doc_id, page_number, line_no, min(x) AS sx1, min(y) + 10 + line_no % 9 AS sy1, min(x) + 150 + line_no % 5 * 40 AS sx2, min(y) + 10 + line_no % 9 + line_no % 2 AS sy2, line_no % 3 + 0.5 AS stroke FROM items GROUP BY doc_id, page_number, line_no)"


@query(f"""{Q.LINES}, {STROKES}, w AS (SELECT DISTINCT doc_id, page_number, (sy1 + sy2) / 2 AS y, least(sx1, sx2) AS x0, greatest(sx1, sx2) AS x1 FROM strokes WHERE abs(sy2 - sy1) <= 2 AND stroke <= 2 AND abs(sx2 - sx1) >= 0.3::DOUBLE * 612)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = w.doc_id AND r.page_number = w.page_number AND abs(w.y - (r.y + r.height)) < 3 AND w.x0 >= r.x - 2 AND w.x1 <= r.x + r.width + 2)""")
def detect_horizontal_rules(spark, d):
    lines = S.by_page(S.read(spark, d, "documents"), K.line_corners, "line_no int, x double, y double")
    strokes = lines.selectExpr(
        *P.PAGE, "x AS sx1", "y + 10 + line_no % 9 AS sy1", "x + 150 + line_no % 5 * 40 AS sx2", "y + 10 + line_no % 9 + line_no % 2 AS sy2", "CAST(line_no % 3 + 0.5 AS DOUBLE) AS stroke",
    )
    return P.horizontal_rules(strokes, Q._lines(spark, d), S.WIDTH)


@query(f"""{Q.ITEMS}, paths AS (SELECT doc_id, page_number, line_no AS path, min(x) + 20 AS px, min(y) - 5 AS py, 200.0::DOUBLE AS pw, (12 + line_no % 4 * 9)::DOUBLE AS ph FROM items WHERE line_no % 3 = 0 GROUP BY ALL),
c AS (SELECT p.doc_id, p.page_number, p.path, any_value(pw * ph) AS area, coalesce(sum((least(px + pw, x + width) - greatest(px, x)) * (least(py + ph, y + height) - greatest(py, y))) FILTER (x IS NOT NULL), 0) AS covered FROM paths p LEFT JOIN items i ON i.doc_id = p.doc_id AND i.page_number = p.page_number
  AND least(px + pw, x + width) > greatest(px, x) AND least(py + ph, y + height) > greatest(py, y) GROUP BY ALL) SELECT doc_id, page_number, sum(greatest(0, area - covered))::DOUBLE AS uncovered FROM c GROUP BY ALL""")
def uncovered_path_area(spark, d):
    return S.by_page(S.read(spark, d, "documents"), _uncovered, "uncovered double")


def _uncovered(words: pa.Table, starts: np.ndarray) -> pa.Table:
    """A path from every third line."""
    lines = K.line_corners(words, starts)
    of = G.groups(G.first_rows(lines, P.PAGE), lines.num_rows)
    line = G.array(lines, "line_no")
    own = np.flatnonzero(line % 3 == 0)
    box = (G.array(lines, "x")[own] + 20, G.array(lines, "y")[own] - 5, np.full(len(own), 200.0), 12.0 + line[own] % 4 * 9)
    pages, areas = K.uncovered(of[own], box, G.groups(starts, words.num_rows), tuple(G.array(words, c) for c in ("x", "y", "width", "height")), len(starts))
    return pa.table(G.keyed(words, P.PAGE, starts[pages]) | {"uncovered": pa.array(areas)})


@query(f"""{X.SQL}, b AS (SELECT id % 80 AS doc, id, CASE WHEN id % 7 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, line FROM s WHERE n % 2 = 0 OR right(line, 1) = '-'),
j AS (SELECT *, kind = 'paragraph' AND lag(kind) OVER w = 'paragraph' AND regexp_matches(lag(line) OVER w, '\\pL-{T.WS}*$') AND regexp_matches(line, '^{T.WS}*\\p{{Ll}}') AS joins FROM b WINDOW w AS (PARTITION BY doc ORDER BY id)),
r AS (SELECT *, sum((NOT coalesce(joins, false))::INT) OVER (PARTITION BY doc ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM j), l AS (SELECT *, lead(id) OVER (PARTITION BY doc, run ORDER BY id) IS NULL AS last_one FROM r)
SELECT doc, min(id) AS idx, any_value(kind) AS kind, string_agg(CASE WHEN last_one THEN line ELSE regexp_replace(line, '-{T.WS}*$', '') END, '' ORDER BY id) AS text FROM l GROUP BY doc, run""")
def splice_soft_hyphens(spark, d):
    own = X.specimens(spark, d).where("n % 2 = 0 OR right(line, 1) = '-'")
    blocks = own.select(F.expr("id % 80").alias("doc"), F.col("id").alias("idx"), F.expr("CASE WHEN id % 7 = 0 THEN 'heading' ELSE 'paragraph' END").alias("kind"), F.col("line").alias("text"))
    return P.splice_soft_hyphens(blocks, "doc")


@query("""WITH c AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderkey, o_orderpriority FROM orders),
r AS (SELECT t, r, chr(10) || '<tr>' || chr(10) || '<' || CASE WHEN r < 1 THEN 'th' ELSE 'td' END || CASE WHEN o_orderkey % 3 = 0 THEN ' colspan="2"' ELSE '' END || '>' || o_orderkey || '</' || CASE WHEN r < 1 THEN 'th' ELSE 'td' END || '>' || chr(10) ||
  '<' || CASE WHEN r < 1 THEN 'th' ELSE 'td' END || '>&lt;' || o_orderpriority || '&gt; &amp; x</' || CASE WHEN r < 1 THEN 'th' ELSE 'td' END || '>' || chr(10) || '</tr>' AS line FROM c)
SELECT t, '<table>' || string_agg(line, '' ORDER BY r) || chr(10) || '</table>' AS html FROM r GROUP BY t""")
def render_html_table(spark, d):
    own = Q.books(spark, d).selectExpr("doc_id AS t", "page_number - 1 AS row", "o_orderkey", "o_orderpriority")
    each = "array(named_struct('col', 0, 'text', CAST(o_orderkey AS STRING), 'colspan', CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, 'rowspan', 1), named_struct('col', 1, 'text', '<' || o_orderpriority || '> & x', 'colspan', 1, 'rowspan', 1))"
    return P.html_tables(own.select("t", "row", F.explode(F.expr(each)).alias("e")).select("t", "row", "e.*"), ["t"])


@query(f"""{Q.LINES}, o AS (SELECT doc_id, page_number, band AS entry, CASE WHEN band % 3 = 0 THEN text[:12] ELSE text || ' and more' END AS title, band % 4 + 1 AS level, y + band % 6 * 4 AS y_top FROM ruled WHERE band % 2 = 0),
m AS (SELECT r.doc_id, r.page_number, r.band, entry, level FROM (SELECT *, lower(trim(regexp_replace(text, ' +', ' ', 'g'))) AS key FROM ruled) r JOIN (SELECT *, lower(trim(regexp_replace(title, ' +', ' ', 'g'))) AS okey FROM o) o ON o.doc_id = r.doc_id AND o.page_number = r.page_number
  AND abs(r.y - y_top) <= 1.5 * height AND key <> '' AND okey <> '' AND (starts_with(key, okey) OR starts_with(okey, key)))
SELECT doc_id, page_number, band, arg_min(level, entry)::INT AS level FROM m GROUP BY ALL""")
def outline_heading_level(spark, d):
    lines = Q._lines(spark, d)
    outline = lines.where("band % 2 = 0").selectExpr("doc_id", "page_number", "band AS entry", "CASE WHEN band % 3 = 0 THEN left(text, 12) ELSE text || ' and more' END AS title", "band % 4 + 1 AS level", "y + band % 6 * 4 AS y_top")
    return P.outline_levels(lines, outline, S.HEIGHT)


@query(f"""{Q.BANDS}, l AS (SELECT DISTINCT doc_id, page_number, band, band % 50 AS mcid FROM banded), n AS (SELECT doc_id, page_number, k AS node, CASE k % 4 WHEN 0 THEN 'H' || (k % 7)::STRING WHEN 1 THEN 'P' WHEN 2 THEN ' h2 ' ELSE 'Figure' END AS role, unnest([k, k + 3, k * 2]) AS mcid
  FROM (SELECT DISTINCT doc_id, page_number FROM banded), (SELECT unnest(range(12)) AS k)),
m AS (SELECT l.*, node, right(trim(role), 1)::INT AS level FROM l JOIN n USING (doc_id, page_number, mcid) WHERE regexp_full_match(trim(role), '[Hh][1-6]')) SELECT doc_id, page_number, band, arg_min(level, node) AS level FROM m GROUP BY ALL""")
def struct_heading_level(spark, d):
    banded = P.band_lines(Q.items(spark, d))
    lines = banded.select(*P.PAGE, "band").distinct().withColumn("mcid", F.expr("CAST(band % 50 AS BIGINT)"))
    nodes = banded.select(*P.PAGE).distinct().withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    role = F.expr("CASE node % 4 WHEN 0 THEN 'H' || CAST(node % 7 AS STRING) WHEN 1 THEN 'P' WHEN 2 THEN ' h2 ' ELSE 'Figure' END")
    return P.structure_levels(lines, nodes.select(*P.PAGE, "node", role.alias("role"), F.expr("array(node, node + 3, node * 2)").alias("mcids")))
