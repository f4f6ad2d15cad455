"""Kernels over whole pages: against plain loops, and what their queries move."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import kernels as K
from folioscope.operators import layout as L
from folioscope.operators import marks as M
from folioscope.operators import paged as G
from folioscope.operators import pages as P
from folioscope.operators import tables as B
from folioscope.plans import catalog
from folioscope.sources import typeset as S

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_not_dealt_out(spark):
    told = plan(catalog.QUERIES["typeset_items"](spark, DATA))
    assert "Window" not in told and "Sort" not in told and told.count("RepartitionByExpression") == 1


def test_words_of_odd_texts(spark):
    texts = [None, "", "\n\n", "  a  b", "x" * 90 + " y\n" + "é 😀 z", " ".join(["ab"] * 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.page_number, r.line_no, r.word_no, r.text, r.x, r.y, r.width) for r in S.items(docs).collect()}
    want = set()
    for d, t in enumerate(texts):
        row, rows = -1, None
        for ln, line in enumerate((t or "").split("\n")):
            off, rows = 0, None
            for k, w in enumerate(line.split(" ")):
                if w:
                    row, rows = row + (off // 80 != rows), off // 80
                    want.add((d, row // 60 + 1, ln, k, w, 36.0 + 6 * (off % 80), 36.0 + 12 * (row % 60), 6.0 * len(w)))
                    off += len(w) + 1
    assert got == want


def test_overlaps_by_loop(spark):
    rng = random.Random(7)
    rows = [(d, 1, k, rng.choice(["a", "b", "cc"]), rng.random() * 200, rng.random() * 300, *((500.0, 900.0) if k % 20 == 0 else (20.0, 10.0)), 51.0 if k % 10 == 3 else None) for d in range(5) for k in range(120)]
    made = spark.createDataFrame(rows, "doc_id long, page_number int, idx int, text string, x double, y double, width double, height double, rotation double")
    own = {(r[0], r[2]): r for r in rows}

    def covered(a, b):
        ix, iy = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]), min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
        small, large = sorted((a[6] * a[7], b[6] * b[7]))
        return a[8] is b[8] is None and ix > 0 and iy > 0 and ix * iy > 0.5 * small and (a[3] == b[3] or large <= 5 * small)

    want = {(d, k) for d, k in own if not any(covered(own[d, k], own[d, m]) for m in range(k + 1, 120))}
    assert {(r.doc_id, r.idx) for r in L.overlap_dedup(made).collect()} == want and len(want) < 600
    told = plan(catalog.QUERIES["overlap_dedup"](spark, DATA))
    assert "Join" not in told and told.count("RepartitionByExpression") == 1


def test_circle_means_are_worked_out_once(spark):
    shown = plan(catalog.QUERIES["circularity"](spark, DATA))
    assert shown.count("aggregate(") <= 4


def test_page_kernels_by_loop(spark):
    """Plain, crowded and lone-item pages; words are dealt out and come back in no order."""
    rng, rows = random.Random(3), []
    for d in range(40):
        for k in range(1 if d == 0 else 60):
            text = rng.choice(["the", "of", "end ", "12", "a", "othe", "\u03a3o"])
            if d % 2:  # set in rows
                x, y, h = 30.0 + k % 6 * 60 + (k // 6 % 3) * 7, 20.0 + k // 6 * 14 + (40 if k > 30 else 0), 10.0
            else:
                x, y, h = rng.random() * 300, rng.choice([10.0, 10.05, 14.0, 30.0, 62.0, 90.5]), rng.choice([0.5, 9.0, 10.0, 30.0])
            rows.append((d, 1, k // 6, k % 6, text, x, y, 6.0 * len(text), h, rng.choice([None, 10.0, 12.0])  if d % 4 == 0 else 10.0))
    names = "doc_id long, page_number int, line_no int, word_no int, text string, x double, y double, width double, height double, font_size double"
    made = spark.createDataFrame(rows, names).orderBy("text", "x", "word_no", "line_no", "doc_id")
    keys = [c.split()[0] for c in names.split(", ")]
    pages = {d: [dict(zip(keys, r, strict=True)) for r in rows if r[0] == d] for d in range(40)}
    grid = {r.doc_id: (r.n_lines, r.text) for r in K.project_to_grid(made).collect()}
    found = {(r.doc_id, r.phrase, r.x, r.y, r.width, r.height) for r in K.search_items(made, ["the of", "END", "\u03c3o", ""]).collect()}
    cuts = {(r.doc_id, r.axis): (r.position, r.score) for r in K.first_cuts(made).collect()}
    want = set()
    for d, own in pages.items():
        lines = K.form_lines(own)
        assert d % 2 == 0 or grid[d] == (len(lines), K.render_lines(lines, K._middle([i["width"] / len(i["text"]) for i in own]), K._middle([i["height"] for i in own])))
        assert grid[d][0] == len(lines) or d % 2 == 0
        want |= {(d, p, *place[:4]) for p in ("the of", "END", "\u03c3o") for place in K.find_phrase(own, p)}
        tall = sorted(i["height"] for i in own)[len(own) // 2]
        for axis, c, s, least in (("vertical", "x", "width", 8.0), ("horizontal", "y", "height", 1.4 * tall)):
            low = min(i[c] for i in own)
            cut = K.best_cut([(i[c], i[c] + i[s], len(i["text"])) for i in own], low, max(i[c] + i[s] for i in own) - low, least)
            assert cuts.get((d, axis)) == cut
    assert found == want and want and cuts


def test_long_lists_are_linear():
    began = time.process_time()
    kept = K.chain_markers([(20 * n, 0.0, [("alpha_lower", 1)]) for n in range(60000)])
    assert kept == [] and time.process_time() - began < 5


def test_lines_and_rows_in_one_pass(spark):
    """The kernels tell what the relational operators do, on pages whose tops and sizes mix."""
    rng, rows = random.Random(5), []
    for d in range(12):
        for k in range(50):
            text = rng.choice(["a", "bc d", "  ", "e\tf", "ghi"])
            rows.append((d % 4, d // 4 + 1, k // 8, k % 8, text, rng.random() * 500, k // 8 * 12 + rng.random() * 3, 5.0 * len(text), rng.choice([0.4, 8.0, 30.0]), rng.choice([9.0, 10.0, 14.0])))
    made = spark.createDataFrame(rows, "doc_id long, page_number int, line_no int, word_no int, text string, x double, y double, width double, height double, font_size double")
    banded = P.band_lines(made)
    lines, cells = P.lines_of(banded), P.split_cells(banded)
    near = lambda frame, columns: sorted(str(tuple([round(v, 9) for v in x] if isinstance(x, list) and x and isinstance(x[0], float) else round(x, 9) if isinstance(x, float) else x for x in r)) for r in frame.select(columns).collect())
    assert near(K.lines_of(made), lines.columns) == near(lines, lines.columns)
    rows_ = B.rows_of(cells, lines)
    assert near(K.table_rows(made), rows_.columns) == near(rows_, rows_.columns)


def test_tables_and_components_travel_once(spark):
    for name, most in (("union_find", 1), ("detect_figure_rects", 1), ("row_spacing_cv", 0)):
        told = plan(catalog.QUERIES[name](spark, DATA))
        assert "Join" not in told and told.count("RepartitionByExpression") == most, name
    assert "cell" in plan(catalog.QUERIES["outline_heading_level"](spark, DATA))
    for name in ("paragraph_flow", "heading_map", "detect_horizontal_rules"):
        assert plan(catalog.QUERIES[name](spark, DATA)).count("MapInArrow") >= 2, name


def inside(b, f):
    return f[0] <= b[0] + b[2] / 2 <= f[0] + f[2] and f[1] <= b[1] + b[3] / 2 <= f[1] + f[3]


def test_ocr_meets_a_page_in_one_kernel(spark):
    """Against loops: tall items, several figures of a page, rows that share a result's number."""
    rng = random.Random(11)
    items, reads, figures = [], [], []
    for d in range(12):
        for _ in range(30):
            items.append((d, 1, rng.choice(["ab", "xkcdqwrtzpl", "e"]), rng.random() * 500, rng.random() * 700, rng.random() * 40, rng.choice([9.0, 10.0, 80.0]), "F", 9.0))
        for k in range(40):
            x, y = rng.random() * 500, rng.random() * 700
            reads.append((d, 1, k // 2 if d == 3 else k, rng.choice(["12 %", "word", "|", "a", "two words", "--", "　一 "]), x, y, x + rng.random() * 40, y + rng.random() * 20, 72.0, rng.choice([0.05, 0.2, 0.5, 0.9])))
        figures += [(d, 1, k, 100.0 * k, 200.0, 150.0, 300.0) for k in range(d % 4)]
    made = [spark.createDataFrame(rows, f"doc_id long, page_number int, {names}") for rows, names in (
        (items, "text string, x double, y double, width double, height double, font_name string, font_size double"),
        (reads, "result_id long, text string, x0 double, y0 double, x1 double, y1 double, dpi double, confidence double"),
        (figures, "figure int, fx double, fy double, fw double, fh double"),
    )]
    native = [i for i in items if i[2] != "xkcdqwrtzpl"]
    boxes = [(r, (r[4], r[5], r[6] - r[4], r[7] - r[5])) for r in reads]
    drawn = set()
    for f in figures:
        held = [r for r, b in boxes if r[0] == f[0] and inside(b, f[3:])]
        if len(held) >= 4 and sum(len(r[3].strip()) <= 3 or r[3] == "12 %" for r in held) >= 0.5 * len(held):
            drawn |= {(r[0], r[2]) for r in held}
    want = [(i[0], i[2], i[3]) for i in native]
    for r, b in boxes:
        rule = r[3] == "--" or r[3] == "|"
        near = any(i[0] == r[0] and b[0] < i[3] + i[5] + 2 and b[0] + b[2] > i[3] - 2 and b[1] < i[4] + i[6] + 2 and b[1] + b[3] > i[4] - 2 for i in native)
        if r[9] >= 0.3 and not rule and (r[0], r[2]) not in drawn and not near:
            want.append((r[0], r[3], b[0]))
    assert sorted((r.doc_id, r.text, r.x) for r in P.merge_ocr(*made, 0.3).collect()) == sorted(want) and drawn and len(want) > len(native)
    told = plan(catalog.QUERIES["merge_ocr_results"](spark, DATA))
    assert "Join" not in told and told.count("RepartitionByExpression") == 1


def test_texts_are_restored_in_one_kernel(spark):
    rng, before = random.Random(13), []
    for d in range(10):
        before += [(d, 1, rng.choice(["a", "b", None]), float(rng.randrange(20)), float(rng.randrange(20)), 4.0, 2.0) for _ in range(60)]
    after = [r for r in before if rng.random() < 0.5]
    frames = [(d, 1, 5 * k, 3, 4, 9) for d in range(10) for k in range(d % 3)]
    names = "doc_id long, page_number int, text string, x double, y double, width double, height double"
    made = M.restored(spark.createDataFrame(after, names), spark.createDataFrame(before, names), spark.createDataFrame(frames, "doc_id long, page_number int, wx int, wy int, ww int, wh int"))
    held = {r[:5] for r in after if r[2] is not None}
    want = after + [r for r in before if r[:5] not in held and any(f[0] == r[0] and inside(r[3:], f[2:]) for f in frames)]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want)) and len(want) > len(after)
    told = plan(catalog.QUERIES["restore_flattened_over_text"](spark, DATA))
    assert "Join" not in told and told.count("RepartitionByExpression") == 1


def test_page_facts_in_one_pass(spark):
    """What the relational operators tell, of one row a page; words are set once."""
    texts = ["a b c", "bcdfghjklmnpq " * 5, "zrt klmnb " * 30, "the quick brown fox " * 90, "é" * 90, "  \n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    facts = {(r.doc_id, r.page_number): tuple(r)[2:] for r in S.by_page(docs, lambda t, s: K.page_facts(t, s, 612.0, 792.0), "n_items long, text_length long, text_coverage double, is_garbled boolean").collect()}
    bad = {(r.doc_id, r.page_number) for r in L.garbled_scope(S.items(docs)).collect() if r.scope == "page"}
    want = {(r.doc_id, r.page_number): (r.n_items, r.text_length, r.text_coverage, (r.doc_id, r.page_number) in bad) for r in P.native_text(S.items(docs), 612.0, 792.0).collect()}
    assert facts == want and bad
    assert "MapInArrow" not in plan(catalog.QUERIES["page_complexity"](spark, DATA))


def test_words_stay_in_the_pass_that_sets_them(spark):
    for name in ("xy_find_best_cut", "project_pages_to_grid", "search_items", "uncovered_path_area", "build_projected_lines"):
        assert plan(catalog.QUERIES[name](spark, DATA)).count("MapInArrow") == 1, name
    for name in ("heading_map", "detect_horizontal_rules"):
        assert plan(catalog.QUERIES[name](spark, DATA)).count("MapInArrow") == 2, name


def test_uncovered_area_by_loop(spark):
    rng = random.Random(17)
    box = lambda: (float(rng.randrange(300)), float(rng.randrange(300)), float(rng.randrange(60)), float(rng.choice([5, 10, 90])))
    paths, items = [(d, 1, k, *box()) for d in range(8) for k in range(9)], [(d, 1, *box()) for d in range(7) for _ in range(40)]
    want = {}
    for p in paths:
        x, y, w, h = p[3:]
        over = sum(max(0.0, min(x + w, i[2] + i[4]) - max(x, i[2])) * max(0.0, min(y + h, i[3] + i[5]) - max(y, i[3])) for i in items if i[0] == p[0])
        if w * h > 0:
            want[p[0]] = want.get(p[0], 0.0) + max(0.0, w * h - over)
    made = spark.createDataFrame(paths, "doc_id long, page_number int, path int, px double, py double, pw double, ph double")
    got = P.uncovered_area(made, spark.createDataFrame(items, "doc_id long, page_number int, x double, y double, width double, height double"))
    assert {r.doc_id: r.uncovered for r in got.collect()} == want


def test_tables_are_told_where_rows_are_made(spark):
    """The kernels tell what the relational operators do; cells of odd blanks, runs that break."""
    rng, rows = random.Random(19), []
    for d in range(30):
        y = 20.0
        for k in range(25):
            y += rng.choice([12.0, 12.0, 14.0, 60.0])
            for w in range(rng.choice([4, 4, 4, 3, 2])):
                for part in range(rng.choice([1, 1, 2])):
                    text = rng.choice(["a", "b|c", "d\\e", " ", "f g", "é\th ", "\U0001f600"])
                    rows.append((d % 10, d // 10 + 1, k, w * 2 + part, text, 40.0 + w * 100 + part * 8 + rng.choice([0.0, 0.0, 0.0, 9.0]), y, 6.0 * len(text), 10.0, 10.0))
    made = spark.createDataFrame(rows, "doc_id long, page_number int, line_no int, word_no int, text string, x double, y double, width double, height double, font_size double")
    banded = P.band_lines(made)
    tables = B.table_runs(B.rows_of(P.split_cells(banded), P.lines_of(banded))).cache()
    cells = tables.select(*P.PAGE, "table", F.col("band").alias("row"), F.posexplode("texts").alias("col", "text"))
    filled = F.size(F.filter("texts", lambda t: t != ""))
    near = lambda frame: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect())
    for told, schema, want in (
        (B.spacing_of_runs, "table int, rows long, columns int, cv double", B.spacing(tables)),
        (B.joined_rows, "table int, band int, n int, row_text string", tables.select(*P.PAGE, "table", "band", "n", F.array_join("texts", " | "))),
        (B.pipes_of_runs, "table int, markdown string", P.pipe_tables(cells, [*P.PAGE, "table"])),
        (B.filled_of_runs, "n_tables long, filled long", tables.groupBy(*P.PAGE).agg(F.count_distinct("table"), F.sum(filled).cast("long"))),
    ):
        assert near(B.tell(made, told, schema)) == near(want) and want.count() > 10, schema
    for name in ("row_spacing_cv", "count_text_table_runs", "detect_tables", "tables_to_markdown"):
        shown = plan(catalog.QUERIES[name](spark, DATA))
        assert shown.count("Window") == 1 and "Generate" not in shown and "Aggregate" not in shown, name


def test_markers_of_lists_by_rule(spark):
    """The kernel's markers are those of the rules, of odd lines too; lines aren't grouped one page at a time."""
    lines = ["a. x", "(a\n) x", "(i\r\n) x", "(iv) x", "iv) x y", "IIX. z", "Ab. c", "a.x", "a. ", "　\x85b) c ", "(b) c d", "(b)\n\nd", "c. d\ne", "(xxxxxxxxxx) y", "vi.\tw", "(a b) c", "(1) c", "(é) c", "m. \U0001f600", "(zz) q", "abcdefgh. i", "(C ) q", "(a\n\n) x"]
    made = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    kinds = T.marker_kinds(T.ordered_marker(F.col("line"))["body"])
    want = {r.id: [tuple(k) for k in r.kinds] for r in made.select("id", kinds.alias("kinds")).collect() if r.kinds}
    got = {}
    for k, line in enumerate(lines):
        found = re2_marker(line)
        if found and K.kinds_of(found):
            got[k] = K.kinds_of(found)
    assert got == want and len(want) > 8
    rng = random.Random(23)
    rows = [(d, k, float(rng.choice([0, 5, 10])), rng.choice(["text", *(f"{c}. of" for c in "abci"), "(ii) of"])) for d in range(9) for k in range(300)]
    rng.shuffle(rows)
    told = spark.createDataFrame(rows, "page long, idx int, indent double, line string")
    got = {tuple(r) for r in K.ordered_list_lines(told).collect()}
    marked = [(d, n, indent, K.kinds_of(re2_marker(line))) for d, n, indent, line in rows if line != "text"]
    want = {(d, n) for d in range(9) for n in K.chain_markers(sorted(r[1:] for r in marked if r[0] == d))}
    assert got == want and len(want) > 50
    shown = plan(catalog.QUERIES["detect_ordered_list_lines"](spark, DATA))
    assert shown.count("MapInArrow") == 1 and "FlatMapGroups" not in shown


def re2_marker(line):
    found = pc.extract_regex(pc.utf8_trim(pa.array([line]), K.SPACES), K.MARKER)[0].as_py()
    return found and found["inside"] + found["end"] + found["plain"]


def test_segments_travel_once(spark):
    """Boxes made where segments are numbered are those of the numbered rows; ties of orders too."""
    own = S.read(spark, DATA, "lineitem").limit(3000)
    odd = own.union(own.withColumn("l_orderkey", F.col("l_orderkey") % 3)).union(own.limit(5).withColumn("l_orderkey", F.lit(-50).cast("long")))
    pages = S.segments(odd)
    whole = G.by_page(S.segment_pages(odd, lambda t: t), ("page",), lambda t, s: t, "page long, idx int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pages.select(whole.columns).collect()))
    assert G.by_page(S.segment_pages(odd, lambda t: t.slice(0, 0)), ("page",), lambda t, s: t, "page long").count() == 0
    shown = plan(catalog.QUERIES["detect_figure_rects"](spark, DATA))
    assert "Window" not in shown and shown.count("RepartitionByExpression") == 1


def test_paragraphs_in_one_pass(spark):
    """The kernel tells what the relational operator does: soft hyphens, blank lines, pages that mix."""
    rng, rows = random.Random(29), []
    for d in range(40):
        y = 10.0
        for k in range(30):
            y += rng.choice([12.0, 12.0, 12.0, 12.0, 40.0])
            text = rng.choice(["word-", "wo-\t", "rest of", " lower", "Upper-", "--", "-", "été-", "ß x", "", "  ", "a-", "12-", "一-"])
            rows.append((d % 8, d // 8 + 1, k, 36.0 + rng.choice([0.0, 0.0, 0.0, 6.0, 20.0]), y, rng.choice([0.4, 10.0]), rng.choice([10.0, 10.0, 10.0, 10.4, 14.0, None]), text))
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "doc_id long, page_number int, band int, x double, y double, height double, font_size double, text string")
    want = sorted(map(tuple, P.paragraphs(made).collect()))
    assert sorted(map(tuple, K.paragraphs(made).collect())) == want and any(r[3] > 4 for r in want)
    shown = plan(catalog.QUERIES["paragraph_flow"](spark, DATA))
    assert "Window" not in shown and "Aggregate" not in shown and shown.count("RepartitionByExpression") == 1


def test_words_leave_their_kernel_narrow(spark):
    kernel = next(line for line in plan(catalog.QUERIES["typeset_items"](spark, DATA)).splitlines() if "MapInArrow" in line)
    assert not any(c in kernel for c in ("font_name", "height", "width"))
    docs = spark.createDataFrame([(7, "a é\n\n" + "xy " * 3000)], "doc_id int, text string")
    frame, words = S.items(docs), S.Words(docs)
    names = list(frame.columns)
    got = words.by_page(lambda t, s: t.select(names), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields))
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, got.collect()))
