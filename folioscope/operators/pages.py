"""Operators over the items of a page: usable text, complexity, lines, cells, paragraphs, OCR.

Items have (doc_id, page_number, text, x, y, width, height, font_size, font_name) and keys.
Everything is grouped by page or document; rectangles meet in grid cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import kernels as K
from folioscope.operators import paged as G

PAGE = ("doc_id", "page_number")
# Least text of a page in bytes, text that is never sparse, least coverage,
# least side of an image in points, share of both sides that makes it the page's background.
LEAST_TEXT, DENSE_TEXT, LEAST_COVERAGE, LEAST_IMAGE, BACKGROUND = 20, 2000, 0.15, 25.0, 0.9


def is_unusable(items: DataFrame) -> Column:
    """Garbled, or (where there is the flag) not mapped to characters."""
    garbled = T.is_likely_garbled(F.col("text"))
    return garbled | F.col("unmapped") if "unmapped" in items.columns else garbled


def native_text(items: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page_number, n_items, text_length, text_coverage, is_sparse): bytes of usable
    text of each page and the share of the page that it covers."""
    usable = ~is_unusable(items)
    covered = F.when(usable, F.col("width") * F.col("height")).otherwise(0.0)
    out = items.groupBy(*PAGE).agg(
        F.count("*").alias("n_items"), F.sum(F.when(usable, F.octet_length("text")).otherwise(0)).cast("long").alias("text_length"),
        (F.sum(covered) / (width * height)).alias("text_coverage"),
    )
    return with_sparse(out)


def with_sparse(native: DataFrame) -> DataFrame:
    return native.withColumn("is_sparse", (F.col("text_length") < LEAST_TEXT) | (F.col("text_coverage") < LEAST_COVERAGE))


def unmapped_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page_number, unmapped, total): pages with 30 characters or more, and 15 %, that
    aren't mapped; white space doesn't count."""
    n = F.length(F.regexp_replace("text", T.WS, ""))
    out = items.groupBy(*PAGE).agg(F.sum(F.when(F.col("unmapped"), n).otherwise(0)).cast("long").alias("unmapped"), F.sum(n).cast("long").alias("total"))
    return out.where("unmapped >= 30 AND unmapped >= 0.15 * total")


def complexity(items: DataFrame, images: DataFrame, garbled: DataFrame, width: float, height: float) -> DataFrame:
    """Of each page the text, the images and why it would need OCR (``reasons``, in order).

    ``images``: (doc_id, page_number, width, height); ``garbled``: (doc_id, page_number, scope).
    Images under 25 points on a side don't count; one over nine tenths of both sides of the page
    is its background, which tells a scan from a blank page.
    """
    return judged(native_text(items, width, height), images, garbled, width, height)


def judged(native: DataFrame, images: DataFrame, garbled: DataFrame, width: float, height: float) -> DataFrame:
    """``complexity`` of pages whose ``native_text`` is told already."""
    big = images.where((F.col("width") >= LEAST_IMAGE) & (F.col("height") >= LEAST_IMAGE))
    full = (F.col("width") > width * BACKGROUND) & (F.col("height") > height * BACKGROUND)
    area = F.when(~full, F.col("width") * F.col("height"))
    shown = big.groupBy(*PAGE).agg(
        F.max(full).alias("full_page_image"), F.sum((~full).cast("int")).cast("long").alias("image_count"),
        F.least(F.coalesce(F.sum(area), F.lit(0.0)) / (width * height), F.lit(1.0)).alias("image_coverage"),
        F.least(F.coalesce(F.max(area), F.lit(0.0)) / (width * height), F.lit(1.0)).alias("largest_image"),
    )
    bad = garbled.where("scope = 'page'").select(*PAGE, F.lit(True).alias("is_garbled")).distinct()
    out = native.join(shown, list(PAGE), "left").join(bad, list(PAGE), "left").fillna(
        {"full_page_image": False, "image_count": 0, "image_coverage": 0.0, "largest_image": 0.0, "is_garbled": False}
    )
    little = F.col("text_length") < LEAST_TEXT
    thin = (F.col("text_length") < DENSE_TEXT) & (F.col("text_coverage") < LEAST_COVERAGE)
    reasons = F.array_compact(F.array(
        F.when(little & F.col("full_page_image"), "scanned").when(little, "no-text").when(thin, "sparse-text"),
        F.when(F.col("image_count") > 0, "embedded-images"), F.when(F.col("is_garbled"), "garbled"),
    ))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("needs_ocr", F.col("reasons") != "")


def band_lines(items: DataFrame) -> DataFrame:
    """Items with ``band``, the number of their line on the page, from 0.

    In the order of (y, x) an item begins a line where its top lies half its height (24 points
    of it at most) or more under that of the item before.
    """
    order = W.partitionBy(*PAGE).orderBy("y", "x", "line_no", "word_no")
    h = lambda c: F.greatest(F.lit(1.0), F.least(c, F.lit(24.0)))
    low = F.least(h(F.col("height")), h(F.coalesce(F.lag("height").over(order), F.col("height"))))
    step = F.coalesce(F.col("y") - F.lag("y").over(order), F.lit(0.0))
    new = (step >= low * 0.5).cast("int")
    return items.withColumn("new", new).withColumn("band", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("new")


def _by_place(*value) -> Column:
    """The values of a group in reading order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("x", "line_no", "word_no", *value))), lambda s: s[value[0]])


def _in_order(order: str, value) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s["v"])


def lines_of(banded: DataFrame) -> DataFrame:
    """(doc_id, page_number, band, n_items, x, y, width, height, font_size, text) of each line:
    its box, the size most characters have (the largest of equals) and its words by x."""
    sizes = banded.groupBy(*PAGE, "band", "font_size").agg(F.sum(F.length("text")).alias("n"))
    size = sizes.groupBy(*PAGE, "band").agg(F.max(F.struct("n", "font_size"))["font_size"].alias("font_size"))
    box = banded.groupBy(*PAGE, "band").agg(
        F.count("*").alias("n_items"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.expr("x + width")) - F.min("x")).alias("width"), (F.max(F.expr("y + height")) - F.min("y")).alias("height"),
        F.array_join(_by_place("text"), " ").alias("text"),
    )
    return box.join(size, [*PAGE, "band"])


def split_cells(banded: DataFrame) -> DataFrame:
    """(doc_id, page_number, band, cell, start_x, end_x, text): a line's cells, cut where the gap
    to the word before is wider than the line's font size; words of blanks only don't count."""
    own = banded.where(T.trim(F.col("text")) != "")
    line = W.partitionBy(*PAGE, "band")
    order = line.orderBy("x", "line_no", "word_no")
    right = F.lag(F.expr("x + greatest(width, 0.0)")).over(order)
    cut = (F.col("x") - right > F.max("font_size").over(line)).cast("int")
    numbered = own.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("cell", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    last = F.max(F.struct("x", "line_no", "word_no", F.expr("x + greatest(width, 0.0)").alias("right")))["right"]
    return numbered.groupBy(*PAGE, "band", "cell").agg(F.min("x").alias("start_x"), last.alias("end_x"), T.collapse(F.array_join(_by_place("text"), " ")).alias("text"))


def continues(lines: DataFrame) -> DataFrame:
    """Lines with ``paragraph``, the number of their paragraph on the page.

    A line goes on where its size is within half a point of the one before, it isn't set over
    six points further in, and the gap is one and a half of the taller line at most.
    """
    order = W.partitionBy(*PAGE).orderBy("band")
    before = lambda c: F.lag(c).over(order)
    gap = F.col("y") - (before("y") + before("height"))
    goes_on = (
        (F.abs(F.col("font_size") - before("font_size")) <= 0.5) & (F.col("x") <= before("x") + 6)
        & (gap <= 1.5 * F.greatest(F.col("height"), before("height"), F.lit(1.0)))
    )
    new = (~F.coalesce(goes_on, F.lit(False))).cast("int")
    return lines.withColumn("new", new).withColumn("paragraph", (F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("new")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, paragraph, n_lines, text): lines joined in order, words that a
    hyphen cuts grown together."""
    joined = F.aggregate(_in_order("band", F.col("text")), F.lit(""), lambda held, t: T.dehyphenate(held, t))
    return continues(lines).groupBy(*PAGE, "paragraph").agg(F.count("*").alias("n_lines"), joined.alias("text"))


def page_text(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): the lines of each page, one under the other."""
    return lines.groupBy(*PAGE).agg(F.array_join(_in_order("band", F.col("text")), "\n").alias("text"))


def format_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages under their banners, a blank line between."""
    banner = F.format_string("\n--- Page %d ---\n%s", "page_number", "text")
    return pages.groupBy("doc_id").agg(F.array_join(_in_order("page_number", banner), "\n\n").alias("text"))


def format_json(items: DataFrame) -> DataFrame:
    """(doc_id, page_number, json): a page's items in reading order; a missing confidence is 1."""
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in items.columns else F.lit(1.0)
    item = F.struct("text", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "width", "height")), confidence.alias("confidence"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word_no", item.alias("item")))), lambda s: s["item"])
    return items.groupBy(*PAGE).agg(listed.alias("text_items")).select(*PAGE, F.to_json(F.struct(F.col("page_number").alias("page"), "text_items")).alias("json"))


def is_diagonal(rotation: Column) -> Column:
    """More than two degrees from a right angle."""
    return F.abs(rotation - F.floor(rotation / 90 + 0.5) * 90) > 2


def strike_outs(items: DataFrame, strokes: DataFrame) -> DataFrame:
    """Items that a flat thin stroke of the page strikes out.

    ``strokes``: (doc_id, page_number, sx1, sy1, sx2, sy2, stroke). Flat: two points of rise at
    most and wider than high; thin: two points at most. Its middle lies between 20 and 65 % of
    the item's height and it covers 60 % of the width.
    """
    rise, run = F.abs(F.expr("sy2 - sy1")), F.abs(F.expr("sx2 - sx1"))
    flat = strokes.where((rise <= 2) & (F.col("stroke") <= 2) & (run > rise))
    own = flat.select(*(F.col(c).alias(f"s_{c}") for c in PAGE), F.expr("(sy1 + sy2) / 2").alias("sy"), F.least("sx1", "sx2").alias("left"), F.greatest("sx1", "sx2").alias("right"))
    covered = F.least(F.expr("x + width"), F.col("right")) - F.greatest("x", "left")
    meets = F.expr("doc_id = s_doc_id AND page_number = s_page_number AND sy BETWEEN y + 0.2 * height AND y + 0.65 * height")
    return items.join(own, meets & (covered >= 0.6 * F.col("width")), "left_semi")


def merge_ocr(items: DataFrame, results: DataFrame, figures: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, page_number, text, x, y, width, height, font_name, font_size, confidence): usable
    items of the pages, and what OCR read where they have none.

    ``results``: (doc_id, page_number, result_id, text, x0, y0, x1, y1, dpi, confidence) in
    pixels; ``figures``: (doc_id, page_number, figure, fx, fy, fw, fh) in points. Results with a
    confidence under ``least`` or of 0.1 and less, misread rules, those centred in a figure that
    reads as a chart (four results or more, half of them labels) and those within two points of
    a native item are left out; OCR results don't drop one another. All of a page meet in one
    kernel, so each row travels once.
    """
    scale, box = 72.0 / F.col("dpi"), ("x", "y", "width", "height")
    placed = results.select(
        *PAGE, "text", (F.col("x0") * scale).alias("x"), (F.col("y0") * scale).alias("y"),
        (F.expr("x1 - x0") * scale).alias("width"), (F.expr("y1 - y0") * scale).alias("height"), F.lit("OCR").alias("font_name"),
        F.col("confidence").cast("double").alias("confidence"), F.lit(1).alias("kind"), F.col("result_id").cast("long").alias("id"),
    ).withColumn("font_size", F.col("height"))
    native = items.where(~is_unusable(items)).select(*PAGE, "text", *box, "font_name", "font_size").withColumns({"confidence": F.lit(None).cast("double"), "kind": F.lit(0)})
    framed = figures.select(*PAGE, *(F.col(c).cast("double").alias(n) for c, n in zip(("fx", "fy", "fw", "fh"), box, strict=True)), F.lit(2).alias("kind"))
    rows = native.unionByName(placed, True).unionByName(framed, True)
    columns = (*PAGE, "text", *box, "font_name", "font_size", "confidence")

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        page, kind, n = G.groups(starts, table.num_rows), G.array(table, "kind"), len(starts)
        item, read, figure = (np.flatnonzero(kind == k) for k in range(3))
        at = lambda own: tuple(G.array(table, c)[own] for c in box)
        part = table.take(pa.array(read))
        kept = K.ocr_kept(page[item], at(item), page[read], G.array(part, "id"), part.column("text").combine_chunks(), at(read), G.array(part, "confidence"), page[figure], at(figure), n, least)
        return table.take(pa.array(np.concatenate([item, read[kept]]))).select(columns)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = G.by_page(rows, PAGE, run, ", ".join(f"{c} {kinds[c]}" for c in columns))
    return out.withColumn("confidence", F.round("confidence", 3))


def target_pages(column: Column, most: int = 100_000) -> Column:
    """Pages of a list as "1-5, 10": sorted, each once; null where a part is no number or range,
    a range runs backwards, or there are more than ``most``."""
    parts = F.transform(F.split(column, ",", -1), lambda p: T.trim(p))
    valid = F.forall(parts, lambda p: p.rlike(rf"^[0-9]{{1,9}}({T.WS}*-{T.WS}*[0-9]{{1,9}})?$"))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, f"{T.WS}*-{T.WS}*", -1), lambda n: n.try_cast("long")))
    first, last = (lambda e: F.get(e, 0)), (lambda e: F.coalesce(F.get(e, 1), F.get(e, 0)))
    forward = F.forall(ends, lambda e: first(e) <= last(e))
    total = F.aggregate(ends, F.lit(0).cast("long"), lambda n, e: n + last(e) - first(e) + 1)
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(first(e), last(e))))))
    return F.when(valid, F.when(forward & (total <= most), listed))


def page_batches(pages: DataFrame, size: int = 25, most: int = 1000) -> DataFrame:
    """(doc_id, batch, first_page, last_page, n_pages): runs of ``size`` pages of each document,
    of its first ``most`` pages."""
    limited = pages.groupBy("doc_id").agg(F.least(F.max("page_number"), F.lit(most)).alias("limit"))
    each = limited.withColumn("batch", F.explode(F.sequence(F.lit(0), F.floor((F.col("limit") - 1) / size).cast("int"))))
    first = F.col("batch") * size + 1
    last = F.least(first + size - 1, F.col("limit"))
    return each.select("doc_id", "batch", first.alias("first_page"), last.alias("last_page"), (last - first + 1).alias("n_pages"))


def select_pages(pages: DataFrame, wanted: list[int], most: int) -> DataFrame:
    """Pages in ``wanted`` (all where it is empty), the first ``most`` of each document."""
    own = pages.where(F.col("page_number").isin(wanted)) if wanted else pages
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_number"))
    return own.withColumn("place", place).where(F.col("place") <= most).drop("place")


def toc_pages(lines: DataFrame) -> DataFrame:
    """(page, entries, numbers, share) of pages that are a table of contents.

    ``lines``: (page, idx, line). Four entries or more, three with an arabic number, and of the
    neighbouring numbers 70 % that don't fall.
    """
    told = lines.withColumns({"number": T.toc_number(F.col("line")), "entry": T.is_toc_entry(F.col("line"))}).where("entry")
    before = F.lag("number").over(W.partitionBy("page").orderBy("idx"))
    numbered = told.where("number IS NOT NULL").withColumn("rises", (F.col("number") >= before).cast("int"))
    runs = numbered.groupBy("page").agg(F.count("*").alias("numbers"), (F.sum("rises") / (F.count("*") - 1)).alias("share"))
    entries = told.groupBy("page").agg(F.count("*").alias("entries"))
    return entries.join(runs, "page").where("entries >= 4 AND numbers >= 3 AND share >= 0.7").select("page", "entries", "numbers", "share")


def running_headings(headings: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, key, first_page, n_pages): headings on ``least`` pages in a row or more, digits
    apart; numbered ones but for sections don't count. ``headings``: (doc_id, page_number, title)."""
    title = F.col("title")
    counted = headings.where(T.numbered_level(title).isNull() | F.lower(title).startswith("section "))
    each = counted.select("doc_id", T.collapse(T.digits_as_sign(title)).alias("key"), "page_number").distinct()
    place = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("page_number"))
    islands = each.withColumn("island", F.col("page_number") - place).groupBy("doc_id", "key", "island")
    return islands.agg(F.min("page_number").alias("first_page"), F.count("*").alias("n_pages")).where(F.col("n_pages") >= least).drop("island")


def trusted_outlines(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, n): documents whose bookmarks can be trusted.

    ``bookmarks``: (doc_id, idx, title, page_index); ``pages``: (doc_id, page_count). Three or
    more, pages that don't fall and exist, no counters for titles, and no title that, digits
    apart, makes four fifths of them.
    """
    before = F.lag("page_index").over(W.partitionBy("doc_id").orderBy("idx"))
    counter = F.lower("title").startswith("page ") | T.trim(F.col("title")).rlike("^[0-9]*$")
    off = (F.col("page_index") < F.coalesce(before, F.lit(-1))) | (F.col("page_index") < 0) | (F.col("page_index") >= F.col("page_count"))
    each = bookmarks.join(pages, "doc_id").withColumn("bad", off | counter)
    key = T.digits_as_sign(T.title_key(F.col("title")))
    keyed = each.groupBy("doc_id", key.alias("key")).agg(F.count("*").alias("k"), F.max("bad").alias("bad"))
    whole = keyed.groupBy("doc_id").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max("bad").alias("bad"))
    return whole.where("n >= 3 AND NOT bad AND most * 5 < n * 4").select("doc_id", "n")


def classify(c: Column) -> dict[str, Column]:
    """kind, level, marker and text of a line as a block: rule, heading, list item, paragraph."""
    marker, level = T.list_marker(c), T.numbered_level(c)
    heading = level.isNotNull() & T.is_physical_heading(c)
    kind = F.when(T.is_divider(c), "rule").when(heading, "heading").when(marker["ordered"], "ordered").when(marker.isNotNull(), "unordered").otherwise("paragraph")
    return {
        "kind": kind, "level": F.when(heading, level).otherwise(0), "marker": marker["marker"],
        "text": F.when(kind.isin("ordered", "unordered"), T.escape_inline(marker["rest"])).otherwise(T.escape_inline(T.collapse(c))),
    }


def render_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """(key, markdown): the blocks of each document in order; list items stand tight, all else
    with a blank line between. ``blocks``: (key, idx, kind, level, marker, text)."""
    text = F.col("text")
    indent = F.expr("repeat('  ', cast(least(level, 6) as int))")
    body = (
        F.when(F.col("kind") == "heading", F.concat(F.expr("repeat('#', cast(greatest(1, least(level, 6)) as int))"), F.lit(" "), text))
        .when(F.col("kind") == "ordered", F.concat(indent, "marker", F.lit(" "), text))
        .when(F.col("kind") == "unordered", F.concat(indent, F.lit("- "), text))
        .when(F.col("kind") == "rule", "---").when(F.col("kind") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)
    )
    order = W.partitionBy(key).orderBy("idx")
    listed = lambda c: c.isin("ordered", "unordered")
    between = F.when(F.lag("kind").over(order).isNull(), "").when(listed(F.col("kind")) & listed(F.lag("kind").over(order)), "\n").otherwise("\n\n")
    told = blocks.select(key, "idx", F.concat(between, body).alias("t"))
    return told.groupBy(key).agg(F.array_join(_in_order("idx", F.col("t")), "").alias("markdown"))


def pipe_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown): a pipe table of each group of (keys, row, col, text), the first row its
    head. Backslashes and bars are escaped, line breaks become blanks."""
    text = F.col("text")
    for sign, told in (("\\", "\\\\"), ("|", "\\|"), ("\n", " ")):
        text = F.replace(text, F.lit(sign), F.lit(told))
    row = cells.groupBy(*keys, "row").agg(F.array_join(_in_order("col", text), " | ").alias("row_cells"), F.count("*").alias("row_width"))
    line = F.concat(F.lit("| "), F.col("row_cells"), F.lit(" |"))
    head = F.col("row") == F.min("row").over(W.partitionBy(*keys))
    ruled = F.when(head, F.concat(line, F.lit("\n|"), F.expr("repeat('---|', cast(row_width as int))"))).otherwise(line)
    return row.withColumn("row_line", ruled).groupBy(*keys).agg(F.array_join(_in_order("row", F.col("row_line")), "\n").alias("markdown"))


def horizontal_rules(strokes: DataFrame, lines: DataFrame, width: float) -> DataFrame:
    """(doc_id, page_number, y, x0, x1) of level strokes that divide a page.

    Two points thick and askew at most, three tenths of the page wide, and not the underline of
    a line: within three points of its bottom and inside its box but for two points.
    """
    level = strokes.select(*PAGE, F.expr("(sy1 + sy2) / 2").alias("y"), F.least("sx1", "sx2").alias("x0"), F.greatest("sx1", "sx2").alias("x1"), F.abs(F.expr("sy2 - sy1")).alias("rise"), "stroke")
    wide = level.where((F.col("rise") <= 2) & (F.col("stroke") <= 2) & (F.expr("x1 - x0") >= 0.3 * width)).select(*PAGE, "y", "x0", "x1").distinct()
    own = lines.select(*(F.col(c).alias(f"l_{c}") for c in PAGE), F.expr("y + height").alias("bottom"), F.col("x").alias("lx"), F.expr("x + width").alias("lr"))
    under = F.expr("doc_id = l_doc_id AND page_number = l_page_number AND abs(y - bottom) < 3 AND x0 >= lx - 2 AND x1 <= lr + 2")
    return wide.join(own, under, "left_anti")


def uncovered_area(paths: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page_number, uncovered): area of filled paths (doc_id, page_number, path, px, py,
    pw, ph) that no item lies over; overlaps add up, to a path's own area at most. All of a page
    meet in one kernel."""
    box = ("x", "y", "width", "height")
    own = paths.select(*PAGE, *(F.col(c).cast("double").alias(n) for c, n in zip(("px", "py", "pw", "ph"), box, strict=True)), F.lit(0).alias("kind"))
    rows = own.unionByName(items.select(*PAGE, *box, F.lit(1).alias("kind")))

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        page, kind = G.groups(starts, table.num_rows), G.array(table, "kind")
        path, item = (np.flatnonzero(kind == k) for k in range(2))
        at = lambda own: tuple(G.array(table, c)[own] for c in box)
        pages, areas = K.uncovered(page[path], at(path), page[item], at(item), len(starts))
        return pa.table(G.keyed(table, PAGE, starts[pages]) | {"uncovered": pa.array(areas)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return G.by_page(rows, PAGE, run, f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, uncovered double")


def splice_soft_hyphens(blocks: DataFrame, key: str) -> DataFrame:
    """Paragraphs that end in a cut word take the next one in, if that begins in lower case; runs
    of such pieces become one block. ``blocks``: (key, idx, kind, text)."""
    order = W.partitionBy(key).orderBy("idx")
    before = lambda c: F.lag(c).over(order)
    joins = F.coalesce((F.col("kind") == "paragraph") & (before("kind") == "paragraph") & T.is_soft_break(before("text"), F.col("text")), F.lit(False))
    told = blocks.withColumn("new", (~joins).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    text = F.aggregate(_in_order("idx", F.col("text")), F.lit(None).cast("string"), lambda held, t: F.when(held.isNull(), t).otherwise(F.concat(F.regexp_replace(held, f"-{T.WS}*$", ""), t)))
    return told.groupBy(key, "run").agg(F.min("idx").alias("idx"), F.first("kind").alias("kind"), text.alias("text")).drop("run")


def html_tables(cells: DataFrame, keys: list[str], header_rows: int = 1) -> DataFrame:
    """(keys, html) of cells (keys, row, col, text, colspan, rowspan); the first rows are heads."""
    tag = F.when(F.col("row") < header_rows, "th").otherwise("td")
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    one = F.concat(F.lit("\n<"), tag, span("colspan"), span("rowspan"), F.lit(">"), T.escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    row = cells.groupBy(*keys, "row").agg(F.concat(F.lit("\n<tr>"), F.array_join(_in_order("col", one), ""), F.lit("\n</tr>")).alias("row_html"))
    return row.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(_in_order("row", F.col("row_html")), ""), F.lit("\n</table>")).alias("html"))


def outline_levels(lines: DataFrame, outline: DataFrame, page_height: float) -> DataFrame:
    """(doc_id, page_number, band, level): lines that a bookmark points at.

    ``outline``: (doc_id, page_number, entry, title, level, y_top). Within one and a half line
    heights of it, and one text begins with the other; the first bookmark counts.
    """
    told = outline.select(*(F.col(c).alias(f"o_{c}") for c in PAGE), "entry", F.lower(T.collapse(F.col("title"))).alias("o_key"), "level", "y_top")
    own = lines.select(*PAGE, "band", "y", "height", F.lower(T.collapse(F.col("text"))).alias("key")).where("key <> ''")
    # They meet in slices of the page: a bookmark is in one, a line in all that it reaches.
    told = told.withColumn("o_cell", F.floor(F.col("y_top") / 24))
    own = own.withColumn("cell", F.explode(F.sequence(F.floor(F.expr("(y - 1.5 * height) / 24 - 0.001")), F.floor(F.expr("(y + 1.5 * height) / 24 + 0.001")))))
    near = F.expr("doc_id = o_doc_id AND page_number = o_page_number AND cell = o_cell AND abs(y - y_top) <= 1.5 * height AND o_key <> '' AND (startswith(key, o_key) OR startswith(o_key, key))")
    met = own.join(told, near)
    return met.groupBy(*PAGE, "band").agg(F.min(F.struct("entry", "level"))["level"].alias("level"))


def structure_levels(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, page_number, band, level): lines whose marked content a heading node holds, the
    first of them. ``lines``: (doc_id, page_number, band, mcid); ``nodes``: (doc_id, page_number,
    node, role, mcids)."""
    level = T.heading_role(F.col("role"))
    each = nodes.withColumn("level", level).where("level IS NOT NULL").select(*PAGE, "node", "level", F.explode("mcids").alias("mcid"))
    return lines.join(each, [*PAGE, "mcid"]).groupBy(*PAGE, "band").agg(F.min(F.struct("node", "level"))["level"].alias("level"))
