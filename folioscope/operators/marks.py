"""Small relational operators on pages: invisible text, context of headings, images, tracks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import paged as G
from folioscope.operators.kernels import figures, lost_in_frames
from folioscope.operators.pages import BACKGROUND, LEAST_IMAGE, PAGE

#: Pixels of the largest render, and points of an inch.
PIXELS, INCH = 150 * 1024 * 1024 // 4, 72.0


def visible_text(items: DataFrame) -> DataFrame:
    """Items but for the invisible ones (``mode`` 3) of pages that have visible ones too."""
    shown = F.max(F.col("mode") != 3).over(W.partitionBy(*PAGE))
    return items.withColumn("shown", shown).where("mode <> 3 OR NOT shown").drop("shown")


def near_table(lines: DataFrame, reach: int = 6) -> DataFrame:
    """Lines (doc, idx, line) with ``in_context``: a row of a pipe table within ``reach`` lines
    below, or a bold table caption within as many above."""
    order = W.partitionBy("doc").orderBy("idx")
    t = F.trim(F.col("line"))
    row, caption = t.startswith("|") & t.endswith("|"), F.lower(t).startswith("**table ")
    below, above = order.rowsBetween(1, reach), order.rowsBetween(-reach, -1)
    return lines.withColumn("in_context", F.coalesce(F.max(row).over(below), F.lit(False)) | F.coalesce(F.max(caption).over(above), F.lit(False)))


def text_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, first, last, n): runs of lines that two blank lines or more part; blank
    lines at the ends of a block don't count."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    filled = lines.where(F.trim(F.col("line")) != "")
    gap = F.col("line_no") - F.lag("line_no").over(order) - 1
    told = filled.withColumn("new", F.coalesce((gap >= 2).cast("int"), F.lit(0)))
    numbered = told.withColumn("block", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy("doc_id", "block").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"))


def image_refs(images: DataFrame, width: float, height: float) -> DataFrame:
    """Images of 25 points a side or more that don't fill the page, numbered on each page by
    place: (doc_id, page_number, slug, x, y, width, height)."""
    full = (F.col("width") > width * BACKGROUND) & (F.col("height") > height * BACKGROUND)
    own = images.where((F.col("width") >= LEAST_IMAGE) & (F.col("height") >= LEAST_IMAGE) & ~full)
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("y", "x", "width", "height"))
    return own.select(*PAGE, F.format_string("p%d_%d", "page_number", place).alias("slug"), "x", "y", "width", "height")


def canonical_images(images: DataFrame) -> DataFrame:
    """(image_id, canonical, duplicate_of): the first image of each content stands for all; only
    digests are grouped."""
    told = images.select("image_id", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    first = told.groupBy("digest").agg(F.min("image_id").alias("canonical"))
    return told.join(first, "digest").select("image_id", "canonical", F.when(F.col("image_id") != F.col("canonical"), F.col("canonical")).alias("duplicate_of"))


def safe_dpi(requested: Column, width: Column, height: Column) -> Column:
    """The resolution that keeps a page within the budget of pixels; null where even 72 doesn't,
    or the page has no area."""
    most = F.floor(INCH * F.sqrt(F.lit(float(PIXELS)) / (width * height)))
    return F.when((width > 0) & (height > 0), F.when(most >= 72, F.least(requested, most.cast("int"))))


def restored(after: DataFrame, before: DataFrame, widgets: DataFrame) -> DataFrame:
    """Items of ``after``, and those of ``before`` that it lacks though their centre is in a widget
    (doc_id, page_number, wx, wy, ww, wh). All of a page meet in one kernel."""
    box, columns = ("x", "y", "width", "height"), after.columns
    own = widgets.select(*PAGE, *(F.col(c).cast("double").alias(n) for c, n in zip(("wx", "wy", "ww", "wh"), box, strict=True)), F.lit(2).alias("kind"))
    rows = after.withColumn("kind", F.lit(0)).unionByName(before.withColumn("kind", F.lit(1))).unionByName(own, True)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        page, kind, text = G.groups(starts, table.num_rows), G.array(table, "kind"), table.column("text").combine_chunks()
        kept, item, frame = (np.flatnonzero(kind == k) for k in range(3))
        at = lambda rows: tuple(G.array(table, c)[rows] for c in box)
        lost = lost_in_frames(page[item], text.take(pa.array(item)), at(item), page[kept], text.take(pa.array(kept)), *at(kept)[:2], page[frame], at(frame), len(starts))
        return table.take(pa.array(np.concatenate([kept, item[lost]]))).select(columns)

    return G.by_page(rows, PAGE, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in after.schema.fields))


def track_of(start: Column, end: Column, tracks: Column) -> Column:
    """Index of the track (low, high) that holds the cell's centre, else its start, else its end;
    null of none."""
    first = lambda at: F.get(F.filter(F.transform(tracks, lambda t, k: F.when(at.between(t["low"], t["high"]), k)), lambda k: k.isNotNull()), 0)
    return F.coalesce(first((start + end) / 2), first(start), first(end))


def layout_reasons(columns: Column, ruled: Column, borderless: Column, figures: Column) -> Column:
    """Why a page's layout is complex: columns, tables, graphics over a fifth of it."""
    return F.array_join(F.array_compact(F.array(F.when(columns >= 2, "multi-column"), F.when(ruled + borderless > 0, "table-likely"), F.when(figures >= 0.2, "dense-graphics"))), ",")


def figure_boxes(boxes: DataFrame, gap: float = 10.0) -> DataFrame:
    """(page, figure, bx0, by0, bx1, by1, n): boxes (page, idx, bx0, by0, bx1, by1) chained where
    neither axis parts them by more than ``gap``; figure: the first box of each."""
    return figures(boxes, gap)


def clip(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """The part (x1, y1, x2, y2) of a segment inside a box, or null."""
    low_x, low_y, high_x, high_y = map(float, box)
    enter, leave, dx, dy = [F.lit(0.0)], [F.lit(1.0)], x2 - x1, y2 - y1
    outside = F.lit(False)
    for p, q in ((-dx, x1 - low_x), (dx, high_x - x1), (-dy, y1 - low_y), (dy, high_y - y1)):
        outside = outside | ((p == 0) & (q < 0))
        enter.append(F.when(p < 0, q / p).otherwise(0.0))
        leave.append(F.when(p > 0, q / p).otherwise(1.0))
    a, b = F.greatest(*enter), F.least(*leave)
    return F.when(~outside & (a <= b), F.struct((x1 + a * dx).alias("x1"), (y1 + a * dy).alias("y1"), (x1 + b * dx).alias("x2"), (y1 + b * dy).alias("y2")))


def circle_of(xs: Column, ys: Column) -> Column:
    """(cx, cy, radius) of points whose distances from their mean vary by a twentieth at most.

    What later steps use again is bound to a lambda's variable: written out, each mean would be
    worked out anew for every point.
    """
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    off = lambda p, m: F.sqrt(F.pow(p["x"] - m["x"], 2) + F.pow(p["y"] - m["y"], 2))

    def told(m: Column, far: Column, radius: Column) -> Column:
        spread = F.sqrt(F.aggregate(far, F.lit(0.0), lambda s, v: s + F.pow(v - radius, 2)) / F.size(far))
        return F.when((radius > 0) & (spread / radius <= 0.05), F.struct(m["x"].alias("cx"), m["y"].alias("cy"), radius.alias("radius")))

    points = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    middle = F.struct(mean(xs).alias("x"), mean(ys).alias("y"))
    return bound(middle, lambda m: bound(F.transform(points, lambda p: off(p, m)), lambda far: bound(mean(far), lambda radius: told(m, far, radius))))
