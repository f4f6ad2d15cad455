"""Layout operators over lines and positioned items.

Pages are the unit of partitioning: every grouping key holds the document and page, and
spatial predicates are joined by grid cells, never by a cross join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import paged as G

HEADER, FOOTER = 0.12, 0.88


def bands(lines: DataFrame) -> DataFrame:
    """``lines`` in the top or bottom band, one row for each band they are in, with their key."""
    top, bottom = F.col("line_no") / F.col("n_lines"), (F.col("line_no") + 1) / F.col("n_lines")
    which = F.array_compact(F.array(F.when(top <= HEADER, "header"), F.when(bottom >= FOOTER, "footer")))
    return lines.withColumn("band", F.explode(which)).withColumns(
        {"key": T.repetition_key(F.col("line")), "is_pattern": T.is_chrome_pattern(F.col("line"))}
    )


def repetition_keys(lines: DataFrame, least_share: float = 0.5, least: int = 2) -> DataFrame:
    """(source, band, key, pages, is_pattern): keys on max(least, ceil(share x pages)) pages.

    Pages of each key are counted as distinct documents, in two combined steps.
    """
    each = bands(lines).where("key <> ''").groupBy("source", "band", "key", "doc_id").agg(F.max("is_pattern").alias("p"))
    counted = each.groupBy("source", "band", "key").agg(F.count("*").alias("pages"), F.max("p").alias("is_pattern"))
    total = lines.groupBy("source").agg(F.count_distinct("doc_id").alias("all_pages"))
    bound = F.greatest(F.lit(least), F.ceil(F.col("all_pages") * least_share))
    kept = counted.join(total, "source").where((F.col("all_pages") >= 2) & (F.col("pages") >= bound))
    return kept.select("source", "band", "key", "pages", "is_pattern")


def header_footer_set(lines: DataFrame, least_share: float = 0.5, least: int = 2) -> DataFrame:
    """Keys to strip: in a band with over three keys that aren't patterns (a letterhead), only
    patterns count."""
    keys = repetition_keys(lines, least_share, least)
    others = F.sum((~F.col("is_pattern")).cast("int")).over(W.partitionBy("source", "band"))
    return keys.withColumn("others", others).where("others <= 3 OR is_pattern").drop("others")


def strip_chrome(lines: DataFrame, least_share: float = 0.5, least: int = 2) -> DataFrame:
    """``lines`` without those in a band whose key is in the set of their source."""
    keys = header_footer_set(lines, least_share, least).select(F.col("source").alias("s"), F.col("key").alias("k")).distinct()
    top, bottom = F.col("line_no") / F.col("n_lines"), (F.col("line_no") + 1) / F.col("n_lines")
    inside = (top <= HEADER) | (bottom >= FOOTER)
    # Lines outside the bands have no key; they stay out of the join, where one task would get them.
    told = lines.where(inside).withColumn("key", T.repetition_key(F.col("line")))
    kept = told.join(keys, (F.col("source") == F.col("s")) & (F.col("key") == F.col("k")), "left_anti").drop("key")
    return lines.where(~inside).unionByName(kept)


def garbled_items(items: DataFrame) -> DataFrame:
    """Items of ten letters or more with less than a tenth of them vowels."""
    return items.where(T.is_likely_garbled(F.col("text")))


def garbled_scope(items: DataFrame) -> DataFrame:
    """(doc_id, page_number, scope): 'page' where a page's letters fail as a whole, else a row for
    each font that fails and has 15 % of the page's letters."""
    fonts = items.groupBy("doc_id", "page_number", "font_name").agg(
        F.sum(T.letters(F.col("text"))).alias("n"), F.sum(T.vowels(F.col("text"))).alias("v")
    )
    page = W.partitionBy("doc_id", "page_number")
    all_ = fonts.withColumns({"pn": F.sum("n").over(page), "pv": F.sum("v").over(page)})
    bad_page = (F.col("pn") >= 30) & (F.col("pv") * 5 < F.col("pn"))
    bad_font = (F.col("n") >= 30) & (F.col("v") * 5 < F.col("n")) & (F.col("n") >= F.ceil(0.15 * F.col("pn")))
    marked = all_.withColumn("scope", F.when(bad_page, "page").when(bad_font, F.col("font_name")))
    return marked.where("scope is not null").select("doc_id", "page_number", "scope").distinct()


def body_size(items: DataFrame) -> DataFrame:
    """(doc_id, body_size): the largest size with half the characters of the commonest one."""
    return body_of(items.select("doc_id", "font_size", F.length("text").alias("n")))


def body_of(weights: DataFrame) -> DataFrame:
    """``body_size`` of (doc_id, font_size, n), n characters of a size."""
    sized = weights.where("font_size > 0").groupBy("doc_id", F.round(F.col("font_size") * 100).alias("key")).agg(F.sum("n").alias("weight"))
    most = F.max(F.greatest("weight", F.lit(1))).over(W.partitionBy("doc_id"))
    return sized.withColumn("most", most).where(F.col("weight") >= F.floor(F.col("most") * 0.5)).groupBy("doc_id").agg((F.max("key") / 100).alias("body_size"))


def heading_map(lines: DataFrame, body: DataFrame) -> DataFrame:
    """(doc_id, size, level): sizes half a point over the body's that make headings, largest
    first, six at most.

    ``lines``: (doc_id, font_size, text); ``body``: (doc_id, body_size). Captions don't count, nor
    texts that three candidates or more have. A size needs ten characters, 8 to 200 a line, and
    letters for half of them.
    """
    text = F.col("text")
    big = lines.join(body, "doc_id").where((F.col("font_size") > F.col("body_size") + 0.5) & ~T.is_caption(text))
    keyed = big.withColumn("key", F.lower(T.collapse(text)))
    rare = keyed.withColumn("same", F.count("*").over(W.partitionBy("doc_id", "key"))).where("same < 3")
    sized = rare.groupBy("doc_id", F.col("font_size").alias("size")).agg(
        F.sum(F.length("text")).alias("chars"), F.count("*").alias("n_lines"), F.sum(T.kept(text, r"\p{L}")).alias("alpha"), F.sum(F.length(F.regexp_replace("text", T.WS, ""))).alias("ink")
    )
    good = sized.where("chars >= 10 AND chars / n_lines BETWEEN 8 AND 200 AND alpha >= 0.5 * ink")
    level = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("size")))
    return good.withColumn("level", level).where("level <= 6").select("doc_id", "size", "level")


def _covered(page: np.ndarray, order: np.ndarray, text: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Which rows a later one (by ``order``) of their page covers.

    In the order of tops each row meets those that begin above its bottom: all rows' first next
    one, then their second, and so on, so memory follows the rows and not the pairs.
    """
    sort = np.lexsort((y, page))
    page, order, text, x, y, width, height = (c[sort] for c in (page, order, text, x, y, width, height))
    right, bottom, area = x + width, y + height, width * height
    gone, at, step = np.zeros(len(page), bool), np.arange(len(page)), 1
    while len(at):
        at = at[at + step < len(page)]
        b = at + step
        near = (page[b] == page[at]) & (y[b] < bottom[at])
        at, b = at[near], b[near]
        ix = np.minimum(right[at], right[b]) - np.maximum(x[at], x[b])
        met = ix > 0
        p, q, ix = at[met], b[met], ix[met]
        iy = np.minimum(bottom[p], bottom[q]) - np.maximum(y[p], y[q])
        small, large = np.minimum(area[p], area[q]), np.maximum(area[p], area[q])
        covers = (iy > 0) & (ix * iy > 0.5 * small) & ((text[p] == text[q]) | (large <= 5 * small))
        p, q = p[covers], q[covers]
        gone[p[order[p] < order[q]]] = True
        gone[q[order[q] < order[p]]] = True
        step += 1
    out = np.empty(len(gone), bool)
    out[sort] = gone
    return out


def overlap_dedup(items: DataFrame, together: bool = False) -> DataFrame:
    """Items that no later one of the page covers: intersection over half of the smaller area, and
    the same text or areas within a factor of five. Items that stand aslant (``rotation``, where
    there is one) neither cover nor are covered.

    Each page is judged in one kernel, so no item travels more than once; where pages stand
    ``together`` none does.
    """

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        page = G.groups(starts, table.num_rows)
        flat = np.ones(table.num_rows, bool)
        if "rotation" in table.column_names:
            turn = pc.fill_null(table.column("rotation").cast(pa.float64()), 0.0).to_numpy()
            flat = np.abs(turn - np.floor(turn / 90 + 0.5) * 90) <= 2.0
        own = np.flatnonzero(flat)
        gone = _covered(page[own], G.array(table, "idx")[own], G.codes(table.column("text"))[own], *(G.array(table, c)[own] for c in ("x", "y", "width", "height")))
        return table.take(pa.array(np.setdiff1d(np.arange(table.num_rows), own[gone], True)))

    return G.by_page(items, ("doc_id", "page_number"), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields), together)


def crop(items: DataFrame, width: float, height: float, left=0.0, top=0.0, right=0.0, bottom=0.0) -> DataFrame:
    """Items that lie wholly inside the page without its margins, given as shares."""
    return items.where(
        (F.col("x") >= left * width) & (F.col("x") + F.col("width") <= (1 - right) * width)
        & (F.col("y") >= top * height) & (F.col("y") + F.col("height") <= (1 - bottom) * height)
    )


def assign_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, word_no, link_id): items whose centre is in a link's box;
    the first link wins. A link far taller than the items in it is no text link."""
    hit = items.join(links, ["doc_id", "page_number"]).where(
        "x + width / 2 BETWEEN lx AND lx + lw AND y + height / 2 BETWEEN ly AND ly + lh"
    )
    ranks = W.partitionBy("doc_id", "page_number", "link_id")
    upper = F.element_at(F.sort_array(F.collect_list("height").over(ranks)), (F.floor(F.count("*").over(ranks) / 2) + 1).cast("int"))
    fit = hit.withColumn("median", upper).where("median <= 0 OR lh <= 1.8 * median")
    return fit.groupBy("doc_id", "page_number", "line_no", "word_no").agg(F.min("link_id").alias("link_id"))


def phrase_search(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, item_id, hits): non-overlapping occurrences of each phrase in each text.

    A word inside a phrase has a blank on both sides, so a text that contains the phrase has it
    between blanks too: phrases are joined by the longest of these. Phrases of one or two words
    meet every text.
    """
    told = phrases.where("phrase <> ''").withColumn("ws", F.split("phrase", " ", -1))
    inner = F.when(F.size("ws") > 2, F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(0))))
    told = told.withColumn("w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).drop("ws")
    # Words travel without their texts; texts are fetched for what was found.
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    words = own.select("h", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("w"))
    met = words.join(told.where("w <> ''"), "w").select("h", "item_id", "phrase").distinct()
    joined = own.join(met, "h").where("contains(text, phrase)").select("doc_id", "text", "item_id", "phrase")
    short = F.broadcast(told.where("w is null or w = ''").drop("w"))
    both = joined.unionByName(docs.select("doc_id", "text").join(short, F.expr("contains(text, phrase)")).select("doc_id", "text", "item_id", "phrase"))
    hits = (F.length("text") - F.length(F.expr("replace(text, phrase, '')"))) / F.length("phrase")
    return both.select("doc_id", "item_id", hits.cast("long").alias("hits"))


def segments_preview(segments: DataFrame, most: int = 50, least: float = 5.0, box=(0.0, 0.0, 400.0, 400.0)) -> DataFrame:
    """The ``most`` longest segments of each page whose box meets ``box``; ties by index."""
    x0, y0, x1, y1 = box
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    kept = segments.withColumn("length", F.sqrt(dx * dx + dy * dy)).where(
        (F.col("length") >= max(least, 0.01)) & (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x1)
        & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y1)
    )
    rank = F.row_number().over(W.partitionBy("page").orderBy(F.desc("length"), "idx"))
    return kept.withColumn("place", rank).where(F.col("place") <= most).select("page", "idx", "length")


def nearest_segments(points: DataFrame, segments: DataFrame, reach: float = 40.0) -> DataFrame:
    """(page, point, idx, distance, confidence): the nearest segment within ``reach`` of each
    point, the lowest index on ties. Segments are filed under every cell of their box widened by
    the reach, so each point looks into one cell."""
    cell = F.lit(2 * reach)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / cell), F.floor((F.greatest(a, b) + reach) / cell))
    filed = segments.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    asked = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    both = asked.join(filed, ["page", "cx", "cy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / size))).otherwise(0.0)
    ex, ey = F.col("px") - F.col("x1") - t * dx, F.col("py") - F.col("y1") - t * dy
    near = both.withColumn("distance", F.round(F.sqrt(ex * ex + ey * ey), 6)).where(F.col("distance") <= reach)
    best = near.groupBy("page", "point").agg(F.min(F.struct("distance", "idx")).alias("b"))
    confidence = F.round(100 * (1 - F.col("b.distance") / reach)).cast("int")
    return best.select("page", "point", "b.idx", "b.distance", confidence.alias("confidence"))
