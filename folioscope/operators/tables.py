"""Borderless tables: runs of lines whose cells stand under one another, and their columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import kernels as K
from folioscope.operators import paged as G

PAGE = ("doc_id", "page_number")
# Least cells of a row, how far apart two cells of one column may begin in points,
# columns of a row that may be off, heights of a line between two rows at most.
CELLS, TRACK, OFF, ROWS_APART = 3, 6.0, 1, 2.5


def rows_of(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, band, n, starts, texts, y, height): lines with their cells in order."""
    ordered = F.array_sort(F.collect_list(F.struct("cell", "start_x", "text")))
    told = cells.groupBy(*PAGE, "band").agg(ordered.alias("cells")).withColumns(
        {"n": F.size("cells"), "starts": F.transform("cells", lambda c: c["start_x"]), "texts": F.transform("cells", lambda c: c["text"])}
    )
    return told.drop("cells").join(lines.select(*PAGE, "band", "y", "height"), [*PAGE, "band"])


def table_runs(rows: DataFrame) -> DataFrame:
    """Rows that make tables, with ``table``, the number of their run on the page, from 1.

    A row of three cells or more goes on with the row just above if that has as many, is two and
    a half line heights away at most, and all columns but one begin within six points of each
    other. Runs of one row are no tables.
    """
    page = W.partitionBy(*PAGE).orderBy("band")
    before = lambda c: F.lag(c).over(page)
    own = rows.withColumns({"a_n": before("n"), "a_starts": before("starts"), "a_bottom": before("y") + before("height"), "a_height": before("height")})
    off = F.size(F.filter(F.arrays_zip(F.col("starts").alias("p"), F.col("a_starts").alias("q")), lambda z: F.abs(z["p"] - z["q"]) > TRACK))
    near = F.col("y") - F.col("a_bottom") <= ROWS_APART * F.greatest("height", "a_height", F.lit(1.0))
    goes_on = (F.col("n") >= CELLS) & (F.col("a_n") == F.col("n")) & near & (off <= OFF)
    told = own.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    told = told.withColumn("run", F.sum("new").over(page.rowsBetween(W.unboundedPreceding, 0)))
    sized = told.withColumn("rows", F.count("*").over(W.partitionBy(*PAGE, "run"))).where((F.col("rows") >= 2) & (F.col("n") >= CELLS))
    return sized.withColumn("table", F.dense_rank().over(W.partitionBy(*PAGE).orderBy("run"))).select(*PAGE, "table", "band", "n", "starts", "texts", "y", "height")


def spacing(tables: DataFrame) -> DataFrame:
    """(doc_id, page_number, table, rows, columns, cv): spread of the gaps between rows, their
    standard deviation by their mean; 0 of fewer than two gaps or a mean of 0."""
    gap = F.col("y") - F.lag(F.col("y")).over(W.partitionBy(*PAGE, "table").orderBy("band"))
    out = tables.withColumn("gap", gap).groupBy(*PAGE, "table").agg(
        F.count("*").alias("rows"), F.max("n").alias("columns"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("dev")
    )
    cv = F.when((F.col("gaps") >= 2) & (F.col("mean") > 0), F.col("dev") / F.col("mean")).otherwise(0.0)
    return out.select(*PAGE, "table", "rows", "columns", cv.alias("cv"))


def runs_of_rows(rows: pa.Table) -> pa.Table:
    """``table_runs`` of the rows of whole pages, which stand in order."""
    if not rows.num_rows:
        return rows.append_column("table", pa.array([], pa.int32()))
    starts = G.first_rows(rows, PAGE)
    page, n, y, height = G.groups(starts, rows.num_rows), *(G.array(rows, c) for c in ("n", "y", "height"))
    listed = rows.column("starts").combine_chunks()
    at, x = listed.offsets.to_numpy(), listed.values.to_numpy()
    tall = np.maximum(np.maximum(height[1:], height[:-1]), 1.0)
    goes_on = np.append(False, (page[1:] == page[:-1]) & (n[1:] == n[:-1]) & (n[1:] >= CELLS) & (y[1:] - (y[:-1] + height[:-1]) <= ROWS_APART * tall))
    own = np.flatnonzero(goes_on)
    if len(own):
        first = np.cumsum(n[own]) - n[own]
        cell = np.repeat(at[own] - first, n[own]) + np.arange(n[own].sum())
        above = cell - np.repeat(at[own] - at[own - 1], n[own])
        off = np.add.reduceat((~(np.abs(x[cell] - x[above]) <= TRACK)).astype(np.int64), first)
        goes_on[own] = off <= OFF
    begins = np.flatnonzero(~goes_on)
    long = np.diff(np.append(begins, len(n))) >= 2
    kept = long[np.cumsum(~goes_on) - 1] & (n >= CELLS)
    new = np.zeros(len(n), np.int64)
    new[begins[long]] = kept[begins[long]]
    count = np.cumsum(new)
    number = count - (count - new)[starts][page]
    return rows.append_column("table", pa.array(number, pa.int32())).filter(pa.array(kept))


def spacing_of_runs(tables: pa.Table) -> pa.Table:
    """``spacing`` of what ``runs_of_rows`` tells."""
    at, y = G.first_rows(tables, (*PAGE, "table")), G.array(tables, "y")
    rows = np.diff(np.append(at, tables.num_rows))
    add = lambda v: np.add.reduceat(v, at) if len(at) else v
    gap = np.append(np.zeros(1), y[1:] - y[:-1])[: len(y)]
    gap[at] = 0.0
    gaps = np.maximum(rows - 1, 1)
    mean = add(gap) / gaps
    off = (gap - np.repeat(mean, rows)) ** 2
    off[at] = 0.0
    cv = np.where((rows > 2) & (mean > 0), np.sqrt(add(off) / gaps) / np.where(mean > 0, mean, 1.0), 0.0)
    return pa.table(G.keyed(tables, (*PAGE, "table"), at) | {"rows": pa.array(rows, pa.int64()), "columns": tables.column("n").take(pa.array(at)), "cv": pa.array(cv)})


def filled_of_runs(tables: pa.Table) -> pa.Table:
    """(doc_id, page_number, n_tables, filled): tables of each page and their cells with text."""
    at, texts = G.first_rows(tables, PAGE), tables.column("texts").combine_chunks()
    cells = np.append(0, np.cumsum(pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False) > 0))
    own = np.append(0, np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False)))
    ends = np.append(at, tables.num_rows)[1:]
    number = G.array(tables, "table")[ends - 1] if len(at) else np.zeros(0)
    return pa.table(G.keyed(tables, PAGE, at) | {"n_tables": pa.array(number, pa.int64()), "filled": pa.array(cells[own[ends]] - cells[own[at]], pa.int64())})


def joined_rows(tables: pa.Table) -> pa.Table:
    """(doc_id, page_number, table, band, n, row_text): cells with bars between."""
    text = pc.binary_join(tables.column("texts").combine_chunks(), " | ")
    return tables.select([*PAGE, "table", "band", "n"]).append_column("row_text", text)


def pipes_of_runs(tables: pa.Table) -> pa.Table:
    """(doc_id, page_number, table, markdown): ``pages.pipe_tables`` of the rows of each table."""
    at, listed = G.first_rows(tables, (*PAGE, "table")), tables.column("texts").combine_chunks()
    text = listed.flatten()
    for sign, told in (("\\", "\\\\"), ("|", "\\|"), ("\n", " ")):
        text = pc.replace_substring(text, sign, told)
    n = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(n))
    line = pc.binary_join_element_wise("| ", pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text), " | "), " |", "")
    head = np.zeros(tables.num_rows, bool)
    head[at] = True
    rule = pc.binary_join_element_wise("\n|", pc.binary_repeat("---|", pa.array(n[at], pa.int64())), "")
    line = pc.replace_with_mask(line, pa.array(head), pc.binary_join_element_wise(line.take(pa.array(at)), rule, ""))
    return pa.table(G.keyed(tables, (*PAGE, "table"), at) | {"markdown": G.joined(line, at, "\n")})


def tell(items, told: Callable[[pa.Table], pa.Table], schema: str, together: bool = False) -> DataFrame:
    """What ``told`` tells of the tables of whole pages, in one pass: words go in, and of each page
    only that comes out. ``schema``: its columns behind (doc_id, page_number)."""
    run = lambda table, starts: told(runs_of_rows(K.rows_of_pages(table, starts)))
    return G.by_page(G.chosen(items, *K.TABLE_ITEMS), PAGE, run, f"doc_id {G.type_of(items, 'doc_id')}, page_number int, {schema}", together)


def clusters(values: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, cluster, mean, support) of (keys, v): values chained where the next is within the
    tolerance."""
    order = W.partitionBy(*keys).orderBy("v")
    new = F.coalesce((F.col("v") - F.lag("v").over(order) > tolerance).cast("int"), F.lit(0))
    told = values.withColumn("new", new).withColumn("cluster", F.sum("new").over(order).cast("int"))
    return told.groupBy(*keys, "cluster").agg(F.avg("v").alias("mean"), F.count("*").alias("support"))
