"""Mixing sources to target weights by capped water-filling, DataFrame functions only.

Targets: every source gets words in proportion to its weight; a source over its cap (its
size times the largest number of epochs) is clamped there, and what is left is shared
among the others by weight until none is above. Documents: whole repetitions of the whole
source, then one more repetition of the documents that come first by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, staged

#: Hash digits by which a source is cut into pieces: 4,096 pieces, each cut again.
DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn. ``share`` times all sizes
    are given out; ``epochs`` times its size is the most a source takes. Sums are made
    before the windows, which see one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(named) - 1) % len(weights)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sources.withColumn("w", cycle[turn]).withColumns(
        {"cap": F.col("source_size") * float(epochs), "budget": F.sum("source_size").over(everything) * float(share)}
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    filled = ranked.withColumns({"place": F.row_number().over(by_ratio), "level": level})
    # The first source that the level doesn't lift above its cap sets the level of all.
    open_ = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("place", "level"))
    final = F.min(open_).over(everything)["level"]
    target = F.coalesce(F.least("cap", final * F.col("w")), F.col("cap"))
    return filled.select("source", "n", "source_size", target.alias("target"))


def _piece(rows: DataFrame, cuts: DataFrame, start: int) -> DataFrame:
    """For each source the piece (next hash digits) in which its sum passes ``rest``."""
    piece = F.substring("h", start, DIGITS).alias("piece")
    sums = rows.groupBy("source", piece).agg(F.sum("size").alias("size"))
    so_far = F.sum("size").over(W.partitionBy("source").orderBy("piece"))
    summed = sums.withColumn("upto", so_far).alias("s").join(
        cuts.select("source", "rest").alias("c"), F.expr("s.source <=> c.source"), "inner"
    )
    passed = summed.where("upto > rest").groupBy("c.source").agg(
        F.min(F.struct("piece", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))).alias("x")
    )
    return passed.select("source", "x.piece", "x.rest")


def _inside(rows: DataFrame, pieces: DataFrame, start: int) -> DataFrame:
    """The rows of each source's piece."""
    known = pieces.select(F.col("source").alias("src"), "piece")
    return rows.join(known, F.expr(f"source <=> src AND substring(h, {start}, {DIGITS}) = piece"), "left_semi")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """(id, source, size, source_size, target, repetitions, taken) for every row of ``docs``.

    size: words of the text (null: 0). All documents are repeated as often as their whole
    source fits its target; of what is left, documents in order of md5(seed:id) are taken
    once more while they fit, and then the one document whose size is nearest to the
    remaining gap, if it makes that gap smaller. Rows that repeat an id stand or fall
    together. Reruns agree. Null ids count as the id ''; a null source is a source of its
    own. An empty table gives an empty result.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sizes = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            h.alias("h"),
        )
    )
    plan = staged(
        targets(sizes, weights, share, epochs).withColumns(
            {
                "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
            }
        ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    left = plan.where("rest > 0").select("source", "rest")
    first = staged(_piece(sizes, left, 1))
    inside = staged(_inside(sizes, first, 1))
    second = staged(_piece(inside, first, 1 + DIGITS))
    # What remains of a source has the first six digits of its hash in common.
    last = _inside(inside, second, 1 + DIGITS).groupBy("source", "h").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("h"))
    cut = (
        last.withColumn("upto", upto).alias("l").join(second.select("source", "rest").alias("c"), F.expr("l.source <=> c.source"))
        .where("upto > rest").groupBy("l.source")
        .agg(F.min(F.struct("h", (F.col("rest") - F.col("upto") + F.col("size")).alias("gap"))).alias("x"))
        .select("source", F.col("x.h").alias("cut"), "x.gap")
    )
    cut = staged(cut)
    few = F.expr("s.source <=> c.source")
    spare = sizes.alias("s").join(cut.alias("c"), few).where("h >= cut AND size > 0")
    nearest = spare.groupBy("c.source").agg(
        F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "h", "gap")).alias("x")
    )
    nearest = staged(nearest.select("source", F.col("x.h").alias("filler"), "x.gap"))
    fits = (
        sizes.alias("s").join(nearest.alias("c"), F.expr("s.source <=> c.source AND h = filler"))
        .groupBy("c.source", "filler", "gap").agg(F.sum("size").alias("size")).where("size < 2 * gap")
    )
    chosen = staged(
        plan.alias("p").join(cut.alias("c"), F.expr("p.source <=> c.source"), "left")
        .join(fits.alias("f"), F.expr("p.source <=> f.source"), "left")
        .select("p.source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), "filler")
    )
    more = F.expr("int(h < cut OR coalesce(h = filler, false))")
    rows = sizes.alias("s").join(chosen.alias("c"), F.expr("s.source <=> c.source"))
    rows = rows.withColumn("repetitions", (F.col("whole") + more).cast("int"))
    return rows.select(
        F.col("id").alias(id_col), F.col("s.source").alias("source"), "size", "source_size", "target",
        "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"),
    )


#: DuckDB SQL for the same rows; {docs} is the table of documents, {seed} the seed.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM sources
), filled AS (
  SELECT *, row_number() OVER r AS place,
         (budget - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM ranked WINDOW r AS (ORDER BY cap / w, source NULLS LAST)
), plan AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, place) FROM filled WHERE cap / w >= level) * w) AS target
  FROM filled
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan
), rests AS (
  SELECT *, target - whole * source_size AS rest FROM shares
), units AS (
  SELECT source, h, sum(size)::BIGINT AS size FROM sizes GROUP BY source, h
), summed AS (
  SELECT u.*, rest, sum(u.size) OVER (PARTITION BY u.source ORDER BY h) AS upto
  FROM units u JOIN rests r ON u.source IS NOT DISTINCT FROM r.source WHERE rest > 0
), cuts AS (
  SELECT source, min(h) AS cut, arg_min(rest - upto + size, h) AS gap FROM summed WHERE upto > rest GROUP BY source
), nearest AS (
  SELECT c.source, first(s.h ORDER BY abs(gap - s.size), s.h) AS filler, first(gap) AS gap
  FROM sizes s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source WHERE s.h >= cut AND s.size > 0 GROUP BY c.source
), fits AS (
  SELECT n.source, filler FROM nearest n JOIN units u ON u.source IS NOT DISTINCT FROM n.source AND u.h = filler
  WHERE u.size < 2 * gap
)
SELECT s.doc_id, s.source, s.size, r.source_size, r.target,
       (whole + CASE WHEN s.h < coalesce(cut, '') OR coalesce(s.h = filler, false) THEN 1 ELSE 0 END)::INT AS repetitions,
       (s.size * repetitions)::BIGINT AS taken
FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
LEFT JOIN cuts c ON c.source IS NOT DISTINCT FROM s.source
LEFT JOIN fits f ON f.source IS NOT DISTINCT FROM s.source
"""
