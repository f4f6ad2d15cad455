"""Quality rules: counts of every text, and a log-likelihood ratio of hashed word n-grams.

Two multinomials over hashed 1- and 2-grams: one of the documents labelled as good, one of
the whole corpus. A document's verdict is the mean log ratio of its n-grams against a
threshold that is chosen on labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import SPACES, Words, cuts, hashes, mix, words
from .common import free_name

BUCKETS = 1 << 16
#: Largest number of labelled documents of each label that target and threshold are fitted on.
FIT_DOCS = 10_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, owner: np.ndarray, texts: int, window: int = 8) -> np.ndarray:
    """Of each text, the words in windows that occur twice or more in it, the first included.

    Windows are told apart by 64-bit hashes of their words' hashes and of their text.
    """
    n = len(hashes) - window + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    runs, span = hashes, 1
    while span < window:
        runs = mix(runs[: len(runs) - span] * np.uint64(3) + (runs[span:] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        span *= 2
    whole = np.flatnonzero(owner[:n] == owner[window - 1 :])
    keys = mix(runs[whole] + owner[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ranked = np.sort(keys)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(again):
        return np.zeros(texts, np.int64)
    at = whole[again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=texts)


def duplicate_lines(w: Words) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(w.data == 10)
    start = np.union1d(w.bounds[:-1], breaks + 1)
    start = start[start < len(w.data)]
    end = np.minimum(np.append(start[1:], len(w.data)), np.append(breaks, len(w.data))[np.searchsorted(breaks, start)])
    filled = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    start, end = start[filled], end[filled]
    owner = np.searchsorted(w.bounds, start, "right") - 1
    keys = mix(hashes(w.data, start, end) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(keys, return_index=True)
    texts = len(w.lengths)
    return np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts)


def grams(w: Words, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1-grams, then of all 2-grams inside a text, and the text of each."""
    inside = w.owner[1:] == w.owner[:-1]
    two = mix(hashed[:-1] * np.uint64(3) + hashed[1:])[inside]
    return (np.concatenate([hashed, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([w.owner, w.owner[1:][inside]])


@dataclass
class Model:
    """Log ratio of target to raw for each bucket, and the least mean that is kept."""

    ratio: np.ndarray
    threshold: float


def _means(ratio: np.ndarray, w: Words, hashed: np.ndarray) -> np.ndarray:
    buckets, owner = grams(w, hashed)
    total = np.bincount(owner, ratio[buckets], len(w.lengths))
    return total / np.maximum(1, np.bincount(owner, minlength=len(w.lengths)))


def _sample(labels: DataFrame, id_col: str, label_col: str, value: int, most: int) -> DataFrame:
    ids = labels.where(F.col(label_col) == value).select(F.col(id_col).alias("lid")).where("lid is not null").distinct()
    return ids.orderBy(F.xxhash64("lid"), "lid").limit(most).withColumn("label", F.lit(value))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most=FIT_DOCS) -> Model:
    """Counts the n-grams of all documents, and those of the labelled half that makes the target.

    At most ``most`` documents of each label are used, dealt in two halves by a hash of the id.
    The documents labelled 1 of the first are the target. The threshold is the mean log ratio
    that best tells the labels of the second apart (largest sum of the two shares that it gets
    right), halfway between the neighbouring scores; where the second lacks a label nothing is
    rejected. Null ids and labels other than 0 and 1 don't count; an id of both labels counts
    as both. The labelled ids are broadcast: 2 * ``most`` at the largest.
    """
    picked = F.broadcast(_sample(labels, id_col, label_col, 1, most).union(_sample(labels, id_col, label_col, 0, most)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = F.pmod(F.xxhash64(F.lit("half"), "lid"), F.lit(2)) == 0
    good = picked.where("label = 1").where(first).select("lid").distinct()
    flagged = rows.join(F.broadcast(good), F.col("id") == F.col("lid"), "left").select("text", F.col("lid").isNotNull().alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, target = batch.column(0), np.array(batch.column(1).to_pylist(), bool)
            for a, b in cuts(texts):
                w = words(texts.slice(a, b - a))
                buckets, owner = grams(w, w.hashes())
                sums[0] += np.bincount(buckets, minlength=BUCKETS)
                sums[1] += np.bincount(buckets[target[a:b][owner]], minlength=BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "good"])

    table = flagged.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in table.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.good
    share = (raw + 1) / (raw.sum() + BUCKETS)
    # The target is smoothed towards the corpus, so that what it lacks isn't simply rare.
    smooth = 0.05 * max(1.0, target.sum())
    model = Model(np.log((target + smooth * share) / (target.sum() + smooth) / share), -np.inf)
    if not target.sum():
        return model
    labelled = rows.join(F.broadcast(picked.where(~first)), F.col("id") == F.col("lid")).select("text", "label")
    scored = means(labelled, model, "text").select("label", "llr").where("llr is not null").toPandas()  # 2 * most rows
    s, y = scored["llr"].to_numpy(), scored["label"].to_numpy()
    if len(set(y.tolist())) == 2:
        order = np.argsort(s, kind="stable")
        s, y = s[order], y[order]
        right = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / (y == 1).sum()
        right = np.where(np.append(s[1:] > s[:-1], True), right, -1)
        k = int(right.argmax())
        model.threshold = float((s[k] + s[min(k + 1, len(s) - 1)]) / 2) if right[k] > 0 else -np.inf
    return model


def means(docs: DataFrame, model: Model, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without its text, with ``llr`` (0 for texts without a word) and, with
    ``counts``, the counts of COUNTS. Rows, repeats included, and other columns are kept."""
    passed = [c for c in docs.columns if c != text_col]
    new = [free_name(docs, c) for c in ((*COUNTS, "llr") if counts else ("llr",))]
    schema = T.StructType([docs.schema[c] for c in passed])
    for c in new:
        schema = schema.add(c, "double" if c.startswith("llr") else "long")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for a, b in cuts(texts):
                w = words(texts.slice(a, b - a))
                hashed = w.hashes()
                columns = [batch.column(c).slice(a, b - a) for c in passed]
                if counts:
                    letters = ~SPACES[w.data] & (w.data & 0xC0 != 0x80)
                    numbers = (
                        w.lengths, w.per_text(letters), w.per_text(SYMBOLS[w.data]), duplicate_lines(w),
                        repeated_words(hashed, w.owner, b - a),
                    )
                    columns += [pa.array(x, pa.int64()) for x in numbers]
                columns.append(pa.array(_means(shared.value.ratio, w, hashed), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*dict.fromkeys([*passed, text_col])).mapInArrow(run, schema)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, llr, kept) for every row; null and empty texts have no words
    and so fail the base rules. Null ids stay null. An empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = means(rows, model, "text", True).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(float(model.threshold))))
    return out.withColumnRenamed("id", id_col)
