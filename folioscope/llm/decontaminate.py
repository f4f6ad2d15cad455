"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

The items are the documents of the index and every training passage is a query. Impacts
are divided by the item's own threshold, so an item is retrieved where its impacts sum
to 1. A bound by pieces of a text leaves few passages; each of these is searched by
block-max WAND, and what it retrieves is verified: the item's question and its answer must
each be found again.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, splitter

#: Items of one index; more items are dealt into several indexes, each run over all texts. All
#: take their statistics from all items, so that results don't depend on the dealing.
INDEX_ITEMS = 20_000
#: A score of 1, less what sums of single-precision numbers may lack.
LEAST = 1 - 1e-5
SENTENCE = re.compile(r"(?<=[.!?])\s+")


_words = splitter(string.ascii_letters + string.digits + "_")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits, _ and any non-ASCII characters."""
    return _words(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The item's words before its last line or sentence, and those of that last part.

    An item of one part, or whose last part has under five words, is split so that the
    answer has a third of the words, five at least where there are ten.
    """
    parts = [p for p in (text or "").split("\n") if tokens(p)]
    if len(parts) < 2:
        parts = [p for p in SENTENCE.split(text or "") if tokens(p)]
    words = tokens(text)
    answer = tokens(parts[-1]) if len(parts) > 1 else []
    if len(answer) < 5 or len(words) - len(answer) < 5:
        n = max(len(words) // 3, min(5, len(words) // 2))
        answer = words[len(words) - n :]
    return words[: len(words) - len(answer)], answer


def shingles(words: list[bytes], size: int = 5) -> set:
    """Word shingles; of fewer words, the whole sequence; none of no words."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@dataclass
class Statistics:
    """Of all items with a word: how many, their words, those of the longest, and items with
    each word."""

    n: int
    words: int
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, texts) -> Statistics:
        df: Counter = Counter()
        n = total = longest = 0
        for t in texts:
            if w := tokens(t):
                n, total, longest = n + 1, total + len(w), max(longest, len(w))
                df.update(set(w))
        return cls(n, total, longest, df)


class Index:
    """Postings with impacts relative to each item's threshold, and the maxima of their blocks,
    kept for those blocks only in which a term has postings."""

    def __init__(self, items: list[tuple], share: float = 0.6, k1: float = 1.2, b: float = 0.4, block: int = 16, facts: Statistics | None = None):
        facts = facts or Statistics.of(t for _, t in items)
        items = [(i, t, w) for i, t in items if (w := tokens(t))]
        self.ids = [i for i, _, _ in items]
        self.parts = [question_and_answer(t) for _, t, _ in items]
        self.shingles = [tuple((shingles(p), len(p)) for p in parts) for parts in self.parts]
        counts = [Counter(w) for _, _, w in items]
        df = facts.df
        self.term = {t: k for k, t in enumerate(sorted(set(chain.from_iterable(counts))))}
        n, every, mean = len(items), facts.n, facts.words / max(1, facts.n)
        rows: list[list] = [[] for _ in self.term]
        for k, (c, (_, _, words)) in enumerate(zip(counts, items, strict=True)):
            norm = k1 * (1 - b + b * len(words) / mean)
            impact = {t: np.log(1 + (every - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + norm) for t, f in c.items()}
            least = share * sum(impact.values())
            for t, v in impact.items():
                rows[self.term[t]].append((k, v / least))
        self.start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        self.item = np.array([k for r in rows for k, _ in r], np.int64)
        self.impact = np.array([v for r in rows for _, v in r], np.float32)
        self.block = block
        # A term's postings ascend by item, so those of one block follow one another.
        owner = np.repeat(np.arange(len(rows)), np.diff(self.start))
        key = owner * (n // block + 1) + self.item // block
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_of = self.item[first] // block
        self.block_max = np.maximum.reduceat(self.impact, first) if len(key) else np.zeros(0, np.float32)
        self.block_start = np.searchsorted(owner[first], np.arange(len(rows) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(key) else np.zeros(0, np.float32)
        # Frequent terms, as long as those that any one item has sum to ``frequent`` at most:
        # a passage must get the rest of 1 from the other terms, whatever frequent ones it has.
        self.frequent, held, self.rare = 0.6, np.zeros(n), np.ones(len(rows), bool)
        for t in sorted(range(len(rows)), key=lambda t: (-len(rows[t]), t)):
            a, b = self.start[t], self.start[t + 1]
            if (held[self.item[a:b]] + self.impact[a:b]).max() <= self.frequent:
                held[self.item[a:b]] += self.impact[a:b]
                self.rare[t] = False
        self.held = held.astype(np.float32)
        self.window = max(128, 2 * facts.longest)

    def retrieve(self, terms: np.ndarray, passage: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """(passage, item, score) of every score of 1 or more. ``terms``: distinct index terms
        of each passage, ``passage``: their passages, ascending, below ``n``."""
        if not len(terms):
            return []
        bound = np.bincount(passage, self.most[terms], n)
        ok = bound[passage] >= LEAST
        terms, passage = terms[ok], passage[ok]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(passage)) + 1, [len(passage)]))
        out = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b > a:
                out += [(int(passage[a]), i, s) for i, s in self._wand(terms[a:b].tolist())]
        return out

    def _wand(self, terms: list[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of every score of 1 or more, by block-max WAND.

        Cursors stand at the next item of each term. The pivot is the first item that the
        terms' maxima could bring to 1; if the maxima of its block can't, the cursors go past the
        block, else they go to the pivot, which is scored once all that can add to it are there.
        """
        lists = [self.item[a:b].tolist() for a, b in ((self.start[t], self.start[t + 1]) for t in terms)]
        held = [(self.block_of[a:b].tolist(), self.block_max[a:b].tolist()) for a, b in ((self.block_start[t], self.block_start[t + 1]) for t in terms)]
        most, impact, begin = self.most[terms].tolist(), self.impact, self.start[terms].tolist()
        at = [0] * len(terms)
        cursors = sorted((own[0], k) for k, own in enumerate(lists))

        def go(count: int, least: int) -> None:
            """Moves the first ``count`` cursors to their next item from ``least`` on."""
            moved = []
            for i, k in cursors[:count]:
                if i < least:
                    at[k] = bisect_left(lists[k], least, at[k])
                    if at[k] == len(lists[k]):
                        continue
                    i = lists[k][at[k]]
                moved.append((i, k))
            cursors[:count] = moved
            cursors.sort()

        while True:
            bound, pivot = 0.0, 0
            for pivot, (_, k) in enumerate(cursors):  # noqa: B007
                bound += most[k]
                if bound >= LEAST:
                    break
            if bound < LEAST:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, bound = item // self.block, 0.0
            for _, k in cursors[: pivot + 1]:
                blocks, maxima = held[k]
                p = bisect_left(blocks, block)
                if p < len(blocks) and blocks[p] == block:
                    bound += maxima[p]
            if bound < LEAST:
                past = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    past = min(past, cursors[pivot + 1][0])
                go(pivot + 1, past)
            elif cursors[0][0] < item:
                go(pivot + 1, item)
            else:
                score = sum(float(impact[begin[k] + at[k]]) for _, k in cursors[: pivot + 1])
                if score >= LEAST:
                    yield item, score
                go(pivot + 1, item + 1)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, item, score) of all passages of all texts.

        Passages are windows of ``window`` words that overlap by half, so that any run of half
        that length, and with it any item, lies whole in one of them.
        """
        half, get = self.window // 2, self.term.get
        words = [tokens(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        total = int(lengths.sum())
        if not total or not self.ids:
            return []
        ids = np.fromiter(map(get, chain.from_iterable(words), repeat(-1)), np.int64, total)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        per_text = -(-lengths // half)  # pieces of half a window of each text
        base = np.cumsum(per_text) - per_text
        n, v = int(per_text.sum()), len(self.term)
        rare = np.flatnonzero(self.rare[ids] & (ids >= 0))
        owner = np.searchsorted(ends, rare, "right")
        pairs = np.unique((base[owner] + (rare - begins[owner]) // half) * v + ids[rare])
        mass = np.bincount(pairs // v, self.most[pairs % v], n)
        # A window is two neighbouring pieces of one text.
        text_of = np.repeat(np.arange(len(words)), per_text)
        paired = np.append(text_of[:-1] == text_of[1:], False)
        both = mass + np.where(paired, np.append(mass[1:], 0), 0)
        tail = np.append(False, paired[:-1]) & ~paired  # the last piece is in the window before
        likely = (both >= 1 - self.frequent - 1e-5) & ~tail
        starts = np.flatnonzero(likely & self._reached(pairs, likely, paired))
        if not len(starts):
            return []
        pairs = []
        for k, piece in enumerate(starts.tolist()):
            at = int(begins[text_of[piece]]) + (piece - int(base[text_of[piece]])) * half
            own = np.unique(ids[at : min(at + self.window, int(ends[text_of[piece]]))])
            pairs.append(own[own >= 0] + k * v)
        pairs = np.concatenate(pairs)
        hits = self.retrieve(pairs % v, pairs // v, len(starts))
        out = []
        for p, item, s in hits:
            piece_no = int(starts[p])
            k = int(text_of[piece_no])
            out.append((k, (piece_no - int(base[k])) * half, item, s))
        return out

    def _reached(self, pairs: np.ndarray, likely: np.ndarray, paired: np.ndarray) -> np.ndarray:
        """Of windows, whether some item gets enough from its rare terms alone to reach 1 with
        all of its frequent ones. ``pairs``: piece * terms + rare term."""
        v, n = len(self.term), len(self.ids)
        used = likely | np.append(False, (likely & paired)[:-1])
        pairs = pairs[used[pairs // v]]
        piece, term = pairs // v, pairs % v
        sizes = self.start[term + 1] - self.start[term]
        take = np.repeat(self.start[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        keys, which = np.unique(np.repeat(piece, sizes) * n + self.item[take], return_inverse=True)
        mass = np.bincount(which, self.impact[take], len(keys))
        item, piece = keys % n, keys // n
        total = mass.copy()
        if len(keys):
            at = np.minimum(np.searchsorted(keys, keys + n), len(keys) - 1)
            total += np.where((keys[at] == keys + n) & paired[piece], mass[at], 0)
        out = np.zeros(len(likely), bool)
        enough = total >= 1 - self.held[item] - 1e-4
        out[piece[enough]] = True
        # An item with rare terms in the second piece only is that piece's own entry.
        alone = piece[mass >= 1 - self.held[item] - 1e-4]
        alone = alone[alone > 0]
        out[alone[paired[alone - 1]] - 1] = True
        return out

    def verify(self, words: list[bytes], item: int) -> tuple[float, float]:
        """Shares of the item's question and answer shingles that the words have."""
        shares = []
        for own, n in self.shingles[item]:
            size = min(5, n)
            shares.append(len(own & shingles(words, size)) / len(own) if own and len(words) >= size else float(not own))
        return shares[0], shares[1]

    def matches(self, texts: list[str | None], least: float) -> list[tuple[int, object, float, float, float]]:
        """(text, item id, best score, question share, answer share), one for each pair."""
        found: dict[tuple[int, int], tuple] = {}
        for k, at, item, s in self.search(texts):
            q, a = self.verify(tokens(texts[k])[at : at + self.window], item)
            if q >= least and a >= least:
                old = found.get((k, item), (0.0, 0.0, 0.0))
                found[k, item] = (max(s, old[0]), max(q, old[1]), max(a, old[2]))
        return [(k, self.ids[item], *v) for (k, item), v in sorted(found.items())]


def _indexes(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Index]:
    """Indexes of at most about ``most`` items each; every item is in one. The vocabulary of all
    items is held on the driver, their texts part by part."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    parts = max(1, -(-rows.count() // most))
    dealt = lambda part: rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t")
    facts = Statistics.of(r.t for part in range(parts) for r in dealt(part).toLocalIterator()) if parts > 1 else None
    for part in range(parts):
        yield Index([(r.i, r.t) for r in dealt(part).collect()], facts=facts)


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.8,
    most_items: int = INDEX_ITEMS,
) -> DataFrame:
    """(id, item id, score, question_overlap, answer_overlap) for each document that holds an
    item: BM25 of a passage at 0.6 or more of the item's score with itself, and at least
    ``least`` of the five-word shingles of both its question and its answer in that passage.

    score: BM25 over the item's threshold, 1 or more; the best over the passages. See
    ``tokens`` for words. Null and empty texts match nothing; items without a word are left
    out; an item id that has several texts counts each. Repeated rows give repeated results,
    null ids are kept as null. Empty tables give an empty result.
    """
    doc_type, item_type = docs.schema[id_col].dataType, items.schema[item_id_col].dataType
    item_name = item_id_col if item_id_col.lower() != id_col.lower() else f"benchmark_{item_id_col}"
    schema = T.StructType().add(id_col, doc_type).add(item_name, item_type)
    for c in ("score", "question_overlap", "answer_overlap"):
        schema = schema.add(c, "double")
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for index in _indexes(items, item_id_col, item_text_col, most_items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, item_kind = batch.column(1).to_pylist(), None
                for a, b in slices(texts):
                    found = shared.value.matches(texts[a:b], least)
                    if found:
                        rows, ids, *numbers = zip(*found, strict=True)
                        item_kind = pa.array(ids) if item_kind is None else pa.array(ids, item_kind.type)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(a, b - a).take(pa.array(rows)), item_kind, *(pa.array(x, pa.float64()) for x in numbers)],
                            names=schema.names,
                        )

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = out.unionByName(part)
    return out


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id has a verified match. Rows without an id stay."""
    found = matches(docs, items, id_col, **options).select(F.col(id_col).alias("held")).distinct()
    return docs.join(found, F.col(id_col) == F.col("held"), "left_anti")
