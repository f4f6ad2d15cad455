"""Toxic spans by a linear-chain conditional random field with two tags.

Token labels come from document labels: a word is tagged toxic in a toxic document when
one of its features (the word or a prefix of it) occurs in toxic documents far more than
in clean ones. The chain is fitted on those tokens; forward-backward marginals give the
spans, and a logistic map of their sums gives the document's score.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain as joined
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import mix
from .common import Numbered, fold, free_name, slices, splitter

#: A token: a run of ASCII letters and of any non-ASCII characters. The same twice: to cut, to locate.
cut = splitter(string.ascii_letters)
TOKEN = re.compile(r"[^\x00-@\[-`{-\x7f]+")
#: Largest number of labelled documents that the model is fitted on, half of each label at most.
FIT_DOCS = 4000
#: Texts of one labelled id that are learned from, at most.
TEXTS = 4
#: Length of the blocks in which a chain is evaluated.
STEP = 256
SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("probability", T.DoubleType()),
        ]
    )
)


def letters(word: bytes) -> str:
    """The letters of a token, lower case."""
    w = word.decode("utf-8", "surrogatepass").lower()
    return w if w.isalpha() else "".join(filter(str.isalpha, w))


def features(word: bytes) -> list[str]:
    """The letters of the word and their first 4 to 7."""
    w = letters(word)
    return ["w" + w, *("p" + w[:k] for k in range(4, 8) if len(w) > k)]


@dataclass
class Chain:
    """weight: emission score that a feature adds to the toxic tag; bias: that of every token;
    link[i, j]: score of tag j after tag i; first[j]: of tag j at the start of a text;
    head: logistic weights of the document score."""

    weight: dict[str, float]
    bias: float
    link: np.ndarray
    first: np.ndarray
    head: np.ndarray

    def emissions(self, words: list[bytes]) -> list[float]:
        # Every feature of a word begins with the word's first letters: most words have none.
        opening = {f[1:5] for f in self.weight}
        get, bias = self.weight.get, self.bias
        return [bias + sum(get(f, 0.0) for f in features(w)) if letters(w)[:4] in opening else bias for w in words]


def marginals(emit: np.ndarray, starts: np.ndarray, link: np.ndarray, first: np.ndarray, links: bool = True):
    """P(tag = toxic) of each token of texts laid end to end; with ``links`` also the expected
    number of links (2 x 2) and of first tags.

    ``starts``: True at the first token of each text. At a start the step matrix has equal
    rows, so texts don't reach into each other. All blocks of STEP tokens advance together:
    first their 2 x 2 products, then one pass over block borders, then inside the blocks.
    The forward message is kept as the ratio of its two entries, the backward one likewise.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
    size = STEP if n > STEP else n
    rows = -(-n // size)
    full = rows * size

    def grid(inside: float, at_start: float, factor=None, pad: float = 1.0) -> np.ndarray:
        out = np.full(full, pad)
        out[:n] = np.where(starts, at_start, inside)
        if factor is not None:
            out[:n] *= factor
        return out.reshape(rows, size).T.copy()

    hop, new = np.exp(np.clip(link, -30, 30)), np.exp(np.clip(first, -30, 30))
    e = np.exp(np.clip(emit, -30, 30))
    a, b = grid(hop[0, 0], new[0]), grid(hop[0, 1], new[1], e, 0.0)
    c, d = grid(hop[1, 0], new[0], None, 0.0), grid(hop[1, 1], new[1], e)
    if full > n:  # the padding is the identity
        c.T.reshape(-1)[n:] = 0.0
    pa_, pb, pc, pd = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for t in range(1, size):
        w, x, y, z = pa_ * a[t] + pb * c[t], pa_ * b[t] + pb * d[t], pc * a[t] + pd * c[t], pc * b[t] + pd * d[t]
        scale = 1 / (w + x + y + z)
        pa_, pb, pc, pd = w * scale, x * scale, y * scale, z * scale
    into, back = np.empty(rows), np.empty(rows)
    at = 1.0
    product = np.stack([pa_, pb, pc, pd], axis=1).tolist()
    for r, (w, x, y, z) in enumerate(product):
        into[r] = at
        at = (x + z * at) / (w + y * at)
    at = 1.0
    for r in range(rows - 1, -1, -1):
        w, x, y, z = product[r]
        back[r] = at
        at = (y + z * at) / (w + x * at)
    fore, aft = np.empty((size, rows)), np.empty((size, rows))
    now = into
    for t in range(size):
        now = (b[t] + d[t] * now) / (a[t] + c[t] * now)
        fore[t] = now
    now = back
    for t in range(size - 1, -1, -1):
        aft[t] = now
        now = (c[t] + d[t] * now) / (a[t] + b[t] * now)
    both = fore * aft
    p = (both / (1 + both)).T.reshape(full)[:n]
    if not links:
        return p, None, None
    before = np.concatenate([into[None], fore[:-1]])
    pair = np.stack([a, b * aft, before * c, before * d * aft])
    pair /= pair.sum(axis=0)
    pair = pair.transpose(0, 2, 1).reshape(4, full)[:, :n]
    return p, pair[:, ~starts].sum(axis=1).reshape(2, 2), np.array([(1 - p[starts]).sum(), p[starts].sum()])


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: 1, log(1 + expected toxic tokens), largest marginal, log(1 + tokens)."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1
    out[:, 3] = np.log1p(lengths) / 10
    some = np.flatnonzero(lengths)
    if len(some):
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))[some]
        out[some, 1] = np.log1p(np.add.reduceat(p, at))
        out[some, 2] = np.maximum.reduceat(p, at)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Newton steps of an L2-penalised logistic fit; the bias isn't penalised."""
    w, keep = np.zeros(x.shape[1]), penalty * len(y) * np.eye(x.shape[1]) / 10
    keep[0, 0] = 1e-6
    for _ in range(30):
        p = _sigmoid(x @ w)
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (p - y) + keep @ w)
    return w


def _strength(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of occurring in k1 of n1 and k0 of n0 texts against one common rate."""
    share = (k1 + k0) / (n1 + n0)
    term = lambda k, x: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(x, 1e-9)), 0.0)
    return 2 * (term(k1, n1 * share) + term(k0, n0 * share) + term(n1 - k1, n1 * (1 - share)) + term(n0 - k0, n0 * (1 - share)))


def telling(
    texts: list[np.ndarray], known: list[bytes], toxic: np.ndarray, ratio: float = 12.0, evidence: float = 18.0
) -> list[str]:
    """Features ``ratio`` times as frequent in toxic texts as in clean ones, with a
    log-likelihood ratio of ``evidence`` (chance alone gives a few in 10^5 features).
    ``texts``: numbers of the words in ``known``. Features are counted by 32-bit hashes."""
    sizes, packed = np.zeros(len(known), np.int64), array("L")
    for k, w in enumerate(known):
        own_hashes = [crc32(f.encode("utf-8", "surrogatepass")) for f in features(w)]
        packed.extend(own_hashes)
        sizes[k] = len(own_hashes)
    begins = np.cumsum(sizes) - sizes
    flat = np.array(packed, np.uint64).astype(np.uint32)
    found: dict[int, list[np.ndarray]] = {0: [np.zeros(0, np.uint32)], 1: [np.zeros(0, np.uint32)]}
    for ids, y in zip(texts, toxic.tolist(), strict=True):
        own = np.unique(ids)
        n = sizes[own]
        found[y].append(np.unique(flat[np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]))
    keys, k1 = np.unique(np.concatenate(found[1]), return_counts=True)
    clean, k0 = np.unique(np.concatenate(found[0]), return_counts=True)
    at = np.minimum(np.searchsorted(clean, keys), max(0, len(clean) - 1))
    k0 = np.where(clean[at] == keys, k0[at], 0) if len(clean) else np.zeros(len(keys), np.int64)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    good = (k1 > 1) & (k1 / n1 >= ratio * k0 / n0) & (_strength(k1, k0, n1, n0) >= evidence)
    hit = np.isin(flat, keys[good])
    chosen = set(flat[hit].tolist())
    holders = np.unique(np.repeat(np.arange(len(known)), sizes)[hit])
    return sorted({f for k in holders.tolist() for f in features(known[k]) if crc32(f.encode("utf-8", "surrogatepass")) in chosen})


def unlike(texts: list[np.ndarray], hashes: np.ndarray, shingle: int = 5) -> list[int]:
    """Positions of the texts that share no min-hash of word shingles with an earlier one.

    Copies of a toxic text would make all of its words look toxic. ``hashes``: of the words.
    """
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    seen: list[set] = [set() for _ in odd]
    kept = []
    for k, ids in enumerate(texts):
        h = hashes[ids]
        marks = h[: max(1, len(h) - shingle + 1)].copy()
        for j in range(1, min(shingle, len(h))):
            marks = mix(marks + h[j : j + len(marks)])
        least = [int((marks * m).min()) if len(marks) else 0 for m in odd]
        if not any(m in own for m, own in zip(least, seen, strict=True)):
            kept.append(k)
        for m, own in zip(least, seen, strict=True):
            own.add(m)
    return kept


def fit(texts: Iterable[str | None], toxic: list[int], rounds: int = 20) -> Chain:
    """A chain from whole labelled texts, one of each group of copies. Deterministic. Without
    texts of both labels every document scores near the one label there is (0 if none)."""
    known = Numbered(10**9)
    ids = [np.fromiter(map(known.__getitem__, w), np.int32, len(w)) for w in map(cut, texts)]
    hashes = mix(np.array([crc32(w.lower()) for w in known.words], np.uint64))
    chosen = unlike(ids, hashes)
    ids, y = [ids[k] for k in chosen], np.array([toxic[k] for k in chosen], np.int64)
    chain = Chain({}, -4.0, np.zeros((2, 2)), np.zeros(2), np.zeros(4))
    if len(y) == 0 or y.min() == y.max():
        chain.head[0] = 6.0 if len(y) and y[0] else -6.0
        return chain
    marks = telling(ids, known.words, y)
    column = {f: k for k, f in enumerate(marks)}
    lengths = np.array([len(i) for i in ids])
    tokens = np.concatenate(ids)
    has = [[column[f] for f in features(w) if f in column] for w in known.words]
    flat = np.array([k for ks in has for k in ks], np.int64)
    owner = np.repeat(np.arange(len(has)), [len(ks) for ks in has])
    bad = np.array([bool(ks) for ks in has], bool)
    starts = np.zeros(len(tokens), bool)
    starts[np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]] = True
    tag = (bad[tokens] & np.repeat(y == 1, lengths)).astype(np.int64) if len(tokens) else tokens
    seen_links = np.bincount((tag[:-1] * 2 + tag[1:])[~starts[1:]], minlength=4).reshape(2, 2)
    seen_first = np.bincount(tag[starts], minlength=2)
    per_word = np.bincount(tokens, weights=tag, minlength=len(has))
    weight = np.zeros(len(marks))
    square: dict[str, object] = dict.fromkeys("wblf", 0.0)
    emit = lambda: chain.bias + np.bincount(owner, weight[flat], len(has))
    # Runs of whole texts, so that memory depends on their length only.
    ends = np.cumsum(lengths)
    runs = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(tokens), 200_000), "right"), len(ends)))
    spans = [(int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in zip(runs, runs[1:], strict=False)]
    for _ in range(rounds if len(tokens) else 0):
        scores, p = emit(), np.empty(len(tokens))
        links, firsts = np.zeros((2, 2)), np.zeros(2)
        for a, b in spans:
            p[a:b], x, f = marginals(scores[tokens[a:b]], starts[a:b], chain.link, chain.first)
            links, firsts = links + x, firsts + f
        slope = per_word - np.bincount(tokens, p, len(has))
        steps = {
            "w": np.bincount(flat, slope[owner], len(marks)) - 0.1 * weight,
            "b": slope.sum(),
            "l": seen_links - links - 0.1 * chain.link,
            "f": seen_first - firsts - 0.1 * chain.first,
        }
        for k, g in steps.items():  # AdaGrad
            square[k] = square[k] + g * g
            steps[k] = g / (np.sqrt(square[k]) + 1e-6)
        weight = weight + steps["w"]
        chain.bias += float(steps["b"])
        chain.link = chain.link + steps["l"]
        chain.first = chain.first + steps["f"]
    chain.weight = dict(zip(marks, weight.tolist(), strict=True))
    scores, p = emit(), np.zeros(len(tokens))
    for a, b in spans:
        p[a:b] = marginals(scores[tokens[a:b]], starts[a:b], chain.link, chain.first, False)[0]
    chain.head = _logistic(summary(p, lengths), y)
    return chain


class Scorer:
    """Applies a chain to texts; remembers the emission score of words seen before."""

    def __init__(self, model: Chain):
        self.chain, self.known, self.emit = model, Numbered(), np.zeros(0)

    def _emissions(self, numbers: np.ndarray) -> np.ndarray:
        new = self.known.words[len(self.emit) :]
        if new:
            self.emit = np.concatenate([self.emit, np.array(self.chain.emissions(new))])
        return self.emit[numbers]

    def __call__(self, texts: list[str | None], spans: bool = False):
        """Scores, and with ``spans`` the runs of tokens with a marginal of 0.5 or more."""
        words = [cut(t) for t in texts]
        get = self.known.__getitem__
        lengths = np.array([len(w) for w in words], np.int64)
        numbers = np.fromiter(map(get, joined.from_iterable(words)), np.int64, int(lengths.sum()))
        starts = np.zeros(len(numbers), bool)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
        starts[begins[lengths > 0]] = True
        p, _, _ = marginals(self._emissions(numbers), starts, self.chain.link, self.chain.first, False)
        if self.known.full():
            self.known.forget()
            self.emit = np.zeros(0)
        scores = _sigmoid(summary(p, lengths) @ self.chain.head)
        if not spans:
            return scores, None
        runs = []
        for text, a, n in zip(texts, begins.tolist(), lengths.tolist(), strict=True):
            own, found = p[a : a + n], []
            if n and own.max() >= 0.5:
                last = -2
                for k, m in enumerate(TOKEN.finditer(text)):
                    if own[k] >= 0.5:
                        if k == last + 1:
                            found[-1] |= {"end": m.end(), "probability": max(found[-1]["probability"], float(own[k]))}
                        else:
                            found.append({"start": m.start(), "end": m.end(), "probability": float(own[k])})
                        last = k
            runs.append(found)
        return scores, runs


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", most=FIT_DOCS) -> Chain:
    """Fit on the documents of at most ``most`` labelled ids, ``most // 2`` of each label, the
    first by a hash (a bounded sample). Rows without an id, or a label of 0 or 1, don't count;
    ids labelled twice count once for each label. The ids are broadcast: ``most`` at the largest.
    Of an id that repeats with different texts ``TEXTS`` count, the first by a hash, so that the
    driver gets no more than ``most * TEXTS`` texts.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).distinct()
    real = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    first = lambda y: marked.where(F.col("y") == y).orderBy(F.xxhash64("lid"), "lid").limit(most // 2)
    picked = F.broadcast(first(0).union(first(1)))
    own = docs.join(picked, F.col(id_col) == F.col("lid")).select("lid", "y", F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    place = F.row_number().over(W.partitionBy("lid", "y").orderBy("h"))
    few = own.withColumn("place", place).where(F.col("place") <= TEXTS)
    rows = sorted(few.collect(), key=lambda r: (r["y"], r["lid"], r["text"] or ""))
    ys = [r["y"] for r in rows]
    model = fit((r["text"] for r in rows), ys)
    if 0 in ys and 1 in ys:
        # The sample holds too many toxic documents; shift the score back to their real share.
        model.head[0] += np.log(real[1] / real[0]) - np.log(ys.count(1) / ys.count(0))
    return model


def score(
    docs: DataFrame, model: Chain, text_col: str = "text", spans: bool = False, keep_text: bool = False
) -> DataFrame:
    """``docs`` (its text only with ``keep_text``) with ``score`` (double, 0 to 1) and,
    with ``spans``, ``toxic_spans``: array of (start, end, probability) in characters.

    Null and empty texts score as a text without tokens. Rows, repeats included, and other
    columns are kept; where their names clash with the new ones, those get a ``_`` appended.
    """
    passed = [c for c in docs.columns if keep_text or c != text_col]
    out = free_name(docs.select(*passed) if passed else docs, "score")
    extra = free_name(docs, "toxic_spans")
    schema = T.StructType([docs.schema[c] for c in passed]).add(out, "double", False)
    if spans:
        schema = schema.add(extra, SPANS)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for a, b in slices(texts):
                scores, found = scorer(texts[a:b], spans)
                columns = [*(batch.column(c).slice(a, b - a) for c in passed), pa.array(scores, pa.float64())]
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
                    columns.append(pa.array(found, kind))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*dict.fromkeys([*passed, text_col])).mapInArrow(run, schema)


def learnable(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows (of documents or labels) that may be learned from: crc32(id) mod 4 is not 2."""
    return rows.where(fold(id_col, 4) != 2)
