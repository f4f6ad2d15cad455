"""Language-model scores: causal self-attention in numpy over subword ids.

log P(text) is a sum over the subwords of its lower-cased words, and one end. Each factor is
P(class of the subword | attention over the subwords before it) times P(subword | class,
subword before), the latter from counts of the whole corpus. Beside it stands a unigram
baseline over words with corpus-wide counts.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, cuts, words
from .common import fold, staged

#: Subwords with a row of their own, and the rows that all others are dealt to by their id.
KEPT, SHARED = 1024, 256
CLASSES = 32
DIM = 8
#: Tokens of a window, and how many of them are only context (but in a text's first window).
WINDOW, CONTEXT = 16, 4
#: Windows of one training step.
BATCH = 1024
SLICE, CHUNK = 1_000_000, 6
#: Words whose counts a task holds before it hands them on, and rows of one batch of them.
HELD_WORDS, BATCH_ROWS = 500_000, 1 << 16


def tokenizer_path() -> str:
    """The default vocabulary, where the box has it; a parameter of every function here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Subwords:
    """Subword ids of words by a byte-level BPE; remembers the words seen by their hashes."""

    _shared: dict[str, Subwords] = {}

    def __init__(self, path: str, most: int = 500_000):
        import public_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2  # and one id for the end of a text
        self.newline, self.most = ranks[b"\n"], most
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    @classmethod
    def at_path(cls, path: str) -> Subwords:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def lookup(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids lie in ``self.ids``, and how many it has. ``hashes``: distinct,
        ascending; start/end: one occurrence of each."""
        if len(self.hashes) + len(hashes) > self.most:
            self._forget()
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            ids = np.array(self.encoding.encode_ordinary("\n".join(texts) + "\n"), np.int32)
            stops = np.flatnonzero(ids == self.newline)
            if len(stops) != len(new):  # a word whose own bytes hold the separator
                parts = [self.encoding.encode_ordinary(t) for t in texts]
                ids = np.array([i for p in parts for i in [*p, self.newline]], np.int32)
                stops = np.cumsum([len(p) + 1 for p in parts]) - 1
            begins = np.append(0, stops[:-1] + 1)
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
            self.at = np.insert(self.at, place[new], begins + base)
            self.n = np.insert(self.n, place[new], stops - begins)
            place = np.searchsorted(self.hashes, hashes)
        return self.at[place], self.n[place]

    def texts(self, column: pa.Array):
        """(ids of all texts end to end, each text closed by the end id; tokens of each text;
        distinct word hashes, distinct word of each word; words)."""
        w = words(column, LOWER)
        hashed = w.hashes()
        distinct, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        at, n = self.lookup(distinct, w.data, w.start[first], w.end[first])
        sizes = n[which]
        # One more place after each text for its end.
        stream = np.full(int(sizes.sum()) + len(w.lengths), self.size - 1, np.int32)
        begins = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
        stream[np.arange(len(inside)) + np.repeat(w.owner, sizes)] = self.ids[np.repeat(at[which], sizes) + inside]
        lengths = np.bincount(w.owner, sizes, len(w.lengths)).astype(np.int64) + 1
        return stream, lengths, distinct, which, w


@dataclass
class Model:
    """reduced: row of each subword; cls: class of each row; pair[u, v]: log P(v | class of v, u);
    rest: log P(subword | its row); query, key, value: of each row; near: score by distance;
    out: class scores of the last subword, mix: of the attended value."""

    reduced: np.ndarray
    cls: np.ndarray
    pair: np.ndarray
    rest: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    near: np.ndarray
    out: np.ndarray
    mix: np.ndarray


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and text of each window; the windows of a text overlap by CONTEXT."""
    step = WINDOW - CONTEXT
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    owner = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(lengths) - lengths)[owner] + k * step, owner


def forward(m: Model, seen: np.ndarray):
    """Class scores after each token of ``seen`` (windows x tokens of row numbers)."""
    q, k, v = m.query[seen], m.key[seen], m.value[seen]
    t = seen.shape[1]
    back = np.arange(t)[:, None] - np.arange(t)[None, :]
    mask = np.where(back >= 0, m.near[np.maximum(back, 0)], -np.float32(40)).astype(np.float32)
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += mask
    np.clip(a, -40, 40, out=a)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    h = np.matmul(a, v)
    return h @ m.mix + m.out[seen], (q, k, v, a, h)


def attend(m: Model, seen: np.ndarray) -> np.ndarray:
    """The class scores of ``forward``, clipped, without what only training needs."""
    t = seen.shape[1]
    back = np.arange(t)[:, None] - np.arange(t)[None, :]
    mask = np.where(back >= 0, np.exp(m.near[np.maximum(back, 0)]), 0).astype(np.float32)
    a = np.matmul(m.query.take(seen, axis=0), m.key.take(seen, axis=0).transpose(0, 2, 1))
    np.clip(a, -40, 40, out=a)
    np.exp(a, out=a)
    a *= mask
    h = np.matmul(a, m.value.take(seen, axis=0))
    h /= (a @ np.ones(t, np.float32))[..., None]
    scores = h.reshape(-1, DIM) @ m.mix
    scores += m.out.take(seen.ravel(), axis=0)
    return np.clip(scores, -40, 40, out=scores).reshape(*seen.shape, CLASSES)


def inputs(m: Model, stream: np.ndarray, lengths: np.ndarray):
    """Rows of the stream, and those of the token before each (a text's first: the end's)."""
    rows = m.reduced[stream]
    before = np.concatenate([[m.reduced[-1]], rows[:-1]]).astype(rows.dtype)
    before[np.cumsum(lengths) - lengths] = m.reduced[-1]
    return rows, before


def log_probabilities(m: Model, stream: np.ndarray, lengths: np.ndarray, batch: int = 512) -> np.ndarray:
    """log P of each token of the stream, each scored in exactly one window."""
    rows, before = inputs(m, stream, lengths)
    start, owner = windows(lengths)
    ends = np.cumsum(lengths)
    first = np.append(True, owner[1:] != owner[:-1])
    out = np.zeros(len(stream))
    padded = np.concatenate([before, np.zeros(WINDOW, before.dtype)])
    want = np.concatenate([m.cls[rows], np.zeros(WINDOW, m.cls.dtype)])
    place, ones = np.arange(WINDOW), np.ones(CLASSES, np.float32)
    for a in range(0, len(start), batch):
        at = start[a : a + batch, None] + place
        scores = attend(m, padded.take(at))
        picked = scores.ravel().take(np.arange(at.size).reshape(at.shape) * CLASSES + want.take(at))
        np.exp(scores, out=scores)
        logp = picked - np.log(scores @ ones)
        fresh = (place >= CONTEXT) | first[a : a + batch, None]
        fresh &= at < ends[owner[a : a + batch], None]
        out[at[fresh]] = logp[fresh]
    return out + m.pair[before, rows] + m.rest[stream]


#: Values that are added up at once in ``sums_by_row``.
RUN = 8


def sums_by_row(parts: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, ascending, and the sums of the parts' values side by side: values
    in the order of their rows are laid out in runs of RUN, the last of each row filled up with
    zeros, and summed by run before by row."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    by_row = rows[order]
    first = np.flatnonzero(np.append(True, by_row[1:] != by_row[:-1]))
    many = np.diff(np.append(first, len(rows)))
    runs = -(-many // RUN)
    begins = np.cumsum(runs) - runs
    laid = np.full(int(runs.sum()) * RUN, len(rows))
    laid[np.arange(len(rows)) + np.repeat(begins * RUN - first, many)] = order
    values = np.zeros((len(rows) + 1, sum(x.shape[1] for x in parts)), parts[0].dtype)
    np.concatenate(parts, axis=1, out=values[:-1])
    by_run = np.matmul(np.ones(RUN, values.dtype), values.take(laid, axis=0).reshape(-1, RUN, values.shape[1]))
    return by_row[first], np.add.reduceat(by_run, begins, axis=0)


LEARNED = ("query", "key", "value", "near", "out", "mix")


class Trainer:
    """Adam on the class cross-entropy of windows; gradients by hand."""

    def __init__(self, m: Model, rate: float = 0.01):
        self.m, self.rate, self.steps = m, rate, 0
        self.state = {n: (np.zeros_like(getattr(m, n)), np.zeros_like(getattr(m, n))) for n in LEARNED}
        back = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        self.back, self.open = np.maximum(back, 0), back >= 0
        self.ones = np.ones(CLASSES, np.float32)

    def learn(self, stream: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, batch: int = BATCH) -> None:
        """One pass over the texts in windows that don't overlap, in a drawn order: each token
        is a target once."""
        rows, before = inputs(self.m, stream, lengths)
        count = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(lengths)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        ends = np.cumsum(lengths)
        start, end = (ends - lengths)[owner] + k * WINDOW, ends[owner]
        padded = np.concatenate([before, np.zeros(WINDOW, before.dtype)])
        want = np.concatenate([self.m.cls[rows], np.zeros(WINDOW, self.m.cls.dtype)])
        order, place = rng.permutation(len(start)), np.arange(WINDOW)
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            at = start[own, None] + place
            self._step(padded[at], want[at], (at < end[own, None]).astype(np.float32))

    def _step(self, seen: np.ndarray, want: np.ndarray, live: np.ndarray) -> None:
        m = self.m
        q, k, v = (x.take(seen, axis=0) for x in (m.query, m.key, m.value))
        w = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(w, -40, 40, out=w)
        np.exp(w, out=w)
        w *= np.where(self.open, np.exp(m.near[self.back]), 0).astype(np.float32)
        w /= (w @ np.ones(WINDOW, np.float32))[..., None]
        h = np.matmul(w, v)
        flat, n = seen.ravel(), seen.size
        p = h.reshape(n, DIM) @ m.mix
        p += m.out.take(flat, axis=0)
        np.clip(p, -40, 40, out=p)
        np.exp(p, out=p)
        weight = live.ravel() / max(1.0, float(live.sum()))
        p *= (weight / (p @ self.ones))[:, None]
        p.ravel()[np.arange(n) * CLASSES + want.ravel()] -= weight
        dh = (p @ m.mix.T).reshape(h.shape)
        dw = np.matmul(dh, v.transpose(0, 2, 1))
        dw -= np.matmul((dw * w), np.ones(WINDOW, np.float32))[..., None]
        dw *= w
        parts = [np.matmul(dw, k), np.matmul(dw.transpose(0, 2, 1), q), np.matmul(w.transpose(0, 2, 1), dh)]
        by_row, sums = sums_by_row([*(x.reshape(n, DIM) for x in parts), p], flat)
        grads = {}
        for name, a, b in (("query", 0, DIM), ("key", DIM, 2 * DIM), ("value", 2 * DIM, 3 * DIM), ("out", 3 * DIM, 3 * DIM + CLASSES)):
            grads[name] = np.zeros_like(getattr(m, name))
            grads[name][by_row] = sums[:, a:b]
        grads["mix"] = h.reshape(n, DIM).T @ p
        grads["near"] = np.bincount(self.back[self.open], dw.sum(axis=0)[self.open], WINDOW).astype(np.float32)
        self.steps += 1
        for name, g in grads.items():
            m1, m2 = self.state[name]
            m1 += 0.1 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            scaled = m1 / (np.sqrt(m2 / (1 - 0.98**self.steps)) + 1e-8)
            setattr(m, name, (getattr(m, name) - self.rate / (1 - 0.9**self.steps) * scaled).astype(np.float32))


def fit(stream: np.ndarray, lengths: np.ndarray, m: Model, epochs: int = 2, batch: int = 128, seed: int = 42) -> None:
    """``epochs`` passes over texts held in memory."""
    trainer, rng = Trainer(m), np.random.default_rng(seed)
    for _ in range(epochs):
        trainer.learn(stream, lengths, rng, batch)


def classes(pair: np.ndarray, seed: int = 42, rounds: int = 12) -> np.ndarray:
    """A class for each row, by k-means over what comes before it."""
    rng = np.random.default_rng(seed)
    share = np.sqrt(pair / np.maximum(1, pair.sum(axis=0, keepdims=True))).T
    flat = share @ rng.standard_normal((pair.shape[0], 24)).astype(np.float32)
    weight = np.sqrt(pair.sum(axis=0) + 1)
    centres = flat[np.argsort(-weight, kind="stable")[:CLASSES]]
    for _ in range(rounds):
        own = ((flat**2).sum(1)[:, None] - 2 * flat @ centres.T + (centres**2).sum(1)).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = np.average(flat[own == c], axis=0, weights=weight[own == c])
    return own.astype(np.int32)


def build(reduced: np.ndarray, pair: np.ndarray, single: np.ndarray, seed: int = 42) -> Model:
    """Tables from counts: pair[u, v] over rows, single over subwords."""
    rng = np.random.default_rng(seed)
    cls, n = classes(pair), len(pair)
    total = pair.sum(axis=0) + 0.5
    member = np.zeros((n, CLASSES), np.float64)
    member[np.arange(n), cls] = 1
    within = total / (member.T @ total)[cls]  # P(v | class)
    pull = 20.0  # pseudo-counts by which P(v | class, u) is drawn to P(v | class)
    table = np.log((pair + pull * within) / ((pair @ member)[:, cls] + pull)).astype(np.float32)
    # Of a row's subwords each has its share; a row of one subword gives 1.
    rest = np.log((single + 1) / np.bincount(reduced, single + 1, n)[reduced]).astype(np.float32)
    init = lambda scale: (rng.standard_normal((n, DIM)) * scale).astype(np.float32)
    # A class without members gets a little, so that its score stays finite.
    out = np.log(pair @ member + 0.5 * CLASSES * (member.T @ total + 0.01) / total.sum()).astype(np.float32)
    return Model(
        reduced, cls, table, rest, init(0.1), init(0.1), init(0.1), np.zeros(WINDOW, np.float32),
        out - out.mean(axis=1, keepdims=True), (rng.standard_normal((DIM, CLASSES)) * 0.1).astype(np.float32),
    )


#: Kinds of rows that ``prepare`` makes: counts of words (by hash) and of subwords, token streams
#: of slices, words that a chunk asks for by shard, and where a chunk's words stand.
WORDS, SUBWORDS, STREAM, ASKED, HELD = range(5)
FIELDS = ("kind", "key", "n", "chunk", "place", "ids", "tokens", "lengths", "learn", "words", "a", "b", "c")
#: Ranges of the word hash: one for so many bytes of text, LEAST_SHARDS at least.
SHARD_BYTES, LEAST_SHARDS = 1 << 26, 1 << 10


def shards_of(docs: DataFrame, text_col: str) -> int:
    """Shards of the count table, so that what is asked of one stays the same at every size."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_SHARDS, size // SHARD_BYTES)


def prepare(docs: DataFrame, id_col: str, text_col: str, learn, path: str, shards: int = LEAST_SHARDS) -> DataFrame:
    """All that training and scoring need of the texts, in one pass and staged.

    Words are asked for by ``shards`` ranges of their hash: each chunk of texts asks each range
    once, for its distinct words. The words and subwords of rows where ``learn`` are counted.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    width = np.uint16 if Subwords.at_path(path).size <= 1 << 16 else np.uint32
    step = np.uint64(2**64 // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords.at_path(path)
        singles = np.zeros(sub.size, np.int64)
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        kinds = dict(zip(FIELDS, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), None, *[pa.binary()] * 7), strict=True))

        def rows(kind: int, many: int, **columns) -> pa.RecordBatch:
            columns |= {"kind": np.full(many, kind, np.int32)}
            return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(many, kinds[c]) for c in FIELDS], names=FIELDS)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate(found), return_inverse=True)
            return keys, np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)

        def handed(keys: np.ndarray, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), BATCH_ROWS):
                own = keys[a : a + BATCH_ROWS]
                yield rows(WORDS, len(own), key=own.view(np.int64), n=totals[a : a + BATCH_ROWS])

        def ask(chunk: str, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
            h, t, c = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.argsort(h, kind="stable")
            h, sizes = np.unique(h, return_counts=True)
            shard = (h // step).astype(np.int64)
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            parts = [x.tobytes() for x in np.split(h, first[1:])]
            yield rows(ASKED, len(first), key=shard[first], chunk=[chunk] * len(first), a=parts)
            yield rows(HELD, 1, chunk=[chunk], **{k: [x.astype(np.uint32).tobytes()] for k, x in zip("abc", (sizes, t[order], c[order]), strict=True)})

        chunk, place, asked = uuid.uuid4().hex, 0, []
        for batch in batches:
            ids, column, learns = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            kinds["ids"] = pa.list_(ids.type)
            for a, b in cuts(column, SLICE):
                stream, lengths, distinct, which, w = sub.texts(column.slice(a, b - a))
                own = learns[a:b].astype(bool)
                singles += np.bincount(stream[np.repeat(own, lengths)], minlength=sub.size)
                packed = {"tokens": stream.astype(width), "lengths": lengths, "learn": own, "words": w.lengths}
                yield rows(
                    STREAM, 1, n=[len(stream)], chunk=[chunk], place=[place],
                    ids=pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a)), **{k: [x.tobytes()] for k, x in packed.items()},
                )
                seen = np.bincount(which[own[w.owner]], minlength=len(distinct))
                found.append(distinct[seen > 0])
                counts.append(seen[seen > 0])
                if sum(map(len, found)) > 2 * HELD_WORDS:
                    keys, totals = merged()
                    found, counts = [keys], [totals]
                    if len(keys) > HELD_WORDS:
                        yield from handed(keys, totals)
                        found, counts = [], []
                if len(which):
                    pairs, tf = np.unique(w.owner * len(distinct) + which, return_counts=True)
                    asked.append((distinct[pairs % len(distinct)], place + pairs // len(distinct), tf))
                place += b - a
                if len(asked) >= CHUNK:
                    yield from ask(chunk, asked)
                    chunk, place, asked = uuid.uuid4().hex, 0, []
        if asked:
            yield from ask(chunk, asked)
        if found:
            yield from handed(*merged())
        at = np.flatnonzero(singles)
        if len(at):
            kinds["ids"] = kinds["ids"] or pa.list_(pa.null())
            yield rows(SUBWORDS, len(at), key=at, n=singles[at])

    schema = f"kind int, key long, n long, chunk string, place int, ids array<{id_type}>, " + ", ".join(f"{c} binary" for c in FIELDS[6:])
    each = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return staged(each.mapInArrow(run, schema), "zstd")


def _streams(batches: Iterator[pa.RecordBatch], width, learn: bool) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Of each slice the batch and row it is in, its tokens and the texts' lengths; with
    ``learn`` only of texts to learn from."""
    for batch in batches:
        columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("tokens", "lengths", "learn")}
        for k in range(batch.num_rows):
            held = {c: x[k].as_buffer() for c, x in columns.items()}
            tokens, lengths = np.frombuffer(held["tokens"], width), np.frombuffer(held["lengths"], np.int64)
            if learn:
                own = np.frombuffer(held["learn"], bool)
                tokens, lengths = tokens[np.repeat(own, lengths)], lengths[own]
            if len(lengths):
                yield batch, k, tokens.astype(np.int32), lengths


def train(work: DataFrame, path: str) -> tuple[Model, DataFrame, int]:
    """The model, a staged table (key, n) of word counts, and the number of training texts, of
    what ``prepare`` gives.

    Every training text takes part in all of it: the counts, the choice of subwords with a row
    of their own, and one pass of the attention weights. In that pass each task learns from its
    own texts, beginning with the same weights; the model is the mean of theirs by tokens.
    """
    spark = work.sparkSession
    size = Subwords.at_path(path).size
    width = np.uint16 if size <= 1 << 16 else np.uint32
    streams = work.where(F.col("kind") == STREAM).select("tokens", "lengths", "learn")
    counted = staged(work.where(F.col("kind") == WORDS).groupBy("key").agg(F.sum("n").alias("n")))
    single = np.zeros(size)
    for r in work.where(F.col("kind") == SUBWORDS).groupBy("key").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        single[r.key] = r.n
    ends = int(single[-1])
    # Subwords with a row of their own are the most frequent ones; the end is one of them.
    rank = single.copy()
    rank[-1] = rank.max() + 1
    top = np.sort(np.argsort(-rank, kind="stable")[: KEPT - 1])
    top = top[rank[top] > 0]
    reduced = (len(top) + np.arange(size) % SHARED).astype(np.int32)
    reduced[top] = np.arange(len(top))
    n = len(top) + SHARED
    shared = spark.sparkContext.broadcast(reduced)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pairs = shared.value, np.zeros(n * n, np.int64)
        for _, _, stream, lengths in _streams(batches, width, True):
            r = rows[stream].astype(np.int64)
            u = np.concatenate([[rows[-1]], r[:-1]])
            u[np.cumsum(lengths) - lengths] = rows[-1]
            pairs += np.bincount(u * n + r, minlength=n * n)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], names=["key", "n"])

    pair = np.zeros(n * n)
    followed = streams.mapInArrow(follow, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # n * n rows at most
    pair[followed["key"].to_numpy(np.int64)] = followed["n"].to_numpy()
    model = build(reduced, pair.reshape(n, n), single)
    first = spark.sparkContext.broadcast(model)

    def learn_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = replace(first.value)
        trainer, rng, seen = Trainer(own_model), np.random.default_rng(42), 0
        for _, _, stream, lengths in _streams(batches, width, True):
            trainer.learn(stream, lengths, rng)
            seen += len(stream)
        if seen:
            flat = np.concatenate([getattr(own_model, name).ravel() for name in LEARNED] + [np.ones(1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64) * seen)], names=["at", "v"])

    learned = streams.mapInArrow(learn_part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    if len(learned):
        flat = learned.sort_values("at")["v"].to_numpy()
        flat = (flat / flat[-1]).astype(np.float32)
        at = 0
        for name in LEARNED:
            old = getattr(model, name)
            setattr(model, name, flat[at : at + old.size].reshape(old.shape))
            at += old.size
    return model, counted, ends


def score(work: DataFrame, model: Model, counted: DataFrame, ends: int, path: str, id_col: str = "doc_id", shards: int = LEAST_SHARDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every text of ``work``.

    Words are looked up in the count table by the ``shards`` of ``prepare``; the replies meet at the chunk, so that
    what travels grows with the distinct words of the chunks. Null and empty texts are an end
    only. Repeated rows and null ids each get their row; an empty table gives an empty result,
    an empty training set counts of 0.
    """
    spark = work.sparkSession
    facts = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total, distinct_words = facts.n + ends, facts.v + (ends > 0)
    shared = spark.sparkContext.broadcast(model)
    id_type = work.schema["ids"].dataType.elementType.simpleString()
    width = np.uint16 if len(model.reduced) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, stream, lengths in _streams(batches, width, False):
            logs = log_probabilities(shared.value, stream, lengths) / np.log(10)
            n, place = len(lengths), batch.column(1)[k].as_py()
            words_ = np.frombuffer(batch.column(3)[k].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[k].as_py()] * n), pa.array(np.arange(place, place + n, dtype=np.int32)), batch.column(2)[k].values,
                    pa.array(words_ + 1), pa.array(np.add.reduceat(logs, np.cumsum(lengths) - lengths)),
                ],
                names=["chunk", "place", "id", "n_tokens", "score"],
            )

    streams = work.where(F.col("kind") == STREAM).select("chunk", "place", "ids", "words", "tokens", "lengths", "learn")
    each = streams.mapInArrow(run, f"chunk string, place int, id {id_type}, n_tokens long, score double")
    step = 2**64 // shards

    def place_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) // np.uint64(step)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *batch.columns], names=["shard", "key", "n"])

    table = counted.select("key", "n").mapInArrow(place_words, "shard long, key long, n long")

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Counts of the words that each chunk asks this shard for; 0 where it has none."""
        keys, n = known.column("key").to_numpy().view(np.uint64), known.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = np.append(keys[order], 0), np.append(n[order], 0)
        out = []
        for h in asked.column("hashes").to_pylist():
            h = np.frombuffer(h, np.uint64)
            at = np.searchsorted(keys[:-1], h)
            out.append(np.where(keys[at] == h, n[at], 0).astype(np.int64).tobytes())
        return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "found": pa.array(out, pa.binary())})

    def add_up(held: pa.Table, replies: pa.Table) -> pa.Table:
        """Sums of each text of a chunk; shards are ranges, so their replies follow one another."""
        empty = {"chunk": pa.array([], pa.string()), "place": pa.array([], pa.int32()), "known": pa.array([], pa.int64()), "logs": pa.array([], pa.float64())}
        if not held.num_rows:
            return pa.table(empty)
        parts = replies.sort_by("shard").column("found").to_pylist()
        n = np.concatenate([np.frombuffer(x, np.int64) for x in parts])
        sizes, t, c = (np.frombuffer(held.column(x)[0].as_py(), np.uint32).astype(np.int64) for x in "abc")
        n = np.repeat(n, sizes)
        live = np.unique(t)
        known = np.bincount(t, (n > 0) * c)[live].astype(np.int64)
        logs = np.bincount(t, np.log10(n + 1.0) * c)[live]
        return pa.table({"chunk": pa.array([held.column("chunk")[0].as_py()] * len(live)), "place": pa.array(live.astype(np.int32)), "known": pa.array(known), "logs": pa.array(logs)})

    asked = work.where(F.col("kind") == ASKED).select("chunk", F.col("key").alias("shard"), F.col("a").alias("hashes"))
    replies = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(answer, "chunk string, shard long, found binary")
    held = work.where(F.col("kind") == HELD).select("chunk", "a", "b", "c")
    sums = held.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(add_up, "chunk string, place int, known long, logs double")
    end_log = float(np.log10(ends + 1.0))
    norm = float(np.log10(total + distinct_words + 1.0))
    return each.join(sums, ["chunk", "place"], "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.coalesce("known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.coalesce("logs", F.lit(0.0)) + end_log - F.col("n_tokens") * norm).alias("base_score"), "score",
    )


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Fit on the rows whose crc32(id as text) mod 7 is not 2 and score all rows; see ``score``."""
    path = path or tokenizer_path()
    shards = shards_of(docs, text_col)
    work = prepare(docs, id_col, text_col, fold(id_col, 7) != 2, path, shards)
    model, counted, ends = train(work, path)
    return score(work, model, counted, ends, path, id_col, shards)
