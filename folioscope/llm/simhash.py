"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``radius`` bits,
some choice of ``together`` of their segments differs in few bits (see ``_near``). Every
fingerprint is filed under each such choice and looks up the small Hamming ball around it;
only found pairs are compared in full. Fingerprints that meet under a crowded value are
indexed again, all of them, under finer choices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, staged
from .components import components

#: A value filed more often than this is crowded: those who file or ask for it go to the next of
#: the LEVELS, (segments, how many together); after the last they are compared in blocks.
CROWDED = 32
LEVELS = ((5, 2), (6, 3))
#: Fingerprints in one block of a crowded segment value.
BLOCK = 2048


def simhash_of(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash, signed, of the lower-cased (A-Z) words' shingles; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [
            digest(joined[a:b], 42)
            for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        ]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` without its text, and a long column ``fingerprint``, one row for each row.

    Null and empty texts: 0. Other columns pass through whatever their type.
    """
    kept = [c for c in docs.columns if c != text_col]
    out = free_name(docs, "fingerprint")
    schema = docs.select(*kept).schema.add(out, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text_col).to_pylist()):
                part = batch.slice(a, b - a)
                marks = pa.array([simhash_of(t, shingle) for t in part.column(text_col).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), marks], names=[*kept, out])

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def _signed(bits: int) -> int:
    """64 bits as a signed number."""
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of 64 bits."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _near(radius: int, segments: int, together: int) -> int:
    """The most bits by which the best choice of ``together`` segments can differ: the largest
    sum of the smallest ``together`` of ``segments`` counts that sum to ``radius``."""
    best = 0
    for low in range(radius + 1):
        # The smallest ones sum to at most ``low`` where each other has at least their largest.
        largest = -(-low // together)
        if low + (segments - together) * largest <= radius:
            best = low
    return best


def near_edges(fps: DataFrame, radius: int = 4, segments: int = 3, together: int = 1, finer=LEVELS) -> DataFrame:
    """(u, v): links among distinct fingerprints ``fps.fp`` at ``radius`` bits or fewer.

    All links of pairs that meet under some value that isn't crowded. Who meets under crowded
    ones only is linked at a finer level; at the last, enough links are given to connect
    whatever the links connect (a spanning forest for each pair of blocks).
    """
    near = _near(radius, segments, together)
    cuts = _cuts(segments)
    filed, probes, masks = [], [], []
    for s, chosen in enumerate(combinations(range(segments), together)):
        mask = sum(((1 << cuts[k][1]) - 1) << cuts[k][0] for k in chosen)
        bits = [b for k in chosen for b in range(cuts[k][0], sum(cuts[k]))]
        masks.append(mask)
        filed.append((s, mask, 0, 0))
        # Of two values that differ, only the one that lacks the highest differing bit looks
        # the other up, so each pair is met once a choice.
        probes += [
            (s, mask, sum(1 << b for b in flips), 1 << max(flips) if flips else 0)
            for r in range(near + 1)
            for flips in combinations(bits, r)
        ]

    def held(bits) -> str:
        return f"cast(split('{','.join(str(_signed(x)) for x in bits)}', ',') as array<bigint>)"

    def spread(entries: list[tuple]) -> DataFrame:
        each = fps.selectExpr("fp", f"inline(arrays_zip({', '.join(map(held, zip(*entries, strict=True)))})) AS (s, mask, flip, top)")
        return each.where("fp & top = 0").selectExpr("fp", "s", "(fp & mask) ^ flip AS value")

    index, asked = spread(filed), spread(probes)
    crowded = staged(index.groupBy("s", "value").count().where(F.col("count") > CROWDED))
    n_crowded = crowded.count()
    if n_crowded:
        small = F.broadcast(crowded) if n_crowded <= 10_000 else crowded
        roomy = index.join(small, ["s", "value"], "left_anti")
    else:
        roomy = index
    u, v = F.col("a.fp"), F.col("b.fp")
    distance = F.bit_count(u.bitwiseXOR(v))
    # A pair is told by the first choice under which it meets. If that one is crowded both go on.
    first = F.expr(f"NOT exists(slice({held(masks)}, 1, cast(a.s as int)), m -> bit_count((a.fp ^ b.fp) & m) <= {near})")
    pairs = (
        asked.alias("a")
        .join(roomy.alias("b"), F.expr("a.value = b.value AND a.s = b.s"))
        .where((u != v) & (distance <= radius) & first)
        .select(u.alias("u"), v.alias("v"))
    )
    if not n_crowded:
        return pairs
    if finer:
        # Who files a crowded value asks for it too, so the askers are all that meet there.
        again = staged(asked.join(small, ["s", "value"], "left_semi").select("fp").distinct())
        return pairs.union(near_edges(again, radius, *finer[0], finer[1:]))
    # Equal values have equal hashes, and what else shares a hash is compared like the rest.
    members = asked.join(small, ["s", "value"]).select(F.xxhash64("s", "value").alias("key"), "fp", "count").distinct()
    return pairs.union(_in_blocks(members, radius))


def _in_blocks(members: DataFrame, radius: int) -> DataFrame:
    """Spanning links of crowded values: each block meets each other block of its value."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") * 4 / BLOCK)).cast("int")
    own = members.withColumn("n", blocks).withColumn("k", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "key", "fp", "k", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j")
    )

    def link(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().astype(np.int64)
        k, i, j = (group.column(c).to_numpy() for c in ("k", "i", "j"))
        left, right = fp[k == i[0]], fp[k == j[0]]
        out = forest(left, right, radius)
        return pa.table({"u": pa.array(out[:, 0], pa.int64()), "v": pa.array(out[:, 1], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(link, "u long, v long")


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the graph of left x right at ``radius`` bits or fewer."""
    nodes = np.unique(np.concatenate([left, right]))
    parent = np.arange(len(nodes))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at_right = np.searchsorted(nodes, right)
    wide, found = right.view(np.uint64), []
    for value, x in zip(left.view(np.uint64), np.searchsorted(nodes, left).tolist(), strict=True):
        hits = at_right[np.bitwise_count(wide ^ value) <= radius]
        # One look at each root that the hits still have.
        for y in np.unique(parent[hits]).tolist():
            a, b = find(x), find(y)
            if a != b:
                found.append((nodes[x], nodes[y]))
                parent[max(a, b)] = min(a, b)
    return np.array(found, np.int64).reshape(-1, 2)


def _rooted(classes: DataFrame, radius: int, segments: int) -> DataFrame:
    """``classes`` (one row for each distinct fingerprint ``fp``) with the root of its component."""
    tree = components(near_edges(classes.select("fp"), radius, segments))
    return classes.join(tree, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    segments: int = 3,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id: the smallest id among the rows whose fingerprints are connected by links
    of ``radius`` bits or fewer. Null and empty texts have fingerprint 0 and link like any
    other. Null ids count as larger than any id: a component of null ids only has a null
    component_id. Repeated rows each get a row. An empty table gives an empty result.
    Exact for every radius and number of segments.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = staged(fingerprints(rows, "text", shingle))
    classes = staged(marks.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least")))
    rooted = _rooted(classes, radius, segments)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(known, F.col("fingerprint") == F.col("fp")).select(
        F.col("id").alias(id_col), "fingerprint", "component_id"
    )


def as_hex(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, segments: int = 3
) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept.

    The row with the smallest id stays, rows without an id last; where its id repeats, the one
    with the smallest digest of the text. Rows are known by id and text, so rows that repeat an
    id, or have none, don't stand for each other.
    """
    own = free_name(docs, "digest")
    digest = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    marks = staged(fingerprints(rows, "text", shingle))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "digest")
    classes = staged(marks.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(rank).alias("lead")))
    leads = _rooted(classes, radius, segments).groupBy("root").agg(F.min("lead").alias("lead"))
    leads = leads.select(F.col("lead.id").alias("lead_id"), F.col("lead.digest").alias("lead_digest"))
    same = F.col(id_col).eqNullSafe(F.col("lead_id")) & F.col(own).eqNullSafe(F.col("lead_digest"))
    kept = docs.withColumn(own, digest).join(leads, same, "left_semi")
    # Rows of one id and one text are of one component, of which one stays.
    repeated = kept.groupBy(F.col(id_col).alias("rid"), F.col(own).alias("rdigest")).count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, own])
    return kept.drop(own)
