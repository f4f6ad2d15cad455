"""Operators and stages against brute force, on odd rows and on very long texts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import bytewords, decontaminate, licenses, lm, pii, quality, secrets, simhash, toxicity, warc
from tests.llm.test_llm import BASE, SCHEMA, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return spark.createDataFrame(rows + rows[4:6], SCHEMA)


@pytest.fixture(scope="module")
def long_text():
    """Four megabytes, with one of everything that is looked for near the end."""
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 5000, 600_000)]
    planted = f'{BASE} mail bob@host.org token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6" {licenses.TEMPLATES[2][1]} '
    return " ".join(words) + "\n" + planted + " ".join(words[:2000])


def test_a_text_of_megabytes(spark, long_text):
    docs = spark.createDataFrame([(1, long_text, "s"), (2, "short", "s")], "doc_id long, text string, source string")
    assert pii.apply(docs, b"k").where("doc_id = 1 AND exists(pii, p -> p.kind = 'email')").count() == 1
    bench = spark.createDataFrame([(7, BASE)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()] == [(1, 7)]
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(1, "MIT")]
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark))).where("is_secret").collect()
    assert [(r.doc_id, r.start) for r in found] == [(1, long_text.index("f0ddae3b"))]
    n = len(WORD.findall(long_text))
    assert {r.doc_id: r.n_words for r in quality.judge(docs, quality.Model(np.zeros(quality.BUCKETS), 0.0)).collect()} == {1: n, 2: 1}
    assert simhash.near_duplicates(docs).count() == 2
    assert {r.doc_id: r.n_tokens for r in lm.scored(docs).collect()} == {1: n + 1, 2: 2}
    model = toxicity.Chain({"wbob": 9.0}, -4.0, np.zeros((2, 2)), np.zeros(2), np.array([-3.0, 4.0, 4.0, 0.0]))
    assert {r.doc_id: r.score > 0.5 for r in toxicity.score(docs, model).collect()} == {1: True, 2: False}


def test_license_containment_against_brute_force():
    rng = np.random.default_rng(11)
    flat = lambda t: re.sub(r"[^\w]", " ", t.lower(), flags=re.ASCII).replace("_", " ").split()
    matcher = licenses.Matcher(licenses.TEMPLATES)
    texts = []
    for k, (_, notice) in enumerate(licenses.TEMPLATES * 3):
        words = notice.split()
        if k >= len(licenses.TEMPLATES):  # some words changed
            for i in rng.integers(0, len(words), max(0, len(words) // 30) * (k // len(licenses.TEMPLATES))):
                words[int(i)] = "other"
        pad = [f"x{int(v)}" for v in rng.integers(0, 99, 40)]
        texts.append(" ".join(pad + words + pad))
    grams = lambda ws: [tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))]
    want = {}
    for t, text in enumerate(texts):
        own = grams(flat(text))
        for name, notice in licenses.TEMPLATES:
            held = set(grams(flat(notice)))
            size = len(grams(flat(notice)))
            share = max(len(held & set(own[i : i + size])) / len(held) for i in range(len(own)))
            if share >= 0.8:
                want[t, name] = max(share, want.get((t, name), 0.0))
    got = {(t, name): share for t, name, share, _ in matcher.matches(pa.array(texts), 0.8)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_short_license_templates_are_retrieved_by_bands():
    matcher = licenses.Matcher([("A", "one two three four five"), ("B", "a b c d e f g")])
    assert sorted(matcher.scales) == [1, 4]
    assert {(t, n) for t, n, *_ in matcher.matches(pa.array(["x y one two three four five z", "q a b c d e f g", "one two three"]), 0.8)} == {(0, "A"), (1, "B")}


def test_secret_offsets_against_the_text(spark):
    forest = secrets.train(secrets.labelled_findings(spark))
    rng = np.random.default_rng(6)
    made = lambda: "".join(rng.choice(list("abcdef0123456789"), 40))
    text = "\n".join(f'line {k} é token = "{made()}" and sha {made()} password: x{k}yq!7' for k in range(300))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    rows = secrets.scan(docs, forest).collect()
    assert len(rows) >= 600 and all(text[r.start : r.end] == r.candidate for r in rows) and len({r.start for r in rows}) == len(rows)
    want = {m.start(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', text)}
    assert want <= {r.start for r in rows if r.is_secret}


def test_ratio_of_multinomials_against_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"{'g' if k % 2 else 'b'}{int(x)}" for x in rng.integers(0, 40, 60)) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    w = bytewords.words(pa.array(texts))
    buckets, owner = quality.grams(w, w.hashes())
    half = {r.id: r.h for r in spark.range(80).select("id", (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0).alias("h")).collect()}
    raw, target = Counter(buckets.tolist()), Counter(b for b, o in zip(buckets.tolist(), owner.tolist(), strict=True) if o % 2 and half[o])
    n, m, size = sum(raw.values()), sum(target.values()), quality.BUCKETS
    share = lambda b: (raw[b] + 1) / (n + size)
    ratio = lambda b: np.log((target[b] + 0.05 * m * share(b)) / (1.05 * m) / share(b))
    want = [np.mean([ratio(b) for b, o in zip(buckets.tolist(), owner.tolist(), strict=True) if o == k]) for k in range(80)]
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert np.allclose([got[k].llr for k in range(80)], want)
    assert all(got[k].kept == (not got[k].base_failed and got[k].llr >= model.threshold) for k in range(80))
    assert np.mean([got[k].kept == bool(k % 2) for k in range(80)]) > 0.95


def test_index_parts_share_their_statistics(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(300)]
    draw = lambda n: " ".join(vocabulary[int(300 * x**3)] for x in rng.random(n))
    items = [(k, draw(25)) for k in range(60)]
    half = lambda t: " ".join(w if rng.random() < 0.93 else "other" for w in t.split())
    docs = spark.createDataFrame([(k, draw(150) + " " + half(items[k % 60][1]) + " " + draw(40)) for k in range(120)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(r.doc_id, r.item_id): r.score for r in decontaminate.matches(docs, bench, least=0.3, most_items=n).collect()} for n in (1000, 7))
    assert one.keys() == many.keys() and len(one) > 20 and all(abs(one[k] - many[k]) < 1e-4 for k in one)


def test_wand_equals_full_scores():
    rng = np.random.default_rng(13)
    items = [(k, " ".join(f"t{int(200 * x**2)}" for x in rng.random(20))) for k in range(300)]
    index = decontaminate.Index(items, block=8)
    for _ in range(60):
        terms = np.unique(rng.choice(len(index.term), 60))
        scores = np.zeros(len(items))
        for t in terms:
            a, b = index.start[t], index.start[t + 1]
            scores[index.item[a:b]] += index.impact[a:b]
        want = set(np.flatnonzero(scores >= decontaminate.LEAST).tolist())
        got = dict(index._wand(terms.tolist()))
        assert set(got) == want and all(abs(got[i] - scores[i]) < 1e-4 for i in want)


def test_pii_findings_and_linked_dates():
    p = pii.Permutation(b"k")
    days = ["1999-12-31", "31.12.1999", "31/12/1999", "12/31/1999"]
    new = [pii.pseudonymise(d, p)[0] for d in days]
    y, m, d = new[0].split("-")
    assert new == [f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}"] and int(d) > 12
    assert [pii.pseudonymise(t, p, back=True)[0] for t in new] == days
    early = [pii.pseudonymise(t, p)[0] for t in ("2001-02-03", "03/02/2001")]
    assert early[1] == "/".join(reversed(early[0].split("-"))) and int(early[0][8:]) <= 12
    for k in range(200):
        phone = pii.pseudonymise(f"call (2{k % 90 + 10}) 555-{k:04d} now", p)[0]
        assert re.fullmatch(r"call \([2-9]\d\d\) [2-9]\d\d-\d{4} now", phone)
    text = "a@b.org 4379362835490466 c@d.org " * 50 + "4379362835490467"
    found = Counter(f[0] for f in pii.pseudonymise(text, p)[1])
    assert found == {"email": 100, "card": 50}


def test_warc_of_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 1)
    monkeypatch.setattr(warc, "MAP_WORDS", 2)
    rows = [(k, f"u{k}", f"<p>{k % 40 if k % 3 else k}</p>") for k in range(300)] + [(None, "n", "<p>1</p>"), (400, None, None), (401, None, "")]
    got = warc.read_back(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    last: dict = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter((i, None if i == last[h or ""] else last[h or ""]) for i, _, h in rows)
    assert Counter((r.page_id, r.refers_to) for r in got) == want


def test_dictionary_records_are_whole_or_even(spark):
    rows = [(k, "u", f"<p>{k}</p>" * 50) for k in range(20)] + [(k, "u", "same") for k in range(20, 400)] + [(999, "u", "".join(chr(97 + j // 20_000) for j in range(400_000)))]
    records = warc.samples(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html")
    assert sum(b"same" in r for r in records) == 1 and all(sum(f"<p>{k}</p>".encode() * 50 in r for r in records) == 1 for k in range(20))
    big = max(records, key=len)
    assert len(big) < 2 * warc.FIT_RECORD and sum(bytes([97 + j]) * 50 in big for j in range(20)) >= 16


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_rows(spark, odd, tmp_path, k):
    for name, rows, schema in (
        ("labels", [(4, 1, 0), (3, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, BASE), (2, None), (None, "")], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, str(tmp_path))
    got = out.collect()
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    if k < 4:
        assert out.columns == odd.columns
    n = odd.count()
    text = {r.doc_id: r.text for r in odd.collect()}
    if name == "simhash_near_dedup":
        assert len(got) == len({(r.doc_id, r.text) for r in got}) < n
    elif name == "benchmark_decontamination":
        flat = lambda t: b" " + b" ".join(decontaminate.tokens(t)) + b" "
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect() if r.doc_id is None or flat(BASE) not in flat(r.text))
    elif name == "secret_scan":
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd.collect()) and text
    else:
        assert len(got) == n
