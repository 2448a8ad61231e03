"""Operators against plain versions of themselves, and the stages of the pipeline one by one."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_filters import base_spans, components, hit_words

import corpus_pipeline
from docquarry.llm import ann, pieces, secrets, toxicity
from docquarry.llm._io import written

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def grams(text):
    """Features of a text, one n-gram at a time."""
    x = [ord(c) * 0x9E3779B97F4A7C15 & M for c in f" {(text or '').lower()} "]
    found = set()
    for order in toxicity.ORDERS:
        for a in range(len(x) - order + 1):
            h = x[a]
            for c in x[a + 1 : a + order]:
                h = (h * 0xD1342543DE82EF95 & M) ^ c
            found.add(mix(h + order & M) >> 64 - toxicity.BITS)
    return found


def plain_score(model, text):
    z = model.bias + sum(model.weight[model.codes[f]] for f in grams(text) if model.codes[f] >= 0)
    return 1 / (1 + math.exp(-z))


def test_toxicity_matches_plain_scores_and_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = {r.doc_id: r.text for r in docs.where("length(text) < 600").collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert some and all(got[i] == pytest.approx(plain_score(model, t), rel=1e-9) for i, t in some.items())
    rows = pa.table({"text": ["you fool", "You fool!", "a friend", ""], "toxic": pa.array([1, 1, 0, 0], pa.int32())})
    counted = pa.Table.from_batches(toxicity._counted(iter(rows.to_batches()))).to_pylist()
    sets = [(grams(t), y) for t, y in zip(rows["text"].to_pylist(), (1, 1, 0, 0), strict=True)]
    every = set().union(*(s for s, _ in sets))
    assert {r["f"]: (r["q"], r["p"]) for r in counted} == {f: tuple(sum(f in s for s, y in sets if y == k) for k in (0, 1)) for f in every}


def test_toxicity_of_ids_labelled_twice_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} plain text") for i in range(60)] + [(i, f"you idiot {i}") for i in range(60, 90)] + [(61, "you idiot 61")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)] + [(70, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.scores(["you idiot"])[0] > 0.5 > model.scores(["plain text"])[0]
    held = {r.doc_id for r in toxicity.score(docs, toxicity.trained(docs, labels)).where("doc_id is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert held


def plain_segments(string, ratios, least):
    """The rule of the Markov segments, character by character."""
    codes = [0, *(ord(c) - 32 if 33 <= ord(c) <= 126 else 0 for c in string)]
    values = [ratios[a * secrets.STATES + b] for a, b in zip(codes, codes[1:], strict=False)]
    found, now, lo, best, hi = [], 0.0, 0, 0.0, 0
    for i, v in enumerate(values, 1):
        now += v
        if now <= 0 or now <= max(best, 0) - least and not now > best:
            if best >= least:
                found.append((lo, hi))
            now, lo, best, hi = 0.0, i, 0.0, i
        elif now > best:
            best, hi = now, i
    if best >= least:
        found.append((lo, hi))
    out = []
    for lo, hi in found:
        if lo and string[lo - 1].isalnum():
            while lo and string[lo - 1].isalnum():
                lo -= 1
        while hi < len(string) and string[hi].isalnum():
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def test_markov_segments_match_plain(spark):
    model = secrets.train(secrets.samples(spark, 3000))
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    words = ["content", "collection", "user", "name", "server", "path", "main"]
    runs = []
    for _ in range(60):
        parts = [rng.choice(words) if rng.random() < 0.6 else "".join(rng.choices(letters[:62], k=rng.randrange(4, 30))) for _ in range(rng.randrange(1, 6))]
        runs.append(rng.choice("/_-").join(parts))
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id int, text string")
    got = {r.doc_id: r for r in secrets.scan(df, model).collect()}
    for i, run in enumerate(runs):
        if len(run) >= secrets.SHORTEST and not base_spans(run):
            want = plain_segments(run, model, secrets.LEAST)
            assert [(s.start, s.stop) for s in got[i].spans if s.kind == "markov"] == want, run


def test_held_out_secrets_are_found(spark):
    """Random keys that training never saw, and ordinary names that it never saw."""
    model = secrets.train(secrets.samples(spark))
    rng = random.Random(11)
    keys = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32)) for _ in range(100)]
    names = [f"{a}_{b}_{c}" for a in ("billing", "kernel", "weather") for b in ("forecast", "adapter", "bridge") for c in ("manager", "service", "worker")]
    df = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(keys + names)], "doc_id int, text string")
    hit = {r.doc_id for r in secrets.scan(df, model).where("size(filter(spans, x -> x.kind = 'markov')) > 0").collect()}
    assert len([i for i in hit if i < 100]) >= 99 and not [i for i in hit if i >= 100]


def test_nearest_neighbours_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    right = total = 0
    for q in (i for i in v if i % 20 == 0):
        true = sorted(((float(np.einsum("d,d->", v[q], x)), -i) for i, x in v.items() if i != q), reverse=True)[:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(v[q] @ v[i]), rel=1e-12) for _, i, s in found)
        right += len({i for _, i, _ in found} & {-i for _, i in true})
        total += 20
    assert right / total >= 0.9


def test_large_leaves_are_split(spark, monkeypatch):
    """Leaves over a size are clustered further, every vector keeps a leaf, and neighbours are found as before."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8)) * 6
    x = centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SAMPLE", 200)
    monkeypatch.setattr(ann, "SPLIT", 60)
    monkeypatch.setattr(ann, "LEAF", 30)
    tree = ann.Tree(x[:200], leaf=30)
    before = tree.leaves
    tree.graft({k: ann.Tree(x[tree.descend(x) == k], leaf=30) for k in range(before)})
    assert tree.leaves > before and np.bincount(tree.descend(x), minlength=tree.leaves).sum() == len(x)
    assert sorted(k for k in tree.leaf_of if k >= 0) == list(range(tree.leaves)) == sorted(tree.best_first(x[0], tree.leaves, np.ones(tree.leaves), 0))
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    true = {q: [i for i in np.argsort(-(x @ x[q]), kind="stable").tolist() if i != q][:20] for q in found}
    right = sum(len(found[q] & set(true[q])) for q in found)
    assert all(len(v) == 20 for v in found.values()) and right / (20 * len(found)) >= 0.9


def test_odd_vectors(spark):
    """Ties go to smaller ids; fewer candidates than 20 give all; vectors that can't take part don't."""
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    step = lambda name, df: written(stages[name](spark, df, SF), name)

    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    mild = step("toxicity", docs)
    assert set(texts(mild)) == {i for i, s in zip(texts(docs), model.scores([t or "" for t in texts(docs).values()]), strict=True) if s < 0.3}

    single = step("near_dedup", mild)
    assert set(texts(single)) == {i for i, (_, c) in components(texts(mild), 5).items() if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fresh = step("decontamination", single)
    kept = set()
    for i, t in texts(single).items():
        n, hit, _ = hit_words(t, items)
        if not (hit and 20 * hit >= n):
            kept.add(i)
    assert set(texts(fresh)) == kept

    spans = {r.doc_id: r.spans for r in secrets.scan(fresh, secrets.train(secrets.samples(spark))).collect()}
    safe = step("secret_scans", fresh)
    for i, t in texts(fresh).items():
        out, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                out += t[at : s.start] + "[SECRET]"
            at = max(at, s.stop)
        assert texts(safe.where(F.col("doc_id") == i))[i] == out + t[at:] if spans[i] else True
    assert {r.doc_id for r in safe.where("n_chars <> length(text)").collect()} <= {r.doc_id for r in fresh.where("n_chars <> length(text)").collect()}

    encoded = {r.doc_id: r for r in stages["sentencepiece"](spark, safe, SF).collect()}
    p = pieces.Pieces(pieces.PUBLIC_MODEL)
    assert set(encoded) == set(texts(safe))
    for i, t in list(texts(safe.where("length(text) < 400")).items())[:20]:
        found = [(0.0, ())]
        for part in p.chain(p.normal(t)):
            found = sorted(((a + s, x + y) for a, x in found for s, y in p.best(part, 4)), key=lambda z: -z[0])[:4]
        assert encoded[i].scores == [s for s, _ in found] and p.decode(encoded[i].ids) == t and encoded[i].round_trip


def test_stages_of_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows, clashing names and empty tables pass every stage."""
    for docs in (odd.withColumn("lang", F.lit("en")), odd.withColumn("lang", F.lit("en")).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert docs.count() >= 0 and docs.where("not round_trip").count() == 0
