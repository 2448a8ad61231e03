import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import ann, pieces, pitmanyor, queries, tokencount, toolcalls, warc
from docquarry.llm._text import NOT_SPACE, Words, buffers

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")


def every_path(p, part):
    edges = p.lattice(part)
    paths = [[(0.0, ())]]
    for b in range(1, len(edges)):
        paths.append([(s + e[1], x + e[2]) for e in edges[b] for s, x in paths[e[0]]])
    return sorted(paths[-1], key=lambda x: -x[0])


def test_n_best_is_brute_force():
    p = pieces.Pieces(pieces.PUBLIC_MODEL)
    for text in ("hello", "the cat", "ab  c", "é", "a\x01b", "日本"):
        all_ = [(0.0, ())]
        for part in p.chain(p.normal(text)):
            all_ = [(a + s, x + y) for a, x in all_ for s, y in every_path(p, part)]
        want = [round(s) for s, _ in sorted(all_, key=lambda x: -x[0])[:5]]
        ids, scores, changes = p.encode(text, 5)
        assert [round(s) for s in scores] == want
        for c in changes:
            other = list(ids)
            for at, size, new in reversed(c):
                other[at : at + size] = new
            assert p.decode(other) == text
    alone, together = pieces.Pieces(pieces.PUBLIC_MODEL), pieces.Pieces(pieces.PUBLIC_MODEL)
    words = [f"word{k}x\x02" if k % 3 else f"größe{k}" for k in range(60)]
    together.encode_all(words, 3)
    for w in words:
        assert together.encode(w, 3)[1] == [s for s, _ in n_best_text(alone, w, 3)]


def test_segmentation_is_the_same_however_cut(monkeypatch):
    """Long texts cut between words, long words alone, and an emptied cache change nothing."""
    texts = ["the  quick brown fox " * 30, "\u65e5\u672c\u8a9e text", "", "x" * 90 + " \x01\u00e9 end", " lead"]
    want = pieces.Pieces(pieces.PUBLIC_MODEL).encode_all(texts, 4)
    for name, value in (("STRETCH", 50), ("BULK", 3), ("CACHE", 2)):
        monkeypatch.setattr(pieces, name, value)
    got = pieces.Pieces(pieces.PUBLIC_MODEL).encode_all(texts, 4)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() and got[2:] == want[2:]


def n_best_text(p, text, n):
    found = [(0.0, ())]
    for part in p.chain(p.normal(text)):
        found = sorted(((a + s, x + y) for a, x in found for s, y in p.best(part, n)), key=lambda z: -z[0])[:n]
    return found


def test_encoding_frames(spark, odd):
    got = pieces.encode(odd, n=3)
    assert got.count() == odd.count() and pieces.encode(odd.limit(0)).count() == 0
    assert got.where("not (pieces.decoded <=> coalesce(text, ''))").count() == 0
    assert got.where("doc_id = 4").select("pieces.scores").first()[0] == [0.0]
    assert queries.QUERIES["op1_sentencepiece"](spark, SF).where("not round_trip").count() == 0


def test_language_model(spark, odd):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_lm_scoring"](spark, SF).collect()}
    texts = {r.doc_id: [*SPACE.findall(lower(r.text)), ""] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(rows[i].base_score - base) < 1e-6 * abs(base) and rows[i].score < 0
    scored = pitmanyor.score(odd, F.lit(True), block_bytes=60_000)
    assert scored.count() == odd.count() and pitmanyor.score(odd.limit(0), F.lit(True)).count() == 0
    assert scored.where("doc_id in (4, 5)").select("n_tokens").distinct().collect() == [(1,)]
    assert pitmanyor.score(odd, F.lit(False)).where("n_known > 0 or score >= 0").count() == 0


def hashes(words):
    """Hashes of whole words, as the model tells them apart."""
    raw, offsets = buffers(pa.array(words))
    w = Words(raw, offsets, NOT_SPACE)
    out = np.zeros(len(words), np.uint64)
    out[w.doc] = w.hash
    return out


def fitted(spark, texts, parts=0):
    """The model of some texts, and of each word: customers and tables in its kept states."""
    dealt = spark.createDataFrame([(k % (parts + 1), False, t) for k, t in enumerate(texts)], "block long, held_out boolean, text string")
    found = pitmanyor.fit(dealt, parts, parts)
    names, at = {}, {}
    for r in found.words.collect():
        words = pitmanyor._words(r.c).to_pylist()
        names[r.bucket] = words
        assert [int(x) for x in hashes(words)] == [int(x) for x in pitmanyor.unpacked(r.a, np.uint64)]
        for w, c in zip(words, pitmanyor.unpacked(r.b, np.int64), strict=True):
            at[w] = {"c": int(c), "k": [], "tt": []}
    for r in sorted(found.states.collect(), key=lambda r: r.other):
        for w, k, tt in zip(names[r.bucket], pitmanyor.unpacked(r.a, np.int64), pitmanyor.unpacked(r.b, np.int64), strict=True):
            at[w]["k"].append(int(k))
            at[w]["tt"].append(int(tt))
    return found.model, at


def test_customers_and_tables_add_up(spark):
    """A word is served by each pair that ends in it, once at least and no more often than it occurs; parts change nothing."""
    texts = ["a b a b c a b", "a b c a", "b b a", "c a b a b x", "y"]
    model, at = fitted(spark, texts)
    pairs = Counter()
    for t in texts:
        pairs.update(zip(["", *t.split()], [*t.split(), ""], strict=True))
    for w, state in at.items():
        ends, begins = [n for (_, x), n in pairs.items() if x == w], [n for (x, _), n in pairs.items() if x == w]
        assert state["c"] == sum(ends) == sum(begins)
        assert all(len(ends) <= k <= sum(ends) for k in state["k"]) and all(len(begins) <= tt <= sum(begins) for tt in state["tt"])
    assert model.tokens == sum(pairs.values()) and model.distinct == len(at)
    assert [sum(s["k"][j] for s in at.values()) for j in range(model.kept + 1)] == [s.customers for s in model.states[-model.kept - 1 :]]
    assert fitted(spark, texts, 3)[1] == at


def test_score_is_the_chain_of_restaurants(spark):
    """Scores again from the kept states of all restaurants, word by word."""
    texts = ["a b a b c", "a b c a", "b b a", "c a b a b", "zz a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitmanyor.score(docs, F.col("doc_id") < 4).collect()}
    model, at = fitted(spark, texts[:4])
    pairs, words = Counter(), Counter()
    for t in texts[:4]:
        for u, w in zip(["", *t.split()], [*t.split(), ""], strict=True):
            pairs[u, w] += 1
            words[w] += 1
    one = lambda w: hashes([w])
    for i, t in enumerate(texts):
        total = 0.0
        for u, w in zip(["", *t.split()], [*t.split(), ""], strict=True):
            each = []
            for j, s in enumerate(model.states[-model.kept :], 1):
                p, before = (pitmanyor._short(model.states[-model.kept - 1 + x].log(pa.array([w]), np.array([at[w]["k"][x] if w in at else 0]), one(w)))[0] for x in (j, j - 1))
                tt, old = (at[u]["tt"][x] if u in at else 0 for x in (j, j - 1))
                c = pairs[u, w]
                seats = pitmanyor.pair_tables(one(u), one(w), np.array([c]), np.array([before], np.float32), np.array([old], np.float32), s.sweep)[0] if c else 0.0
                n = words[u]  # every token but an end is a context once, and every text begins after an end
                each.append((max(c - pitmanyor.DISCOUNT * seats, 0) + (pitmanyor.STRENGTH + pitmanyor.DISCOUNT * tt) * math.exp(p)) / (n + pitmanyor.STRENGTH))
            total += math.log10(sum(each) / len(each))
        assert got[i] == pytest.approx(total, rel=1e-5)


def test_seating_follows_the_rule():
    """Mean tables of many equal dishes against those of customers who sit down one by one."""
    rng = np.random.default_rng(5)
    for count, base, mass in ((5, 0.2, 3.0), (60, 0.05, 8.0), (400, 0.02, 30.0)):
        n = 4000
        got = pitmanyor.seated(np.full(n, count), np.full(n, base), rng.integers(0, 1 << 63, n).astype(np.uint64), 0.75, mass)
        t = np.ones(n)
        for done in range(1, count):
            t += rng.random(n) < mass * base / (done - 0.75 * t + mass * base)
        assert abs(got.mean() - t.mean()) < 5 * t.std() / n**0.5 + 0.01 * t.mean()


def test_language_model_probabilities_add_up(spark):
    """Over all words of one and two bytes, and the rest by spelling, probabilities in the word restaurant stay within one."""
    model, at = fitted(spark, ["a b a ab a", "b a"])
    words = ["", *map(chr, range(0x21, 0x7F)), *(a + b for a in map(chr, range(0x21, 0x7F)) for b in map(chr, range(0x21, 0x7F)))]
    arr = pa.array(words)
    for j, state in enumerate(model.states[-model.kept - 1 :]):
        p = np.exp(state.log(arr, np.array([at[w]["k"][j] if w in at else 0 for w in words]), hashes(words)))
        assert 0.5 < p.sum() <= 1 + 1e-9 and p[words.index("a")] > p[words.index("z")]


def test_language_model_reads_word_order(spark):
    """The same words in another order score lower, and scores do not depend on blocks."""
    rows = [(i, "red apples grow on tall trees while small birds sing") for i in range(50)] + [(100, "red apples grow on tall trees"), (101, "trees on apples tall red grow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pitmanyor.score(docs, F.col("doc_id") < 100).collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[100].score > got[101].score + 3
    follow = spark.createDataFrame([(i, "a b a b a c b a") for i in range(9)] + [(100, "a"), *((200 + k, f"a {w}") for k, w in enumerate("abcdefgh"))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitmanyor.score(follow, F.col("doc_id") < 100, block_bytes=100, word_bytes=50, pair_bytes=50).collect()}
    again = {r.doc_id: r.score for r in pitmanyor.score(follow, F.col("doc_id") < 100).collect()}
    assert got == pytest.approx(again)  # whatever the blocks
    assert got[201] > got[203]


def test_odd_tool_arguments(spark):
    """Numbers beyond doubles, long integers, lone surrogates, deep nesting and null dependencies are results, not crashes."""
    said = ['{"query":"x","turn":1e400}', '{"query":"x","turn":' + "9" * 400 + "}", '{"query":"\\ud800","turn":1}', "[" * 100_000, '{"query":"a","turn":true}', None, '{"turn":1}']
    rows = [(1, k, "user", None, f"c{k}", "ask", x, ["c9", None]) for k, x in enumerate(said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, depends_on array<string>")
    got = {r.turn: r for r in toolcalls.link(df, toolcalls.ASK).collect()}
    assert [got[k].valid for k in range(7)] == [False, True, True, False, False, False, False]
    assert [got[k].errors for k in (0, 3, 4, 6)] == [["$: not JSON"], ["$: not JSON"], ["$.turn: type"], ["$.query: required"]] and r"\ud800" in got[2].json
    assert toolcalls.violations(True, {"enum": [1]}) == ["$: enum"] and toolcalls.violations(1.0, {"enum": [1]}) == []


def test_token_attribution(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", "a b\nc d\n\ne", "x\n", "日本 é\nü", None]
    got = defaultdict(list)
    for r in tokencount.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.start, r.stop, r.n_tokens))
    for i, x in enumerate(texts):
        x = x or ""
        starts = [0, *(k + 1 for k, c in enumerate(x) if c == "\n" and k + 1 < len(x))]
        n = [0] * len(starts)
        for a, _ in t.encode(x, add_special_tokens=False).offsets:
            n[max(k for k, s in enumerate(starts) if s <= a)] += 1
        assert got[i] == [(a, b, c) for a, b, c in zip(starts, [*starts[1:], len(x)], n, strict=True)]
    assert tokencount.section_tokens(odd).agg(F.countDistinct("doc_id")).first()[0] == 10 and tokencount.section_tokens(odd.limit(0)).count() == 0
    first, stop, starts = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 6, 8])
    assert [tokencount.attributed(first, stop, starts, r).tolist() for r in tokencount.RULES] == [[2, 1, 0, 0], [1, 1, 0, 1], [1, 1, 1, 0], [2, 2, 1, 1]]


def test_warc_round_trip(spark):
    pages = [(1, "http://a/b c\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    bundles = warc.write_bundles(df, frame_bytes=1000)
    rows = warc.read_bundles(bundles).collect()
    want = {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), None: ("response", None)}
    assert len(rows) == 7 and all((r.record_type, r.refers_to) == want[r.page_id] for r in rows)
    text = {i: (h or "").encode() for i, _, h in pages}
    assert all((r.payload_bytes, r.payload_digest) == (len(text[r.page_id]), warc.digest(text[r.page_id])) for r in rows)
    data = {r.bundle_id: bytes(r.bundle) for r in bundles.collect()}
    for e in warc.index(bundles).collect():
        fields, _ = warc.read_record(data[e.bundle_id], e.frame, e.offset)
        assert fields["WARC-Record-ID"] == e.record_id
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_nearest_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] * 64, 0), (9004, [None] * 64, 0), (9005, [1.0], 0), (None, [1.0] * 64, 0)], e.schema)
    copies = e.limit(1).select(F.explode(F.expr("sequence(10000L, 10080L)")).alias("vec_id"), "embedding", "label")
    rows = e.union(odd).union(copies)
    got = defaultdict(list)
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = e.union(copies).collect()
    x, ids = np.array([r.embedding for r in good], float), np.array([r.vec_id for r in good])
    hit = total = 0
    for j in np.flatnonzero(ids % 20 == 0):
        s = x @ x[j]
        o = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != ids[j]][:20]
        hit += len({v for v, _ in got[ids[j]]} & set(ids[o].tolist()))
        total += 20
        assert len(got[ids[j]]) == 20 and ids[j] not in dict(got[ids[j]])
    assert hit / total >= 0.9
    assert ann.search(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tool_calls(spark):
    kind = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, depends_on array<string>"
    rows = [
        (1, 0, "user", "hi", None, None, None, None), (1, 1, "assistant", None, "a", "ask", '{"turn":1.0,"query":"x"}', ["b"]), (1, 2, "tool", "ra", "a", None, None, None),
        (1, 3, "assistant", None, "b", "ask", '{"turn":-1}', None), (1, 4, "tool", "rb", "b", None, None, None), (1, 4, "tool", "rb", "b", None, None, None),
        (1, 5, "tool", "z", "zz", None, None, None), (1, 6, "assistant", None, "q", "nope", "{", ["q2"]), (1, 7, "assistant", None, "q2", "nope", "{}", ["q"]),
        (1, 8, "tool", "r", "q", None, None, None), (1, 9, "tool", "r", "q2", None, None, None), (None, None, None, None, None, None, None, None),
    ]
    got = toolcalls.link(spark.createDataFrame(rows, kind), toolcalls.ASK).collect()
    assert len(got) == len(rows)
    order = [(r.call_id, r.turn) for r in sorted((r for r in got if r.status == "linked"), key=lambda r: (r.position, r.hops, r.turn))]
    assert order == [("b", 3), ("b", 4), ("a", 1), ("a", 2)]
    assert Counter(r.status for r in got) == {"message": 2, "linked": 4, "duplicate": 1, "orphan": 1, "cycle": 4}
    by = {(r.call_id, r.turn): r for r in got}
    assert by["a", 1].valid and '"arguments":{"query":"x","turn":1}' in by["a", 1].json
    assert by["b", 3].errors == ["$.query: required", "$.turn: minimum"] and by["q", 6].errors == ["$: not JSON"] and by["q2", 7].errors == ["$: unknown tool"]
    assert toolcalls.canonical({"b": [1.0, 2.5, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.5,null,true]}'
    assert queries.QUERIES["op8_tool_calls"](spark, SF).count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline as c
    from docquarry.llm import decontam
    from docquarry.llm._io import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert docs.exceptAll(before).count() == 0
        if name == "decontamination":
            left = decontam.scan(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert left.where(decontam.judged()[1]).count() == 0
    last = c.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0
