"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and its distinct character n-grams (ORDERS long, hashed into 2**BITS
features) are marked present. From labelled texts, feature f gets the log-count ratio
r_f = log((p_f + a) / (P + 2a)) - log((q_f + a) / (Q + 2a)) of toxic and other texts. The FEATURES
most telling features, by the G statistic of their presence (TELLING at least), enter a logistic regression whose
inputs are r_f for present features and 0 for absent ones. A score is its probability.

Training reads a bounded sample of labelled rows: the SAMPLE ids that come first by hash of the
id, of each class SAMPLE at most. Nothing else is limited; every text is scored whole.

Defined cases: null texts score as empty ones (by the intercept); repeated rows each get a row;
labels whose class is null are left out; an id labelled both ways counts as toxic, a
labelled id with several texts by the least of them; without
labelled rows of both classes every text scores the share of toxic rows (0 if none). No input
but the text reaches a score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import table, written
from ._text import chunks, column, distinct, mix, released

ORDERS = (4, 5, 6, 7, 8)
BITS = 22
#: Labelled rows of each class that training reads at most.
SAMPLE = 10_000
FEATURES = 8192
#: Least G statistic (in nats) of a feature: far beyond what the largest of 2**BITS chance features has.
TELLING = 9.0
THRESHOLD = 0.3
#: Smoothing of counts, L2 penalty of weights, and steps of training.
ALPHA, PENALTY, STEPS = 0.5, 1e-3, 400

#: Bytes of text whose n-grams are hashed at once.
STRETCH = 1 << 17

_U = np.uint64


def hashed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers of the n-grams at each character of some texts, for each order, and the text of each character.

    A text is framed by one space on either side; n-grams that leave a text get -1.
    """
    framed = [f" {x.lower()} " for x in texts]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    doc = np.repeat(np.arange(len(framed), dtype=np.int32), sizes)
    x = points.astype(_U) * _U(0x9E3779B97F4A7C15)
    n, out = len(points), []
    rolled = x
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            rolled = (rolled[:-1] * _U(0xD1342543DE82EF95)) ^ x[order - 1 :] if n >= order else rolled[:0]
        if order in ORDERS:
            f = np.full(n, -1, np.int64)
            if len(rolled):
                inside = doc[: len(rolled)] == doc[order - 1 :]
                f[: len(rolled)] = np.where(inside, (mix(rolled + _U(order)) >> _U(64 - BITS)).astype(np.int64), -1)
            out.append(f)
    return out, doc


def present(texts: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted; with `codes` (feature number to code or -1) only coded features, as codes."""
    orders, doc = hashed(texts)
    pairs = []
    for f in orders:
        c = np.where(f >= 0, codes[f], -1) if codes is not None else f
        on = np.flatnonzero(c >= 0)
        pairs.append(doc[on].astype(np.int64) << BITS | c[on])
    pair = distinct(np.concatenate(pairs))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def coded(features: np.ndarray) -> np.ndarray:
    """Feature number to place among `features`, or -1."""
    codes = np.full(1 << BITS, -1, np.int32)
    codes[features] = np.arange(len(features))
    return codes


@dataclass
class Model:
    """features: their numbers; `weight` holds coefficient times log-count ratio of each."""

    features: np.ndarray
    weight: np.ndarray
    bias: float

    @functools.cached_property
    def codes(self) -> np.ndarray:
        """Made where texts are scored: it is large, and the model is small without it."""
        return coded(self.features)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(texts) and len(self.weight):
            doc, f = present(texts, self.codes)
            z += np.bincount(doc, self.weight[f], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for rows, _, _ in chunks(batches, "text", STRETCH):
        doc, f = present([x or "" for x in column(rows, "text").to_pylist()])
        toxic = column(rows, "toxic").to_numpy()[doc] == 1
        for k in (0, 1):
            some = np.sort(f[toxic == k])
            heads = np.flatnonzero(np.diff(some, prepend=-1))
            counts[k, some[heads]] += np.diff(heads, append=len(some)).astype(np.int32)
    f = np.flatnonzero(counts[0] | counts[1])
    for at in range(0, len(f), 50_000):
        part = f[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(counts[k, part].astype(np.int64)) for k in (0, 1))], ["f", "q", "p"])


def _marked(batches: Iterator[pa.RecordBatch], features: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The class of each text, and the places of its features as 16-bit integers."""
    codes = coded(features)
    for rows, _, _ in chunks(batches, "text", STRETCH):
        doc, f = present([x or "" for x in column(rows, "text").to_pylist()], codes)
        ends = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        f = f.astype(np.uint16)
        yield pa.RecordBatch.from_arrays([column(rows, "toxic").cast(pa.int32()), pa.array([f[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["toxic", "f"])


def fit(rows: pa.Table, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression on scaled presence, by accelerated gradient steps; rows of _marked()."""
    rows = rows.sort_by([("toxic", "ascending"), ("f", "ascending")])  # in whatever order tasks ended
    packed = pa.concat_arrays(rows.column("f").chunks)
    y = rows.column("toxic").to_numpy().astype(float)
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    f = np.frombuffer(packed.buffers()[2], np.uint16)[ends[0] // 2 : ends[-1] // 2]
    bounds = (ends - ends[0]) // 2
    n = len(y)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    x = ratio[f].astype(np.float32)
    full = np.flatnonzero(np.diff(bounds))  # texts with a feature

    def forward(v: np.ndarray) -> np.ndarray:
        z = np.zeros(n)
        if len(full):
            z[full] = np.add.reduceat(x * v[f].astype(np.float32), bounds[full], dtype=float)
        return z

    def backward(u: np.ndarray) -> np.ndarray:
        out, u = np.zeros(len(ratio)), u.astype(np.float32)
        for lo in range(0, len(f), 1 << 19):  # counts take doubles: some at a time
            part = slice(lo, lo + (1 << 19))
            out += np.bincount(f[part], x[part] * u[doc[part]], len(ratio))
        return out / n

    w, b = np.zeros(len(ratio)), float(np.log(y.mean() / (1 - y.mean())))
    # a bound of the curvature by a few power iterations
    v, top = np.ones(len(ratio)), 0.0
    for _ in range(8):
        v = backward(forward(v))
        top = float(np.linalg.norm(v))
        v = v / top if top else v
    rate = 1 / (0.25 * (top + 1) * 1.1 + PENALTY)
    pw, pb, a = w, b, 1.0
    yw, yb = w, b
    for _ in range(STEPS):
        g = 1 / (1 + np.exp(-np.clip(yb + forward(yw), -700, 700))) - y
        w = yw - rate * (backward(g) + PENALTY * yw)
        b = yb - rate * float(g.mean())
        na = (1 + (1 + 4 * a * a) ** 0.5) / 2
        yw, yb = w + (a - 1) / na * (w - pw), b + (a - 1) / na * (b - pb)
        pw, pb, a = w, b, na
    return w, b


def train(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled documents; `labels` has `ids` and `label` (0 or 1)."""
    known = labels.select(F.col(ids).alias("__id"), F.col(label).cast("int").alias("toxic")).where("__id is not null and toxic in (0, 1)").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col(ids).alias("__id"), F.col(text).alias("text")).join(F.broadcast(picked), "__id")
    rows = rows.groupBy("__id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")  # 2 * sample rows at most
    rows = written(rows, "labelled")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    whole = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    P, Q = totals.get(1, 0), totals.get(0, 0)
    if not P or not Q:
        share = P / max(P + Q, 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    counts = rows.mapInArrow(_counted, "f long, q long, p long").groupBy("f").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    n = P + Q

    def g(k, m, of):  # observed count k where m features of n rows, `of` of them in the class, meet
        return F.when(k > 0, k * F.log(k * n / (m * of))).otherwise(0.0)

    m = F.col("p") + F.col("q")
    told = g(F.col("p"), m, P) + g(F.col("q"), m, Q) + g(P - F.col("p"), n - m, P) + g(Q - F.col("q"), n - m, Q)
    best = counts.withColumn("g", F.round(told, 6)).where(F.col("g") >= TELLING).orderBy(F.desc("g"), "f").limit(FEATURES).collect()
    f = np.array([r.f for r in best], np.int64)
    ratio = np.log((np.array([r.p for r in best]) + ALPHA) / (P + 2 * ALPHA)) - np.log((np.array([r.q for r in best]) + ALPHA) / (Q + 2 * ALPHA))
    shared = rows.sparkSession.sparkContext.broadcast(f)
    marked = rows.mapInArrow(lambda it: _marked(it, shared.value), "toxic int, f binary").toArrow()  # bounded by the sample
    w, b = fit(marked, ratio)
    shared.destroy()
    b += float(np.log(whole[1] / whole[0]) - np.log(P / Q))  # the classes' shares among all labelled rows, not in the sample
    del marked
    released()
    return Model(f, w * ratio, b)


def _scored(batches: Iterator[pa.RecordBatch], text: str, model: Model, out: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in chunks(batches, text, STRETCH):
        s = model.scores([x or "" for x in column(rows, text).to_pylist()])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s)], schema=schema)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a double column `out`, which replaces one of that name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _scored(it, text, shared.value, out, arrow), schema)


def _fold(ids: str = "doc_id"):
    return F.pmod(F.crc32(F.col(ids).cast("string").cast("binary")), F.lit(4))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of op10 and of the pipeline: rows of fold 2 are held out of training."""
    return train(docs, labels.where(_fold() != 2))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """`docs` without rows that score `threshold` or more; columns as before."""
    return score(docs, model, text, "__toxic").where(F.col("__toxic") < threshold).select(*[f"`{c}`" for c in docs.columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score, from a model that never saw the labels of held-out documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
