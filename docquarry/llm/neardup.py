"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set holds the 52-bit hashes of its distinct word shingles; its sketch is the `k`
smallest of them (the whole set, if smaller). Copies are put together first, by a 64-bit hash of
the set. Then

1. inverted lists: every retained value has a list of the sketches that hold it. Two sets of
   Jaccard similarity t share at least c of their retained values, so both hold one of the
   other's s - c + 1 rarest ones (values in the order of their list's length): only those lists
   count, which leaves out lists of common shingles exactly, without a cap. For sets whose
   partners all lie whole in their sketches, c is the exact bound ceil(t * size); for others
   it is SHARED of k, over five standard deviations below the mean t * k: one pair of exactly t in 3 * 10**6 is missed.
2. a list isn't expanded into its pairs. Each list picks as centre the set that shares most of
   its values, and pairs are (member, centre). The similarity estimated on the union's sketch
   drops pairs, the exact Jaccard of the full sets decides, and links join into components.
3. lists whose other members lie in different components after that are compared in blocks of
   bounded size, only across components: outsiders of the list's largest component against all.
   Two sets can share only shingles that two of these sets have, which rules out most pairs
   exactly. Blocks of short lists give pairs whose estimate passes, to be verified on full sets;
   blocks of long lists hold full sets and give links, one for each pair of components. So no
   link between components is lost.

Components come from alternating large-star and small-star steps on tables in the shared folder.

Defined cases: null texts and texts without words have an empty set and link with nothing; rows
with a null id link with nothing, get a null component and stay; repeated rows are copies and
each gets its row. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import dropped, table, written
from ._text import NOT_SPACE, Words, column, gathered, mix

SKETCH = 64
#: Least share of a sketch's values that a linked sketch has too.
SHARED = 34 / 64
#: Rows of either side of a comparison of blocks.
BLOCK = 128

_U = np.uint64


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a chunk, text by text, and where each text begins."""
    w = Words(buf, offsets, NOT_SPACE)
    n, counts = len(w.hash), np.diff(w.bounds)
    step = _U(0x9FB21C651E98DF25)

    def joined(start: np.ndarray, m: int) -> np.ndarray:
        x = w.hash[start]
        for j in range(1, m):
            x = mix(x * step + w.hash[start + j])
        return x

    start = np.arange(max(n - words + 1, 0))
    start = start[w.doc[start] == w.doc[start + words - 1]] if len(start) else start
    hashes, docs = [joined(start, words)], [w.doc[start]]
    for m in range(1, words):
        few = np.flatnonzero(counts == m)
        if len(few):
            hashes.append(mix(joined(w.bounds[few], m) + _U(m)))
            docs.append(few)
    key = np.concatenate(docs).astype(_U) << _U(52) | np.concatenate(hashes) >> _U(12)
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return (key & _U((1 << 52) - 1)).astype(np.int64), np.searchsorted(key >> _U(52), np.arange(len(offsets)).astype(_U))


def _set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each set; 0 for empty ones."""
    out = np.zeros(len(bounds) - 1, _U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = sets.astype(_U)
        at = bounds[full]
        a, b = np.add.reduceat(mix(x + _U(1)), at), np.bitwise_xor.reduceat(mix(x * _U(0xD6E8FEB86659FD93) + _U(7)), at)
        out[full] = mix(a ^ mix(b + np.diff(bounds)[full].astype(_U)))
    return out.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], ids: str, text: str, words: int, keep: int | None) -> Iterator[pa.RecordBatch]:
    for rows, buf, offsets in gathered(batches, text):
        sets, bounds = shingle_sets(buf, offsets, words)
        size = np.diff(bounds)
        short = np.minimum(size, keep) if keep else size
        ends = np.concatenate([[0], np.cumsum(short)])
        where = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], short)
        values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets[where]))
        yield pa.RecordBatch.from_arrays([column(rows, ids).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(_set_keys(sets, bounds)), values], ["doc_id", "n_shingles", "key", "vals"])


_SETS = "doc_id long, n_shingles long, key long, vals array<long>"


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (a, b): key and root, the smallest key of its component, for every key with an edge."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before, old = None, []
    while True:
        # large star: larger neighbours of a key go to the smallest of its neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the key itself go to the smallest neighbour
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(edges, "stars", old)
        old = [edges]
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


def _estimated(a: str, b: str, n_a: str, n_b: str, k: int, num: int, den: int):
    """Whether two sketches can belong to linked sets, from the k smallest values of their union; exact where they hold the whole sets."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    shared = F.size(F.array_intersect(a, b))
    whole = (F.col(n_a) <= k) & (F.col(n_b) <= k)
    return F.when(whole, den * shared >= num * (F.col(n_a) + F.col(n_b) - shared)).otherwise(both >= F.floor(SHARED * F.size(union)))


def _sizes_fit(n_a, n_b, num: int, den: int):
    return (den * F.least(n_a, n_b)) >= (num * F.greatest(n_a, n_b))


def _padded(lists: pa.ListArray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(lists), width), fill, np.int64)
    size = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


_GROUP = ("kind", "value", "i", "j")


def _cross(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (kind, list, i, j) groups: pairs of a left and a right row in different components. Of kind 0, those whose
    estimate passes, each in the first list they share; of kind 1, links by full sets."""

    def verified(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Links between a group's left and right rows by their full sets; one for each pair of components."""
        left = column(t, "left").to_numpy(zero_copy_only=False)
        key, comp, n, held = (column(t, c).to_numpy() for c in ("key", "root", "n", "held"))
        lists = column(t, "full")
        values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        _, number, often = np.unique(values, return_inverse=True, return_counts=True)
        new = np.cumsum(often > 1) - 1  # values of one row alone are never shared
        number, row = new[number[(two := often[number] > 1)]], row[two]
        order = np.argsort(number, kind="stable")
        number, row = number[order], row[order]
        place, (L, R) = np.zeros(len(left), int), (np.flatnonzero(left), np.flatnonzero(~left))
        place[L], place[R] = np.arange(len(L)), np.arange(len(R))
        shared = np.zeros((len(L), len(R)), np.float32)
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 1 << 14):
            a, b = np.searchsorted(number, [lo, lo + (1 << 14)])
            c, r = number[a:b] - lo, row[a:b]
            x, y = np.zeros((len(L), 1 << 14), np.float32), np.zeros((len(R), 1 << 14), np.float32)
            x[place[r[left[r]]], c[left[r]]] = 1
            y[place[r[~left[r]]], c[~left[r]]] = 1
            shared += x @ y.T
        shared = shared.astype(np.int64)
        i, j = np.nonzero((comp[L][:, None] != comp[R][None]) & (den * shared >= num * (n[L][:, None] + n[R][None] - shared)))
        if len(i):
            u, v = comp[L[i]], comp[R[j]]
            _, first = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0, return_index=True)
            u, v = key[L[i[first]]], key[R[j[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["a", "b"])

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = column(t, "kind").to_numpy()
        cut = int(np.searchsorted(kind, 1))
        if cut:
            yield from estimated(t.slice(0, cut).combine_chunks())
        if cut < len(kind):
            rest = t.slice(cut).combine_chunks()
            g = np.stack([column(rest, c).to_numpy() for c in _GROUP])
            ends = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1).tolist(), rest.num_rows]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                yield from verified(rest.slice(lo, hi - lo).combine_chunks())

    def estimated(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left = column(t, "left").to_numpy(zero_copy_only=False)
        key, comp, n, value, held = (column(t, c).to_numpy() for c in ("key", "root", "n", "value", "held"))
        g = np.stack([column(t, c).to_numpy() for c in _GROUP])
        group = np.concatenate([[0], np.cumsum((g[:, 1:] != g[:, :-1]).any(0))])
        L, R = np.flatnonzero(left), np.flatnonzero(~left)
        lo, hi = np.searchsorted(group[R], group[L], "left"), np.searchsorted(group[R], group[L], "right")
        sketch = lists = None
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(L):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
            m = hi[at:stop] - lo[at:stop]
            p = np.repeat(L[at:stop], m)
            q = R[np.arange(m.sum()) + np.repeat(lo[at:stop] - (np.cumsum(m) - m), m)]
            at = stop
            fit = (comp[p] != comp[q]) & (den * np.minimum(n[p], n[q]) >= num * np.maximum(n[p], n[q]))
            fit &= (num + den) * np.minimum(held[p], held[q]) >= num * (n[p] + n[q])  # the most they can share
            p, q = p[fit], q[fit]
            if len(p) and sketch is None:
                sketch, lists = _padded(column(t, "vals"), k, -1), _padded(column(t, "lists"), k, -1)
            for x in range(0, len(p), 1 << 14):
                a, b = p[x : x + (1 << 14)], q[x : x + (1 << 14)]
                both = np.sort(np.concatenate([lists[a], lists[b]], 1), 1)
                same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
                first = both[np.arange(len(a)), same.argmax(1)] == value[a]
                a, b = a[first], b[first]
                both = np.sort(np.concatenate([sketch[a], sketch[b]], 1), 1)
                real = both >= 0
                twice = np.zeros(both.shape, bool)
                twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
                rank = np.cumsum(real & ~twice, 1)
                union = np.minimum(rank[:, -1], k)
                shared, near = twice.sum(1), (twice & (rank <= k)).sum(1)
                whole = (n[a] <= k) & (n[b] <= k)
                ok = np.where(whole, den * shared >= num * (n[a] + n[b] - shared), near >= np.floor(SHARED * union))
                if ok.any():
                    u, v = key[a[ok]], key[b[ok]]
                    pair = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        last = [t.column(c)[-1].as_py() for c in _GROUP]
        other = np.zeros(t.num_rows, bool)
        for c, x in zip(_GROUP, last, strict=True):
            other |= column(t, c).to_numpy() != x
        cut = int(other.sum())  # rows are sorted: those of the last group come last
        if cut:
            yield from compared(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield from compared(rest.combine_chunks())


def near_duplicates(docs: DataFrame, ids: str = "doc_id", text: str = "text", words: int = 5, threshold: tuple[int, int] = (4, 5), k: int = SKETCH) -> DataFrame:
    """One row per row of `docs`: doc_id (integral), n_shingles, component_id (smallest id of its component), kept.

    `threshold` is the least Jaccard similarity of linked sets, as a fraction of integers.
    """
    num, den = threshold
    t = num / den
    source = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(source.mapInArrow(lambda it: _sets(it, "doc_id", "text", words, k), _SETS), "sketches")
    nodes = written(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("at"), F.first("n_shingles").alias("n"), F.first("vals").alias("vals")), "nodes"
    )

    # 1. the lists that count
    least = F.when(F.col("n") * den <= k * num, F.ceil(F.col("n") * num / den)).otherwise(F.floor(F.size("vals") * SHARED))
    values = nodes.select("key", F.explode("vals").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per_node = values.join(shared, "value").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("seen"))  # k at most
    alone = F.size("vals") - F.size("seen")
    lists = written(
        per_node.join(nodes, "key")
        .select("key", "n", (alone / F.size("vals")).alias("alone"), F.transform(F.slice("seen", 1, F.greatest(F.lit(0), F.size("vals") - least.cast("int") + 1 - alone)), lambda x: x["value"]).alias("lists"))
        .where(F.size("lists") > 0),
        "lists",
    )
    members = lists.select("key", "n", "alone", F.explode("lists").alias("value"))
    centres = members.groupBy("value").agg(F.count("*").alias("m"), F.min(F.struct("alone", "key", "n")).alias("c")).where("m > 1")

    # 2. members against centres
    pairs = members.join(centres, "value").where("key <> c.key").where(_sizes_fit(F.col("n"), F.col("c.n"), num, den)).select(F.greatest("key", "c.key").alias("a"), F.least("key", "c.key").alias("b")).distinct()
    sketch = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("vals").alias(f"s_{x}"))
    pairs = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(_estimated("s_a", "s_b", "n_a", "n_b", k, num, den)).select("a", "b", ((F.col("n_a") <= k) & (F.col("n_b") <= k)).alias("sure"))
    pairs = written(pairs, "pairs")
    links = _verified(pairs, nodes, source, words, num, den)
    dropped(pairs)
    roots = components(links)

    # 3. lists across components; pairs with a list's centre have been decided
    labelled = members.join(centres.select("value", F.col("c.key").alias("centre")), "value").where("key <> centre").join(roots, "key", "left").select("value", "key", "n", F.coalesce("root", "key").alias("root"))
    cases = written(_mixed(labelled), "open")
    more = None
    if not cases.isEmpty():
        # the most frequent root of a list is at home: outsiders are compared with all
        home = cases.groupBy("value", "root").agg(F.count("*").alias("m")).groupBy("value").agg(F.max(F.struct("m", "root")).alias("home"), F.sum("m").alias("m"))
        cases = written(cases.join(home.select("value", "m", F.col("home.root").alias("home")), "value"), "homes", [cases])
        homes = cases
        small = cases.where(F.col("m") <= BLOCK).join(lists.select("key", "lists"), "key").select("value", "key", "root", "n", F.col("n").alias("held"), "lists", "home", "m", F.lit(0).alias("kind"))
        # long lists of one home are one set of members; shingles that no other of them has can't be in an overlap
        long = cases.where(F.col("m") > BLOCK).select(F.col("home").alias("value"), "key", "root", "n", "home").distinct()
        full = written(_full_sets(long.select("key").distinct(), nodes, source, words), "sets")
        each = full.select("key", F.explode("vals").alias("value"))
        twice = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").select("value")
        held = each.join(twice, "value").groupBy("key").agg(F.count("*").alias("held"))
        long = long.join(held, "key").where(F.col("held") * den >= F.col("n") * num)
        long = written(long.join(long.groupBy("value").agg(F.count("*").alias("m")), "value").select("value", "key", "root", "n", "held", F.array("value").alias("lists"), "home", "m", F.lit(1).alias("kind")), "long")
        cases = small.unionByName(long)
        outside = cases.where("root <> home").groupBy("kind", "value").agg(F.count("*").alias("outside"))
        sides, zero = cases.join(outside, ["kind", "value"]).withColumn("left_n", F.ceil(F.col("outside") / BLOCK)).withColumn("right_n", F.ceil(F.col("m") / BLOCK)), F.lit(0).cast("long")
        own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
        shape = ["kind", "value", "key", "root", "n", "held", "lists"]
        left = sides.where("root <> home").select(*shape, F.lit(True).alias("left"), own("left_n").alias("i"), F.explode(F.sequence(zero, F.col("right_n") - 1)).alias("j"))
        right = sides.select(*shape, F.lit(False).alias("left"), F.explode(F.sequence(zero, F.col("left_n") - 1)).alias("i"), own("right_n").alias("j"))
        # 31 bits of a value do for an estimate: values that fall together can only add to it
        short = nodes.select("key", F.transform("vals", lambda x: F.shiftrightunsigned(x, 21).cast("int")).alias("vals"))
        deep = long.select("key").distinct().join(full, "key").select("key", F.col("vals").alias("full"))
        every = left.unionByName(right)
        none = F.lit(None)
        both = every.where("kind = 0").join(short, "key").withColumn("full", none.cast("array<bigint>")).unionByName(every.where("kind = 1").join(deep, "key").withColumn("vals", none.cast("array<int>")))
        keys = ["kind", "value", "i", "j"]
        got = both.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "left", "key", "root", "n", "held", "vals", "full", "lists").mapInArrow(lambda it: _cross(it, k, num, den), "a long, b long")
        got = written(got.distinct(), "pairs", [homes, long, full])
        more = _verified(got.withColumn("sure", F.lit(False)), nodes, source, words, num, den)
        dropped(got)
    if more is not None and not more.isEmpty():
        roots = components(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).union(more))

    named = rows.select("doc_id", "n_shingles", "key", F.expr("n_shingles > 0 and doc_id is not null").alias("linked"))
    lone = named.where("not linked").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rooted = named.where("linked").join(roots, "key", "left").select("doc_id", "n_shingles", F.coalesce("root", "key").alias("root"))
    firsts = nodes.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("at").alias("component_id"))
    out = rooted.join(firsts, "root").select("doc_id", "n_shingles", "component_id").union(lone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of lists (value) whose members have more than one root."""
    mixed = rows.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value")
    return rows.join(mixed, "value")


def _full_sets(keys: DataFrame, nodes: DataFrame, source: DataFrame, words: int) -> DataFrame:
    """(key, vals) with the full sets of some nodes, from the texts again."""
    wanted = keys.join(nodes, "key").select(F.col("at").alias("doc_id"), F.col("key").alias("want"))
    texts = source.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInArrow(lambda it: _sets(it, "doc_id", "text", words, None), _SETS)
    return found.join(wanted, "doc_id").where("key = want").groupBy("key").agg(F.first("vals").alias("vals"))


def _exact(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The linked ones of `pairs`, by exact Jaccard on full sets."""
    side = lambda x: full.select(F.col("key").alias(x), F.col("vals").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(den * both >= num * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The linked ones of `pairs`; pairs marked sure were compared on whole sets before."""
    unsure = pairs.where("not sure")
    full = written(_full_sets(unsure.select(F.explode(F.array("a", "b")).alias("key")).distinct(), nodes, source, words), "sets")
    return written(pairs.where("sure").select("a", "b").union(_exact(unsure, full, num, den)), "links", [full])


def keep_one(docs: DataFrame, ids: str = "doc_id", **options) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id. Rows with a null id stay."""
    report = near_duplicates(docs, ids=ids, **options)
    stay = report.where("kept and doc_id is not null").select(F.col("doc_id").alias("__stay")).distinct()
    return docs.where(F.col(ids).isNotNull()).join(stay, F.col(ids) == F.col("__stay"), "left_semi").unionByName(docs.where(F.col(ids).isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


_SHINGLE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: The same in DuckDB: shared shingles of all pairs, and components as what a document reaches.
OP9_SQL = f"""
with recursive d as (select doc_id, {_SHINGLE_WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
m as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select a, b from m union all select b, a from m),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, len(s)::bigint as n_shingles, c.least_id as component_id, s.doc_id = c.least_id as kept from s join (select a, min(b) as least_id from r group by a) c on c.a = s.doc_id"""
