"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Largest inner products become smallest Euclidean distances by one more component, the square root
of the largest squared norm less the vector's own (0 for queries). The tree is fitted on SAMPLE
vectors at most, those that come first by hash of the id: k-means with BRANCH centres, again within
every cluster of over LEAF sampled vectors. Leaves that more than SPLIT vectors of the table fall into
are clustered further by a sample of their own, SAMPLE_LEAF at most, each in a task; so a leaf is
small up to about SAMPLE_LEAF / LEAF times as many vectors as without. Every vector is then indexed
in its nearest leaf.

A query walks the tree with a priority queue of nodes by distance to their centres, and visits
leaves until there are `visits` of them, and k + 1 candidates in them. `visits` is calibrated:
CALIBRATE query vectors are compared by brute force with all rows, and visits widen until TARGET of
their neighbours are reached (all leaves at most, which is exact). A query's own row is none of its
neighbours there, and a vector counts as often as it asks.

Rows of a leaf are dealt into blocks of about ROWS vectors and its queries into blocks of about
QUERIES, and each pair of blocks is one matrix product, so no leaf, however large, meets in one
task. Equal vectors are searched once: an index row carries the k + 1 smallest ids of its vector,
which is all that can be among anyone's k nearest, and each query leaves out itself.

Scores are inner products of the original vectors in double precision. Ties go to smaller ids.
Defined cases: vectors that are null, empty, of another length than the most common one, zero, or
with null or non-finite components take no part; ids that are null take no part; a repeated id
counts once for each different vector; fewer candidates than k give all; no vectors, no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import table, written
from ._text import column

SAMPLE, BRANCH, LEAF, ROUNDS = 20_000, 16, 128, 8
SPLIT, SAMPLE_LEAF = 4096, 4096
CALIBRATE, TARGET = 200, 0.95
ROWS, QUERIES = 4096, 1024
K = 20


class Tree:
    """Nodes in arrays: centre, children (a range of nodes) and the leaf's number or -1."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, rounds: int = ROUNDS):
        rng = np.random.default_rng(0)
        centres, first, last, leaf_of = [x.mean(0)], [0], [0], [-1]
        todo, self.leaves = [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop(0)
            parts = self._split(x[rows], branch, rounds, rng) if len(rows) > leaf else None
            if parts is None:
                leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            c, of = parts
            first[node], last[node] = len(centres), len(centres) + len(c)
            for j in range(len(c)):
                todo.append((len(centres), rows[of == j]))
                centres.append(c[j])
                first.append(0)
                last.append(0)
                leaf_of.append(-1)
        self.centres, self.first, self.last, self.leaf_of = np.array(centres), first, last, leaf_of

    @staticmethod
    def _split(x: np.ndarray, k: int, rounds: int, rng) -> tuple[np.ndarray, np.ndarray] | None:
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return None
        c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        of = np.zeros(len(x), int)
        for _ in range(rounds):
            of = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(of, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, of, x)
            c = sums[n > 0] / n[n > 0, None]
        of = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        used = np.unique(of)
        return (c[used], np.searchsorted(used, of)) if len(used) > 1 else None

    def graft(self, subtrees: dict[int, Tree]) -> None:
        """Puts trees in the place of leaves; the first leaf of each takes the number of the old one."""
        node_of = {leaf: node for node, leaf in enumerate(self.leaf_of) if leaf >= 0}
        centres = [self.centres]
        for leaf, sub in sorted(subtrees.items()):
            if sub.leaves < 2:
                continue
            shift = len(self.first) - 1  # the subtree's root is the leaf's node
            node = node_of[leaf]
            number = {k: self.leaves + k - 1 if k else leaf for k in range(sub.leaves)}
            self.leaves += sub.leaves - 1
            self.leaf_of[node], self.first[node], self.last[node] = -1, sub.first[0] + shift, sub.last[0] + shift
            for a, b, k in zip(sub.first[1:], sub.last[1:], sub.leaf_of[1:], strict=True):
                self.first.append(a + shift if a < b else 0)
                self.last.append(b + shift if a < b else 0)
                self.leaf_of.append(number[k] if k >= 0 else -1)
            centres.append(sub.centres[1:])
        self.centres = np.concatenate(centres)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            a, b = self.first[node], self.last[node]
            if a == b:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centres[a:b]
            of = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(a + j, rows[of == j]) for j in range(b - a)]
        return out

    def best_first(self, q: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """The leaves of one query in the order of a best-bin-first traversal: `visits`, and more until they hold `least` candidates."""
        found: list[int] = []
        held = 0
        distance = ((self.centres - q) ** 2).sum(1)
        queue = [(0.0, 0)]
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            if self.first[node] == self.last[node]:
                found.append(self.leaf_of[node])
                held += int(sizes[self.leaf_of[node]])
            for child in range(self.first[node], self.last[node]):
                heapq.heappush(queue, (distance[child], child))
        return found


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _raised(x: np.ndarray, top: float) -> np.ndarray:
    """With the component that makes inner products distances."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]], 1)


def clean(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part; components as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(ids).cast("long").alias("vec_id"), v.alias("v")).where(good)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    return rows.where(F.size("v") == (lengths.n if lengths else 0))


def _best(out: list) -> pa.RecordBatch:
    q, ids, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _top(queries: np.ndarray, qid: np.ndarray, rows: np.ndarray, members: list[list[int]], k: int) -> list:
    """The k best candidates of each query among the rows, as (query ids, candidate ids, scores)."""
    # einsum, not a blocked product: each score is the same however rows are dealt
    s = np.einsum("qd,rd->qr", queries, rows)
    size = np.array([len(m) for m in members])
    flat = np.concatenate([np.asarray(m, np.int64) for m in members])
    of = np.repeat(np.arange(len(rows)), size)
    s = s[:, of]
    out = []
    for j in range(len(queries)):
        cut = np.partition(s[j], len(flat) - k)[len(flat) - k] if len(flat) > k else -np.inf
        keep = np.flatnonzero(s[j] >= cut)
        keep = keep[np.lexsort((flat[keep], -s[j, keep]))[:k]]
        out.append((np.full(len(keep), qid[j]), flat[keep], s[j, keep]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (leaf, i, j): vectors (id, v, members) and queries (id, v, null members)."""
    keys = ("leaf", "i", "j")

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        members = column(t, "members")
        is_query = members.is_null().to_numpy(zero_copy_only=False)
        v, ids = _matrix(column(t, "v")), column(t, "id").to_numpy()
        if is_query.any() and not is_query.all():
            rows = np.flatnonzero(~is_query)
            yield _best(_top(v[is_query], ids[is_query], v[rows], [members[int(r)].as_py() for r in rows], k))

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        g = np.stack([column(t, c).to_numpy() for c in keys])
        cuts = (np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if cuts else ():
            yield from solved(t.slice(a, b - a).combine_chunks())
        rest = t.slice(cuts[-1]) if cuts else t
    if rest is not None and rest.num_rows:
        yield from solved(rest.combine_chunks())


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries, k: int = K, ids: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which the column `queries` (of vec_id) holds, itself left out."""
    spark = vectors.sparkSession
    rows = clean(vectors, ids, vector).distinct()
    # equal vectors together: first by salted groups, so that no task has all copies
    by = Window.partitionBy("v", "salt").orderBy("vec_id")
    once = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("salt", F.pmod("vec_id", F.lit(64))).withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(once)).where(F.col("n") <= k + 1)
    index = written(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(F.element_at("members", 1).alias("id"), "v", "members"), "vectors")
    asked = rows.where(queries).select("v", "vec_id")
    heads = written(asked.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("askers")), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = index.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if top is None:
        return empty
    picked = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    tree = Tree(_raised(_matrix(column(picked, "v")), top))
    shared = spark.sparkContext.broadcast(tree)

    def within(it):
        for b in it:
            x = _raised(_matrix(column(b, "v")), top)
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "v"), pa.array(shared.value.descend(x))], ["id", "v", "leaf"])

    def clustered(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        sub = Tree(_raised(_matrix(column(t, "v")), top))
        return pa.table({"leaf": column(t, "leaf")[:1], "tree": pa.array([pickle.dumps(sub)], pa.binary())})

    at = index.mapInArrow(within, "id long, v array<double>, leaf long")
    full = at.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("leaf")
    few = Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id")
    some = at.join(F.broadcast(full), "leaf").withColumn("n", F.row_number().over(few)).where(F.col("n") <= SAMPLE_LEAF).select("id", "v", "leaf")  # no more leaves than SAMPLE
    subtrees = some.groupBy("leaf").applyInArrow(clustered, "leaf long, tree binary").collect()  # of SAMPLE_LEAF vectors, for each leaf
    if subtrees:
        tree.graft({r.leaf: pickle.loads(r.tree) for r in subtrees})
        shared = spark.sparkContext.broadcast(tree)

    def leaves(it):
        for b in it:
            leaf = shared.value.descend(_raised(_matrix(column(b, "v")), top))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("id", "v", "members")), pa.array(leaf)], ["id", "v", "members", "leaf"])

    placed = written(index.mapInArrow(leaves, "id long, v array<double>, members array<long>, leaf long"), "leaves", [index])
    sizes = np.zeros(tree.leaves, np.int64)  # candidates of each leaf
    for r in placed.groupBy("leaf").agg(F.sum(F.size("members")).alias("n")).collect():  # no more rows than leaves
        sizes[r.leaf] = r.n
    visits = _calibrated(spark, placed, heads, tree, sizes, k, target)

    def walk(it):
        for b in it:
            lists = [shared.value.best_first(np.append(q, 0.0), visits, sizes, k + 1) for q in _matrix(column(b, "v"))]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "v"), pa.array(lists, pa.list_(pa.int64()))], ["id", "v", "leaves"])

    asking = heads.select("id", "v").mapInArrow(walk, "id long, v array<double>, leaves array<long>").select("id", "v", F.explode("leaves").alias("leaf"))
    asking = written(asking, "visits")
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("rows_n")).join(asking.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("queries_n")), "leaf")
    counts = F.broadcast(counts)  # leaves of a tree over SAMPLE vectors: never more than those
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    zero = F.lit(0)
    right = placed.join(counts, "leaf").select("leaf", own("rows_n").alias("i"), F.explode(F.sequence(zero, F.col("queries_n") - 1)).alias("j"), "id", "v", "members")
    left = asking.join(counts, "leaf").select("leaf", F.explode(F.sequence(zero, F.col("rows_n") - 1)).alias("i"), own("queries_n").alias("j"), "id", "v", F.lit(None).cast("array<long>").alias("members"))
    dealt = right.unionByName(left).repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    found = dealt.mapInArrow(lambda it: _blocks(it, k + 1), "query_id long, vec_id long, score double")
    best = _ranked(found, k + 1).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), "vec_id", "score"))).alias("found"))
    best = best.join(heads.select(F.col("id").alias("query_id"), "v"), "query_id").select("v", "found")
    own_list = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    each = asked.join(best, "v").select(F.col("vec_id").alias("query_id"), own_list.alias("found"))
    return each.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _calibrated(spark: SparkSession, placed: DataFrame, heads: DataFrame, tree: Tree, sizes: np.ndarray, k: int, target: float) -> int:
    """Visits that reach `target` of the true k neighbours of some queries, their own rows left out; the truth comes from all rows, in blocks."""
    some = heads.orderBy(F.xxhash64("id"), "id").limit(CALIBRATE).toArrow()
    if not some.num_rows:
        return tree.leaves
    q, qid, askers = _matrix(column(some, "v")), column(some, "id").to_numpy(), column(some, "askers").to_numpy()
    shared = spark.sparkContext.broadcast((q, qid))

    def brute(it):
        for b in it:
            v, leaf = _matrix(column(b, "v")), column(b, "leaf").to_numpy()
            lists = [m.as_py() for m in column(b, "members")]
            where = {x: int(leaf[i]) for i, m in enumerate(lists) for x in m}
            for a, c, s in _top(*shared.value, v, lists, k + 1):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s), pa.array([where[x] for x in c.tolist()], pa.int64())], ["query_id", "vec_id", "score", "leaf"])

    truth: dict[int, list[int]] = {}
    for r in _ranked(placed.mapInArrow(brute, "query_id long, vec_id long, score double, leaf long"), k + 1).orderBy("query_id", "rank").collect():  # k + 1 rows of each calibrating query
        if r.vec_id != r.query_id:
            truth.setdefault(r.query_id, []).append(r.leaf)
    needed = np.zeros(tree.leaves + 1)
    for j, ident in enumerate(qid.tolist()):
        order = {leaf: n + 1 for n, leaf in enumerate(tree.best_first(np.append(q[j], 0.0), tree.leaves, sizes, 0))}
        for leaf in truth.get(ident, [])[:k]:
            needed[order[leaf]] += askers[j]
    reached = np.cumsum(needed) / max(needed.sum(), 1)
    return max(1, int(min(np.searchsorted(reached, target), tree.leaves)))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
