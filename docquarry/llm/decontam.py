"""Benchmark decontamination with suffix arrays over the training words.

Each chunk of documents (a shard of a few MB, never a collected group) gets a suffix array over its
words, numbered within the shard, with a mark between documents. It is ordered by prefix doubling
as deep as the longest benchmark item. Every suffix of the benchmark is then binary-searched in
every shard, word by word: the range of suffixes that begin with its first d words shrinks as d
grows, until it is empty. The ranges give the verbatim matches and their places: at `window` words
the occurrences of windows, and all along the longest match at each place.

Ranges of one depth are the same or apart, so each place is met once for each depth, however often
the benchmark or the documents repeat themselves. Occurrences mark words in a difference array.

Nothing is shuffled. The benchmark travels to the tasks in blocks of about BLOCK_BYTES of text (one
item at least), one at a time: with several blocks, each pass adds to the results of the one
before, which are written to the shared folder.

Null or empty texts have no words: they are never hit and hit nothing. Benchmark rows with a
null id take no part. Repeated item ids count once, also with different texts and whatever the
blocks; repeated document rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import table, written
from ._text import ALNUM, Words, buffers, column, distinct, gathered, mix

WINDOW = 13
#: UTF-8 bytes of benchmark text that go to the tasks at once, and of documents that share a suffix array.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20
#: A document is contaminated if one word in this many is hit.
SHARE = 20

_U = np.uint64


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of a sequence of numbers (0 or more), ordered by `depth` numbers at least."""
    n = len(seq)
    bits = 21 if n == 0 or int(seq.max()) < 1 << 21 else 31
    done = 63 // bits
    padded = np.concatenate([seq, np.zeros(done, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(done):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n + 1, bool)  # whether a place of the order begins a group; the end does
    new[1:n] = key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0)) if n else order
    while done < depth:
        at = np.flatnonzero(~(new[:-1] & new[1:]))  # groups of several
        if not len(at):
            break
        pos = order[at]
        group, then = rank[pos], rank[np.minimum(pos + done, n)]
        by = np.argsort(group * (n + 2) + then)
        pos, then, group = pos[by], then[by], group[by]
        order[at] = pos
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        new[at[fresh]] = True
        rank[pos] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        done *= 2
    return order


class Benchmark:
    """Words of benchmark items laid end to end, as numbers into the sorted hashes `vocabulary`."""

    def __init__(self, rows: pa.Table, window: int):
        buf, offsets = buffers(column(rows, "t"))
        w = Words(buf, offsets, ALNUM)
        size = np.diff(w.bounds)
        self.vocabulary = distinct(w.hash)
        self.word = np.searchsorted(self.vocabulary, w.hash).astype(np.int32)
        self.ids, number = np.unique(column(rows, "i").to_numpy(), return_inverse=True)
        self.item = number[w.doc].astype(np.int32)
        self.stop = w.bounds[1:][w.doc].astype(np.int32)
        self.longest = int(size.max(initial=0))
        #: words of the window that begins at each word, or 0
        self.size = np.where(np.arange(len(w.hash)) + window <= self.stop, window, 0).astype(np.int32)
        few = np.flatnonzero((size > 0) & (size < window))
        self.size[w.bounds[few]] = size[few]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ranges, and the number of the range of each."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(n.sum()) + np.repeat(lo - ends + n, n), np.repeat(np.arange(len(n)), n)


class Shard:
    """A suffix array over the words of some documents, and what a benchmark has in it."""

    def __init__(self, w: Words, depth: int):
        self.hashes, number = np.unique(w.hash, return_inverse=True)
        docs = len(w.bounds) - 1
        self.seq = np.zeros(len(number) + docs + 1, np.int64)  # 0 ends a document
        self.seq[np.arange(len(number)) + w.doc] = number + 1
        self.bounds = w.bounds + np.arange(docs + 1)
        self.doc = np.repeat(np.arange(docs), np.diff(self.bounds))
        self.order = suffix_array(self.seq[:-1], depth)
        count = np.bincount(self.seq[:-1], minlength=len(self.hashes) + 2)
        self.begin = np.cumsum(count) - count

    def _narrowed(self, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        """The first place of each range, ordered behind `depth` words, whose next word is `want` or more."""
        a, b = lo.copy(), hi.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self.seq[np.minimum(self.order[mid] + depth, len(self.seq) - 1)] < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        return a

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word, the length of the longest match from there; how many windows cover it; and pairs (document, item) as
        sorted numbers document * items + item."""
        n, items = len(self.seq), max(len(bench.ids), 1)
        longest, cover, pairs = np.zeros(n, np.int32), np.zeros(n + 1, np.int64), []
        at = np.searchsorted(self.hashes, bench.vocabulary)
        at[at == len(self.hashes)] = 0
        known = np.where(self.hashes[at] == bench.vocabulary, at + 1, 0) if len(self.hashes) else at * 0
        word = known[bench.word]
        q = np.flatnonzero(word)
        lo, hi = self.begin[word[q]], self.begin[word[q] + 1]
        depth = 1
        while len(q):
            some, first = np.unique(lo, return_index=True)
            here, number = _spread(some, hi[first])
            here = self.order[here]
            longest[here] = depth  # ranges are nested, so depths only grow
            whole = np.flatnonzero(bench.size[q] == depth)
            if len(whole):
                of = np.searchsorted(some, lo[whole])
                mine = np.zeros(len(some), bool)
                mine[of] = True
                hit = mine[number]
                start = here[hit]
                cover += np.bincount(start, minlength=n + 1) - np.bincount(start + depth, minlength=n + 1)
                pairs.append(_paired(distinct(self.doc[start] * len(some) + number[hit]), distinct(of * items + bench.item[q[whole]]), len(some), items))
            on = q + depth < bench.stop[q]
            q, lo, hi = q[on], lo[on], hi[on]
            want = word[q + depth]
            on = want > 0
            q, lo, hi, want = q[on], lo[on], hi[on], want[on]
            lo = self._narrowed(lo, hi, depth, want)
            hi = self._narrowed(lo, hi, depth, want + 1)
            on = lo < hi
            q, lo, hi = q[on], lo[on], hi[on]
            depth += 1
        return longest, np.cumsum(cover[:-1]), distinct(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def _paired(doc_window: np.ndarray, window_item: np.ndarray, windows: int, items: int) -> np.ndarray:
    """Pairs document * items + item, from sorted pairs document * windows + window and window * items + item; windows of the same items count as one."""
    window, item = window_item // items, window_item % items
    seen, first, n = np.unique(window, return_index=True, return_counts=True)
    mark = np.add.reduceat(mix(item.astype(_U) + _U(1)), first)
    _, one, kind = np.unique(mark, return_index=True, return_inverse=True)
    pair = distinct(doc_window // windows * len(one) + kind[np.searchsorted(seen, doc_window % windows)])
    doc, kind = pair // len(one), pair % len(one)
    where, of = _spread(first[one[kind]], (first + n)[one[kind]])
    return distinct(doc[of] * items + item[where])


_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))),
        T.StructField("hit_items", T.ArrayType(T.LongType())),
        T.StructField("longest_match", T.LongType()),
    ]
)


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _entries(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists, and the number of the list of each."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def _scan(batches: Iterator[pa.RecordBatch], text: str, out: str, bench: Benchmark, window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with the struct `out`; one that is there already, of blocks before, is added to."""
    for rows, buf, offsets in gathered(batches, text, SHARD_BYTES):
        w = Words(buf, offsets, ALNUM)
        shard = Shard(w, max(window, bench.longest))
        n, bounds = len(offsets) - 1, shard.bounds
        longest, cover, pair = shard.search(bench)
        full = np.flatnonzero(np.diff(bounds))
        best = np.zeros(n, np.int64)
        best[full] = np.maximum.reduceat(longest, bounds[full])
        doc, item = pair // max(len(bench.ids), 1), bench.ids[pair % max(len(bench.ids), 1)]
        if out in rows.column_names:
            old = column(rows, out)
            rows = rows.drop_columns([out])
            best = np.maximum(best, old.field("longest_match").to_numpy())
            spans, of = _entries(old.field("hit_spans"))
            cover[_spread(spans.field("first").to_numpy() + bounds[of], spans.field("stop").to_numpy() + bounds[of])[0]] += 1
            old_items, of_items = _entries(old.field("hit_items"))
            both = np.unique(np.stack([np.concatenate([doc, of_items]), np.concatenate([item, old_items.to_numpy()])]), axis=1)
            doc, item = both[0], both[1]
        hit = np.concatenate([[False], cover > 0, [False]])
        first, stop = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
        of = shard.doc[first] if len(first) else first
        spans = _lists(np.searchsorted(of, np.arange(n + 1)), pa.StructArray.from_arrays([pa.array(x - bounds[of], pa.int64()) for x in (first, stop)], ["first", "stop"]))
        items = _lists(np.searchsorted(doc, np.arange(n + 1)), pa.array(item, pa.int64()))
        new = pa.StructArray.from_arrays([pa.array(np.diff(w.bounds), pa.int64()), spans, items, pa.array(best)], [f.name for f in _HITS])
        yield from rows.append_column(out, new).cast(schema).to_batches()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, out: str = "hits") -> DataFrame:
    """`docs` with a struct column `out`: n_words; hit_spans, the merged word ranges that windows cover; hit_items, ids of the
    items with a window in the text, ascending; longest_match, the words of the longest verbatim match with an item.

    `item_id` must be integral. An existing column named `out` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    df = docs.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, _HITS)])
    arrow = to_arrow_schema(schema)
    before = None
    for k in range(blocks):
        part = Benchmark(bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).toArrow(), window)  # a block's bytes
        shared = spark.sparkContext.broadcast(part)
        df = df.mapInArrow(lambda it, s=shared: _scan(it, text, out, s.value, window, arrow), schema)
        if k < blocks - 1:
            before = df = written(df, "scanned", [before] if before is not None else [])
            shared.destroy()
    return df


def judged(hits: str = "hits", share: int = SHARE) -> tuple:
    """Columns n_hit and contaminated from a scan's struct."""
    n_hit = F.aggregate(F.col(f"{hits}.hit_spans"), F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["first"])
    return n_hit, (n_hit > 0) & (F.lit(share).cast("long") * n_hit >= F.col(f"{hits}.n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without contaminated rows; columns as before."""
    found = scan(docs, benchmark, out="__decontam", **options)
    return found.where(~judged("__decontam")[1]).select(*[f"`{c}`" for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words inside benchmark windows, the items that occur, and whether it is contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit, bad = judged()
    names = F.array_join(F.array_sort(F.transform("hits.hit_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.hit_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        bad.alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
with b as (select item_id, {_WORDS} as w from benchmark where item_id is not null), d as (select row_number() over () as r, doc_id, coalesce({_WORDS}, []) as w from documents),
v as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g from b, unnest(range(1, len(w) - least(len(w), 13) + 2)) as u(i) where len(w) > 0),
p as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as g from d, (select distinct n from v) as s, unnest(range(1, len(w) - n + 2)) as u(i)),
h as (select r, i, p.n, item_id from p join v on p.n = v.n and p.g = v.g),
x as (select r, count(distinct i + j) as n_hit from h, unnest(range(0, n)) as k(j) group by r),
y as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct r, item_id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join x using (r) left join y using (r)"""
