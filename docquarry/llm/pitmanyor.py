"""LM scoring by a hierarchical Pitman-Yor model of word bigrams, and by a smoothed unigram base.

Texts are words and an end, which is the empty word; the word before the first one is empty too.
Each word is a context with a restaurant of its own, which seats one customer for each training
token after it. A table opened there sends a customer to the word restaurant, the parent of them
all. Its base distribution spells words byte by byte: restaurants of the two bytes before (a space
before the word and as its end), which share parents: those of one byte, and they the root over
all 256 bytes. A table of the word restaurant sends its word's bytes as customers to the byte
restaurants, a table there sends one to the parent.

Seating is sampled by Gibbs sweeps from one table for each dish on: given the parent's probabilities
and the number of tables of the sweep before, the customers of each pair of words, then those of each
word, then those of the byte restaurants level by level are seated anew by the Chinese-restaurant
rule. Customers of a dish sit down one by one up to ONE_BY_ONE, and beyond in blocks of a ONE_BY_ONEth
of those seated, whose chance of a new table is that at the block's beginning. After BURN_IN sweeps,
the probabilities under SAMPLES states are averaged.

What grows with the corpus stays distributed, and packed: a row of a table holds arrays, so that the
shuffles move some large values instead of a row for each pair. Words are told apart by 64-bit hashes.

- Documents meet in blocks of about BLOCK_BYTES. A block asks for each of its distinct words and pairs
  once, so hot ones never meet in numbers that grow faster than the blocks.
- Pairs are dealt by a hash of both words into parts of about PAIR_BYTES of text, and words into parts
  of about WORD_BYTES, so a word that is in a third of all pairs is one entry of each part.
- In a sweep, the parts of words send what is known of their words to the parts of pairs that hold
  them, which seat their customers and send back the tables that they opened. Pairs that occur once
  have one table always and take no part.
- Random numbers are hashes of the words and the sweep: a lost task repeats its draws, and scoring
  repeats them instead of keeping tables of each pair.

Only byte restaurants meet in one place: at most 65,793 of 256 bytes, whatever the corpus.

Defined cases: null texts are empty (one end token); rows with a null id are training rows and
score like others; repeated rows count as often as they occur; an empty table scores nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import dropped, table, written
from ._text import NOT_SPACE, Words, buffers, column, distinct, gathered, grouped, mix

DISCOUNT, STRENGTH = 0.75, 1.0
#: Of byte restaurants.
BYTE_DISCOUNT, BYTE_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 1, 2
ONE_BY_ONE = 64
#: Bytes of text to a block of documents, and (of the whole corpus) to a part of the words and of the pairs.
BLOCK_BYTES, WORD_BYTES, PAIR_BYTES = 6 << 20, 32 << 20, 16 << 20
#: The base score's added count.
ADDED = 0.1

_U = np.uint64
_SPACE = 0x20


@dataclass
class Spelling:
    """Log probabilities of bytes: `rows` has the row of `log` for each context of two bytes. Then what the next sweep goes by:
    tables of each restaurant of two bytes, one and none, and probabilities under one byte and none."""

    rows: np.ndarray
    log: np.ndarray
    tables: tuple[np.ndarray, np.ndarray, float]
    parents: tuple[np.ndarray, np.ndarray]

    def words(self, texts: pa.Array) -> np.ndarray:
        context, byte, start = spelled(texts)
        return np.add.reduceat(self.log[self.rows[context].astype(np.int64) * 256 + byte], start) if len(start) else np.zeros(0)


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and bytes of words with their ends, laid end to end, and where each word begins."""
    raw, offsets = buffers(texts)
    n = len(offsets) - 1
    start = offsets[:-1] + np.arange(n)
    byte = np.full(len(raw) + n, _SPACE, np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))
    byte[at] = raw
    one = np.full(len(byte), _SPACE, np.int64)
    one[1:] = byte[:-1]
    two = np.full(len(byte), _SPACE, np.int64)
    two[2:] = byte[:-2]
    one[start] = _SPACE
    two[start] = _SPACE
    return two << 8 | one, byte.astype(np.int64), start


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    return (mix(seed + _U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(11)).astype(float) / (1 << 53)


def seated(count: np.ndarray, base: np.ndarray, seed: np.ndarray, discount: float, mass: np.ndarray | float) -> np.ndarray:
    """Tables of dishes with `count` customers each; mass: strength + discount * tables of the restaurant; base: the parent's probability."""
    tables = (count > 0).astype(float)
    some = np.flatnonzero(count > 1)
    some = some[np.argsort(-count[some])]  # those with most customers first: who still waits is always a first part
    c, t, new, seed = count[some], np.ones(len(some)), np.broadcast_to(mass * base, count.shape)[some], seed[some]
    less = -c
    done, step = 1, 0
    while n := int(np.searchsorted(less, -done)):
        block = max(1, done // ONE_BY_ONE)
        p = new[:n] / (np.maximum(done - discount * t[:n], 1e-12) + new[:n])
        step += 1
        u = _uniform(seed[:n], step)
        if block == 1:
            t[:n] += u < p
        else:
            size = np.minimum(block, c[:n] - done)
            t[:n] += np.minimum(np.floor(size * p + u), size)
        done += block
    tables[some] = t
    return tables


def spelling(counts: np.ndarray, at: np.ndarray, sweep: int, last: Spelling | None) -> Spelling:
    """A sampled state of the byte restaurants: counts of customers at numbers context * 256 + byte; each level sits down under the parents of the state before."""
    context, byte = at >> 8, at & 255
    seen, row = np.unique(context, return_inverse=True)

    def seats(count: np.ndarray, base: np.ndarray, own: np.ndarray, level: int, tables: np.ndarray) -> np.ndarray:
        if last is None:
            return (count > 0).astype(float)
        seed = mix(own.astype(_U) + _U((3 * sweep + level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        return seated(count, base, seed, BYTE_DISCOUNT, BYTE_STRENGTH + BYTE_DISCOUNT * tables)

    old2, old1, old0 = last.tables if last else (np.zeros(65536), np.zeros(256), 0.0)
    q1, q0 = last.parents if last else (np.full((256, 256), 1 / 256), np.full(256, 1 / 256))
    t2 = seats(counts, q1[context & 255, byte], at, 0, old2[context])
    c1 = np.bincount((context & 255) * 256 + byte, t2, 65536).astype(np.int64)
    some = np.flatnonzero(c1)
    t1 = np.zeros(65536)
    t1[some] = seats(c1[some], q0[some & 255], some, 1, old1[some >> 8])
    c0 = t1.reshape(256, 256).sum(0).astype(np.int64)
    t0 = seats(c0, np.full(256, 1 / 256), np.arange(256), 2, np.full(256, old0))
    p0 = _predict(c0[None], t0[None], np.full((1, 256), 1 / 256))[0]
    p1 = _predict(c1.reshape(256, 256), t1.reshape(256, 256), np.broadcast_to(p0, (256, 256)))
    tables = np.bincount(context, t2, 65536), t1.reshape(256, 256).sum(1), float(t0.sum())
    log = np.empty((len(seen) + 256, 256), np.float32)
    for lo in range(0, len(seen), 4096):
        part = slice(lo, lo + 4096)
        mine = (row >= lo) & (row < lo + 4096)
        m = len(seen[part])
        where = (row[mine] - lo) * 256 + byte[mine]
        c = np.bincount(where, counts[mine], m * 256).reshape(m, 256)
        t = np.bincount(where, t2[mine], m * 256).reshape(m, 256)
        log[lo : lo + m] = np.log(_predict(c, t, p1[seen[part] & 255]))
    log[len(seen) :] = np.log(p1)
    rows = (len(seen) + (np.arange(65536) & 255)).astype(np.int32)
    rows[seen] = np.arange(len(seen))
    return Spelling(rows, log.reshape(-1), tables, (p1, p0))


def _predict(c: np.ndarray, t: np.ndarray, parent: np.ndarray) -> np.ndarray:
    n, tables = c.sum(1, keepdims=True), t.sum(1, keepdims=True)
    return (np.maximum(c - BYTE_DISCOUNT * t, 0) + (BYTE_STRENGTH + BYTE_DISCOUNT * tables) * parent) / (n + BYTE_STRENGTH)


@dataclass
class State:
    """Of the word restaurant and below: the spelling it was seated by, its number of tables before, its sweep, its own customers, tables and spelling."""

    before: Spelling
    tables_before: float
    sweep: int
    customers: int
    tables: float
    after: Spelling

    def log(self, words: pa.Array, count: np.ndarray, seed: np.ndarray, spell=None) -> np.ndarray:
        """Log probabilities of words with `count` customers."""
        spell = spell or (lambda s: s.words(words).astype(float))
        all_ = math.log(STRENGTH + self.customers)
        new = math.log(STRENGTH + DISCOUNT * self.tables) - all_ + spell(self.after)
        seen = np.flatnonzero(count)
        own = np.full(len(count), -np.inf)
        if len(seen):
            t = self.seated(count[seen], spell(self.before)[seen], seed[seen])
            own[seen] = np.log(np.maximum(count[seen] - DISCOUNT * t, 1e-300)) - all_
        return np.logaddexp(own, new)

    def seated(self, count: np.ndarray, spelled_: np.ndarray, seed: np.ndarray) -> np.ndarray:
        if self.sweep == 0:
            return (count > 0).astype(float)
        return seated(count, np.exp(spelled_), seed + _U(self.sweep), DISCOUNT, STRENGTH + DISCOUNT * self.tables_before)


@dataclass
class Model:
    """Totals, and the states in order; the last `kept` are averaged."""

    tokens: int
    distinct: int
    states: list[State]
    kept: int

    def log10(self, words: pa.Array, count: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Averaged log10 probabilities in the word restaurant, of words with `count` customers in every state."""
        total = np.full(len(count), -np.inf)
        cache: dict[int, np.ndarray] = {}
        spell = lambda s: cache.setdefault(id(s), s.words(words).astype(float))
        for state in self.states[-self.kept :]:
            total = np.logaddexp(total, state.log(words, count, seed, spell))
        return (total - math.log(self.kept)) / math.log(10)


def _byte_customers(words: pa.Array, k: np.ndarray, seed: np.ndarray, last: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the byte restaurants that the tables of words with `k` customers send: sorted numbers context * 256 + byte and
    their counts; number -1 counts tables."""
    seats = np.flatnonzero(k)
    words, count = words.take(pa.array(seats)), k[seats]
    t = np.ones(len(count))
    if last:
        spell, before, sweep = last
        t = seated(count, np.exp(spell.words(words).astype(float)), seed[seats] + _U(sweep), DISCOUNT, STRENGTH + DISCOUNT * before)
    context, byte, start = spelled(words)
    each = np.repeat(t, np.diff(np.append(start, len(byte))))
    used = np.flatnonzero(np.bincount(byte, minlength=256) > 0)
    used = np.union1d(used, [_SPACE])
    size = len(used)
    if size**3 <= 1 << 23:  # few bytes occur: a dense count over all three of them
        code = np.zeros(256, np.int64)
        code[used] = np.arange(size)
        n = np.bincount((code[context >> 8] * size + code[context & 255]) * size + code[byte], each, size**3)
        at = np.flatnonzero(n)
        n = n[at]
        at = used[at // size**2] << 16 | used[at // size % size] << 8 | used[at % size]
    else:
        at, _, back = grouped(context << 8 | byte)
        n = np.bincount(back, each, len(at))
    return np.append(at, -1), np.append(n.astype(np.int64), int(t.sum()))


def _stream(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word before and of the word, and the text, for each token of n texts with their ends."""
    word = np.zeros(len(w.hash) + n, _U)
    word[np.arange(len(w.hash)) + w.doc] = w.hash
    before = np.zeros(len(word), _U)
    before[1:] = word[:-1]
    return before, word, np.repeat(np.arange(n), np.diff(w.bounds) + 1)


def _pair_seed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before + _U(0xD1B54A32D192ED03)) + word)


_ROW = "kind int, bucket long, other long, a binary, b binary, c binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("other", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
# Kinds of packed rows.
WORDS, ONES, ASKED, PAIRS, HASHES, ROUTE, BASE, SUMS, STATE, BYTES, SENT, KNOWN, TOLD = range(13)


def packed(x: np.ndarray) -> bytes:
    """An array byte by byte of all its numbers: what they have in common compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unpacked(x: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel() if x else np.zeros(0, kind)


def _with(run, *more):
    """A function of one table (Spark counts arguments)."""
    return lambda t: run(t, *more)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows else _ARROW.empty_table()


def _of(t: pa.Table, kind: int) -> list[dict]:
    """Rows of a kind, in the order of `other`."""
    return sorted(t.filter(pa.array(column(t, "kind").to_numpy() == kind)).to_pylist(), key=lambda r: r["other"])


def _all(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpacked(r[name], kind) for r in rows)])


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that sorted keys fall into, by their highest bits."""
    if not len(keys):
        return []
    part = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True))


def _text(words: pa.Array) -> bytes:
    """Words as one string, a blank after each: words have none."""
    raw, offsets = buffers(words)
    out = np.full(len(raw) + len(words), _SPACE, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = raw
    return out.tobytes()


def _words(text: bytes) -> pa.Array:
    raw = np.frombuffer(text, np.uint8) if text else np.zeros(0, np.uint8)
    ends = np.flatnonzero(raw == _SPACE)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != _SPACE])])


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Words of training rows with their counts, packed by part; the empty word ends each text."""
    for rows, buf, offsets in gathered(batches, "text", BLOCK_BYTES, 1 << 20):
        w = Words(buf, offsets, NOT_SPACE)
        h, first, back = grouped(w.hash)
        n = np.bincount(back, minlength=len(h))
        h, n = np.concatenate([np.zeros(1, _U), h]), np.concatenate([[rows.num_rows], n]).astype(np.int64)
        words = pa.concat_arrays([pa.array([""], pa.string()), w.strings(first)])
        yield from _rows([(WORDS, j, 0, packed(h[x:y]), packed(n[x:y]), _text(words.slice(x, y - x))) for j, x, y in _cuts(h, bits)]).to_batches()


def _merged(t: pa.Table) -> pa.Table:
    """The words of a part, sorted by hash, with their counts; `other` is the sum of these."""
    rows = _of(t, WORDS)
    h, first, back = grouped(_all(rows, "a", _U))
    n = np.bincount(back, _all(rows, "b", np.int64), len(h)).astype(np.int64)
    words = pa.concat_arrays([_words(r["c"]) for r in rows]).take(pa.array(first))
    return _rows([(WORDS, rows[0]["bucket"], int(n.sum()), packed(h), packed(n), _text(words))])


def _pairs(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a block as sorted keys; first and second word; how often they occur in its training rows."""
    buf, offsets = buffers(column(rows, "text"))
    before, word, doc = _stream(Words(buf, offsets, NOT_SPACE), len(offsets) - 1)
    train = ~column(rows, "held_out").to_numpy(zero_copy_only=False).astype(bool)
    key, one, back = grouped(_pair_seed(before, word))
    return key, before[one], word[one], np.bincount(back, train[doc], len(one)).astype(np.int64)


def _ask(rows: pa.Table, bits: int) -> pa.Table:
    """A block's pairs with their counts, by part."""
    key, _, _, n = _pairs(rows)
    block = column(rows, "block")[0].as_py()
    return _rows([(ASKED, r, block, packed(key[x:y]), packed(n[x:y]), None) for r, x, y in _cuts(key, bits)])


def _tell(t: pa.Table) -> pa.Table:
    """For the pairs that each block asked for: twice their count in all training rows, and 1 more for one of the blocks that have them."""
    rows = _of(t, ASKED)
    keys = [unpacked(r["a"], _U) for r in rows]
    _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    said = np.bincount(back, _all(rows, "b", np.int64), len(first)).astype(np.int64)[back] << 1
    said[first] |= 1
    ends = np.cumsum([0, *map(len, keys)]).tolist()
    return _rows([(TOLD, r["bucket"], r["other"], packed(said[x:y]), None, None) for r, x, y in zip(rows, ends[:-1], ends[1:], strict=True)])


def _facts(docs: pa.Table, told: pa.Table, word_bits: int, pair_bits: int) -> pa.Table:
    """Of a block: the pairs it speaks for that occur more than once, by part; and how many of those that occur once each word ends and begins."""
    key, u, w, _ = _pairs(docs)
    said = _all(sorted(told.to_pylist(), key=lambda r: r["bucket"]), "a", np.int64)
    block, c, own = column(docs, "block")[0].as_py(), said >> 1, (said & 1).astype(bool)
    many = np.flatnonzero(own & (c > 1))
    out = [(PAIRS, r, block, packed(u[many[x:y]]), packed(w[many[x:y]]), packed(c[many[x:y]])) for r, x, y in _cuts(key[many], pair_bits)]
    once = own & (c == 1)
    h, _, back = grouped(np.concatenate([w[once], u[once]]))
    n = int(once.sum())
    k, tt = np.bincount(back[:n], minlength=len(h)).astype(np.int32), np.bincount(back[n:], minlength=len(h)).astype(np.int32)
    return _rows(out + [(ONES, j, block, packed(h[x:y]), packed(k[x:y]), packed(tt[x:y])) for j, x, y in _cuts(h, word_bits)])


def _block_words(rows: pa.Table) -> np.ndarray:
    """Sorted hashes of a block's words and of the empty one."""
    buf, offsets = buffers(column(rows, "text"))
    return distinct(np.concatenate([np.zeros(1, _U), Words(buf, offsets, NOT_SPACE).hash]))


def _ask_words(rows: pa.Table, bits: int) -> pa.Table:
    h, block = _block_words(rows), column(rows, "block")[0].as_py()
    return _rows([(ASKED, j, block, packed(h[x:y]), None, None) for j, x, y in _cuts(h, bits)])


def _dealt_pairs(t: pa.Table, word_bits: int) -> pa.Table:
    """A part of the pairs: numbers of both words in its sorted hashes, and counts; its hashes; and these by the part of words that has them."""
    rows = _of(t, PAIRS)
    u, w, c = (_all(rows, x, kind) for x, kind in (("a", _U), ("b", _U), ("c", np.int64)))
    h, _, back = grouped(np.concatenate([u, w]))
    r, back = rows[0]["bucket"], back.astype(np.int32)
    out = [(PAIRS, r, 0, packed(back[: len(u)]), packed(back[len(u) :]), packed(c)), (HASHES, r, 0, packed(h), None, None)]
    return _rows(out + [(ROUTE, j, r, packed(h[x:y]), None, None) for j, x, y in _cuts(h, word_bits)])


def _based(t: pa.Table) -> pa.Table:
    """Of a part of the words: customers and tables that pairs of one occurrence give, and places of the words that parts of pairs hold."""
    own = _of(t, WORDS)[0]
    h = unpacked(own["a"], _U)
    k, tt = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for r in _of(t, ONES):
        at = np.searchsorted(h, unpacked(r["a"], _U))
        k[at] += unpacked(r["b"], np.int32)
        tt[at] += unpacked(r["c"], np.int32)
    routes = [(ROUTE, own["bucket"], r["other"], packed(np.searchsorted(h, unpacked(r["a"], _U)).astype(np.int32)), None, None) for r in _of(t, ROUTE)]
    return _rows([(BASE, own["bucket"], 0, packed(k), packed(tt), None), *routes])


def _sent(t: pa.Table, state: State) -> pa.Table:
    """To each part of pairs, of the words that it holds: log probability in the word restaurant, and tables of their own restaurants."""
    own, now = _of(t, WORDS)[0], _of(t, STATE)[0]
    p = _short(state.log(_words(own["c"]), unpacked(now["a"], np.int64), unpacked(own["a"], _U)))
    tt = unpacked(now["b"], np.int64).astype(np.float32)
    out = []
    for r in _of(t, ROUTE):
        at = unpacked(r["a"], np.int32)
        out.append((SENT, r["other"], own["bucket"], packed(p[at]), packed(tt[at]), None))
    return _rows(out)


def _seated(t: pa.Table, sweep: int, word_bits: int) -> pa.Table:
    """Seats the pairs of a part, and sends back the tables opened, by the words that end and begin them."""
    own, h = _of(t, PAIRS)[0], unpacked(_of(t, HASHES)[0]["a"], _U)
    u, w, c = unpacked(own["a"], np.int32), unpacked(own["b"], np.int32), unpacked(own["c"], np.int64)
    tables = np.ones(len(c))
    if sweep:
        sent = _of(t, SENT)
        p, tt = _all(sent, "a", np.float32), _all(sent, "b", np.float32)
        tables = pair_tables(h[u], h[w], c, p[w], tt[u], sweep)
    k, tt = (np.bincount(x, tables, len(h)).astype(np.int64) for x in (w, u))
    return _rows([(SUMS, j, own["bucket"], packed(k[x:y]), packed(tt[x:y]), None) for j, x, y in _cuts(h, word_bits)])


def _stated(t: pa.Table, sweep: int, last: tuple | None) -> pa.Table:
    """Of a part of the words: customers in the word restaurant and tables of their own ones after a sweep; customers of the byte restaurants."""
    own, base = _of(t, WORDS)[0], _of(t, BASE)[0]
    k, tt = unpacked(base["a"], np.int64), unpacked(base["b"], np.int64)
    places = {r["other"]: unpacked(r["a"], np.int32) for r in _of(t, ROUTE)}
    for r in _of(t, SUMS):
        at = places[r["other"]]
        k[at] += unpacked(r["a"], np.int64)
        tt[at] += unpacked(r["b"], np.int64)
    at, n = _byte_customers(_words(own["c"]), k, unpacked(own["a"], _U), last)
    return _rows([(STATE, own["bucket"], sweep, packed(k), packed(tt), None), (BYTES, own["bucket"], int(k.sum()), packed(at), packed(n), None)])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(a, np.int64)), pa.array(unpacked(b, np.int64))], ["at", "n"])


def _short(x: np.ndarray) -> np.ndarray:
    """Numbers with 16 bits behind the first one, which compress; senders and scorers see the same."""
    bits = x.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)


def _known(t: pa.Table, model: Model) -> pa.Table:
    """For the words that each block asked for, in their order: c, and log probabilities and tables in the last kept + 1 states; zeros where they aren't known."""
    s = model.kept + 1
    if own := _of(t, WORDS):
        h, c, words, states = unpacked(own[0]["a"], _U), unpacked(own[0]["b"], np.int64), _words(own[0]["c"]), _of(t, STATE)
        p = [_short(state.log(words, unpacked(r["a"], np.int64), h)) for r, state in zip(states, model.states[-s:], strict=True)]
        both = np.stack(p + [unpacked(r["b"], np.int64) for r in states], 1).astype(np.float32)
    out = []
    for r in _of(t, ASKED):
        asked = unpacked(r["a"], _U)
        count, state = np.zeros(len(asked), np.int64), np.zeros((len(asked), 2 * s), np.float32)
        if own:
            at, hit = _found(h, asked)
            count[hit], state[hit] = c[at[hit]], both[at[hit]]
        out.append((KNOWN, r["other"], r["bucket"], packed(count), packed(np.ascontiguousarray(state.T).ravel()), None))
    return _rows(out)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted `keys` have each of `wanted`, and whether they do."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def pair_tables(u: np.ndarray, w: np.ndarray, c: np.ndarray, p: np.ndarray, tt: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of pairs in a sweep; p: log probability of the word in the word restaurant before, tt: tables of the context before."""
    return seated(c, np.exp(p.astype(float)), _pair_seed(u, w) + _U(sweep), DISCOUNT, STRENGTH + DISCOUNT * tt.astype(float))


@dataclass
class Fitted:
    """The model, and packed tables: words, their states after the last sweeps, and what blocks were told of their pairs."""

    model: Model
    words: DataFrame
    states: DataFrame
    told: DataFrame


def fit(dealt: DataFrame, word_bits: int, pair_bits: int, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Fitted:
    """Of documents dealt into blocks (block, held_out, text)."""
    spark = dealt.sparkSession
    kind = lambda df, *k: df.where(F.col("kind").isin(*k))
    by = lambda df, run: df.groupBy("bucket").applyInArrow(run, _ROW)
    train = dealt.where("not held_out").select("text")
    words = written(by(train.mapInArrow(lambda it: _counted(it, word_bits), _ROW), _merged), "words")
    total = words.agg(F.sum("other").alias("n"), F.sum(F.octet_length("a") / 8).cast("long").alias("v")).first()
    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask(t, pair_bits), _ROW)
    told = written(by(asked, _tell), "told")
    facts = dealt.groupBy("block").cogroup(told.groupBy("other")).applyInArrow(lambda d, t: _facts(d, t, word_bits, pair_bits), _ROW)
    facts = written(facts, "facts")
    pairs = written(by(kind(facts, PAIRS), lambda t: _dealt_pairs(t, word_bits)), "pairs")
    base = written(by(words.union(kind(facts, ONES)).union(kind(pairs, ROUTE)), _based), "base", [facts])
    states: list[State] = []
    kept: list[DataFrame] = []
    seats = kind(pairs, PAIRS, HASHES)
    for sweep in range(burn_in + samples + 1):
        rows, last = seats, None
        if sweep:
            shared = spark.sparkContext.broadcast(states[-1])
            last = spark.sparkContext.broadcast((states[-1].after, states[-1].tables, sweep))
            rows = rows.union(by(words.union(kind(base, ROUTE)).union(kind(kept[-1], STATE)), _with(lambda t, s: _sent(t, s.value), shared)))
        sums = by(rows, _with(_seated, sweep, word_bits))
        after = by(words.union(base).union(sums), _with(lambda t, n, s: _stated(t, n, s.value if s else None), sweep, last))
        kept.append(written(after, "states"))
        found = kind(kept[-1], BYTES)
        customers = found.agg(F.sum("other")).first()[0] or 0
        counts = found.mapInArrow(_bytes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").toArrow()  # 2 ** 24 + 1 at most
        at, n = column(counts, "at").to_numpy(), column(counts, "n").to_numpy()
        before = states[-1] if states else None
        spell = spelling(n[at >= 0], at[at >= 0], sweep, before.after if before else None)
        states.append(State(before.after if before else spell, before.tables if before else 0.0, sweep, customers, float(n[at < 0].sum()), spell))
        if len(kept) > samples + 1:
            dropped(kept.pop(0))
    dropped(pairs)
    dropped(base)
    after = kept[0]
    for more in kept[1:]:
        after = after.union(more)
    return Fitted(Model(total.n or 0, total.v or 0, states, samples), words, kind(after, STATE), told)


def _scored(docs: pa.Table, known: pa.Table, model: Model, schema: pa.Schema) -> pa.Table:
    """Scores of a block's documents, from what it was told of its words and pairs, both in the order of their hashes."""
    s = model.kept + 1
    own = _of(known, KNOWN)  # parts are ranges of hashes, so what is known follows the order of the block's words
    c = _all(own, "a", np.int64)
    both = np.concatenate([np.zeros((2 * s, 0), np.float32), *(unpacked(r["b"], np.float32).reshape(2 * s, -1) for r in own)], 1)
    p, tt = both[:s].astype(float), both[s:]
    pair_c = _all(_of(known, TOLD), "a", np.int64) >> 1

    buf, offsets = buffers(column(docs, "text"))
    w, n = Words(buf, offsets, NOT_SPACE), len(offsets) - 1
    before, word, doc = _stream(w, n)
    _, at, of_word = grouped(word)  # every text has an end, so the empty word is the first one, and the last before each text
    if len(miss := np.flatnonzero(c == 0)):
        some = miss[word[at[miss]] != 0]
        texts, none = w.strings(at[some] - doc[at[some]]), np.zeros(len(some), np.int64)
        for j, state in enumerate(model.states[-s:]):
            p[j, some] = state.log(texts, none, none.astype(_U))
            if len(some) < len(miss):  # no training row, so not even an end
                p[j, miss[0]] = state.log(pa.array([""]), np.zeros(1, np.int64), np.zeros(1, _U))[0]
    base = np.log10((c + ADDED) / (model.tokens + ADDED * (model.distinct + 1)))
    _, one, pair = grouped(_pair_seed(before, word))
    v = of_word[one]
    u = np.where(one > 0, of_word[one - 1], 0)
    u_word, v_word, served = before[one], word[one], c[u] + STRENGTH
    many, some = np.flatnonzero(pair_c > 1), np.flatnonzero(pair_c)
    total = np.full(len(one), -np.inf)
    for j, state in enumerate(model.states[-model.kept :], 1):
        tables = np.ones(len(one))
        tables[many] = pair_tables(u_word[many], v_word[many], pair_c[many], p[j - 1, v[many]], tt[j - 1, u[many]], state.sweep)
        lp = np.log(STRENGTH + DISCOUNT * tt[j, u]) + p[j, v]
        lp[some] = np.logaddexp(np.log(pair_c[some] - DISCOUNT * tables[some]), lp[some])
        total = np.logaddexp(total, lp - np.log(served))
    total = (total - math.log(model.kept)) / math.log(10)
    of_token = lambda x: np.bincount(doc, x, n)
    new = [
        pa.array(np.diff(w.bounds) + 1, pa.int64()), pa.array(of_token((c > 0)[of_word]).astype(np.int64)), pa.array(np.full(n, model.tokens), pa.int64()), pa.array(of_token(base[of_word])), pa.array(of_token(total[pair])),
    ]
    return pa.Table.from_arrays([*(docs.column(f.name) for f in schema if f.name in docs.column_names), *new], schema=schema)


def _parts(total: int, size: int) -> int:
    """Bits that tell the parts of some bytes apart."""
    return max(0, math.ceil(total / size) - 1).bit_length()


def score(docs: DataFrame, train, ids: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; `train` is a boolean column of the training rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = docs.select(F.col(ids).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), train.alias("train"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(total / block_bytes))))
    dealt = rows.select(block.alias("block"), "doc_id", (~F.col("train")).alias("held_out"), "text")
    word_bits = _parts(total, word_bytes)
    found = fit(dealt, word_bits, _parts(total, pair_bytes))
    shared = rows.sparkSession.sparkContext.broadcast(found.model)
    asked = dealt.groupBy("block").applyInArrow(lambda t: _ask_words(t, word_bits), _ROW)
    known = found.words.union(found.states).union(asked).groupBy("bucket").applyInArrow(lambda t: _known(t, shared.value), _ROW)
    told = found.told.select("kind", F.col("other").alias("bucket"), F.col("bucket").alias("other"), "a", "b", "c")
    result = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double".format(dict(dealt.dtypes)["doc_id"])
    schema = to_arrow_schema(_parse_datatype_string(result))
    return dealt.groupBy("block").cogroup(known.union(told).groupBy("bucket")).applyInArrow(lambda d, k: _scored(d, k, shared.value, schema), result)


def _split(docs: DataFrame):
    """Training rows."""
    return ~F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by models of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, _split(docs)).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def base_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5 SQL can say: counts, and the base score to four places."""
    return op5_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_CRC_SQL = """xor(list_reduce(list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint),
 lambda c, b: list_reduce(range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""
BASE_UNIGRAMS_SQL = r"""
with d as (select doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') as w, HELD as held_out from documents),
t as (select doc_id, held_out, unnest(w) as x from d), c as (select x, count(*) as c from t where not held_out group by x), n as (select sum(c)::bigint as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))), 4) as base_score from t left join c using (x), n group by doc_id, held_out""".replace("HELD", f"{_CRC_SQL} % 10 = 0")
