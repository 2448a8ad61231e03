"""SentencePiece encoding and decoding with N-best segmentation.

A text is normalised as its model says (user-defined symbols aside: identity or NFKC, dummy prefix,
extra white space, blanks as U+2581) and laid out as a lattice of pieces. A forward Viterbi pass
gives the best score of every position from the start. Those scores are the exact rest costs of a
backward A* search from the end: hypotheses leave the queue in the order of their whole score, so
the first N that reach the start are the N best segmentations.

No piece of the model crosses from a word into the blank before the next one, so the lattice is a
chain of word lattices; that is checked when a model is loaded, and a text is one word where it
fails. The same A* search runs over the chain. With forward scores as rest costs, a search that
leaves the best path does so at one of its positions, by the second best edge there: what that
loses is known from the forward pass alone. Only the N - 1 words that lose least can differ from
their best in any of a text's N best, so only their lattices are searched. Words' best
segmentations are kept in a cache that is emptied when it is full, which changes no result.

Scores are the model file's piece scores; characters without a piece become byte pieces (each
scored 10 below the lowest piece), or the unknown piece where the model has none. Segmentations of
equal scores come in the order of the search, which is the same on every run.
The model file is a parameter; PUBLIC_MODEL is where this environment keeps a public one.

Defined cases: null texts encode as empty ones, to no ids, one segmentation of score 0; repeated
rows each get a row; other columns don't matter. Decoding gives back the normalised text.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import table
from ._text import chunks, column

PUBLIC_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
N_BEST = 4
#: Words whose best segmentation a worker keeps.
CACHE = 400_000
#: Characters of text whose words are looked up at once.
STRETCH = 1 << 19
#: Longest words that are segmented side by side.
BULK = 64

_U = np.uint64


class _Store:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1024, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(self.n, len(x)), self.held.dtype)])
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)


class Pieces:
    """A piece vocabulary and its segmentations."""

    def __init__(self, model_file: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        self.names = [p.id_to_piece(k) for k in range(n)]
        self.score = [p.get_score(k) for k in range(n)]
        self.unk = p.unk_id()
        self.bytes = {}
        ordinary = {}
        for k in range(n):
            if p.is_byte(k):
                self.bytes[int(self.names[k][3:-1], 16)] = k
            elif not (p.is_control(k) or p.is_unknown(k) or p.is_unused(k)):
                ordinary[self.names[k]] = k
        self.ids = ordinary
        self.longest = max(map(len, ordinary))
        self.whole_words = not any(re.search(f"[^{BLANK}]{BLANK}", x) for x in ordinary)
        self.unknown = min(self.score[k] for k in ordinary.values()) - 10.0
        probe = [p.encode(x, out_type=str) for x in ("a", "ﬁ", "a  b")]
        self.prefix = probe[0][0].startswith(BLANK)
        self.nfkc = BLANK not in "".join(probe[1])[1:] and "ﬁ" not in p.decode(p.encode("ﬁ"))
        self.squeeze = "  " not in p.decode(p.encode("a  b"))
        self._byte_of = {k: b for b, k in self.bytes.items()}
        self._byte_ids = set(self._byte_of)
        self._flat = None
        self._byte_id = np.array([self.bytes.get(k, -1) for k in range(256)])
        self._points = np.array(self.score)
        self._grow_trie()
        self._cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._edge = re.compile(f"(?<!{BLANK}){BLANK}")
        self._forget()

    def normal(self, text: str) -> str:
        if self.nfkc:
            text = unicodedata.normalize("NFKC", text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", BLANK)

    def chain(self, normal: str) -> list[str]:
        """The parts of a normalised text that no piece crosses."""
        if not self.whole_words:
            return [normal] if normal else []
        return self._cut.findall(normal)

    def lattice(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position, the edges (start, score, ids) that end there."""
        n = len(part)
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        ids, score = self.ids, self.score
        for a in range(n):
            single = False
            for b in range(a + 1, min(n, a + self.longest) + 1):
                k = ids.get(part[a:b])
                if k is not None:
                    edges[b].append((a, score[k], (k,)))
                    single |= b == a + 1
            if not single:
                spelt = self._spelt(part[a])
                edges[a + 1].append((a, self.unknown * len(spelt), spelt))
        return edges

    def best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a part, best first."""
        return n_best(self.lattice(part), n)

    def _forget(self) -> None:
        """Empties the cache: number of each word; score of its best segmentation, what the second best loses, and where its ids are."""
        self._number: dict[str, int] = {}
        self._best, self._loss, self._begin, self._count, self._ids = (_Store(t) for t in (float, float, np.int64, np.int64, np.int32))
        self._several: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def _grow_trie(self) -> None:
        """The pieces as a trie: nodes are found by a hash of the node before and a character, by open addressing."""
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for x, k in self.ids.items():
            at = 0
            for c in x:
                at = nodes.setdefault((at, ord(c)), len(piece))
                if at == len(piece):
                    piece.append(-1)
            piece[at] = k
        self._piece = np.array(piece)
        self._bits = len(nodes).bit_length() + 2
        self._keys, self._node = np.zeros(1 << self._bits, np.int64), np.full(1 << self._bits, -1, np.int64)
        for (before, c), at in nodes.items():
            key = before << 21 | c
            slot = int(self._slot(np.array([key]))[0])
            while self._node[slot] >= 0:
                slot = (slot + 1) & (len(self._keys) - 1)
            self._keys[slot], self._node[slot] = key, at

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(_U) * _U(0x9E3779B97F4A7C15)
        return ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - self._bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes behind `node` by a character, or -1."""
        key = node << 21 | char
        slot = self._slot(key)
        out = np.where(self._keys[slot] == key, self._node[slot], -1)
        live = np.flatnonzero((out < 0) & (self._node[slot] >= 0))
        while len(live):  # another key is in the slot
            slot[live] = (slot[live] + 1) & (len(self._keys) - 1)
            found = self._node[slot[live]]
            hit = (self._keys[slot[live]] == key[live]) & (found >= 0)
            out[live[hit]] = found[hit]
            live = live[(found >= 0) & ~hit]
        return out

    def _edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First character, length, id and score of every edge; `end` is where a character's word ends. Spelt characters have id -2 - code."""
        first, size, ids = [], [], []
        live = np.arange(len(codes))
        node = self._step(np.zeros(len(codes), np.int64), codes)
        alone = np.ones(len(codes), bool)
        for m in range(1, self.longest + 1):
            on = node >= 0
            live, node = live[on], node[on]
            if not len(live):
                break
            k = self._piece[node]
            hit = k >= 0
            first.append(live[hit])
            size.append(np.full(len(first[-1]), m))
            ids.append(k[hit])
            if m == 1:
                alone[live[hit]] = False
            on = live + m < end[live]
            live, node = live[on], node[on]
            node = self._step(node, codes[live + m])
        alone = np.flatnonzero(alone)
        points = [self._points[k] for k in ids]
        first.append(alone)
        size.append(np.ones(len(alone), np.int64))
        ids.append(-2 - codes[alone])
        points.append(self.unknown * (_width(codes[alone]) if self.bytes else np.ones(len(alone))))
        return tuple(np.concatenate(x) for x in (first, size, ids, points))

    def _solve(self, words: list[str]) -> None:
        """Puts words into the cache."""
        short = [x for x in words if len(x) <= BULK]
        if short:
            self._together(short)
        for x in words:
            if len(x) > BULK:
                self._alone(x)

    def _keep(self, words: list[str], best: np.ndarray, loss: np.ndarray, count: np.ndarray, path: np.ndarray) -> None:
        """Words with their ids laid end to end, `count` each, characters still unspelt."""
        low = path < 0
        width = np.ones(len(path), np.int64)
        if self.bytes:
            width[low] = _width(-2 - path[low])
        ends = np.cumsum(width)
        ids = np.repeat(path, width)
        spelt = np.flatnonzero(ids < 0)
        if len(spelt):
            ids[spelt] = self._byte_id[_utf8(-2 - ids[spelt], np.repeat(width, width)[spelt], spelt - np.repeat(ends - width, width)[spelt])] if self.bytes else self.unk
        by_word = np.concatenate([[0], np.cumsum(count)])
        bounds = np.concatenate([[0], ends])[by_word]
        at = len(self._number)
        self._number.update(zip(words, range(at, at + len(words)), strict=True))
        self._begin.extend(self._ids.n + bounds[:-1])
        self._count.extend(np.diff(bounds))
        self._best.extend(best)
        self._loss.extend(loss)
        self._ids.extend(ids)

    def _together(self, words: list[str]) -> None:
        """Segments words side by side: boundary by boundary, a forward pass over all of their edges."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        of = np.repeat(np.arange(len(words)), size)
        a, m, ids, cost = self._edges(codes, stop[of])
        w = of[a]
        far = a + m - (stop - size)[w]  # characters of the word up to the edge's end
        by = np.argsort((w + len(words) * far) * (self.longest + 1) - m)  # at each boundary, the longest edge first
        far, cost, ids = far[by], cost[by], ids[by]
        low = (a + w)[by]  # boundaries: those of a word are one more than its characters
        high = low + m[by]
        n = len(codes) + len(words)
        ahead, gap, back = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        cuts = np.searchsorted(far, np.arange(1, int(size.max()) + 2))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, to = ahead[low[x:y]] + cost[x:y], high[x:y]
            new = np.ones(y - x, bool)
            new[1:] = to[1:] != to[:-1]
            heads = np.flatnonzero(new)
            best = np.maximum.reduceat(s, heads)
            group = np.cumsum(new) - 1
            top = np.flatnonzero(s == best[group])
            keep = np.ones(len(top), bool)
            keep[1:] = group[top[1:]] != group[top[:-1]]
            s[top[keep]] = -np.inf
            to = to[heads]
            ahead[to], back[to], gap[to] = best, x + top[keep], best - np.maximum.reduceat(s, heads)
        begin = stop - size + np.arange(len(words))
        at, live = begin + size, np.arange(len(words))
        best, loss = ahead[at], np.full(len(words), np.inf)
        who, path = [], []
        while len(live):
            here = at[live]
            loss[live] = np.minimum(loss[live], gap[here])
            who.append(live)
            path.append(ids[back[here]])
            at[live] = low[back[here]]
            live = live[at[live] > begin[live]]
        turn = np.repeat(-np.arange(len(who)), [len(x) for x in who])
        who, path = np.concatenate(who), np.concatenate(path)
        self._keep(words, best, loss, np.bincount(who, minlength=len(words)), path[np.lexsort((turn, who))])

    def _alone(self, word: str) -> None:
        """A long word by itself, some of its edges at a time."""
        n = len(word)
        ahead, gap, size, ids = (np.full(n + 1, x) for x in (-np.inf, np.inf, 0, 0))
        ahead[0] = 0.0
        second = np.full(n + 1, -np.inf)
        for lo in range(0, n, STRETCH):
            part = word[lo : lo + STRETCH + self.longest]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            a, m, k, cost = self._edges(codes, np.full(len(codes), len(codes)))
            here = a < STRETCH
            a, m, k, cost = a[here], m[here], k[here], cost[here]
            by = np.lexsort((m, a))
            for x, y, i, c in zip((a[by] + lo).tolist(), m[by].tolist(), k[by].tolist(), cost[by].tolist(), strict=True):
                s = ahead[x] + c
                if s > ahead[x + y]:
                    second[x + y], ahead[x + y], size[x + y], ids[x + y] = ahead[x + y], s, y, i
                elif s > second[x + y]:
                    second[x + y] = s
        path, at, loss = [], n, np.inf
        while at:
            loss = min(loss, ahead[at] - second[at])
            path.append(ids[at])
            at -= int(size[at])
        path = np.array(path[::-1], np.int64)
        self._keep([word], ahead[n:], np.array([loss]), np.array([len(path)]), path)

    def _stretches(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Normalised texts as (text, part) in groups of about STRETCH characters; long ones are cut between words."""
        group: list[tuple[int, str]] = []
        held = 0
        for k, x in enumerate(map(self.normal, texts)):
            lo = 0
            while lo < len(x):
                cut = self._edge.search(x, lo + STRETCH) if self.whole_words and len(x) - lo > STRETCH else None
                hi = cut.start() if cut else len(x)
                group.append((k, x[lo:hi]))
                held += hi - lo
                lo = hi
                if held >= STRETCH:
                    yield group
                    group, held = [], 0
        if group:
            yield group

    def _spelt(self, char: str) -> tuple[int, ...]:
        """Ids of a character without a piece."""
        return tuple(self.bytes[x] for x in char.encode("utf-8", "surrogatepass")) if self.bytes else (self.unk,)

    def encode_all(self, texts: list[str], n: int = 1) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[tuple[int, int, tuple[int, ...]]]]]]:
        """Ids of the best segmentations of some texts, laid end to end, and their bounds; scores of the n best of each; and how
        each of these differs from the best: (at, size, ids) says that `ids` take the place of `size` ids from `at` on."""
        flat, tokens, total = [], np.zeros(len(texts), np.int64), np.zeros(len(texts))
        least: list[list[tuple[float, int, str]]] = [[] for _ in texts]  # of each text, the words that lose least: loss, first id, word
        for group in self._stretches(texts):
            if len(self._number) > CACHE:
                self._forget()
            parts = [self.chain(x) for _, x in group]
            each = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
            words = each.dictionary.to_pylist()
            new = [x for x in words if x not in self._number]
            if new:
                self._solve(new)
            w = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))[each.indices.to_numpy()]
            of = np.repeat(np.arange(len(group)), [len(x) for x in parts])
            count = self._count.held[w]
            first = np.cumsum(count) - count
            flat.append(self._ids.held[np.arange(count.sum()) + np.repeat(self._begin.held[w] - first, count)])
            text = np.array([k for k, _ in group])
            sums, sizes = np.bincount(of, self._best.held[w], len(group)), np.bincount(of, count, len(group)).astype(np.int64)
            loss = self._loss.held[w]
            some = np.flatnonzero(loss < np.inf) if n > 1 else np.zeros(0, np.int64)
            some = some[np.lexsort((some, loss[some], of[some]))]
            rank = np.arange(len(some)) - np.searchsorted(of[some], of[some])
            some = some[rank < n - 1]
            base = tokens[text[of[some]]] + first[some] - (np.cumsum(sizes) - sizes)[of[some]]
            for j, x in enumerate(text.tolist()):  # a text has one part in a group
                total[x] += sums[j]
                tokens[x] += sizes[j]
            back = each.indices.to_numpy()[some]
            for k, l, at, i in zip(text[of[some]].tolist(), loss[some].tolist(), base.tolist(), back.tolist(), strict=True):
                least[k].append((l, at, words[i]))
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        results = [self._several_best(s, x, n) for s, x in zip(total.tolist(), least, strict=True)]
        return ids, np.concatenate([[0], np.cumsum(tokens)]), [r[0] for r in results], [r[1] for r in results]

    def _several_best(self, total: float, least: list[tuple[float, int, str]], n: int) -> tuple[list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Scores of a text's n best segmentations, and their changes: A* over the chain of the words that can differ."""
        if not least:
            return [total], [[]]
        open_ = sorted(sorted(least)[: n - 1], key=lambda x: x[1])
        lists = []
        for _, _, x in open_:
            if (x, n) not in self._several:
                if len(self._several) > CACHE:
                    self._several.clear()
                self._several[x, n] = self.best(x, n)
            lists.append(self._several[x, n])
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[]]
        for j, found in enumerate(lists):
            edges.append([(j, s - found[0][0], (c,)) for c, (s, _) in enumerate(found)])
        scores, changes = [], []
        for loss, choice in n_best(edges, n):
            scores.append(total + loss)
            changes.append([(open_[j][1], len(lists[j][0][1]), lists[j][c][1]) for j, c in enumerate(choice) if c])
        return scores, changes

    def encode(self, text: str, n: int = 1) -> tuple[list[int], list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """encode_all() of one text."""
        ids, _, scores, changes = self.encode_all([text], n)
        return ids.tolist(), scores[0], changes[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy prefix."""
        if self._byte_ids.isdisjoint(ids):
            text = "".join(map(self.names.__getitem__, ids))
        else:
            out, raw = [], bytearray()
            for k in ids:
                if k in self._byte_ids:
                    raw.append(self._byte_of[k])
                    continue
                out += [raw.decode("utf-8", "replace"), self.names[k]]
                raw.clear()
            text = "".join([*out, raw.decode("utf-8", "replace")])
        text = text.replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of lists of ids, laid end to end; bytes that aren't UTF-8 are replaced."""
        if self._flat is None:
            names = [bytes([self._byte_of[k]]) if k in self._byte_ids else x.replace(BLANK, " ").encode() for k, x in enumerate(self.names)]
            size = np.array([len(x) for x in names])
            self._flat = np.frombuffer(b"".join(names), np.uint8), np.cumsum(size) - size, size
        data, start, size = self._flat
        n = size[ids]
        stop = np.concatenate([[0], np.cumsum(n)])
        raw = data[np.arange(stop[-1]) + np.repeat(start[ids] - stop[:-1], n)]
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(stop[ends[:-1]], stop[ends[1:]], strict=True)]
        return pa.array([t[1:] if self.prefix and t[:1] == " " else t for t in texts], pa.string())


def _width(codes: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8."""
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def _utf8(codes: np.ndarray, width: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The j-th byte of characters that take `width` bytes."""
    low = codes >> 6 * (width - 1 - j)
    lead = np.where(width == 1, 0, (0xFF00 >> width) & 0xFF)
    return np.where(j == 0, lead | low, 0x80 | low & 0x3F)


def n_best(edges: list[list[tuple[int, float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best paths from 0 to the last position, as (score, labels): a forward pass, then A* from the end.

    edges[b] has (a, score, labels) with a < b.
    """
    end = len(edges) - 1
    ahead = [0.0] + [float("-inf")] * end  # best score from the start
    back: list[tuple[int, float, tuple[int, ...]] | None] = [None] * (end + 1)
    for b in range(1, end + 1):
        for e in edges[b]:
            s = ahead[e[0]] + e[1]
            if s > ahead[b]:
                ahead[b], back[b] = s, e
    if n == 1:
        labels: list[tuple[int, ...]] = []
        at = end
        while at:
            e = back[at]
            labels.append(e[2])
            at = e[0]
        return [(ahead[end], tuple(i for x in reversed(labels) for i in x))]
    queue: list = [(-ahead[end], end, 0, 0.0, None)]  # scores are exact, so whole paths leave in order
    found: list[tuple[float, tuple[int, ...]]] = []
    pushed = 0
    while queue and len(found) < n:
        _, at, _, behind, path = heapq.heappop(queue)
        if not at:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((behind, tuple(ids)))
            continue
        for a, s, x in edges[at]:
            pushed += 1
            heapq.heappush(queue, (-(ahead[a] + s + behind), a, pushed, s + behind, (x, path)))
    return found


@functools.lru_cache(maxsize=2)
def loaded(model_file: str) -> Pieces:
    return Pieces(model_file)


_IDS = T.ArrayType(T.IntegerType())
_BEST = T.StructType(
    [
        T.StructField("ids", _IDS),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("changes", T.ArrayType(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("ids", _IDS)])))),
        T.StructField("decoded", T.StringType()),
    ]
)


def _encoded(batches: Iterator[pa.RecordBatch], text: str, model_file: str, n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pieces = loaded(model_file)
    kind = schema.field(len(schema.names) - 1).type
    for rows, _, _ in chunks(batches, text, 1 << 20):
        texts = [x or "" for x in column(rows, text).to_pylist()]
        flat, ends, scores, changed = pieces.encode_all(texts, n)
        changes = [[[{"at": a, "size": m, "ids": ids} for a, m, ids in c] for c in x] for x in changed]
        new = [
            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
            pa.array(scores, pa.list_(pa.float64())),
            pa.array(changes, kind.field("changes").type),
            pieces.decode_all(flat, ends),
        ]
        new = [x.cast(f.type) for x, f in zip(new, kind, strict=True)]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(new, fields=list(kind))], schema=schema)


def encode(docs: DataFrame, text: str = "text", model_file: str = PUBLIC_MODEL, n: int = N_BEST, out: str = "pieces") -> DataFrame:
    """`docs` with a struct `out`: ids of the best segmentation, scores of the n best, changes (how each of them differs from
    the best, see Pieces.encode), and decoded, the text that the best ids give back."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _BEST)])
    arrow = to_arrow_schema(schema)
    return docs.mapInArrow(lambda it: _encoded(it, text, model_file, n, arrow), schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentations of every document: token count, scores and digests of ids, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = encode(docs)
    changes = F.transform("pieces.changes", lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["at"].cast("string"), x["size"].cast("string"), F.array_join(x["ids"], "+"))), ","))
    return best.select(
        "doc_id",
        F.size("pieces.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("pieces.ids", ","), 256).alias("ids_sha256"),
        F.col("pieces.scores").alias("scores"),
        F.array_join(changes, ";").alias("changes"),
        (F.col("pieces.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
