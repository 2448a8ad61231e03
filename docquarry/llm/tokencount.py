"""Token counts of sections: each text is encoded once as a whole, and its tokens are attributed.

The tokenizer is a byte-level BPE of public ranks, so its tokens' bytes laid end to end are the
text's: token spans are running sums of byte lengths, turned into code points. Sections are spans
of the text too, in order and without overlaps (lines by default, each with the line feed that
ends it). Tokens and sections are joined as intervals by binary search, both sides being sorted.

A token that crosses section boundaries is allocated by `rule`:
- "first" (default): to the section of its first character, so counts add up to the text's;
- "last": to the section of its last character;
- "most": to the section with most of its characters, the earlier one of a tie;
- "each": to every section that it touches (counts may add up to more).
A token that begins inside a character (in continuation bytes) counts as beginning at it.

The file of ranks is a parameter; PUBLIC_RANKS is where this environment keeps a public one.

Defined cases: a null or empty text has one empty section without tokens; texts that end in a line
feed have no empty last section; repeated rows each get their rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import table
from ._text import buffers, column, gathered

PUBLIC_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits a text before merges; a fixed value of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("first", "last", "most", "each")


@functools.cache
def encoder(ranks_file: str, pattern: str = PATTERN):
    """A tiktoken encoding and the byte length of each token; read once in each process."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def attributed(first: np.ndarray, stop: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Token spans are [first, stop), sections begin at the sorted `starts` and meet each other."""
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1
    if rule == "first" or not len(first):
        return np.bincount(a, minlength=n)
    b = np.searchsorted(starts, stop - 1, "right") - 1
    if rule == "last":
        return np.bincount(b, minlength=n)
    if rule == "each":
        out = np.zeros(n + 1, np.int64)
        np.add.at(out, a, 1)
        np.add.at(out, b + 1, -1)
        return np.cumsum(out)[:n]
    best, at = np.zeros(len(first), np.int64), a.copy()
    for step in range(int((b - a).max()) + 1):
        s = a + step
        live = s <= b
        end = np.where(s + 1 < n, starts[np.minimum(s + 1, n - 1)], stop)
        inside = np.where(live, np.minimum(stop, end) - np.maximum(first, starts[np.minimum(s, n - 1)]), 0)
        more = inside > best
        best, at = np.where(more, inside, best), np.where(more, s, at)
    return np.bincount(at, minlength=n)


def _counted(batches: Iterator[pa.RecordBatch], ids: str, text: str, ranks_file: str, rule: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoding, size = encoder(ranks_file)
    for rows, buf, offsets in gathered(batches, text, 1 << 20):
        texts = [x or "" for x in column(rows, text).to_pylist()]
        of, number, begin, end, count = [], [], [], [], []
        for k, x in enumerate(texts):
            raw = buf[offsets[k] : offsets[k + 1]]
            char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
            tokens = size[np.asarray(encoding.encode_to_numpy(x), np.int64)] if x else np.zeros(0, np.int64)
            stop_byte = np.cumsum(tokens)
            first_byte = stop_byte - tokens
            # the character that a byte belongs to
            first, stop = np.maximum(char[first_byte + 1] - 1, 0) if len(tokens) else first_byte, char[stop_byte]
            lines = char[np.flatnonzero(raw == 0x0A) + 1]
            starts = np.concatenate([[0], lines[lines < char[-1]]])
            n = attributed(first, np.maximum(stop, first + 1), starts, rule)
            of.append(np.full(len(starts), k))
            number.append(np.arange(len(starts)))
            begin.append(starts)
            end.append(np.append(starts[1:], char[-1]))
            count.append(n)
        of = np.concatenate(of)
        out = [column(rows, ids).take(pa.array(of)), *(pa.array(np.concatenate(x), pa.int64()) for x in (number, begin, end, count))]
        yield pa.RecordBatch.from_arrays(out, schema=schema)


def section_tokens(docs: DataFrame, ids: str = "doc_id", text: str = "text", ranks_file: str = PUBLIC_RANKS, rule: str = "first") -> DataFrame:
    """One row for each section: the id, section (from 0), start, stop (code points) and n_tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = T.StructType([T.StructField(ids, docs.schema[ids].dataType), *(T.StructField(c, T.LongType()) for c in ("section", "start", "stop", "n_tokens"))])
    arrow = to_arrow_schema(schema)
    return docs.select(ids, text).mapInArrow(lambda it: _counted(it, ids, text, ranks_file, rule, arrow), schema)


def field_tokens(docs: DataFrame, fields: list[str], ids: str = "doc_id", ranks_file: str = PUBLIC_RANKS, rule: str = "first") -> DataFrame:
    """One row per row of `docs`: the id and n_<field> for each field, from one encoding of all fields, joined by line feeds.

    The line feed that joins two fields counts with the field before it.
    """
    body = F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    lines = [F.size(F.split(F.coalesce(F.col(f), F.lit("")), "\n", -1)) for f in fields]
    keyed = docs.select(F.col(ids), F.struct(F.col(ids).alias("id"), *[x.cast("long").alias(f"l{k}") for k, x in enumerate(lines)], F.monotonically_increasing_id().alias("row")).alias("key"), body.alias("body"))
    counted = section_tokens(keyed, "key", "body", ranks_file, rule)
    before, out = F.lit(0).cast("long"), []
    for k, f in enumerate(fields):
        after = before + F.col(f"key.l{k}")
        out.append(F.sum(F.when((F.col("section") >= before) & (F.col("section") < after), F.col("n_tokens")).otherwise(0)).alias(f"n_{f}"))
        before = after
    return counted.groupBy("key").agg(*out).select(F.col("key.id").alias(ids), *[f"n_{f}" for f in fields])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded once as a whole."""
    return section_tokens(table(spark, sf_dir, "documents"))
