"""Chunks: paragraphs, sentences, greedy packing to a token limit with sentence overlap.

The tokenizer and the sentence splitter are callables; the defaults need no model. Chunks differ
from those of a model-based splitter, which isn't available offline.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import listed

MAX_TOKENS, OVERLAP = 480, 1
#: Tokens that a model adds to every text.
SPECIAL = 2
TOKEN = r"\w+|[^\w\s]"
#: No sentence ends after these.
ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|et al|cf|vs|Figs?|Eqs?|Tabs?|Refs?|No|Dr|approx)\.|^\(?[A-Za-z0-9]{1,2}[.)])$", re.I)


def spans(text: str) -> list[tuple[int, int]]:
    """Spans of the default tokenizer's tokens; they never cross white space, so counts of joined texts add up."""
    return [m.span() for m in re.finditer(TOKEN, text)]


def split_sentences(paragraph: str) -> list[str]:
    out, start = [], 0
    for m in re.finditer(r"[.!?][\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9À-￿])", paragraph):
        if not ABBREVIATION.search(paragraph[start : m.end()].strip()):
            out.append(paragraph[start : m.end()].strip())
            start = m.end()
    return [x for x in (*out, paragraph[start:].strip()) if x]


def count_tokens(text: str, special: bool = True, tokens: Callable[[str], list[tuple[int, int]]] = spans) -> int:
    n = len(tokens(text)) if text else 0
    return n + SPECIAL if n and special else n


def pack(paragraph: str, limit: int, overlap: int, sentences: Callable[[str], list[str]] = split_sentences, tokens: Callable[[str], list[tuple[int, int]]] = spans) -> list[str]:
    """Chunks of one paragraph within `limit` tokens; the last sentences are repeated if they still fit; an over-long one is cut at tokens."""
    out: list[str] = []
    held: list[str] = []
    fits = lambda parts: count_tokens(" ".join(parts), tokens=tokens) <= limit
    for s in sentences(paragraph):
        if not fits([s]):
            if held:
                out.append(" ".join(held))
            at = tokens(s)
            step = limit - SPECIAL
            out += [s[at[k][0] : at[min(k + step, len(at)) - 1][1]] for k in range(0, len(at), step)]
            held = []
        elif fits([*held, s]):
            held.append(s)
        else:
            out.append(" ".join(held))
            tail = held[len(held) - overlap :] if overlap else []
            held = [*tail, s] if fits([*tail, s]) else [s]
    if held:
        out.append(" ".join(held))
    return out


def chunk_texts(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP, sentences: Callable[[str], list[str]] = split_sentences, tokens: Callable[[str], list[tuple[int, int]]] = spans) -> list[tuple[int, str, int]]:
    """(paragraph, chunk, tokens) of a normalised text; no chunk crosses a paragraph."""
    paragraphs = [p.strip() for p in (text or "").split("\n\n") if p.strip()]
    return [(k, c, count_tokens(c, tokens=tokens)) for k, p in enumerate(paragraphs) for c in pack(p, limit, overlap, sentences, tokens)]


def token_count(x: Column, special: bool = True) -> Column:
    """The default tokenizer's count on the JVM side; texts of ASCII alone have the same tokens without the Unicode classes, which take longer."""
    text = F.coalesce(x, F.lit(""))
    tokens = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    n = F.when(F.octet_length(text) == F.length(text), tokens(TOKEN)).otherwise(tokens(rf"(?U){TOKEN}"))
    return F.when(n == 0, 0).otherwise(n + (SPECIAL if special else 0))


def chunks(sections: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP, sentences: Callable[[str], list[str]] = split_sentences, tokens: Callable[[str], list[tuple[int, int]]] = spans, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks of sections, numbered within their section and over their document, with links to neighbours in the section.

    `sentences` splits a paragraph; `tokens` gives the spans of a text's tokens. `each` adds columns to
    chunks where they are cut, before any are shuffled.
    """
    if limit <= SPECIAL or overlap < 0:
        raise ValueError("limit must leave room for tokens, and overlap can't be negative")

    def cut(texts: list[str]) -> list[list[dict]]:
        return [[{"paragraph": a, "text": b, "token_count": n} for a, b, n in chunk_texts(x, limit, overlap, sentences, tokens)] for x in texts]

    kind = "array<struct<paragraph:int,text:string,token_count:int>>"
    rows = sections.withColumn("c", listed(cut, kind)(T.normalize_text(F.col("content")))).select("*", F.size("c").alias("total_chunks"), F.posexplode("c").alias("at", "x"))
    rows = rows.select(
        "doc_id", "source_file", F.col("ord").alias("section_ord"), "section_id", "section_number", "section_title", "section_title_full", "parent_section_id", "hierarchy",
        (F.col("at") + 1).alias("local_order"), "total_chunks", F.col("x.text").alias("text"), F.col("x.token_count").alias("token_count"),
    )
    rows = each(rows) if each else rows
    rows = rows.withColumn("node_id", F.concat("section_id", F.lit("__chunk_"), "local_order"))
    own = Window.partitionBy("doc_id").orderBy("section_ord", "local_order")
    near = Window.partitionBy("doc_id", "section_ord").orderBy("local_order")
    rows = rows.withColumn("global_order", F.row_number().over(own)).withColumn("prev_chunk_id", F.lag("node_id").over(near)).withColumn("next_chunk_id", F.lead("node_id").over(near))
    return rows.withColumn("checked", F.assert_true(F.col("token_count") <= limit)).drop("checked")
