"""Query understanding, bucketed retrieval, reranking, graph expansion and budgets, over tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..functions.models import model, model_of_two
from . import _near
from .chunk import token_count

# Buckets by keyword in the order of precedence, and hints of queries.
BUCKETS = ("intro", "method", "results", "discussion", "results_discussion", "conclusion", "other")
BUCKET_WORDS = (
    ("results_discussion", ("results and discussion", "results & discussion", "discussion and results", "discussion & results", "results discussion")),
    ("intro", ("introduction", "background")),
    ("method", ("method", "materials and methods", "materials & methods", "experimental", "experiments", "materials", "procedure")),
    ("results", ("results", "findings")),
    ("discussion", ("discussion",)),
    ("conclusion", ("conclusion", "concluding remarks", "summary", "outlook", "perspectives", "final remarks")),
)
QUERY_TYPES = (("mechanism", ("mechanism", "why", "原因", "机理")), ("comparison", ("compare", "difference", "相比", "对比")), ("design", ("design", "optimize", "筛选", "设计")))
KINDS = ("fact", "method", "mechanism", "comparison", "design")
NEEDS = {
    "need_figures": ("fig", "figure", "图", "曲线", "峰", "xrd", "sem", "tem"), "need_tables": ("table", "表", "数据表"),
    "need_equations": ("equation", "eq.", "公式"), "need_references": ("reference", "文献", "citation", "来源"),
}
METHOD_HINTS = ("how", "method", "experiment", "experimental", "制备", "测试")
VISION_HINTS = ("trend", "curve", "peak", "morphology", "看图", "根据图")
ROUTES = {"mechanism": ("results", "discussion", "results_discussion"), "comparison": ("results", "discussion"), "design": ("results", "discussion", "conclusion")}
TOP_K, TOP_N, MAX_OBJECTS, MAX_VISUAL, MAX_TOKENS = 20, 10, 20, 5, 5120
FAR = 1_000_000
# Fixed value: characters that no search term has.
NOT_TERM = r"[^a-zA-Z0-9一-鿿+\-]+"
#: Characters of a search term by which it meets tokens.
GRAM = 12
#: Parts of a bucket that a query meets in different tasks.
PARTS = 16


def _any(x: Column, words) -> Column:
    return reduce(lambda a, w: a | x.contains(w), words, F.lit(False))


def bucket(title: Column, path: Column) -> Column:
    """Bucket of a section by keywords in its path and title."""
    full = T.one_line(F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(title, F.lit("")))))
    return reduce(lambda c, r: c.when(_any(full, r[1]), r[0]), BUCKET_WORDS[1:], F.when(_any(full, BUCKET_WORDS[0][1]), BUCKET_WORDS[0][0])).otherwise("other")


def section_documents(chunked: DataFrame) -> DataFrame:
    """What is searched: chunks with text, and their bucket."""
    return chunked.where(F.trim("text") != "").withColumn("bucket", bucket(F.col("section_title"), T.section_path(F.col("hierarchy"))))


def analyze(queries: DataFrame, structure: bool = True) -> DataFrame:
    """`queries` (query_id, query) with type, needs, sub-questions and buckets; all buckets without `structure`."""
    q = T.normalize_text(F.col("query"))
    low = F.lower(q)
    kind = reduce(lambda c, r: c.when(_any(low, r[1]), r[0]), QUERY_TYPES[1:], F.when(_any(low, QUERY_TYPES[0][1]), QUERY_TYPES[0][0])).otherwise("fact")
    names = lambda x: F.array(*map(F.lit, x))
    plain = F.when(_any(low, METHOD_HINTS), names(("method", "results"))).otherwise(names(("results", "discussion")))
    route = reduce(lambda c, r: c.when(F.col("query_type") == r[0], names(r[1])), list(ROUTES.items())[1:], F.when(F.col("query_type") == "mechanism", names(ROUTES["mechanism"]))).otherwise(plain)
    parts = F.filter(F.transform(F.split(q, "[；;]"), lambda x: T.strip(x)), lambda x: x != "")
    out = queries.withColumn("normalized_query", q).withColumn("query_type", kind)
    out = out.select("*", *[_any(low, words).alias(n) for n, words in NEEDS.items()], F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")).alias("sub_questions"))
    out = out.withColumn("vision_reason", F.when(F.col("need_figures") & _any(low, VISION_HINTS), "caption_first_default").otherwise(""))
    return out.withColumn("retrieval_buckets", route if structure else names(BUCKETS))


def analysis_prompt(query: Column) -> Column:
    """What a model is asked about a query."""
    kinds, buckets = ", ".join(KINDS), ", ".join(BUCKETS)
    rules = (
        f"Analyse a question about scientific papers. Answer with one JSON object and nothing else: normalized_query; query_type, one of {kinds}; retrieval_buckets, the sections to search, "
        f"of {buckets}; needs_decomposition; sub_questions; need_figures, need_tables, need_equations, need_references; vision_required; vision_reason."
    )
    return F.concat(F.lit(f"{rules}\n\nQuestion:\n"), query)


def analyzed_by(queries: DataFrame, client: Callable[[pd.Series], pd.Series], structure: bool = True) -> DataFrame:
    """As analyze(), from a model's answers (prompts to answers): types and buckets that aren't known are left out, and a query whose
    answer is null or no JSON object, or that is blank, is analysed by the rules."""
    plain = analyze(queries, structure)
    ask = model(client, "string")
    said = queries.withColumn("said", F.when(T.normalize_text(F.col("query")) != "", ask(analysis_prompt(T.normalize_text(F.col("query")))))).select("query_id", J.first_object(F.col("said")).alias("said"))
    text = lambda k: T.strip(F.coalesce(F.get_json_object("said", f"$.{k}"), F.lit("")))
    many = lambda k: F.coalesce(F.from_json(F.get_json_object("said", f"$.{k}"), "array<string>"), F.array_compact(F.array(F.nullif(text(k), F.lit("")))))
    yes = lambda k: ~F.lower(F.coalesce(F.get_json_object("said", f"$.{k}"), F.lit("false"))).isin("false", "", "0", "null", "[]", "{}")
    kind = F.lower(text("query_type"))
    known = F.array_distinct(F.filter(F.transform(many("retrieval_buckets"), lambda b: F.lower(T.strip(b))), lambda b: b.isin(*BUCKETS)))
    route = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("results"), F.lit("discussion")))
    fields = {
        "normalized_query": F.coalesce(F.nullif(text("normalized_query"), F.lit("")), "normalized_query"),
        "query_type": F.when(kind.isin(*KINDS), kind).otherwise("fact"),
        "sub_questions": F.filter(F.transform(many("sub_questions"), lambda x: T.strip(x)), lambda x: x != ""),
        "retrieval_buckets": route if structure else F.col("retrieval_buckets"),
        "vision_reason": text("vision_reason"),
        **{n: yes(n) for n in NEEDS},
    }
    both = plain.join(said, "query_id", "left")
    return both.select(*[F.when(F.col("said").isNotNull(), fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in plain.columns], F.when(F.col("said").isNotNull(), "model").otherwise("rules").alias("analyzed_by"))


def task_mode(mode: str) -> str:
    """Canonical name of a task."""
    known = {"qa": "qa", "question_answering": "qa", "literature_qa": "qa", "literature_grounded_qa": "qa", "extraction": "extraction", "extract": "extraction", "structured_extraction": "extraction"}
    if (name := mode.strip().lower().replace("-", "_")) not in known:
        raise ValueError(f"unknown task {mode!r}")
    return known[name]


def depth(k: int | None, n: int | None) -> tuple[int, int]:
    """Retrieval and rerank depths; 0 and None mean the defaults."""
    k = max(1, k or TOP_K)
    return k, min(max(1, n or TOP_N), k)


def terms(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(x), NOT_TERM, " "), " "), lambda w: F.length(w) >= 2)


def lexical(analyzed: DataFrame, rows: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k rows of a query's buckets with most of its terms in their text (repeated terms count), ties by row order.

    Rows are told apart by doc_id and global_order. An inverted index: a term has none of the characters that split a text
    into tokens, so it occurs in a text just if it occurs in one of its tokens. Terms meet tokens by their first GRAM characters, whole
    where they are no longer, so that terms which begin alike don't meet each other's tokens; no query meets a row that has none of
    its terms, and texts are read once for all queries.
    """
    token = F.split(F.regexp_replace(F.lower(T.normalize_text(F.col("text"))), NOT_TERM, " "), " ")
    postings = rows.select("bucket", "doc_id", "global_order", F.explode(F.array_distinct(token)).alias("token")).where(F.length("token") >= 2)
    asked = analyzed.select("query_id", "retrieval_buckets", F.explode(terms(F.col("normalized_query"))).alias("term")).groupBy("query_id", "retrieval_buckets", "term").agg(F.count("*").alias("weight"))
    wanted = asked.select("term").distinct().withColumn("size", F.least(F.length("term"), F.lit(GRAM))).withColumn("gram", F.expr("substring(term, 1, size)"))
    sizes = wanted.agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # GRAM at most
    places = lambda n: F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.substring(F.col("token"), i, n))
    grams = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("token")), places))
    inside = postings.select("token").distinct().crossJoin(F.broadcast(sizes)).select("token", F.explode(F.array_distinct(grams)).alias("gram"))
    inside = inside.join(wanted, "gram").where(F.col("token").contains(F.col("term"))).select("token", "term").distinct()
    found = postings.join(inside, "token").select("bucket", "doc_id", "global_order", "term").distinct()
    scored = found.join(asked, "term").withColumn("turn", F.array_position("retrieval_buckets", F.col("bucket")) - 1).where("turn >= 0")
    scored = scored.groupBy("query_id", "turn", "bucket", "doc_id", "global_order").agg(F.sum("weight").cast("int").alias("score"))
    best = ranked(scored, [F.desc("score"), F.col("turn"), F.col("doc_id"), F.col("global_order")], k)
    return rows.join(best, ["bucket", "doc_id", "global_order"])


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; zero vectors stay."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    scaled = F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n)), F.lit(0))  # the norm once, not for each component
    return F.when(norm > 0, scaled).otherwise(v)


def nearest(asked: DataFrame, index: DataFrame, k: int, by: str = "bucket", key: str = "node_id", parts: int = PARTS, measure=squared_distance, largest: bool = False) -> DataFrame:
    """Exact search: asked (query_id, q, `by`) against index (`key`, v, `by`), the smallest squared distance first (or the largest
    of another measure), ties by key.

    A bucket's index rows are dealt into `parts`, which every query of the bucket meets in different tasks, so that a bucket, even a
    single one, is many keys; k rows of each part are all that is shuffled by query. Squared distances are taken from blocks of
    queries and the rows that may be near them (see _near), other measures pair by pair. Of equal vectors in a bucket, no more than
    the first k keys can be found.
    """
    order = [F.desc("distance") if largest else F.col("distance"), F.col(key)]
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    part = F.pmod(F.xxhash64(key), F.lit(parts).cast("long"))
    if measure is squared_distance and not largest:
        doubles = lambda c: F.col(c).cast("array<double>").alias(c)
        few = index.select(by, key, doubles("v")).withColumn("n", F.dense_rank().over(Window.partitionBy(by, "v").orderBy(key))).where(F.col("n") <= k).drop("n").withColumn("part", part)
        kinds = dict(asked.dtypes) | {key: dict(index.dtypes)[key]}

        def found(own: pa.Table, rows: pa.Table) -> pa.Table:
            return pa.Table.from_arrays(list(_near.nearest(own, rows, key, k)), ["query_id", key, "distance"])

        near = spread.select("query_id", by, doubles("q"), "part").groupBy(by, "part").cogroup(few.groupBy(by, "part"))
        near = near.applyInArrow(found, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, distance double")
        return ranked(near.groupBy("query_id", key).agg(F.min("distance").alias("distance")), order, k)
    best = F.array_max if largest else F.array_min
    once = index.groupBy(by, key).agg(F.collect_set("v").alias("vs")).withColumn("part", part)
    both = once.join(spread, [by, "part"]).select("query_id", by, "part", key, best(F.transform("vs", lambda v: measure(v, F.col("q")))).alias("distance"))
    few = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", by, "part").orderBy(*order))).where(F.col("n") <= k)
    merged = few.groupBy("query_id", key).agg((F.max if largest else F.min)("distance").alias("distance"))
    return ranked(merged, order, k)


def captions(asked: DataFrame, objects: DataFrame, k: int = 5, by: str = "bucket", key: str = "node_id") -> DataFrame:
    """Figures and tables by the cosine of their captions' vectors with a query's (both of length 1), largest first."""
    cosine = lambda v, q: F.round(inner_product(v, q), 6)
    return nearest(asked, objects, k, by, key, measure=cosine, largest=True).withColumnRenamed("distance", "score")


def rerank(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], n: int = TOP_N) -> DataFrame:
    """The n best hits by a scoring function of query and text; it runs on hits alone, and ties keep the retrieval rank."""
    scored = hits.withColumn("rerank_score", model_of_two(score, "double")("query", "text")).withColumnRenamed("rank", "retrieval_rank")
    return ranked(scored, [F.desc("rerank_score"), F.col("retrieval_rank")], n)


def overlap_score(query: pd.Series, text: pd.Series) -> pd.Series:
    """The default reranker: share of a query's words that a text has."""
    share = lambda q, t: len(a & set(t.lower().split())) / len(a) if (a := set(q.lower().split())) else 0.0
    return pd.Series([share(q or "", t or "") for q, t in zip(query, text, strict=True)], dtype=float)


def expand(hits: DataFrame, nodes: DataFrame, edges: DataFrame, chunked: DataFrame, association: bool = True) -> DataFrame:
    """Evidence of each query: hits, their neighbours, and objects they cite; without `association` no objects.

    Rows: query_id, bucket, doc_id, node_id, evidence_uid, position (from 0 in the bucket), expand_role and
    expanded_from (of the first time a node came up), triggered_by_chunk_ids (all hits, in order).
    """
    chunk = chunked.select("doc_id", "node_id", "prev_chunk_id", "next_chunk_id", "nearby_evidence_ids")
    h = hits.select("query_id", "rank", "doc_id", F.col("node_id").alias("hit")).join(chunk.withColumnRenamed("node_id", "hit"), ["doc_id", "hit"])
    step = lambda k, node, role, pos: F.struct(F.lit(k).alias("step"), pos.cast("int").alias("pos"), node.alias("node_id"), F.lit(role).alias("role"))
    zero = F.lit(0)
    own = F.array(step(0, F.col("hit"), "primary_hit", zero), step(1, F.col("prev_chunk_id"), "context_prev", zero), step(2, F.col("next_chunk_id"), "context_next", zero))
    near = F.transform("nearby_evidence_ids", lambda x, i: step(3, x, "nearby_chunk", i))
    seen = h.select("query_id", "rank", "doc_id", "hit", F.explode(F.concat(own, near)).alias("x")).select("query_id", "rank", "doc_id", "hit", "x.*").where("node_id is not null")
    if association:
        cites = edges.where(F.col("relation").isin("cites_figure", "cites_table", "cites_equation", "cites_reference"))
        out = h.join(cites.select("doc_id", F.col("source").alias("hit"), F.col("target").alias("node_id"), "edge_id"), ["doc_id", "hit"])
        pos = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("edge_id"))
        seen = seen.union(out.select("query_id", "rank", "doc_id", "hit", F.lit(4), pos, "node_id", F.lit("")))
    typed = seen.join(nodes.select("doc_id", "node_id", "node_type", "evidence_uid"), ["doc_id", "node_id"])
    place = F.when(F.col("node_type") == "section_chunk", "chunks").when(F.col("node_type").isin("figure", "table", "equation", "reference"), F.concat("node_type", F.lit("s")))
    typed = typed.withColumn("bucket", place).where("bucket is not null")
    if not association:
        typed = typed.where("bucket = 'chunks'")
    seq = F.struct("rank", "step", "pos")
    once = typed.groupBy("query_id", "bucket", "doc_id", "node_id", "evidence_uid").agg(F.min(F.struct(seq.alias("seq"), "role", "hit")).alias("first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "hit"))), lambda x: x["hit"])).alias("triggered_by_chunk_ids"))
    w = Window.partitionBy("query_id", "bucket").orderBy("first.seq")
    role = F.when(F.col("bucket") == "chunks", F.col("first.role")).otherwise("")
    return once.select("query_id", "bucket", "doc_id", "node_id", "evidence_uid", (F.row_number().over(w) - 1).alias("position"), role.alias("expand_role"), F.col("first.hit").alias("expanded_from"), F.col("first.seq.rank").alias("hit_rank"), "triggered_by_chunk_ids")


def cap_objects(evidence: DataFrame, objects: int = MAX_OBJECTS, visual: int = MAX_VISUAL) -> DataFrame:
    """At most `objects` of a query, `visual` of them figures and tables, by priority, rank of the hit and position.

    Capping figures and tables first is the same as passing over them in one greedy run, as those passed over take no room.
    """
    role = F.col("expand_role")
    priority = F.when(F.col("bucket") == "chunks", F.when(role == "primary_hit", 0).when(role.isin("context_prev", "context_next"), 2).otherwise(3)).when(F.col("bucket") == "references", 4).otherwise(1)
    turn = F.expr("array_position(array('chunks','figures','tables','equations','references'), bucket)")
    seen = evidence.withColumn("priority", priority).withColumn("is_visual", F.col("bucket").isin("figures", "tables"))
    order = [F.col("priority"), F.coalesce("hit_rank", F.lit(FAR)), F.col("position"), turn]
    first = seen.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "is_visual").orderBy(*order))).where(~F.col("is_visual") | (F.col("n") <= visual))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= objects).withColumnRenamed("n", "kept_rank").drop("is_visual")


def greedy_budget(rows: DataFrame, key: str, order: list[str], tokens: str, budget: int = MAX_TOKENS, exempt: Column | None = None) -> DataFrame:
    """Rows of each key that a greedy run keeps: one that doesn't fit is passed over, later ones may fit; exempt rows stay and cost nothing.

    Tokens add up, since the default tokenizer never joins texts across line feeds. Rows of a key lie together in `order`, nulls last, and
    a run goes over them once, so that equal rows are each kept or not for themselves.
    """
    cost = F.when(F.lit(False) if exempt is None else exempt, 0).otherwise(F.col(tokens)).cast("long")
    spread = rows.withColumn("__cost", cost).repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = object(), 0
        for batch in batches:
            keep = []
            for k, n in zip(batch.column(key).to_pylist(), batch.column("__cost").to_pylist(), strict=True):
                if k != at:
                    at, used = k, 0
                fits = n is not None and used + n <= budget
                if fits:
                    used += n
                keep.append(fits)
            yield batch.drop_columns(["__cost"]).filter(pa.array(keep, pa.bool_()))

    return spread.mapInArrow(run, rows.schema)


def context_blocks(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence with the text of its block and that text's tokens (without special ones)."""
    body = evidence.join(nodes.select("doc_id", "node_id", "title", "content", "section_title_full"), ["doc_id", "node_id"])
    tag = F.upper(F.regexp_replace("bucket", "s$", ""))
    line = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), c))
    block = F.concat_ws("\n", F.concat(F.lit("["), tag, F.lit("]")), line("uid", F.col("evidence_uid")), line("section", F.col("section_title_full")), line("title", F.col("title")), line("content", F.col("content")))
    return body.withColumn("block", block).withColumn("tokens", token_count(F.col("block"), special=False)).withColumn("turn", F.expr("array_position(array('chunks','tables','figures','equations','references'), bucket)"))


def within_budget(blocks: DataFrame, budget: int = MAX_TOKENS) -> DataFrame:
    """Blocks in the order of the context that fit; figures and tables are exempt."""
    return greedy_budget(blocks, "query_id", ["turn", "position"], "tokens", budget, F.col("bucket").isin("figures", "tables"))


def numbered(evidence: DataFrame) -> DataFrame:
    """Evidence with its number for display: Fig. i, Table i, Eq. i, [i] within query and bucket."""
    n = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("position")).cast("string")
    label = F.when(F.col("bucket") == "figures", F.concat(F.lit("Fig. "), "n")).when(F.col("bucket") == "tables", F.concat(F.lit("Table "), "n")).when(F.col("bucket") == "equations", F.concat(F.lit("Eq. "), "n")).when(F.col("bucket") == "references", F.concat(F.lit("["), "n", F.lit("]")))
    return evidence.withColumn("n", n).withColumn("display", label).drop("n")


def minimal_answers(analyzed: DataFrame, hits: DataFrame, length: int = 220) -> DataFrame:
    """A deterministic draft for each query: the start of the first hit's text, or a sentence that says there is none."""
    first = hits.where("rank = 1").select("query_id", F.substring(F.regexp_replace(T.normalize_text(F.col("text")), "\n", " "), 1, length).alias("snippet"), F.col("evidence_uid").alias("support_uid"))
    none = F.lit("The retrieved evidence is insufficient to answer the question.")
    return analyzed.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("snippet", none).alias("answer"), F.when(F.col("snippet").isNull(), "insufficient").otherwise("supported").alias("status"), "support_uid")


def check_mode(mode: str) -> None:
    if mode not in ("full", "wo_structure", "wo_multimodal", "wo_association"):
        raise ValueError(f"unknown mode {mode!r}")


def ablated(evidence: DataFrame, mode: str, captions: DataFrame | None = None) -> DataFrame:
    """Evidence under full, wo_structure, wo_multimodal (no figures and tables) or wo_association (caption hits come in for objects)."""
    check_mode(mode)
    if mode == "wo_multimodal":
        return evidence.where(~F.col("bucket").isin("figures", "tables"))
    if mode == "wo_association" and captions is not None:
        kept = evidence.where("bucket = 'chunks'")
        new = captions.join(kept.select("query_id", "evidence_uid"), ["query_id", "evidence_uid"], "left_anti")
        return kept.unionByName(new.select(*[F.col(c) if c in captions.columns else F.lit(None).cast(t).alias(c) for c, t in kept.dtypes]))
    return evidence
