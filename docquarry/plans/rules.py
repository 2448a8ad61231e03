"""Registered queries of validation rules, over tables that are broken by a rule of numbers, which SQL repeats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import mentions as M
from ..functions import text as T
from ..operators import chunk, clean, embed, graph, parse, retrieve, validate
from ..sources import files, index
from ..sources.shared import new_folder
from .registry import _joined, query, read


def _counts(rules: list[DataFrame]) -> DataFrame:
    """Findings by severity and code."""
    keep = new_folder(rules[0].sparkSession, "findings") if len(rules) > 4 else None
    return validate.findings(rules, keep).groupBy("severity", "code").agg(F.count("*").alias("n"))


def _expected(table: str, **codes: str) -> str:
    """SQL that counts rows of a table by condition; a code is severity__CODE. Codes without a row are left out."""
    each = [f"select '{name.split('__')[0]}' as severity, '{name.split('__')[1]}' as code, count(*) as n from {table} where {cond}" for name, cond in codes.items()]
    return "select * from (" + " union all ".join(each) + ") as x where n > 0"


def _when(k: Column, n: int, rest: int, value, otherwise) -> Column:
    return F.when(k % n == rest, value).otherwise(otherwise)


# ---- graphs: each order is a document with a section, a chunk and a figure, broken by its number


def _broken(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    doc = k.cast("string")
    o = read(spark, d, "orders")
    meta = o.select(_when(k, 97, 96, "", doc).alias("doc_id"), _when(k, 97, 1, "", F.lit("f.md")).alias("source_file"))
    none = F.lit(None).cast("string")
    node = lambda ident, kind, section, parent=none: F.struct(ident.alias("node_id"), kind.alias("node_type"), section.alias("section_id"), parent.alias("parent_section_id"))
    section, piece, figure = F.lit("s1"), F.lit("c1"), F.lit("g1")
    parts = [
        node(section, F.lit("section"), section, _when(k, 97, 2, F.lit("nowhere"), none)),
        node(_when(k, 97, 3, F.lit(" "), piece), F.lit("section_chunk"), _when(k, 97, 4, none, _when(k, 97, 5, F.lit("s9"), section))),
        node(figure, _when(k, 97, 6, F.lit("drawing"), F.lit("figure")), section),
        F.when(k % 97 == 7, node(figure, F.lit("figure"), section)),
    ]
    nodes = o.where(k % 97 != 8).select(k.alias("k"), doc.alias("doc_id"), F.explode(F.array_compact(F.array(*parts))).alias("x")).select("k", "doc_id", "x.*")
    uid = F.concat("doc_id", F.lit("::"), "node_id")
    is_figure = F.col("node_id") == "g1"
    uid = F.when(is_figure & (F.col("k") % 97 == 9), "").when(is_figure & (F.col("k") % 97 == 10), F.concat("doc_id", F.lit("::other"))).otherwise(uid)
    nodes = nodes.select("doc_id", "node_id", "node_type", "section_id", "parent_section_id", uid.alias("evidence_uid"), F.when(is_figure & (F.col("k") % 97 == 11), "other.md").when(F.col("k") % 97 == 1, "").otherwise("f.md").alias("source_file"))
    edge = lambda ident, source, target, relation: F.struct(ident.alias("edge_id"), source.alias("source"), target.alias("target"), relation.alias("relation"))
    good = edge(_when(k, 97, 12, "", F.lit("e1")), piece, _when(k, 97, 13, F.lit("g9"), figure), _when(k, 97, 14, F.lit(" "), _when(k, 97, 15, F.lit("cites_table"), F.lit("cites_figure"))))
    edges = o.select(doc.alias("doc_id"), F.explode(F.array_compact(F.array(good, F.when(k % 97 == 16, good), F.when(k % 97 == 17, edge(F.lit("e2"), section, figure, F.lit("cites_figure")))))).alias("x")).select("doc_id", "x.*")
    return meta, nodes, edges


@query(_expected(
    "orders, (select 1) as one",
    error__GRAPH_DOC_ID_MISSING="o_orderkey % 97 = 96", warning__GRAPH_SOURCE_FILE_MISSING="o_orderkey % 97 = 1", error__GRAPH_NODES_EMPTY="o_orderkey % 97 in (8, 96)",
    error__NODE_ID_MISSING="o_orderkey % 97 = 3", error__NODE_ID_DUPLICATE="o_orderkey % 97 = 7", error__EVIDENCE_UID_MISSING="o_orderkey % 97 = 9", error__EVIDENCE_UID_DUPLICATE="o_orderkey % 97 = 7",
    error__EVIDENCE_UID_INCONSISTENT="o_orderkey % 97 = 10", warning__NODE_TYPE_UNKNOWN="o_orderkey % 97 = 6",
    error__EDGE_ID_MISSING="o_orderkey % 97 = 12", error__EDGE_ID_DUPLICATE="o_orderkey % 97 = 16", error__EDGE_RELATION_MISSING="o_orderkey % 97 = 14", error__EDGE_DANGLING_ENDPOINT="o_orderkey % 97 in (3, 13) or o_orderkey % 97 = 8",
    error__SECTION_REFERENCE_INVALID="o_orderkey % 97 in (2, 4, 5)",
).replace("count(*) as n from orders, (select 1) as one where o_orderkey % 97 in (8, 96)", "count(*) as n from orders where o_orderkey % 97 in (8, 96)")
    + " union all select 'error', 'NODE_PROVENANCE_MISMATCH', sum(case when o_orderkey % 97 = 11 then 1 when o_orderkey % 97 = 96 then 3 else 0 end)::bigint from orders having sum((o_orderkey % 97 in (11, 96))::int) > 0"
    + " union all select 'error', 'EDGE_RELATION_TYPE_MISMATCH', sum(case when o_orderkey % 97 in (6, 15, 17) then 1 else 0 end)::bigint from orders having sum((o_orderkey % 97 in (6, 15, 17))::int) > 0")
def graph_findings(spark, d):
    return _counts(validate.graph_rules(*_broken(spark, d)))


@query(f"""
with r as (select 97 as m), f as (select o_orderkey::varchar as doc_id, o_orderkey % 97 as x from orders)
select doc_id, case when x in (3, 13) or x = 8 then 'EDGE_DANGLING_ENDPOINT' else 'EDGE_ID_DUPLICATE' end as code, 1 as n from f where x in (3, 8, 13, 16)""")
def graph_reports(spark, d):
    found = validate.findings(validate.graph_rules(*_broken(spark, d))).where(F.col("code").isin("EDGE_DANGLING_ENDPOINT", "EDGE_ID_DUPLICATE"))
    return validate.report(found).select("doc_id", "code", F.col("n").cast("int").alias("n"))


# ---- chunks: two for each order, with links and mentions


def _chunked(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    doc = k.cast("string")
    o = read(spark, d, "orders")
    many = lambda *x: F.array(*x).cast("array<string>")
    none = F.lit(None).cast("string")
    first = F.struct(
        F.lit("c1").alias("node_id"), none.alias("prev_chunk_id"), _when(k, 89, 1, F.lit("c9"), F.lit("c2")).alias("next_chunk_id"), _when(k, 89, 2, 481, 10).alias("token_count"), _when(k, 89, 3, many(F.lit("x")), many(F.lit("g1"))).alias("nearby_evidence_ids"),
        _when(k, 89, 4, many(F.lit("Fig. 1"), F.lit("Fig. 8")), many(F.lit("Fig. 1"))).alias("mentioned_figures"), many(F.lit("Table 1")).alias("mentioned_tables"), many(F.lit("eq_1")).alias("mentioned_equation_ids"), many(F.lit("7")).alias("mentioned_equation_numbers"), many(F.lit("ref_1")).alias("mentioned_references"),
    )
    second = F.struct(
        F.lit("c2").alias("node_id"), _when(k, 89, 5, none, F.lit("c1")).alias("prev_chunk_id"), none.alias("next_chunk_id"), F.lit(10).alias("token_count"), many().alias("nearby_evidence_ids"),
        *[many().alias(f"mentioned_{c}") for c in ("figures", "tables", "equation_ids", "equation_numbers", "references")],
    )
    chunks = o.select(doc.alias("doc_id"), F.explode(F.array(first, second)).alias("x")).select("doc_id", "x.*")
    node = lambda ident, kind, title, content, meta: F.struct(F.lit(ident).alias("node_id"), F.lit(kind).alias("node_type"), F.lit(title).alias("title"), content.alias("content"), meta.alias("metadata"), F.lit(1).alias("order_index"))
    full, text = F.lit("{}"), F.lit("t")
    table = _when(k, 89, 6, F.lit('{"table_data":{"columns":[],"rows":[],"grid":[]}}'), F.lit('{"table_data":{"columns":["a"],"rows":[["1"]],"grid":[["a"]]}}'))
    image = _when(k, 89, 7, F.lit('{"image_path":"","image_url":""}'), F.lit('{"image_path":"a.png"}'))
    parts = [
        node("c1", "section_chunk", "", text, full), node("c2", "section_chunk", "", text, full), node("g1", "figure", "Fig. 1", text, image), node("t1", "table", "Table 1", text, table),
        node("eq_1", "equation", "Equation 7", _when(k, 89, 8, F.lit(" "), text), F.lit('{"equation_number":"7"}')), node("ref_1", "reference", "Reference 1", text, full),
    ]
    nodes = o.select(doc.alias("doc_id"), F.explode(F.array(*parts)).alias("x")).select("doc_id", "x.*")
    edge = lambda kind, target: F.struct(F.lit("c1").alias("source"), F.lit(target).alias("target"), F.lit(f"cites_{kind}").alias("relation"))
    cited = F.array_compact(F.array(edge("figure", "g1"), F.when(k % 89 != 9, edge("table", "t1")), edge("equation", "eq_1"), edge("reference", "ref_1")))
    return chunks, nodes, o.select(doc.alias("doc_id"), F.explode(cited).alias("x")).select("doc_id", "x.*")


@query(_expected(
    "orders", error__CHUNK_TOKEN_LIMIT_EXCEEDED="o_orderkey % 89 = 2", error__CHUNK_LINK_INVALID="o_orderkey % 89 in (1, 3)", warning__CHUNK_LINK_ASYMMETRIC="o_orderkey % 89 in (1, 5)", warning__MENTION_UNRESOLVED="o_orderkey % 89 = 4",
    error__MENTION_EDGE_MISSING="o_orderkey % 89 = 9", warning__FIGURE_IMAGE_LOCATOR_MISSING="o_orderkey % 89 = 7", warning__TABLE_DATA_EMPTY="o_orderkey % 89 = 6", warning__EQUATION_CONTENT_EMPTY="o_orderkey % 89 = 8",
))
def chunk_findings(spark, d):
    return _counts(validate.chunk_rules(*_chunked(spark, d), 480))


# ---- search rows against chunk nodes


@query(_expected(
    "orders", error__RETRIEVAL_ID_DUPLICATE="o_orderkey % 83 = 1", error__RETRIEVAL_UID_DUPLICATE="o_orderkey % 83 = 1", error__RETRIEVAL_CHUNK_MISSING="o_orderkey % 83 in (2, 3, 7)", error__RETRIEVAL_ORPHAN_ROW="o_orderkey % 83 = 3",
    error__RETRIEVAL_ROW_INCONSISTENT="o_orderkey % 83 in (4, 5, 6, 7)", error__RETRIEVAL_TEXT_MISMATCH="o_orderkey % 83 = 8", error__RETRIEVAL_TOKEN_COUNT_MISMATCH="o_orderkey % 83 = 9",
))
def retrieval_findings(spark, d):
    k = F.col("o_orderkey")
    doc = k.cast("string")
    o = read(spark, d, "orders")
    uid = F.concat(doc, F.lit("::c1"))
    nodes = o.select(doc.alias("doc_id"), F.lit("c1").alias("node_id"), F.lit("section_chunk").alias("node_type"), uid.alias("evidence_uid"), F.lit("f").alias("source_file"), F.lit("a  text").alias("content"), F.lit('{"token_count":4}').alias("metadata"))
    rows = o.where(k % 83 != 2).select(
        k.alias("k"), doc.alias("doc_id"), _when(k, 83, 3, F.lit("c9"), _when(k, 83, 7, F.lit(""), F.lit("c1"))).alias("id"), _when(k, 83, 4, F.lit("u"), uid).alias("evidence_uid"), _when(k, 83, 5, F.lit("section"), F.lit("section_chunk")).alias("node_type"),
        _when(k, 83, 6, F.lit("g"), F.lit("f")).alias("source_file"), _when(k, 83, 8, F.lit("another"), F.lit("a text ")).alias("text"), _when(k, 83, 9, 5, 4).alias("token_count"),
    )
    rows = rows.union(rows.where("k % 83 = 1")).drop("k")
    return _counts(validate.retrieval_rules(rows, nodes))


# ---- tokens, statistics, indexes, results


@query(_expected("orders", error__TOKEN_COUNT_RECOMPUTE_MISMATCH="o_orderkey % 7 = 1", error__TOKEN_COUNT_RECOMPUTE_OVER_LIMIT="o_orderkey % 7 = 2", error__METADATA_TOKEN_OVER_LIMIT="o_orderkey % 7 = 3"))
def token_findings(spark, d):
    k = F.col("o_orderkey")
    doc = k.cast("string")
    o = read(spark, d, "orders")
    rows = o.select(doc.alias("doc_id"), F.lit("c1").alias("id"), _when(k, 7, 2, F.lit("a b c d e f g h i j"), F.lit("a b")).alias("text"), _when(k, 7, 1, 9, _when(k, 7, 2, 12, 4)).alias("token_count"))
    meta = o.select(doc.alias("doc_id"), F.lit("m").alias("node_id"), F.lit("metadata_structured").alias("node_type"), F.lit("Title: one two three").alias("content"), _when(k, 7, 3, F.lit('{"embedding_config":{"max_embedding_tokens":6}}'), F.lit('{"embedding_config":{"max_embedding_tokens":7}}')).alias("metadata"))
    return _counts([*validate.token_rules(rows, chunk.token_count(F.col("text")), 8), *validate.metadata_token_rules(meta, chunk.token_count(F.col("content")))])


def loader(name: str) -> str:
    """Stands for a tokenizer library: one that is there, one that isn't, one that fails."""
    if name == "absent":
        raise ImportError(name)
    if name == "broken":
        raise OSError(name)
    return name


@query(_expected("orders", warning__TOKENIZER_MODEL_UNKNOWN="o_orderkey % 5 = 1", warning__TOKENIZER_CHECK_UNAVAILABLE="o_orderkey % 5 = 2", error__TOKENIZER_LOAD_FAILED="o_orderkey % 5 = 3"))
def tokenizer_findings(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 1, " ").when(k % 5 == 2, "absent").when(k % 5 == 3, "broken").otherwise("there")
    return _counts(validate.tokenizer_rules(read(spark, d, "orders").select(k.cast("string").alias("doc_id"), name.alias("tokenizer")), loader))


@query(_expected("customer", error__GRAPH_STATS_MISMATCH="c_custkey % 5 in (1, 2)", warning__GRAPH_TOKEN_STAT_MISMATCH="c_custkey % 5 = 3"))
def statistics_findings(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k, k.cast("string").alias("doc_id"), F.lit(10).alias("total_nodes"), F.lit(4).alias("section_nodes"), F.lit(9).alias("max_chunk_tokens"))
    stored = c.select("doc_id", _when(k, 5, 1, 11, 10).alias("total_nodes"), _when(k, 5, 2, 5, 4).alias("section_nodes"), _when(k, 5, 3, 8, 9).alias("max_chunk_tokens"))
    return _counts(validate.statistics_rules(stored, c.drop("c_custkey")))


@query(_expected(
    "customer", error__INDEX_DOC_ID_MISMATCH="c_custkey % 23 = 1", error__INDEX_SOURCE_FILE_MISMATCH="c_custkey % 23 = 2", warning__INDEX_DISTANCE_SEMANTICS_UNCLEAR="c_custkey % 23 = 3", error__INDEX_CHUNK_CONFIG_MISMATCH="c_custkey % 23 = 4",
    warning__INDEX_MISSING="c_custkey % 23 in (5, 7)", error__INDEX_MANIFEST_MISSING="c_custkey % 23 = 6", error__INDEX_FILE_INCONSISTENT="c_custkey % 23 in (5, 7, 8)", error__INDEX_READ_FAILED="c_custkey % 23 = 9",
    error__INDEX_COUNT_MISMATCH="c_custkey % 23 in (10, 11, 12)",
))
def index_findings(spark, d):
    k = F.col("c_custkey")
    doc = k.cast("string")
    c = read(spark, d, "customer")
    meta = c.select(_when(k, 23, 1, F.concat(F.lit("x"), doc), doc).alias("doc_id"), F.lit("f").alias("source_file")).where("doc_id not like 'x%'")
    counts = c.select(doc.alias("doc_id"), F.lit("intro").alias("bucket"), F.lit(2).cast("long").alias("documents"))
    said = _when(k, 23, 3, F.lit("larger is better"), F.lit(index.SEMANTICS))
    manifest = c.where(~(k % 23).isin(6)).select(
        doc.alias("doc_id"), _when(k, 23, 2, F.lit("g"), F.lit("f")).alias("source_file"), F.lit("intro").alias("bucket"), _when(k, 23, 10, 3, 2).cast("long").alias("documents"), _when(k, 23, 11, 4, 3).alias("dimensions"), said.alias("distance_semantics"),
        _when(k, 23, 4, F.lit('{"limit":"9"}'), F.lit('{"limit":"480"}')).alias("chunking"),
    )
    vector = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    row = lambda bucket, v: F.struct(F.lit(bucket).alias("bucket"), v.alias("v"))
    rows = F.array_compact(F.array(row("intro", vector), F.when(k % 23 != 12, row("intro", vector)), F.when(k % 23 == 8, row("other", vector)), F.when(k % 23 == 9, row("intro", F.lit(None).cast("array<double>")))))
    stored = c.where(~(k % 23).isin(5, 7)).select(doc.alias("doc_id"), F.explode(rows).alias("x")).select("doc_id", "x.*")
    return _counts(validate.index_rules(manifest, meta, counts, stored, c.select(doc.alias("doc_id"), F.lit('{"limit":"480"}').alias("chunking"))))


@query(_expected("orders", error__RESULT_SUPPORT_UID_UNRESOLVED="o_orderkey % 11 = 1", error__RESULT_RENDER_UID_UNRESOLVED="o_orderkey % 11 = 2", error__RESULT_RENDER_TYPE_MISMATCH="o_orderkey % 11 = 3"))
def result_findings(spark, d):
    k = F.col("o_orderkey")
    doc = k.cast("string")
    o = read(spark, d, "orders")
    nodes = o.select(F.concat(doc, F.lit("::g1")).alias("evidence_uid"), F.lit("figure").alias("node_type"))
    use = lambda n, place, kind: F.struct(F.concat(doc, _when(k, 11, n, F.lit("::g9"), F.lit("::g1"))).alias("evidence_uid"), F.lit(place).alias("place"), kind.alias("expected_type"))
    used = o.select(doc.alias("doc_id"), F.explode(F.array(use(1, "support", F.lit("figure")), use(2, "render", _when(k, 11, 3, F.lit("table"), F.lit("figure"))))).alias("x")).select("doc_id", "x.*")
    return _counts(validate.result_rules(used, nodes))


@query(_expected(
    "supplier", error__GRAPH_FILE_MISSING="s_suppkey % 9 = 1", error__GRAPH_FILE_INVALID="s_suppkey % 9 = 2", error__RETRIEVAL_FILE_MISSING="s_suppkey % 9 = 3", error__RETRIEVAL_FILE_INVALID="s_suppkey % 9 = 4", error__RESULT_JSON_MISSING="s_suppkey % 9 = 5",
    error__RESULT_JSON_INVALID="s_suppkey % 9 = 6", error__INDEX_MANIFEST_MISSING="s_suppkey % 9 = 7", error__INDEX_MANIFEST_INVALID="s_suppkey % 9 = 8",
))
def file_findings(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier")
    kinds = ("graph", "retrieval", "result", "manifest")
    path = lambda kind: F.concat(F.lit(f"/{kind}/"), k.cast("string"))
    expected = s.select(k.cast("string").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), path(x).alias("path")) for x in kinds])).alias("x")).select("doc_id", "x.*")
    content = lambda n, kind: F.when(k % 9 == 2 * n + 2, "[1]").otherwise('{"a":1}\n\n{"b":2}' if kind == "retrieval" else '{"a":1}')
    have = [F.when(k % 9 != 2 * n + 1, F.struct(path(x).alias("path"), content(n, x).alias("content"))) for n, x in enumerate(kinds)]
    found = s.select(F.explode(F.array_compact(F.array(*have))).alias("x")).select("x.*")
    return _counts(validate.file_rules(expected, found))


@query(_expected("supplier", error__FIGURE_IMAGE_NOT_FOUND="s_suppkey % 4 = 1", warning__SOURCE_DOCUMENT_NOT_FOUND="s_suppkey % 4 = 2"))
def asset_findings(spark, d):
    k = F.col("s_suppkey")
    doc = k.cast("string")
    s = read(spark, d, "supplier")
    image = F.when(k % 4 == 3, "http://x/a.png").otherwise(F.concat(F.lit("a"), doc, F.lit(".png")))
    nodes = s.select(doc.alias("doc_id"), F.lit("g1").alias("node_id"), F.lit("figure").alias("node_type"), F.concat(F.lit('{"image_path":"'), image, F.lit('"}')).alias("metadata"))
    meta = s.select(doc.alias("doc_id"), F.concat(doc, F.lit(".md")).alias("source_file"))
    there = s.select(F.explode(F.array_compact(F.array(F.when(k % 4 != 1, F.concat(F.lit("file:///r/images/a"), doc, F.lit(".png"))), F.when(k % 4 != 2, F.concat(F.lit("/r/"), doc, F.lit(".md")))))).alias("path"))
    return _counts(validate.asset_rules(nodes, meta, there, ["/q", "/r", "/r/images/"]))


@query("select s_suppkey::varchar as doc_id, 'INDEX_DEEP_CHECK_UNAVAILABLE' as code from supplier")
def dependency_findings(spark, d):
    meta = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"))
    return validate.findings(validate.deep_check_rule(meta, "a_module_that_is_nowhere") + validate.deep_check_rule(meta, "json")).select("doc_id", "code")


# ---- rewriting rules, front matter, sources

_REWRITES = [
    ("elements", T.normalize_elements, [(r"$\mathrm{{Cr}}$", "Cr"), (r"$\mathrm{Ni}$", "Ni"), (r"$\mathbf{{Ti}}$", "Ti"), (r"$\mathbf{Al}$", "Al")]),
    ("phases", T.normalize_phases, [(r"${\gamma }^{\prime }$", "γ′"), (r"$\delta$ $\mu$ $\chi$ $\beta$ $\eta$ $\gamma$", "δ μ χ β η γ"), (r"$\gamma / {\gamma }^{\prime }$", "γ / γ′"), (r"$\gamma + \gamma$", "γ + γ"), (r"$\gamma - {\gamma}^{\prime}$", "γ - γ′"), (r"$> \mathrm{{Co}} > \mathrm{{W}}$", "> Co > W"), ("γ ’", "γ′")]),
    ("temperatures", T.normalize_temperatures, [(r"${N}^{ \circ }\mathrm{C}$", "N °C"), (r"${N}{}^{ \circ }\mathrm{C}$", "N °C"), (r"${N}\mathrm{\;h}$", "N h"), (r"${N}\mathrm{h}$", "N h"), (r"${N}^{\circ}\mathrm{C}/{N}\mathrm{\;h}$", "N °C / N h"), (r"$N\mathrm{\;h}$", "N h"), (r"${N}^{\circ}\mathrm{C}/\mathrm{{min}}$", "N °C/min"), (r"${N}^{\circ}\mathrm{C}/\mathrm{min}$", "N °C/min")]),
    ("units", T.normalize_units, [(r"${N\mu }\mathrm{m}$", "N μm"), (r"$N\mathrm{\;{mm}}$", "N mm"), (r"${N}\mathrm{{kV}}$", "N kV"), (r"${N}\mathrm{{pJ}}$", "N pJ"), (r"${N}\mathrm{{kHz}}$", "N kHz"), (r"${N}\mathrm{\;K}$", "N K"), (r"N$\%$", "N%"), (r"${N}\mathrm{\;{nm}}$", "N nm"), (r"${N.5}\mathrm{\;{nm}}$", "N.5 nm"), (r"$N.5\mathrm{\;{nm}}$", "N.5 nm"), (r"${N.5\mu }\mathrm{m}$", "N.5 μm"), (r"$\mu \mathrm{m}$", "μm")]),
    ("primes", T.normalize_primes, [("γ ’", "γ′"), ("γ'", "γ′"), ("γ ′", "γ′")]),
    ("notation", T.normalize_notation, [("γ/γ’", "γ / γ′"), ("γ/γ", "γ / γ"), ("γ+γ'", "γ + γ′"), ("γ-γ′", "γ - γ′")]),
]


def _filled(text: str, sql: bool):
    if sql:
        return "'" + text.replace("'", "''").replace("N", "' || p_size || '") + "'"
    parts = text.split("N")
    return F.concat(*[x for n, p in enumerate(parts) for x in ([F.col("p_size").cast("string")] if n else []) + [F.lit(p)]])


def _numbered(name: str, texts: list[str]) -> list[str]:
    return texts if name not in ("elements", "phases") else [t.replace("N", "\x00") for t in texts]


@query("select p_partkey, " + ", ".join(" || ' and ' || ".join(_filled(b, True) for b in _numbered(name, [b for _, b in pairs])).replace("\x00", "N") + f" as {name}" for name, _, pairs in _REWRITES) + " from part")
def rewriting_rules(spark, d):
    rows = read(spark, d, "part")
    for name, _, pairs in _REWRITES:
        texts = _numbered(name, [a for a, _ in pairs])
        body = [_filled(t, False) for t in texts]
        whole = [x for n, b in enumerate(body) for x in ([F.lit(" and ")] if n else []) + [b]]
        rows = rows.withColumn(name, F.replace(F.concat(*whole), F.lit("\x00"), F.lit("N")))
    return rows.select("p_partkey", *[use(F.col(name)).alias(name) for name, use, _ in _REWRITES])


@query("""
select p_partkey, 'see [' || p_size || ',' || (p_size + 1) || '-' || (p_size + 3) || ']' as cited, 'a b' || chr(10) || chr(10) || 'c' as text, 'a b c' as line, 'x; y' as listed, 'a,b' as kept, case when p_partkey % 3 < 2 then true else false end as remote,
 'T' || p_partkey || ', ' || p_size as citation from part""")
def text_functions(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    more = lambda n: (size + n).cast("string")
    cited = F.concat(F.lit(r"see $\left\lbrack {{"), size.cast("string"), F.lit("},{"), more(1), F.lit("} - {"), more(3), F.lit(r"}}\right\rbrack$"))
    uri = F.when(k % 3 == 0, "HTTPS://x").when(k % 3 == 1, "data:image/png").otherwise("a/b.png")
    lit = lambda *x: F.array(*map(F.lit, x))
    return read(spark, d, "part").select(
        "p_partkey", T.normalize_citations(cited).alias("cited"), T.normalize_text(F.lit("\r\na \t b\n\n\n\nc\xa0 ")).alias("text"), T.one_line(F.lit(" a\n\tb  c ")).alias("line"), T.joined(lit(" x", "", " ", "y ")).alias("listed"),
        _joined(T.distinct_in_order(lit("a", " b", "a ", "", "b"))).alias("kept"), T.is_remote(uri).alias("remote"), J.citation(F.concat(F.lit("T"), k), size, F.lit(" ")).alias("citation"),
    )


#: Papers whose body begins in another way, and how.
_STARTS = [
    ("# T\n\n## Abstract\nA.\n\n## 1. Introduction\nB.", "introduction", "## 1. Introduction\nB."),
    ("# T\n\n## Background of it\nB.\n\n## Results\nC.", "background", "## Background of it\nB.\n\n## Results\nC."),
    ("# T\n\n## Keywords\nK.\n\n## 2 Methods\nB.", "recognized_body_heading", "## 2 Methods\nB."),
    ("# T\n\n## Highlights\nK.\n\n## Thoughts\nB.", "first_non_front_matter_heading", "## Thoughts\nB."),
    ("# T\n\n## Abstract\nA.", "no_body_heading", ""),
    ("# T\nText.", "no_level2_heading", ""),
]


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("select p_partkey, case p_partkey % 6 " + " ".join(f"when {n} then '{rule}'" for n, (_, rule, _) in enumerate(_STARTS)) + " end as strategy, case p_partkey % 6 " + " ".join(f"when {n} then {_sql_text(md[: len(md) - len(body)].strip())}" for n, (md, _, body) in enumerate(_STARTS)) + " end as metadata_block from part")
def body_starts(spark, d):
    md = F.get(F.array(*[F.lit(x) for x, _, _ in _STARTS]), (F.col("p_partkey") % 6).cast("int"))
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("f").alias("source_file"), md.alias("md_text"))
    return parse.documents(docs).select(F.col("doc_id").alias("p_partkey"), "strategy", "metadata_block")


#: Markdown before and after cleaning; N is the part's number.
_CLEANED = [
    ("# T\r\n\r\n## 1. Introduction\r\nA  b , c.\n\n---\n* Corresponding author: N.\n---\n\nMore.\n\n\n\nEnd.", "# T\n\n---\n* Corresponding author: N.\n---\n\n## Introduction\nA b, c.\n\nMore.\n\nEnd.\n"),
    ("## 2. Results\n![x](iN.png)\n\nFigure 2. A  curve.\nText.", "## Results\n![x](iN.png)\n# Figure 2. A curve.\nText.\n"),
    ("## Results\nTable N\nMeasured\nvalues\n<table><tr><td>1</td></tr></table>\nText.", "## Results\n# Table N Measured values\n<table><tr><td>1</td></tr></table>\nText.\n"),
    ("## Results\n$$x  =  {N} ,$$ and  ( y ).", "## Results\n$$x  =  {N} ,$$ and (y).\n"),
    ("## Results\n---\nNo cue here.\n---\nText.", "## Results\n---\nNo cue here.\n---\nText.\n"),
]


@query("select p_partkey, case p_partkey % 5 " + " ".join(f"when {n} then replace({_sql_text(b)}, 'N', p_partkey::varchar)" for n, (_, b) in enumerate(_CLEANED)).replace("No cue", "o cue") + " end as md_text from part")
def cleaned_papers(spark, d):
    md = F.replace(F.get(F.array(*[F.lit(a.replace("No cue", "o cue")) for a, _ in _CLEANED]), (F.col("p_partkey") % 5).cast("int")), F.lit("N"), F.col("p_partkey").cast("string"))
    return clean.clean_markdown(read(spark, d, "part").select("p_partkey", md.alias("md_text")))


#: Tables and what is read from them.
_GRIDS = [
    ('<table><tr><th rowspan="2">N</th><th colspan="2">A</th></tr><tr><th>x</th><th>y</th></tr><tr><td>a</td><td>1</td><td>2</td></tr></table>', "N,A_x,A_y", "a,1,2", 2),
    ("<table><tr><td>Alloy</td><td>Value</td></tr><tr><td>5</td><td>6</td></tr><tr><td>7</td></tr></table>", "Alloy,Value", "5,6,7,", 1),
    ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", "1,2", "3,4", 1),
    ("<table><tr><th>a</th><th>a</th></tr></table>", "a,a", "", 1),
    ('<table><tr><th colspan="²">a</th><th></th></tr><tr><td>b</td><td rowspan="9">c</td></tr></table>', "a,col_2", "b,c", 1),
    ("<table></table>", "", "", 0),
]


@query("select p_partkey, " + ", ".join(f"case p_partkey % 6 {' '.join(f'when {n} then {v[c]!r}' for n, v in enumerate(_GRIDS))} end as {name}" for c, name in ((1, "columns"), (2, "cells"), (3, "start"))) + " from part")
def grid_shapes(spark, d):
    html = F.get(F.array(*[F.lit(g[0]) for g in _GRIDS]), (F.col("p_partkey") % 6).cast("int"))
    md = F.concat(F.lit("## Results\n# Table 1 T\n"), html, F.lit("\nEnd."))
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("f").alias("source_file"), md.alias("md_text"))
    rows = parse.exploded(parse.documents(docs), "tables")
    return rows.select(F.col("doc_id").alias("p_partkey"), _joined(F.col("data.columns")).alias("columns"), _joined(F.flatten("data.rows")).alias("cells"), F.col("data.data_start_row").alias("start"))


@query("select s_suppkey, policy from supplier, unnest(['objects', 'lenient']) as u(policy) where s_suppkey % 4 < 2")
def json_lines(spark, d):
    folder = new_folder(spark, "lines")
    k = F.col("s_suppkey")
    line = F.when(k % 4 < 2, F.to_json(F.struct("s_suppkey", "s_name"))).when(k % 4 == 2, F.lit("[1, 2]")).otherwise("")
    read(spark, d, "supplier").select(line.alias("value")).write.text(f"{folder}/objects")
    read(spark, d, "supplier").select(F.when(k % 4 == 3, "{broken").otherwise(line).alias("value")).write.text(f"{folder}/lenient")
    rows = lambda p: files.read_jsonl(spark, f"{folder}/{p}", "s_suppkey long, s_name string", p).select("s_suppkey", F.lit(p).alias("policy"))
    return rows("objects").union(rows("lenient"))


@query("select s_suppkey, s_name, s_acctbal from supplier")
def json_objects(spark, d):
    folder = new_folder(spark, "objects")
    files.write_json(read(spark, d, "supplier"), folder)
    return files.read_json(spark, folder, "s_suppkey long, s_name string, s_acctbal double")


@query("select s_suppkey, 'a' || s_suppkey || ',b/c,d' as paths from supplier")
def nested_paths(spark, d):
    said = F.concat(F.lit('{"files": [{"path": "a'), F.col("s_suppkey").cast("string"), F.lit('"}, ["b/c"]], "n": 3, "last": {"x": {"y": "d"}}}'))
    return read(spark, d, "supplier").select("s_suppkey", _joined(index.pathlike(said)).alias("paths"))


@query("""
select s_suppkey, case s_suppkey % 5 when 0 then 'http://x/a.png' when 1 then 'data:image/png;base64,' || to_base64('h'::blob) when 2 then 'data:image/jpeg;base64,' || to_base64('p'::blob) when 3 then 'data:image/png;base64,' || to_base64('b'::blob) end as image_uri from supplier""")
def image_addresses(spark, d):
    k = F.col("s_suppkey")
    image = F.when(k % 5 == 0, "http://x/a.png").when(k % 5 == 1, "i/h.png").when(k % 5 == 2, "i/p.jpg").when(k % 5 == 3, "/abs/b.png").otherwise("i/none.png")
    figures = read(spark, d, "supplier").select("s_suppkey", image.alias("image_path"), F.lit("").alias("image_url"), F.lit("/w/doc").alias("base_dir"))
    found = [("file:/w/doc/i/h.png", b"h"), ("/w/i/h.png", b"x"), ("/w/i/p.jpg", b"p"), ("/abs/b.png", b"b")]
    images = spark.createDataFrame(found, "path string, content binary")
    return files.image_uris(figures, images).select("s_suppkey", "image_uri")


@query("select s_suppkey::varchar as doc_id, s_suppkey || '.pdf' as source_file, '# ' || s_name as md_text from supplier where s_suppkey % 3 = 1")
def converted_files(spark, d):
    """Of files of which a third were converted before, and a third can't be."""
    k = F.col("s_suppkey").cast("string")
    s = read(spark, d, "supplier")
    found = s.select(F.concat(F.lit("/in/"), k, F.lit(".pdf")).alias("path"), F.when(F.col("s_suppkey") % 3 == 2, "").otherwise(F.col("s_name")).cast("binary").alias("content"))
    done = s.where("s_suppkey % 3 = 0").select(k.alias("doc_id"))
    client = lambda x: x.map(lambda b: f"# {bytes(b).decode()}" if len(b) else None)
    return files.converted(found, client, done).select("doc_id", "source_file", "md_text")


# ---- reranking, caps of text, captions, set differences


@query("""
with h as (select o_custkey as query_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r, o_orderkey % 3 as hit from orders),
s as (select *, case hit when 0 then 1.0 when 1 then 0.5 else 0.0 end::double as score, row_number() over (partition by query_id order by case hit when 0 then 0 when 1 then 1 else 2 end, r) as rank from h where r <= 20)
select query_id, o_orderkey, score, r::int as retrieval_rank, rank::int as rank from s where rank <= 10""")
def reranked(spark, d):
    w = "row_number() over (partition by o_custkey order by o_orderkey)"
    text = F.get(F.array(F.lit("red widget here"), F.lit("a Red one"), F.lit("none")), (F.col("o_orderkey") % 3).cast("int"))
    hits = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", F.expr(w).alias("rank"), F.lit("Red widget").alias("query"), text.alias("text")).where("rank <= 20")
    return retrieve.rerank(hits, retrieve.overlap_score, 10).select("query_id", "o_orderkey", F.col("rerank_score").alias("score"), "retrieval_rank", "rank")


@query("""
select o_custkey as query_id, 'c' || o_orderkey as evidence_uid, 'chunks' as bucket from orders union all select o_custkey, 'f' || o_orderkey, 'figures' from orders where o_orderkey % 2 = 0""")
def captions_appended(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey")
    kept = o.select("query_id", F.concat(F.lit("c"), "o_orderkey").alias("evidence_uid"), F.lit("chunks").alias("bucket")).union(o.select("query_id", F.concat(F.lit("g"), "o_orderkey"), F.lit("figures")))
    captions = o.select("query_id", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("f"), "o_orderkey")).otherwise(F.concat(F.lit("c"), "o_orderkey")).alias("evidence_uid"), F.lit("figures").alias("bucket"))
    return retrieve.ablated(kept, "wo_association", captions)


@query("select o_orderkey, o_orderkey::varchar as doc_id, 'n1' as node_id from orders where o_orderkey % 3 < 2")
def resolved_uids(spark, d):
    k = F.col("o_orderkey")
    doc = k.cast("string")
    o = read(spark, d, "orders")
    nodes = o.select(doc.alias("doc_id"), F.lit("n1").alias("node_id"), F.lit("figure").alias("node_type"), F.when(k % 3 == 0, F.concat(F.lit("own-"), doc)).otherwise(F.lit("")).alias("evidence_uid"))
    uids = o.select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("own-"), doc)).when(k % 3 == 1, F.concat(doc, F.lit("::n1"))).otherwise(F.concat(doc, F.lit("::n2"))).alias("evidence_uid"))
    return graph.resolve_uids(uids, nodes).select("o_orderkey", "doc_id", "node_id")


@query("select s_suppkey as query_id, case s_suppkey % 4 when 0 then 20 when 1 then 1 when 2 then 5 else 20 end as k, case s_suppkey % 4 when 0 then 10 when 1 then 1 when 2 then 5 else 3 end as n, case when s_suppkey % 2 = 0 then 'qa' else 'extraction' end as task from supplier")
def depths_and_tasks(spark, d):
    """Driver-side choices, by query."""
    cases = [(None, None, "Literature-QA"), (-3, 4, "extract"), (5, 9, "qa"), (0, 3, "structured_extraction")]
    rows = [(i, *retrieve.depth(k, n), retrieve.task_mode(t)) for i, (k, n, t) in enumerate(cases)]
    said = spark.createDataFrame(pd.DataFrame(rows, columns=["i", "k", "n", "task"]), "i long, k int, n int, task string")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id")).join(F.broadcast(said), F.col("query_id") % 4 == F.col("i")).select("query_id", "k", "n", "task")


@query("""
select o_orderkey, 1::bigint as first, (o_orderkey * 1000 + 1) as last, o_orderkey % 5 as singles from orders""")
def citation_spans(spark, d):
    k = F.col("o_orderkey")
    some = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.when(n <= k % 5, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise("")), "")
    text = F.concat(F.lit("[1–"), (k * 1000 + 1).cast("string"), F.lit("] [9-3] "), some)
    spans = read(spark, d, "orders").select("o_orderkey", M.citation_spans(text).alias("s"))
    return spans.select("o_orderkey", F.col("s")[0]["first"].alias("first"), F.col("s")[0]["last"].alias("last"), (F.size("s") - 1).cast("long").alias("singles"))


@query("select n_nationkey, 2 as shared, 16 as width, round(1.0::double, 6) as norm from nation")
def hashed_vectors(spark, d):
    """The default embedder: its width, its length, and the product of two texts that share half of their tokens."""
    texts = read(spark, d, "nation").select("n_nationkey", F.lit("aa bb").alias("text"))
    v = embed.embedded(texts, "text", lambda x: embed.hashing(x, 16))
    raw = F.size(F.filter("v", lambda x: x > 0))
    return v.select("n_nationkey", raw.alias("shared"), F.size("v").alias("width"), F.round(F.sqrt(retrieve.inner_product(F.col("v"), F.col("v"))), 6).alias("norm"))
