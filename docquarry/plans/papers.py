"""Registered queries over whole papers: one made from each part by the same rule in Spark and in SQL, built into tables, asked and answered."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, embed, graph, parse, profiles, render, retrieve, validate
from ..sources import index
from ..sources.shared import new_folder
from . import pipeline
from .registry import _joined, query, read

#: The folder of built tables, and those that are in it, by application and input: queries of one session share them.
_FOLDERS: dict[tuple[str, str], tuple[str, set[str]]] = {}


def _run(k: Column) -> Column:
    return F.concat(F.lit("r"), F.lpad(k, 6, "0"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """A paper in Markdown for each part: sections, a figure, a table, an equation, mentions and references."""
    k = F.col("p_partkey").cast("string")
    size = F.concat(F.lit("${"), F.col("p_size").cast("string"), F.lit(r"\mu }\mathrm{m}$"))
    md = F.concat(
        F.lit("# Paper "), k, F.lit("\n\n## Abstract\nShort.\n\n## 1. Introduction\nAs [1-3] show, Fig. 1 and Table 1 hold.\n\n![](images/a"), k, F.lit(".png)\nFig. 1. A "), F.col("p_name"),
        F.lit(" curve.\n\n## 2. Experimental details\nBy Eq. (1) with $$a = "), k, F.lit(" \\tag{1}$$ done.\n\nTable 1\nMeasured values\n<table><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>"), k,
        F.lit("</td></tr></table>\n\n## 3. Results\nThe "), F.col("p_name"), F.lit(" is "), size, F.lit(" wide in run "), _run(k), F.lit(".\n\nIt works.\n\n### 3.1. Details\nSee Fig. 1, Fig. 9 and Eq. (1) in "), _run(k),
        F.lit(".\n\n## References\n[1] A first one.\n[2] A second\none.\n[3] A third one.\n"),
    )
    return read(spark, d, "part").select(k.alias("doc_id"), F.lit("paper.md").alias("source_file"), md.alias("md_text"))


def scholar(prompts: pd.Series) -> pd.Series:
    """Stands for a model that reads front matter: by the number of the paper it answers in a fence, within prose, or not at all."""

    def said(prompt: str) -> str | None:
        k = int(re.search(r"^Document: (\d+)$", prompt, re.M)[1])
        body = f'{{"bibliography": {{"title": "Paper {k}", "year": {2000 + k % 20}, "journal": "J", "keywords": ["k{k}", " ", "kw"]}}, "abstract_profile": {{"abstract": "one two three four five six"}}}}'
        return (f"```json\n{body}\n```", f"It is {body} so.", "I can't.")[k % 3]

    return prompts.map(said)


def built(spark: SparkSession, d: str) -> pipeline.Built:
    """The tables of all sheets; each is written once for a session and an input, when a query first asks for it."""
    key = spark.sparkContext.applicationId, d
    if key not in _FOLDERS:
        _FOLDERS[key] = new_folder(spark, "sheets"), set()
    folder, done = _FOLDERS[key]
    return pipeline.build(sheets(spark, d), keep=folder, client=scholar, done=done)


# What SQL says of a sheet: its number, name, size and run.
K, RUN = "p_partkey::varchar", "'r' || lpad(p_partkey::varchar, 6, '0')"
WIDE = f"'The ' || p_name || ' is ' || p_size || ' μm wide in run ' || {RUN} || '.'"
DETAIL = f"'See Fig. 1, Fig. 9 and Eq. (1) in ' || {RUN} || '.'"
ROWS = "'<table><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>' || p_partkey || '</td></tr></table>'"
REFS = "'[1] A first one.' || chr(10) || '[2] A second' || chr(10) || 'one.' || chr(10) || '[3] A third one.'"
NAME_TOKENS = "len(string_split(p_name, ' '))"


def _values(names: str, *rows: str) -> str:
    """Rows for each part; texts may use its columns."""
    some = " union all ".join(f"select {', '.join(f'{x} as {n}' for x, n in zip(row.split('; '), names.split(), strict=True))} from part" for row in rows)
    return some


@query(f"""
select {K} as doc_id, '# Paper ' || p_partkey || chr(10) || chr(10) || '## Abstract' || chr(10) || 'Short.' as metadata_block, 'introduction' as strategy,
 4 as n_sections, 1 as n_equations, 1 as n_tables, 1 as n_figures, 1 as n_additional from part""")
def sheet_blocks(spark, d):
    parsed = built(spark, d).parsed
    return parsed.select("doc_id", "metadata_block").join(parse.processing_info(parsed), "doc_id").select("doc_id", "metadata_block", "strategy", "n_sections", "n_equations", "n_tables", "n_figures", "n_additional")


@query(_values(
    "doc_id ord section_id section_number section_title level parent_section_id path content refs",
    f"{K}; 1; 'sec_1'; '1'; 'Introduction'; 1; null; '1 Introduction'; 'As [1-3] show, Fig. 1 and Table 1 hold.'; ''",
    f"{K}; 2; 'sec_2'; '2'; 'Experimental details'; 1; null; '2 Experimental details'; 'By Eq. (1) with [EQUATION:eq_1] done.'; 'eq_1'",
    f"{K}; 3; 'sec_3'; '3'; 'Results'; 1; null; '3 Results'; {WIDE} || chr(10) || chr(10) || 'It works.'; ''",
    f"{K}; 4; 'sec_3_1'; '3.1'; 'Details'; 2; 'sec_3'; '3 Results > 3.1 Details'; {DETAIL}; ''",
))
def sheet_sections(spark, d):
    rows = parse.exploded(built(spark, d).parsed, "sections")
    own = T.last_of(F.col("hierarchy"), "section_title")
    return rows.where(own == F.col("section_title")).select("doc_id", "ord", "section_id", "section_number", "section_title", "level", "parent_section_id", T.section_path(F.col("hierarchy")).alias("path"), "content", _joined(F.col("equation_refs")).alias("refs"))


@query(_values(
    "doc_id kind object_id number caption body",
    f"{K}; 'figure'; 'fig_1'; 'Fig. 1'; 'Fig. 1. A ' || p_name || ' curve.'; 'images/a' || p_partkey || '.png'",
    f"{K}; 'table'; 'table_1'; 'Table 1'; 'Table 1 Measured values'; {ROWS}",
    f"{K}; 'equation'; 'eq_1'; '1'; 'Equation 1'; 'a = ' || p_partkey || ' \\tag{{1}}'",
    f"{K}; 'additional'; '1'; 'References'; 'References'; {REFS}",
))
def sheet_objects(spark, d):
    parsed = built(spark, d).parsed
    s = lambda c: F.col(c).cast("string")
    part = lambda name, kind, *c: parse.exploded(parsed, name).select("doc_id", F.lit(kind).alias("kind"), *[s(x).alias(n) for x, n in zip(c, ("object_id", "number", "caption", "body"), strict=True)])
    figures, tables = part("figures", "figure", "figure_id", "figure_number", "caption", "image_path"), part("tables", "table", "table_id", "table_number", "caption", "raw_html")
    equations = part("equations", "equation", "equation_id", "equation_number", "equation_label", "latex")
    return figures.union(tables).union(equations).union(part("additional", "additional", "ord", "additional_info_title", "additional_info_title", "content"))


@query(f"select {K} as doc_id, 1 as ord, 'eq_1' as equation_id, 'sec_2' as section_id, '2 Experimental details' as section_title_full, 1 as depth from part")
def sheet_equation_context(spark, d):
    return parse.equations_in_context(built(spark, d).parsed).select("doc_id", "ord", "equation_id", "section_id", "section_title_full", F.size("hierarchy").alias("depth"))


@query(_values("doc_id ord number node_id content", f"{K}; 1; '1'; 'ref_1'; 'A first one.'", f"{K}; 2; '2'; 'ref_2'; 'A second one.'", f"{K}; 3; '3'; 'ref_3'; 'A third one.'"))
def sheet_references(spark, d):
    return parse.references(built(spark, d).parsed).select("doc_id", "ord", "number", "node_id", "content")


_WIDE_TOKENS, _DETAIL_TOKENS = f"{NAME_TOKENS} + 11", "19"


@query(_values(
    "doc_id node_id text token_count local_order total_chunks global_order prev_chunk_id next_chunk_id",
    f"{K}; 'sec_1__chunk_1'; 'As [1-3] show, Fig. 1 and Table 1 hold.'; 18; 1; 1; 1; null; null",
    f"{K}; 'sec_2__chunk_1'; 'By Eq. (1) with [EQUATION:eq_1] done.'; 16; 1; 1; 2; null; null",
    f"{K}; 'sec_3__chunk_1'; {WIDE}; {_WIDE_TOKENS}; 1; 2; 3; null; 'sec_3__chunk_2'",
    f"{K}; 'sec_3__chunk_2'; 'It works.'; 5; 2; 2; 4; 'sec_3__chunk_1'; null",
    f"{K}; 'sec_3_1__chunk_1'; {DETAIL}; {_DETAIL_TOKENS}; 1; 1; 5; null; null",
))
def sheet_chunks(spark, d):
    return built(spark, d).chunks.select("doc_id", "node_id", "text", "token_count", "local_order", "total_chunks", "global_order", "prev_chunk_id", "next_chunk_id")


@query(_values(
    "doc_id node_id figures tables equation_ids equation_numbers cited nearby",
    f"{K}; 'sec_1__chunk_1'; 'Fig. 1'; 'Table 1'; ''; ''; 'ref_1,ref_2,ref_3'; 'fig_1,ref_1,ref_2,ref_3,table_1'",
    f"{K}; 'sec_2__chunk_1'; ''; ''; 'eq_1'; '1'; ''; 'eq_1'",
    f"{K}; 'sec_3__chunk_1'; ''; ''; ''; ''; ''; ''",
    f"{K}; 'sec_3__chunk_2'; ''; ''; ''; ''; ''; ''",
    f"{K}; 'sec_3_1__chunk_1'; 'Fig. 1,Fig. 9'; ''; ''; '1'; ''; 'eq_1,fig_1'",
))
def sheet_mentions(spark, d):
    names = {"mentioned_figures": "figures", "mentioned_tables": "tables", "mentioned_equation_ids": "equation_ids", "mentioned_equation_numbers": "equation_numbers", "mentioned_references": "cited", "nearby_evidence_ids": "nearby"}
    return built(spark, d).chunks.select("doc_id", "node_id", *[_joined(F.col(c)).alias(n) for c, n in names.items()])


_TITLED = "case when p_partkey % 3 < 2 then 'Paper ' || p_partkey else 'Structured document metadata' end"
_META_TEXT = "case when p_partkey % 3 < 2 then 'Title: Paper ' || p_partkey || chr(10) || 'Keywords: k' || p_partkey || chr(59) || ' kw' || chr(10) || 'Abstract: one two three four five six' else 'Structured document metadata' end"


@query(_values(
    "doc_id node_id node_type title content section_id section_path order_index",
    f"{K}; 'metadata_structured'; 'metadata_structured'; {_TITLED}; {_META_TEXT}; null; null; null",
    f"{K}; 'metadata_1'; 'metadata'; 'Metadata'; '# Paper ' || p_partkey || chr(10) || chr(10) || '## Abstract' || chr(10) || 'Short.'; null; null; 0",
    f"{K}; 'sec_1'; 'section'; '1 Introduction'; 'As [1-3] show, Fig. 1 and Table 1 hold.'; 'sec_1'; '1 Introduction'; 1",
    f"{K}; 'sec_2'; 'section'; '2 Experimental details'; 'By Eq. (1) with [EQUATION:eq_1] done.'; 'sec_2'; '2 Experimental details'; 2",
    f"{K}; 'sec_3'; 'section'; '3 Results'; {WIDE} || chr(10) || chr(10) || 'It works.'; 'sec_3'; '3 Results'; 3",
    f"{K}; 'sec_3_1'; 'section'; '3.1 Details'; {DETAIL}; 'sec_3_1'; '3 Results > 3.1 Details'; 4",
    f"{K}; 'sec_1__chunk_1'; 'section_chunk'; '1 Introduction'; 'As [1-3] show, Fig. 1 and Table 1 hold.'; 'sec_1'; '1 Introduction'; 1",
    f"{K}; 'sec_2__chunk_1'; 'section_chunk'; '2 Experimental details'; 'By Eq. (1) with [EQUATION:eq_1] done.'; 'sec_2'; '2 Experimental details'; 2",
    f"{K}; 'sec_3__chunk_1'; 'section_chunk'; '3 Results'; {WIDE}; 'sec_3'; '3 Results'; 3",
    f"{K}; 'sec_3__chunk_2'; 'section_chunk'; '3 Results'; 'It works.'; 'sec_3'; '3 Results'; 4",
    f"{K}; 'sec_3_1__chunk_1'; 'section_chunk'; '3.1 Details'; {DETAIL}; 'sec_3_1'; '3 Results > 3.1 Details'; 5",
    f"{K}; 'fig_1'; 'figure'; 'Fig. 1'; 'Fig. 1. A ' || p_name || ' curve.'; 'sec_1'; '1 Introduction'; 1",
    f"{K}; 'table_1'; 'table'; 'Table 1'; 'Table 1 Measured values' || chr(10) || 'Columns: Name | Value' || chr(10) || 'a | ' || p_partkey; 'sec_1'; '1 Introduction'; 1",
    f"{K}; 'eq_1'; 'equation'; 'Equation 1'; 'a = ' || p_partkey || ' \\tag{{1}}'; 'sec_2'; null; 1",
    *[f"{K}; 'ref_{n}'; 'reference'; 'Reference {n}'; 'A {x} one.'; null; null; {n}" for n, x in ((1, "first"), (2, "second"), (3, "third"))],
    f"{K}; 'additional_1'; 'additional_info'; 'References'; {REFS}; null; null; 1",
))
def sheet_nodes(spark, d):
    return built(spark, d).nodes.select("doc_id", "node_id", "node_type", "title", "content", "section_id", "section_path", "order_index")


_CITES = [("sec_1__chunk_1", "figure", "fig_1"), ("sec_1__chunk_1", "table", "table_1"), *[("sec_1__chunk_1", "reference", f"ref_{n}") for n in (1, 2, 3)], ("sec_2__chunk_1", "equation", "eq_1"), ("sec_3_1__chunk_1", "figure", "fig_1")]
_EDGES = [(a, f"cites_{k}", b, "") for a, k, b in _CITES] + [(b, "referenced_by_chunk", a, "") for a, _, b in _CITES]
_EDGES += [("sec_2__chunk_1", "cites_equation", "eq_1", "::num"), ("sec_3_1__chunk_1", "cites_equation", "eq_1", "::num"), ("sec_3", "parent_of_section", "sec_3_1", ""), ("sec_3_1", "child_of_section", "sec_3", "")]
_EDGES += [("sec_1", "contains_figure", "fig_1", ""), ("sec_1", "contains_table", "table_1", ""), ("sec_2", "contains_equation", "eq_1", ""), ("sec_3__chunk_1", "next_chunk", "sec_3__chunk_2", ""), ("sec_3__chunk_2", "prev_chunk", "sec_3__chunk_1", "")]
_EDGES += [(s, "has_chunk", f"{s}__chunk_{n}", "") for s, n in (("sec_1", 1), ("sec_2", 1), ("sec_3", 1), ("sec_3", 2), ("sec_3_1", 1))]


@query(_values("doc_id edge_id source target relation", *[f"{K}; '{a}::{r}::{b}{x}'; '{a}'; '{b}'; '{r}'" for a, r, b, x in _EDGES]))
def sheet_edges(spark, d):
    return built(spark, d).edges.select("doc_id", "edge_id", "source", "target", "relation")


@query(_values("doc_id way node_id relation other", *[f"{K}; 'out'; '{a}'; '{r}'; '{b}'" for a, r, b, _ in _EDGES if a == "sec_3_1__chunk_1"], *[f"{K}; 'in'; '{b}'; '{r}'; '{a}'" for a, r, b, _ in _EDGES if b == "eq_1" and r == "cites_equation"]))
def sheet_adjacency(spark, d):
    edges = built(spark, d).edges
    out = graph.out_edges(edges, "sec_3_1__chunk_1").select("doc_id", F.lit("out").alias("way"), F.col("source").alias("node_id"), "relation", F.col("target").alias("other"))
    return out.union(graph.in_edges(edges, "eq_1", "cites_equation").select("doc_id", F.lit("in"), "target", "relation", "source"))


@query(f"""
select {K} as doc_id, 18 as total_nodes, {len(_EDGES)} as total_edges, 4 as section_nodes, 5 as section_chunk_nodes, 3 as reference_nodes, greatest(19, {_WIDE_TOKENS})::int as max_chunk_tokens,
 round((18 + 16 + {_WIDE_TOKENS} + 5 + 19) / 5.0, 2)::double as mean_chunk_tokens from part""")
def sheet_statistics(spark, d):
    return built(spark, d).statistics().select("doc_id", "total_nodes", "total_edges", "section_nodes", "section_chunk_nodes", "reference_nodes", "max_chunk_tokens", "mean_chunk_tokens")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.checked(built(spark, d), keep=new_folder(spark, "findings"))


@query(f"select {K} as doc_id, 'warning' as severity, 'MENTION_UNRESOLVED' as code, 1 as n, 'sec_3_1__chunk_1|Fig. 9' as examples from part union all select {K}, 'error', 'STRICT_WARNING_FAILURE', 1, '' from part")
def sheet_findings(spark, d):
    return validate.report(_checked(spark, d), strict=True).select("doc_id", "severity", "code", "n", F.array_join("examples", ";").alias("examples"))


@query(f"select {K} as doc_id, 0 as errors, 1 as warnings, true as passed from part")
def sheet_verdicts(spark, d):
    return validate.verdict(_checked(spark, d))


@query(f"select {K} as doc_id, 'completed' as clean, 'skipped' as embed, 4 as n_sections, 18 as total_nodes from part")
def sheet_summary(spark, d):
    b = built(spark, d)
    found = pipeline.summary(sheets(spark, d).select("doc_id", "source_file"), b, {"clean": True, "embed": False})
    return found.select("doc_id", F.col("steps")["clean"].alias("clean"), F.col("steps")["embed"].alias("embed"), "n_sections", "total_nodes")


# ---- metadata profiles


@query(f"""
select {K} as doc_id, true as llm_called, p_partkey % 3 < 2 as json_parsed, p_partkey % 3 = 2 as fallback_used, case when p_partkey % 3 < 2 then 'Paper ' || p_partkey else '' end as title,
 case when p_partkey % 3 < 2 then 2000 + p_partkey % 20 end::int as year, '' as publisher, 0 as authors from part""")
def sheet_profiles(spark, d):
    rows = profiles.structured(built(spark, d).parsed, scholar)
    bib = "profile.bibliography"
    return rows.select("doc_id", "parse_status.*", F.col(f"{bib}.title").alias("title"), F.col(f"{bib}.year").alias("year"), F.col(f"{bib}.publisher").alias("publisher"), F.size(f"{bib}.authors").alias("authors"))


@query(f"""
with t as (select *, p_partkey % 3 < 2 as said from part)
select {K} as doc_id, case when said then 'Title: Paper ' || p_partkey || chr(10) || 'Keywords: k' || p_partkey || '; kw' || chr(10) || 'Abstract: one two three' else 'Structured document metadata' end as content,
 case when said then 16 else 5 end as tokens, case when said then 'Title,Keywords,Abstract' else '' end as included, case when said then 'Abstract' end as truncated, '' as omitted from t""")
def profile_budgets(spark, d):
    rows = profiles.structured(built(spark, d).parsed, scholar).select("doc_id", profiles.embedding_text(F.col("profile"), 16).alias("e"))
    return rows.select("doc_id", F.col("e.text").alias("content"), F.col("e.token_count").alias("tokens"), _joined(F.col("e.included_fields")).alias("included"), F.col("e.truncated_field").alias("truncated"), _joined(F.col("e.omitted_fields")).alias("omitted"))


@query(f"""
select {K} as doc_id, {K} || '::metadata_structured' as evidence_uid, case when p_partkey % 3 < 2 then 'Paper ' || p_partkey else '' end as title, case when p_partkey % 3 < 2 then 'J' else '' end as journal,
 case when p_partkey % 3 < 2 then 'k' || p_partkey || ', ,kw' else '' end as keywords, 'metadata' as bucket from part""")
def metadata_documents(spark, d):
    return profiles.documents(built(spark, d).nodes).select("doc_id", "evidence_uid", "title", "journal", _joined(F.col("keywords")).alias("keywords"), "bucket")


@query(f"select {K} as doc_id, case when p_partkey % 3 < 2 then 'Paper ' || p_partkey || ', ' || (2000 + p_partkey % 20) || ', J' else '' end as citation from part")
def paper_citations(spark, d):
    return profiles.paper_citation(built(spark, d).nodes)


@query(f"select {K} as doc_id, p_partkey % 4 <> 3 as again, case when p_partkey % 4 <> 3 then {_META_TEXT} end as content from part")
def upgraded_profiles(spark, d):
    nodes = built(spark, d).nodes.where("node_type = 'metadata_structured'")
    k = F.col("doc_id").cast("long")
    profile = F.get_json_object("metadata", "$.structured_profile")
    raw = F.when(k % 4 == 1, F.concat(F.lit('{"metadata_type":"document_profile",'), F.substring(profile, 2, 1_000_000)))
    other = F.when(k % 4 == 3, "elsewhere").otherwise(F.col("doc_id"))
    cached = nodes.select("doc_id", "source_file", "node_type", other.alias("node_doc_id"), F.when(k % 4 != 1, F.col("metadata")).alias("metadata"), raw.alias("raw_content"))
    good, rest = profiles.upgraded(cached)
    return good.select("doc_id", F.lit(True).alias("again"), "content").union(rest.select("doc_id", F.lit(False), F.lit(None).cast("string")))


@query(f"""
select {K} as doc_id, p_name as composition, case when p_partkey % 4 = 3 then null else 'p' end as processing, case p_partkey % 4 when 0 then p_type when 1 then p_brand when 2 then p_name end as conditions from part""")
def extraction_fields(spark, d):
    k = F.col("p_partkey") % 4
    key = F.get(F.array(*map(F.lit, ("experimental conditions", "experimental_conditions", "experimental condition", "other"))), k.cast("int"))
    value = F.get(F.array("p_type", "p_brand", "p_name", "p_name"), k.cast("int"))
    said = F.concat(F.lit('Well: {"composition": "'), "p_name", F.lit('", "'), key, F.lit('": "'), value, F.lit('", "processing": '), F.when(k == 3, "null").otherwise('"p"'), F.lit("}"))
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), profiles.extraction(said).alias("x"))
    return rows.select("doc_id", "x.composition", "x.processing", F.col("x.experimental conditions").alias("conditions"))


# ---- the index


@query(f"""
select {K} as doc_id, b as bucket, case b when 'intro' then 1 when 'method' then 1 when 'results' then 3 when 'metadata' then 1 else 0 end as documents, b in ('intro', 'method', 'results', 'metadata') as created,
 case when b in ('intro', 'method', 'results', 'metadata') then {embed.DIMENSIONS} end::int as dimensions, '{{"limit":"480"}}' as chunking from part, unnest([{", ".join(f"'{b}'" for b in index.EVERY)}]) as u(b)""")
def index_manifest(spark, d):
    rows = pipeline.vectors(built(spark, d))
    return index.write(rows, new_folder(spark, "index"), "hashing", {"limit": "480"}).select("doc_id", "bucket", "documents", "created", "dimensions", "chunking")


@query(f"""
select {K} as doc_id, 6 as documents, 5 as section_documents, greatest(19, {_WIDE_TOKENS})::int as max_tokens, {K} || '::sec_3_1__chunk_1' as max_tokens_uid, p_partkey % 2 as mismatched, 2 + (p_partkey % 2 = 9)::int as over_declared,
 {K} || '::sec_1__chunk_1,' || {K} || '::sec_3_1__chunk_1' as examples from part""")
def length_report(spark, d):
    b = built(spark, d)
    stored = F.when((F.col("doc_id").cast("long") % 2 == 1) & (F.col("node_id") == "sec_2__chunk_1"), 99).otherwise(F.col("token_count"))
    section = b.search_rows.select("doc_id", "evidence_uid", "bucket", "text", stored.alias("token_count"))
    meta = profiles.documents(b.nodes).select("doc_id", "evidence_uid", "bucket", "text", F.lit(None).cast("int").alias("token_count"))
    found = embed.lengths(section.union(meta), chunk.token_count(F.col("text")), declared=17, model_max=512)
    return found.select("doc_id", "documents", "section_documents", "max_tokens", "max_tokens_uid", "mismatched", "over_declared", _joined(F.col("over_declared_examples")).alias("examples"))


def compass(texts: pd.Series) -> pd.Series:
    """Stands for an embedder: the direction of the run that a text names, and whether it names a figure."""

    def vector(text: str) -> list[float]:
        run = re.search(r"r(\d{6})", text)
        angle = int(run[1]) / 1e6 * math.pi if run else 0.0
        return [math.cos(angle), math.sin(angle), float("Fig." in text)] if run else [0.0, 0.0, 1.0]

    return texts.map(vector)


@query(f"select p_partkey as query_id, {K} as doc_id, 'sec_3__chunk_1' as node_id, 1 as rank, 0.0::double as distance, {WIDE} as text, '3 Results' as section from part")
def sheet_vector_search(spark, d):
    b = built(spark, d)
    asked = b.chunks.where("node_id = 'sec_3__chunk_1'").select(F.col("doc_id").cast("long").alias("query_id"), F.col("text").alias("normalized_query"), F.array(F.lit("results"), F.lit("discussion")).alias("retrieval_buckets"))
    hits = embed.enriched(embed.search(asked, pipeline.vectors(b, compass), 1, compass), b.search_rows, b.nodes)
    return hits.select("query_id", "doc_id", "node_id", "rank", F.round("distance", 6).alias("distance"), "text", F.col("section_title_full").alias("section"))


# ---- asking


def _asked(spark, d) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Why "), _run(k), F.lit("?")).alias("query"))


def answered(spark, d, **options) -> pipeline.Answered:
    return pipeline.answer(built(spark, d), _asked(spark, d), keep=new_folder(spark, "answered"), **options)


@query(_values("query_id rank evidence_uid bucket retrieval_rank score", f"p_partkey; 1; {K} || '::sec_3__chunk_1'; 'results'; 1; 0.0::double", f"p_partkey; 2; {K} || '::sec_3_1__chunk_1'; 'results'; 2; 0.0::double"))
def sheet_hits(spark, d):
    hits = answered(spark, d).hits
    return hits.select("query_id", "rank", "evidence_uid", "bucket", "retrieval_rank", F.round("rerank_score", 4).alias("score"))


@query(_values("query_id answer status support_uid", f"p_partkey; {WIDE}; 'supported'; {K} || '::sec_3__chunk_1'"))
def sheet_answers(spark, d):
    return answered(spark, d).answers


def _block(tag: str, uid: str, section: str | None, title: str, content: str) -> str:
    lines = [f"'[{tag}]'", f"'uid: ' || {K} || '::{uid}'", *([f"'section: {section}'"] if section else []), f"'title: {title}'", f"'content: ' || {content}"]
    return " || chr(10) || ".join(lines)


@query(_values(
    "query_id bucket node_id expand_role expanded_from triggers kept_rank display block",
    f"p_partkey; 'chunks'; 'sec_3__chunk_1'; 'primary_hit'; 'sec_3__chunk_1'; 'sec_3__chunk_1'; 1; null; {_block('CHUNK', 'sec_3__chunk_1', '3 Results', '3 Results', WIDE)}",
    f"p_partkey; 'chunks'; 'sec_3_1__chunk_1'; 'primary_hit'; 'sec_3_1__chunk_1'; 'sec_3_1__chunk_1'; 2; null; {_block('CHUNK', 'sec_3_1__chunk_1', '3.1 Details', '3.1 Details', DETAIL)}",
    f"p_partkey; 'figures'; 'fig_1'; ''; 'sec_3_1__chunk_1'; 'sec_3_1__chunk_1'; 3; 'Fig. 1'; {_block('FIGURE', 'fig_1', '1 Introduction', 'Fig. 1', "'Fig. 1. A ' || p_name || ' curve.'")}",
    f"p_partkey; 'equations'; 'eq_1'; ''; 'sec_3_1__chunk_1'; 'sec_3_1__chunk_1'; 4; 'Eq. 1'; " + _block("EQUATION", "eq_1", "2 Experimental details", "Equation 1", "'a = ' || p_partkey || ' \\tag{1}'"),
    f"p_partkey; 'chunks'; 'sec_3__chunk_2'; 'context_next'; 'sec_3__chunk_1'; 'sec_3__chunk_1'; 5; null; {_block('CHUNK', 'sec_3__chunk_2', '3 Results', '3 Results', "'It works.'")}",
))
def sheet_evidence(spark, d):
    return answered(spark, d).evidence.select("query_id", "bucket", "node_id", "expand_role", "expanded_from", _joined(F.col("triggered_by_chunk_ids")).alias("triggers"), "kept_rank", "display", "block")


@query(_values(
    "query_id mode bucket n",
    *[f"p_partkey; '{m}'; '{b}'; {n}" for m, counts in (("full", (3, 1, 1)), ("wo_association", (3, 0, 0)), ("wo_multimodal", (3, 0, 1))) for b, n in zip(("chunks", "figures", "equations"), counts, strict=True) if n],
))
def sheet_ablations(spark, d):
    full = answered(spark, d)
    counts = lambda m, found: found.evidence.groupBy("query_id", F.lit(m).alias("mode"), "bucket").agg(F.count("*").alias("n"))
    return counts("full", full).union(counts("wo_association", answered(spark, d, mode="wo_association", hits=full.hits))).union(counts("wo_multimodal", answered(spark, d, mode="wo_multimodal", hits=full.hits)))


@query(_values(
    "query_id bucket evidence_uid number label body triggers citation",
    f"p_partkey; 'figures'; {K} || '::fig_1'; 'Fig.1'; 'Fig. 1'; 'images/a' || p_partkey || '.png'; {K} || '::sec_3_1__chunk_1'; case when p_partkey % 3 < 2 then 'Paper ' || p_partkey || ', ' || (2000 + p_partkey % 20) || ', J' else '' end",
    f"p_partkey; 'equations'; {K} || '::eq_1'; 'Eq.1'; 'Equation 1'; 'a = ' || p_partkey || ' \\tag{{1}}'; {K} || '::sec_3_1__chunk_1'; case when p_partkey % 3 < 2 then 'Paper ' || p_partkey || ', ' || (2000 + p_partkey % 20) || ', J' else '' end",
))
def sheet_shown(spark, d):
    shown = answered(spark, d).shown
    said = lambda path: F.get_json_object("payload", path)
    body = F.coalesce(said("$.image_path"), said("$.latex"))
    return shown.select("query_id", "bucket", "evidence_uid", "number", said("$.display_label").alias("label"), body.alias("body"), said("$.triggered_by_evidence_uids[0]").alias("triggers"), said("$.source.paper_citation").alias("citation"))


@query(f"""
select p_partkey as query_id, case when p_partkey % 2 = 0 then {K} || '::fig_1' else {K} || '::sec_3__chunk_1' end as uids, case when p_partkey % 2 = 0 then 1 else 0 end as shown from part""")
def sheet_allow_lists(spark, d):
    k = F.col("p_partkey").cast("string")
    listed = read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(k, F.when(F.col("p_partkey") % 2 == 0, "::fig_1").otherwise("::sec_3__chunk_1")).alias("evidence_uid"))
    found = answered(spark, d, limit=listed)
    shown = found.shown.groupBy("query_id").agg(F.count("*").cast("int").alias("shown"))
    uids = found.evidence.groupBy("query_id").agg(_joined(F.array_sort(F.collect_set("evidence_uid"))).alias("uids"))
    return uids.join(shown, "query_id", "left").select("query_id", "uids", F.coalesce("shown", F.lit(0)).alias("shown"))


@query(f"""
select p_partkey as query_id, 'qa' as task, {WIDE} as output, 'mechanism' as query_type, {K} as source, {K} || '::sec_3__chunk_1' as first_uid, {K} || '::sec_3__chunk_2' as second_included, {K} || '::fig_1' as first_linked, '1' as equations from part""")
def sheet_packages(spark, d):
    said = lambda path: F.variant_get("p", path, "string")
    trace = "$.evidence_trace"
    return answered(spark, d).packages().select("query_id", F.parse_json("package").alias("p")).select(  # each package is parsed once
        "query_id", said("$.task_mode").alias("task"), said("$.task_output").alias("output"), said("$.query_analysis.query_type").alias("query_type"), said("$.source_map[0].doc_id").alias("source"),
        said(f"{trace}.primary_retrieved_evidence_uids[0]").alias("first_uid"), said(f"{trace}.included_evidence_uids[1]").alias("second_included"), said(f"{trace}.linked_render_evidence_uids[0]").alias("first_linked"),
        said("$.retrieval_debug.expanded_counts.equations").alias("equations"),
    )


def writer(prompts: pd.Series, images: pd.Series) -> pd.Series:
    """Stands for a model that answers: it fails where it is shown images, and where the run ends in 7."""

    def said(prompt: str, shown) -> str | None:
        run = re.findall(r"r\d{6}", prompt)[0]
        return None if len(shown) or run.endswith("7") else f'{{"composition": "{run}", "property": {{"n": 1}}}}'

    return pd.Series([said(p, i) for p, i in zip(prompts, images, strict=True)], index=prompts.index)


@query(f"""
select p_partkey as query_id, case when p_partkey % 10 = 7 then 'fallback' else 'model' end as generated_by, case when p_partkey % 10 <> 7 then {RUN} end as composition, case when p_partkey % 10 <> 7 then '{{"n":1}}' end as property from part""")
def sheet_generated(spark, d):
    found = answered(spark, d)
    images = found.shown.where("bucket = 'figures'").select("query_id", F.concat(F.lit("http://x/"), "node_id").alias("image_uri"))
    out = render.generated(found.analyzed, found.evidence, found.hits, writer, "structured-extraction", images, fallback=True)
    return out.select("query_id", "generated_by", F.get_json_object("extraction", "$.composition").alias("composition"), F.get_json_object("extraction", "$.property").alias("property"))


def analyst(prompts: pd.Series) -> pd.Series:
    """Stands for a model that analyses: known and unknown types and buckets, or no JSON."""

    def said(prompt: str) -> str:
        n = int(re.search(r"Q(\d+)$", prompt)[1])
        return (f'{{"query_type": "Method", "retrieval_buckets": ["results", "nowhere", "Results", "intro"], "need_tables": true, "sub_questions": ["a{n}", " "]}}', '{"query_type": "odd", "retrieval_buckets": "x"}', "no")[n % 3]

    return prompts.map(said)


@query("""
select c_custkey as query_id, case c_custkey % 3 when 0 then 'method' when 1 then 'fact' else 'mechanism' end as query_type, case c_custkey % 3 when 0 then 'results,intro' when 1 then 'results,discussion' else 'results,discussion,results_discussion' end as buckets,
 c_custkey % 3 = 0 as need_tables, case when c_custkey % 3 = 0 then 'a' || c_custkey else '' end as sub_questions, case when c_custkey % 3 = 2 then 'rules' else 'model' end as analyzed_by from customer""")
def query_analyze_model(spark, d):
    asked = read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Why Q"), "c_custkey").alias("query"))
    return retrieve.analyzed_by(asked, analyst).select("query_id", "query_type", _joined(F.col("retrieval_buckets")).alias("buckets"), "need_tables", _joined(F.col("sub_questions")).alias("sub_questions"), "analyzed_by")
