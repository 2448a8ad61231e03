"""The evidence graph: nodes and edges of a corpus, keyed by doc_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mentions as M
from ..functions import text as T
from . import parse

NODE_TYPES = ("metadata", "metadata_structured", "section", "section_chunk", "figure", "table", "equation", "reference", "additional_info")
CITES = {"cites_figure": "figure", "cites_table": "table", "cites_equation": "equation", "cites_reference": "reference"}
_FIELDS = ("section_id", "section_number", "section_title", "section_title_full", "parent_section_id", "section_path")


def with_mentions(chunks: DataFrame) -> DataFrame:
    """Chunks with arrays of what they mention; equations apart by id and by number."""
    eq = M.equations(F.col("text"))
    by_number = F.transform(F.filter(eq, lambda x: x.startswith("eqnum::")), lambda x: F.substring(x, 8, 1_000_000))
    return chunks.select(
        "*", M.figures(F.col("text")).alias("mentioned_figures"), M.tables(F.col("text")).alias("mentioned_tables"), F.filter(eq, lambda x: x.startswith("eq_")).alias("mentioned_equation_ids"),
        by_number.alias("mentioned_equation_numbers"), M.citations(F.col("text")).alias("mentioned_references"),
    )


def first_sections(objects: DataFrame, sections: DataFrame, label: str, mentioned: Column) -> DataFrame:
    """Objects without a section take that of the first section whose text mentions their label."""
    seen = sections.select("doc_id", "ord", F.struct("section_id", "section_number", "section_title", "section_title_full", "parent_section_id", T.section_path(F.col("hierarchy")).alias("section_path")).alias("s"), F.explode(mentioned).alias(label))
    first = seen.groupBy("doc_id", label).agg(F.min_by("s", "ord").alias("s"))
    have = [c for c in _FIELDS if c in objects.columns]
    joined = objects.join(first, ["doc_id", label], "left")
    own = F.col("section_id").isNotNull() if "section_id" in have else F.lit(False)
    filled = [F.when(own, F.col(c) if c in have else F.lit(None)).otherwise(F.col(f"s.{c}")).alias(c) for c in _FIELDS]
    return joined.select(*[c for c in objects.columns if c not in have], *filled)


def nodes(parsed: DataFrame, chunked: DataFrame) -> DataFrame:
    """All nodes but structured metadata: ids, type, title, content, section fields, position; `metadata` is JSON."""
    sections = parse.exploded(parsed, "sections")
    blank, none = F.lit(""), F.lit(None).cast("string")

    def node(df: DataFrame, kind: str, ident: Column, title: Column, content: Column, metadata: Column, order: Column, rank: int) -> DataFrame:
        fields = [F.col(c) if c in df.columns else (T.section_path(F.col("hierarchy")) if c == "section_path" and "hierarchy" in df.columns else none).alias(c) for c in _FIELDS]
        return df.select("doc_id", "source_file", ident.alias("node_id"), F.lit(kind).alias("node_type"), T.evidence_uid(F.col("doc_id"), ident).alias("evidence_uid"), title.alias("title"), content.alias("content"), *fields, order.cast("int").alias("order_index"), F.to_json(metadata).alias("metadata"), F.lit(rank).alias("rank"))

    ord_ = F.col("ord")
    figures = first_sections(parse.exploded(parsed, "figures"), sections, "figure_number", M.figures(F.col("content")))
    tables = first_sections(parse.exploded(parsed, "tables"), sections, "table_number", M.tables(F.col("content")))
    equations = first_sections(parse.equations_in_context(parsed).drop("hierarchy"), sections, "equation_id", F.filter(M.equations(F.col("content")), lambda x: x.startswith("eq_")))
    preview = F.array_join(F.transform(F.slice("data.rows", 1, 3), lambda r: F.array_join(r, " | ")), "\n")
    table_text = F.concat_ws("\n", F.nullif("caption", blank), F.when(F.size("data.columns") > 0, F.concat(F.lit("Columns: "), F.array_join("data.columns", " | "))), F.nullif(preview, blank))
    metadata = parsed.where(F.trim("metadata_block") != "")
    refs = parse.references(parsed).join(parsed.select("doc_id", "source_file"), "doc_id")
    parts = [
        node(metadata, "metadata", F.lit("metadata_1"), F.lit("Metadata"), T.normalize_text(F.col("metadata_block")), F.struct(F.lit(True).alias("raw")), F.lit(0), 0),
        node(sections, "section", F.col("section_id"), F.coalesce(F.nullif("section_title_full", blank), "section_title"), T.normalize_text(F.col("content")), F.struct("level", "equation_refs"), ord_, 1),
        node(chunked, "section_chunk", F.col("node_id"), F.coalesce(F.nullif("section_title_full", blank), "section_title"), F.col("text"), F.struct("local_order", "total_chunks", "prev_chunk_id", "next_chunk_id", "token_count"), F.col("global_order"), 2),
        node(figures, "figure", F.col("figure_id"), F.col("figure_number"), F.col("caption"), F.struct("figure_number", "image_path", "image_url"), ord_, 3),
        node(tables, "table", F.col("table_id"), F.col("table_number"), table_text, F.struct("table_number", F.col("data").alias("table_data"), "raw_html"), ord_, 4),
        node(equations, "equation", F.col("equation_id"), F.col("equation_label"), F.col("latex"), F.struct("equation_number"), ord_, 5),
        node(refs, "reference", F.col("node_id"), F.concat(F.lit("Reference "), "number"), F.col("content"), F.struct(F.col("number").alias("reference_number")), ord_, 6),
        node(parse.exploded(parsed, "additional"), "additional_info", F.concat(F.lit("additional_"), ord_), F.col("additional_info_title"), F.col("content"), F.struct("ord"), ord_, 7),
    ]
    return reduce(DataFrame.unionByName, parts)


def _resolved(chunked: DataFrame, mentioned: str, objects: DataFrame, kind: str, label: Column) -> DataFrame:
    """Inner join of mentions with objects by label; of equal labels the last object counts."""
    of = objects.where(F.col("node_type") == kind).groupBy("doc_id", label.alias("label")).agg(F.max_by("node_id", "order_index").alias("target"))
    return chunked.select("doc_id", F.col("node_id").alias("source"), F.explode(mentioned).alias("label")).join(of, ["doc_id", "label"])


def citation_edges(chunked: DataFrame, objects: DataFrame) -> DataFrame:
    """cites_* edges of resolvable mentions, and referenced_by_chunk back but for equations by number."""
    title, ident = F.col("title"), F.col("node_id")
    number = F.get_json_object("metadata", "$.equation_number")
    found = [
        (_resolved(chunked, "mentioned_figures", objects, "figure", title), "cites_figure", True),
        (_resolved(chunked, "mentioned_tables", objects, "table", title), "cites_table", True),
        (_resolved(chunked, "mentioned_equation_ids", objects, "equation", ident), "cites_equation", True),
        (_resolved(chunked, "mentioned_equation_numbers", objects, "equation", number), "cites_equation", False),
        (_resolved(chunked, "mentioned_references", objects, "reference", ident), "cites_reference", True),
    ]
    out = []
    for rows, relation, both in found:
        suffix = F.lit("") if both else F.lit("::num")
        there = F.struct(F.concat("source", F.lit(f"::{relation}::"), "target", suffix).alias("edge_id"), F.col("source"), F.col("target"), F.lit(relation).alias("relation"))
        back = F.struct(F.concat("target", F.lit("::referenced_by_chunk::"), "source").alias("edge_id"), F.col("target").alias("source"), F.col("source").alias("target"), F.lit("referenced_by_chunk").alias("relation"))
        out.append(rows.select("doc_id", F.explode(F.array(there, back) if both else F.array(there)).alias("e")).select("doc_id", "e.*"))
    return reduce(DataFrame.union, out)


def structure_edges(all_nodes: DataFrame) -> DataFrame:
    """Parent and child sections, sections with their objects and chunks, and neighbouring chunks."""
    edge = lambda a, b, r: F.struct(F.concat(a, F.lit(f"::{r}::"), b).alias("edge_id"), a.alias("source"), b.alias("target"), F.lit(r).alias("relation"))
    node, section, parent, kind = F.col("node_id"), F.col("section_id"), F.col("parent_section_id"), F.col("node_type")
    after = F.get_json_object("metadata", "$.next_chunk_id")
    every = F.array_compact(
        F.array(
            F.when((kind == "section") & parent.isNotNull(), edge(parent, node, "parent_of_section")),
            F.when((kind == "section") & parent.isNotNull(), edge(node, parent, "child_of_section")),
            *[F.when((kind == k) & section.isNotNull(), edge(section, node, f"contains_{k}")) for k in ("figure", "table", "equation")],
            F.when(kind == "section_chunk", edge(section, node, "has_chunk")),
            F.when((kind == "section_chunk") & after.isNotNull(), edge(node, after, "next_chunk")),
            F.when((kind == "section_chunk") & after.isNotNull(), edge(after, node, "prev_chunk")),
        )
    )
    return all_nodes.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")


def edges(chunked: DataFrame, all_nodes: DataFrame) -> DataFrame:
    return structure_edges(all_nodes).union(citation_edges(chunked, all_nodes))


def with_nearby(chunked: DataFrame, cites: DataFrame) -> DataFrame:
    """Chunks with nearby_evidence_ids: what they cite, distinct and sorted."""
    near = cites.where(F.col("relation").startswith("cites_")).groupBy("doc_id", F.col("source").alias("node_id")).agg(F.array_sort(F.collect_set("target")).alias("nearby"))
    return chunked.join(near, ["doc_id", "node_id"], "left").withColumn("nearby_evidence_ids", F.coalesce("nearby", F.array().cast("array<string>"))).drop("nearby")


def statistics(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Counts by type, edges, and the largest and mean token count of chunks, per document."""
    tokens = F.when(F.col("node_type") == "section_chunk", F.get_json_object("metadata", "$.token_count").cast("int"))
    tokens = F.when(tokens > 0, tokens)
    per = all_nodes.groupBy("doc_id").agg(F.count("*").alias("total_nodes"), *[F.count_if(F.col("node_type") == k).alias(f"{k}_nodes") for k in NODE_TYPES], F.coalesce(F.max(tokens), F.lit(0)).alias("max_chunk_tokens"), F.coalesce(F.round(F.avg(tokens), 2), F.lit(0.0)).alias("mean_chunk_tokens"))
    return per.join(all_edges.groupBy("doc_id").agg(F.count("*").alias("total_edges")), "doc_id", "left").fillna(0, ["total_edges"])


def out_edges(all_edges: DataFrame, node_id: str, relation: str | None = None) -> DataFrame:
    found = all_edges.where(F.col("source") == node_id)
    return found if relation is None else found.where(F.col("relation") == relation)


def in_edges(all_edges: DataFrame, node_id: str, relation: str | None = None) -> DataFrame:
    found = all_edges.where(F.col("target") == node_id)
    return found if relation is None else found.where(F.col("relation") == relation)


def resolve_uids(uids: DataFrame, all_nodes: DataFrame, *more: Column) -> DataFrame:
    """Rows of `uids` (evidence_uid) with the node of that uid, else of the parts before and after the first '::'; with `more` of the node.

    A node is listed under its uid and, where that isn't made of them, its parts, so that nodes meet uids in one join.
    """
    doc, ident, uid = F.col("doc_id"), F.col("node_id"), F.col("evidence_uid")
    made = F.concat(doc, F.lit("::"), ident)
    made = F.when(F.substring_index(made, "::", 1) == doc, made)  # else these parts aren't read from it
    bare = F.when((ident == "") & ~doc.contains("::"), doc)
    under = lambda key, exact: F.struct(key.alias("key"), F.lit(exact).alias("exact"))
    keys = F.filter(F.array(under(uid, True), under(F.when(uid.isNull() | (uid != made), made), False), under(F.when(uid.isNull() | (uid != bare), bare), False)), lambda x: x["key"].isNotNull())
    n = all_nodes.select(doc.alias("n_doc"), ident.alias("n_id"), "node_type", *more, F.explode(keys).alias("k")).select("*", "k.*").drop("k")
    taken = n.withColumn("any", F.max("exact").over(Window.partitionBy("key"))).where("exact = any").drop("exact", "any")
    found = uids.join(taken, F.col("evidence_uid") == F.col("key"))
    kept = [c for c in taken.columns if c not in ("n_doc", "n_id", "node_type", "key")]
    return found.select(*uids.columns, F.col("n_doc").alias("doc_id"), F.col("n_id").alias("node_id"), "node_type", *kept)


def _like(profiles: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Structured metadata nodes with the columns of all nodes, in front."""
    return profiles.select(*[F.lit(-1).alias(c) if c == "rank" else F.col(c) if c in profiles.columns else F.lit(None).cast(t).alias(c) for c, t in all_nodes.dtypes])


def with_profiles(all_nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Nodes that hold no structured metadata yet, with that of the same documents: as upsert_metadata(), without looking either up in the other."""
    return _like(profiles, all_nodes).unionByName(all_nodes)


def upsert_metadata(all_nodes: DataFrame, profiles: DataFrame, replace: bool = True) -> DataFrame:
    """`all_nodes` with each document's structured metadata node in front; an existing one is replaced, or kept if not `replace`.

    A profile of a document without nodes is an error.
    """
    kind = F.col("node_type") == "metadata_structured"
    known = all_nodes.select("doc_id").distinct().withColumn("known", F.lit(True))
    new = profiles.join(known, "doc_id", "left").withColumn("ok", F.assert_true(F.col("known").isNotNull(), F.lit("a profile's document has no graph")))
    new = _like(new.where(F.col("ok").isNull()), all_nodes)
    if not replace:
        return all_nodes.unionByName(new.join(all_nodes.where(kind).select("doc_id"), "doc_id", "left_anti").select(*all_nodes.columns))
    rest = all_nodes.withColumn("old", kind).join(new.select("doc_id").withColumn("old", F.lit(True)), ["doc_id", "old"], "left_anti").select(*all_nodes.columns)
    return new.select(*all_nodes.columns).unionByName(rest)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def in_order(all_nodes: DataFrame) -> DataFrame:
    """Nodes with their position in their document's list."""
    return all_nodes.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "order_index", "node_id")))
