"""Consistency rules of a built graph: each gives findings (doc_id, severity, code, context)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import shared
from .graph import CITES, NODE_TYPES


FINDING = "doc_id string, severity string, code string, context string"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _find(df: DataFrame, severity: str, code: str, *context: str) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in context]) if context else F.lit("")
    return df.select("doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("context"))


def graph_rules(meta: DataFrame, nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Rules on identifiers, provenance and edges. meta: doc_id, source_file."""
    ids = nodes.select("doc_id", F.col("node_id").alias("ref"), F.col("node_type").alias("ref_type")).distinct()
    side = lambda c: edges.join(ids.withColumnRenamed("ref", c).withColumnRenamed("ref_type", f"{c}_type"), ["doc_id", c], "left")
    typed = side("source").join(ids.withColumnRenamed("ref", "target").withColumnRenamed("ref_type", "target_type"), ["doc_id", "target"], "left")
    wanted = F.create_map(*[F.lit(x) for pair in CITES.items() for x in pair])
    dangling = F.col("source_type").isNull() | F.col("target_type").isNull()
    expected = T.evidence_uid(F.col("doc_id"), F.col("node_id"))
    own = nodes.withColumnRenamed("source_file", "node_source").join(meta, "doc_id", "left")
    count = lambda df, c: df.where(~_blank(c)).groupBy("doc_id", c).agg(F.count("*").alias("n")).where("n > 1")
    section = nodes.where("node_type = 'section'").select("doc_id", F.col("node_id").alias("sid")).distinct().withColumn("known", F.lit(True))
    refs = nodes.select("doc_id", "node_id", F.explode(F.array("section_id", "parent_section_id")).alias("sid")).where("sid is not null").join(section, ["doc_id", "sid"], "left_anti")
    return [
        _find(meta.where(_blank("doc_id")), "error", "GRAPH_DOC_ID_MISSING"),
        _find(meta.where(_blank("source_file")), "warning", "GRAPH_SOURCE_FILE_MISSING"),
        _find(meta.join(nodes.select("doc_id").distinct(), "doc_id", "left_anti"), "error", "GRAPH_NODES_EMPTY"),
        _find(nodes.where(_blank("node_id")), "error", "NODE_ID_MISSING", "node_type"),
        _find(count(nodes, "node_id"), "error", "NODE_ID_DUPLICATE", "node_id", "n"),
        _find(nodes.where(_blank("evidence_uid")), "error", "EVIDENCE_UID_MISSING", "node_id"),
        _find(count(nodes, "evidence_uid"), "error", "EVIDENCE_UID_DUPLICATE", "evidence_uid", "n"),
        _find(nodes.where(~_blank("evidence_uid") & ~_blank("node_id") & (F.col("evidence_uid") != expected)), "error", "EVIDENCE_UID_INCONSISTENT", "evidence_uid"),
        _find(nodes.where(~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False))), "warning", "NODE_TYPE_UNKNOWN", "node_type"),
        _find(own.where(~F.col("node_source").eqNullSafe(F.col("source_file"))), "error", "NODE_PROVENANCE_MISMATCH", "node_id"),
        _find(edges.where(_blank("edge_id")), "error", "EDGE_ID_MISSING", "source", "target"),
        _find(count(edges, "edge_id"), "error", "EDGE_ID_DUPLICATE", "edge_id", "n"),
        _find(edges.where(_blank("relation")), "error", "EDGE_RELATION_MISSING", "edge_id"),
        _find(typed.where(dangling), "error", "EDGE_DANGLING_ENDPOINT", "source", "target"),
        _find(typed.where(~dangling & F.col("relation").isin(*CITES) & ((F.try_element_at(wanted, F.col("relation")) != F.col("target_type")) | (F.col("source_type") != "section_chunk"))), "error", "EDGE_RELATION_TYPE_MISMATCH", "edge_id"),
        _find(refs, "error", "SECTION_REFERENCE_INVALID", "node_id", "sid"),
        _find(nodes.where("node_type = 'section_chunk'").where(_blank("section_id")).withColumn("sid", F.lit("")), "error", "SECTION_REFERENCE_INVALID", "node_id", "sid"),
    ]


def chunk_rules(chunked: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int) -> list[DataFrame]:
    """Rules on chunks: limits, links and mentions. chunked has mentions and nearby_evidence_ids."""
    ids = nodes.select("doc_id", F.col("node_id").alias("ref"), "node_type").distinct()
    link = chunked.select("doc_id", "node_id", F.explode(F.array("prev_chunk_id", "next_chunk_id")).alias("ref")).where("ref is not null")
    near = chunked.select("doc_id", "node_id", F.explode("nearby_evidence_ids").alias("ref"))
    bad = link.join(ids.where("node_type = 'section_chunk'"), ["doc_id", "ref"], "left_anti").union(near.join(ids, ["doc_id", "ref"], "left_anti"))
    other = chunked.select("doc_id", F.col("node_id").alias("ref"), F.col("prev_chunk_id").alias("back"), F.col("next_chunk_id").alias("on"))
    after = chunked.select("doc_id", "node_id", F.col("next_chunk_id").alias("ref")).join(other, ["doc_id", "ref"]).where(~F.col("back").eqNullSafe(F.col("node_id")))
    before = chunked.select("doc_id", "node_id", F.col("prev_chunk_id").alias("ref")).join(other, ["doc_id", "ref"]).where(~F.col("on").eqNullSafe(F.col("node_id")))
    number = F.get_json_object("metadata", "$.equation_number")
    kinds = [("mentioned_figures", "figure", F.col("title"), "cites_figure"), ("mentioned_tables", "table", F.col("title"), "cites_table"), ("mentioned_equation_ids", "equation", F.col("node_id"), "cites_equation"), ("mentioned_equation_numbers", "equation", number, "cites_equation"), ("mentioned_references", "reference", F.col("node_id"), "cites_reference")]
    lost, missing = [], []
    for column, kind, label, relation in kinds:
        said = chunked.select("doc_id", F.col("node_id").alias("source"), F.explode(column).alias("label"))
        of = nodes.where(F.col("node_type") == kind).groupBy("doc_id", label.alias("label")).agg(F.max_by("node_id", "order_index").alias("target"))
        lost.append(said.join(of, ["doc_id", "label"], "left_anti").select("doc_id", "source", "label"))
        have = edges.where(F.col("relation") == relation).select("doc_id", "source", "target")
        missing.append(said.join(of, ["doc_id", "label"]).join(have, ["doc_id", "source", "target"], "left_anti").select("doc_id", "source", "label"))
    meta = lambda path: F.coalesce(F.get_json_object("metadata", path), F.lit(""))
    return [
        _find(chunked.where(F.col("token_count") > limit), "error", "CHUNK_TOKEN_LIMIT_EXCEEDED", "node_id", "token_count"),
        _find(bad, "error", "CHUNK_LINK_INVALID", "node_id", "ref"),
        _find(after.select("doc_id", "node_id", "ref").union(before.select("doc_id", "node_id", "ref")), "warning", "CHUNK_LINK_ASYMMETRIC", "node_id", "ref"),
        *[_find(x, "warning", "MENTION_UNRESOLVED", "source", "label") for x in lost],
        *[_find(x, "error", "MENTION_EDGE_MISSING", "source", "label") for x in missing],
        _find(nodes.where("node_type = 'figure'").where((meta("$.image_path") == "") & (meta("$.image_url") == "")), "warning", "FIGURE_IMAGE_LOCATOR_MISSING", "node_id"),
        _find(nodes.where("node_type = 'table'").where((meta("$.table_data.columns").isin("", "[]")) & (meta("$.table_data.rows").isin("", "[]")) & (meta("$.table_data.grid").isin("", "[]"))), "warning", "TABLE_DATA_EMPTY", "node_id"),
        _find(nodes.where("node_type = 'equation'").where(_blank("content")), "warning", "EQUATION_CONTENT_EMPTY", "node_id"),
    ]


def statistics_rules(stored: DataFrame, recounted: DataFrame) -> list[DataFrame]:
    """Stored statistics (doc_id and counts) against recounted ones, for the columns that are stored."""
    keys = [c for c in stored.columns if c in recounted.columns and c not in ("doc_id", "max_chunk_tokens", "mean_chunk_tokens")]
    both = stored.alias("s").join(recounted.alias("r"), "doc_id")
    counts = both.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"s.{k}").cast("long").alias("stored"), F.col(f"r.{k}").cast("long").alias("found")) for k in keys])).alias("x")).select("doc_id", "x.*") if keys else None
    out = [_find(counts.where("stored is not null and stored <> found"), "error", "GRAPH_STATS_MISMATCH", "name", "stored", "found")] if keys else []
    if "max_chunk_tokens" in stored.columns:
        out.append(_find(both.where("s.max_chunk_tokens <> r.max_chunk_tokens").select("doc_id", F.col("s.max_chunk_tokens").alias("stored"), F.col("r.max_chunk_tokens").alias("found")), "warning", "GRAPH_TOKEN_STAT_MISMATCH", "stored", "found"))
    return out


def retrieval_rules(rows: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """Search rows (doc_id, id, evidence_uid, node_type, source_file, text, token_count) against chunk nodes."""
    chunk = nodes.where("node_type = 'section_chunk'").select("doc_id", F.col("node_id").alias("id"), F.col("evidence_uid").alias("n_uid"), F.col("source_file").alias("n_source"), F.col("content").alias("n_text"), F.get_json_object("metadata", "$.token_count").cast("int").alias("n_tokens"))
    both = rows.join(chunk, ["doc_id", "id"])
    reasons = F.array_compact(F.array(F.when(~F.col("evidence_uid").eqNullSafe(F.col("n_uid")), "evidence_uid"), F.when(~F.col("node_type").eqNullSafe(F.lit("section_chunk")), "node_type"), F.when(~F.col("source_file").eqNullSafe(F.col("n_source")), "source_file")))
    dup = lambda c: rows.where(~_blank(c)).groupBy("doc_id", c).agg(F.count("*").alias("n")).where("n > 1")
    return [
        _find(dup("id"), "error", "RETRIEVAL_ID_DUPLICATE", "id", "n"),
        _find(dup("evidence_uid"), "error", "RETRIEVAL_UID_DUPLICATE", "evidence_uid", "n"),
        _find(chunk.join(rows, ["doc_id", "id"], "left_anti"), "error", "RETRIEVAL_CHUNK_MISSING", "id"),
        _find(rows.where(~_blank("id")).join(chunk, ["doc_id", "id"], "left_anti"), "error", "RETRIEVAL_ORPHAN_ROW", "id"),
        _find(both.select("doc_id", "id", F.explode(reasons).alias("reason")), "error", "RETRIEVAL_ROW_INCONSISTENT", "id", "reason"),
        _find(rows.where(_blank("id")).withColumn("reason", F.lit("id")), "error", "RETRIEVAL_ROW_INCONSISTENT", "evidence_uid", "reason"),
        _find(both.where(T.one_line(F.col("text")) != T.one_line(F.col("n_text"))), "error", "RETRIEVAL_TEXT_MISMATCH", "id"),
        _find(both.where(~F.col("token_count").eqNullSafe(F.col("n_tokens"))), "error", "RETRIEVAL_TOKEN_COUNT_MISMATCH", "id", "token_count", "n_tokens"),
    ]


def token_rules(rows: DataFrame, recount: Column, limit: int) -> list[DataFrame]:
    """Stored token counts against those of a tokenizer."""
    again = rows.withColumn("again", recount)
    return [
        _find(again.where(~F.col("token_count").eqNullSafe(F.col("again"))), "error", "TOKEN_COUNT_RECOMPUTE_MISMATCH", "id", "token_count", "again"),
        _find(again.where(F.col("again") > limit), "error", "TOKEN_COUNT_RECOMPUTE_OVER_LIMIT", "id", "again"),
    ]


def metadata_token_rules(nodes: DataFrame, recount: Column) -> list[DataFrame]:
    """Structured metadata nodes (content, metadata) whose text is over the limit that they declare."""
    rows = nodes.where("node_type = 'metadata_structured'").where(F.coalesce("content", F.lit("")) != "")
    rows = rows.withColumn("again", recount).withColumn("declared", F.get_json_object("metadata", "$.embedding_config.max_embedding_tokens").try_cast("int"))
    return [_find(rows.where("again > declared"), "error", "METADATA_TOKEN_OVER_LIMIT", "node_id", "again", "declared")]


def tokenizer_rules(meta: DataFrame, load) -> list[DataFrame]:
    """Whether token counts can be checked: meta has doc_id and tokenizer; `load` maps a name to a tokenizer and raises where it can't.

    Each name is tried once. A missing dependency (ImportError) is no error of the data, anything else is.
    """
    named = meta.withColumn("tokenizer", F.trim(F.coalesce("tokenizer", F.lit(""))))

    def tried(names: pd.Series) -> pd.Series:
        def code(name: str) -> str | None:
            try:
                load(name)
            except ImportError:
                return "TOKENIZER_CHECK_UNAVAILABLE"
            except Exception:  # whatever a loader raises
                return "TOKENIZER_LOAD_FAILED"
            return None

        return names.map(code)

    result = named.where("tokenizer <> ''").select("tokenizer").distinct().withColumn("found", F.pandas_udf(tried, "string").asNondeterministic()("tokenizer"))
    lost = named.join(result.where("found is not null"), "tokenizer")
    return [
        _find(named.where("tokenizer = ''"), "warning", "TOKENIZER_MODEL_UNKNOWN"),
        _find(lost.where("found = 'TOKENIZER_CHECK_UNAVAILABLE'"), "warning", "TOKENIZER_CHECK_UNAVAILABLE", "tokenizer"),
        _find(lost.where("found = 'TOKENIZER_LOAD_FAILED'"), "error", "TOKENIZER_LOAD_FAILED", "tokenizer"),
    ]


def index_rules(manifest: DataFrame, meta: DataFrame, counts: DataFrame, stored: DataFrame | None = None, chunking: DataFrame | None = None) -> list[DataFrame]:
    """An index manifest (doc_id, source_file, bucket, documents, dimensions, distance_semantics, chunking) against the graph, the
    expected counts by bucket, the stored vectors (doc_id, bucket, v; null for files that can't be read) and the graph's chunking
    (doc_id, chunking). Documents of `meta` without an index, or of the index without a manifest, are findings too."""
    both = manifest.join(meta.withColumnRenamed("source_file", "g_source"), "doc_id", "left")
    expected = counts.withColumnRenamed("documents", "expected").join(manifest.select("doc_id", "bucket", "documents"), ["doc_id", "bucket"], "full")
    said = manifest.where(F.coalesce("distance_semantics", F.lit("")) != "").where(~F.lower("distance_semantics").rlike("smaller|lower")).select("doc_id").distinct() if "distance_semantics" in manifest.columns else manifest.where("false").select("doc_id")
    wrong = [expected.where("documents is not null and coalesce(expected, 0) <> documents").select("doc_id", "bucket", "expected", F.col("documents").alias("found"))]
    out = [
        _find(both.where("g_source is null").select("doc_id").distinct(), "error", "INDEX_DOC_ID_MISMATCH"),
        _find(both.where("g_source <> source_file").select("doc_id").distinct(), "error", "INDEX_SOURCE_FILE_MISMATCH"),
        _find(said, "warning", "INDEX_DISTANCE_SEMANTICS_UNCLEAR"),
    ]
    if chunking is not None:
        other = manifest.select("doc_id", F.col("chunking").alias("m")).distinct().join(chunking, "doc_id").where("m <> '{}' and chunking <> '{}' and m <> chunking")
        out.append(_find(other.select("doc_id", "m", "chunking").distinct(), "error", "INDEX_CHUNK_CONFIG_MISMATCH", "m", "chunking"))
    if stored is not None:
        have = stored.groupBy("doc_id", "bucket").agg(F.count("v").alias("stored"), F.count_if(F.col("v").isNull()).alias("unread"), F.max(F.size("v")).alias("width"))
        full = counts.withColumnRenamed("documents", "expected").join(have, ["doc_id", "bucket"], "full").fillna(0, ["expected", "stored", "unread"])
        wrong.append(full.where("stored > 0 and expected > 0 and stored <> expected").select("doc_id", "bucket", "expected", F.col("stored").alias("found")))
        width = manifest.join(have, ["doc_id", "bucket"]).where("width <> dimensions") if "dimensions" in manifest.columns else None
        if width is not None:
            wrong.append(width.select("doc_id", "bucket", F.col("dimensions").cast("long").alias("expected"), F.col("width").cast("long").alias("found")))
        out += [
            _find(meta.join(stored.select("doc_id").distinct(), "doc_id", "left_anti"), "warning", "INDEX_MISSING"),
            _find(stored.select("doc_id").distinct().join(manifest.select("doc_id").distinct(), "doc_id", "left_anti"), "error", "INDEX_MANIFEST_MISSING"),
            _find(full.where("(expected > 0 and stored = 0) or (expected = 0 and stored > 0)"), "error", "INDEX_FILE_INCONSISTENT", "bucket", "expected", "stored"),
            _find(full.where("unread > 0"), "error", "INDEX_READ_FAILED", "bucket", "unread"),
        ]
    return [*out, _find(reduce(DataFrame.unionByName, wrong), "error", "INDEX_COUNT_MISMATCH", "bucket", "expected", "found")]


#: Codes of files that are missing and of files that hold no JSON object (or lines of them), by what they are.
FILES = {
    "graph": ("GRAPH_FILE_MISSING", "GRAPH_FILE_INVALID"),
    "retrieval": ("RETRIEVAL_FILE_MISSING", "RETRIEVAL_FILE_INVALID"),
    "result": ("RESULT_JSON_MISSING", "RESULT_JSON_INVALID"),
    "manifest": ("INDEX_MANIFEST_MISSING", "INDEX_MANIFEST_INVALID"),
}


def file_rules(expected: DataFrame, found: DataFrame) -> list[DataFrame]:
    """Expected files (doc_id, kind: a key of FILES, path) against those found (path, content as text)."""
    both = expected.join(found, "path", "left")
    is_object = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))
    lines = F.filter(F.split(F.col("content"), "\n"), lambda x: F.trim(x) != "")
    good = F.when(F.col("kind") == "retrieval", F.forall(lines, is_object)).otherwise(is_object(F.col("content")))
    rows = both.withColumn("missing", F.col("content").isNull()).withColumn("good", good)
    out = []
    for kind, (lost, broken) in FILES.items():
        own = rows.where(F.col("kind") == kind)
        out += [_find(own.where("missing"), "error", lost, "path"), _find(own.where("not missing and not good"), "error", broken, "path")]
    return out


def asset_rules(nodes: DataFrame, meta: DataFrame, listed: DataFrame, roots: list[str]) -> list[DataFrame]:
    """Local images of figures, and source documents, that are under none of the roots. listed: path of the files that are there."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    there = listed.select(plain.alias("candidate")).distinct()

    def lost(rows: DataFrame, path: str) -> DataFrame:
        local = rows.where((F.trim(F.coalesce(path, F.lit(""))) != "") & ~T.is_remote(F.col(path))).withColumn("__row", F.monotonically_increasing_id())
        under = F.array(F.col(path), *[F.concat(F.lit(r.rstrip("/") + "/"), F.col(path)) for r in roots])
        tried = local.select("__row", F.explode(F.when(F.col(path).startswith("/"), F.array(F.col(path))).otherwise(under)).alias("candidate"))
        return local.join(tried.join(there, "candidate").select("__row").distinct(), "__row", "left_anti")

    said = F.coalesce(F.nullif(F.get_json_object("metadata", "$.image_path"), F.lit("")), F.get_json_object("metadata", "$.image_url"))
    return [
        _find(lost(nodes.where("node_type = 'figure'").withColumn("image", said), "image"), "error", "FIGURE_IMAGE_NOT_FOUND", "node_id", "image"),
        _find(lost(meta, "source_file"), "warning", "SOURCE_DOCUMENT_NOT_FOUND", "source_file"),
    ]


def deep_check_rule(meta: DataFrame, dependency: str) -> list[DataFrame]:
    """A warning for every document where the module that a deep check of its index asks for can't be imported."""
    import importlib.util

    missing = importlib.util.find_spec(dependency) is None
    return [_find(meta.where(F.lit(missing)).withColumn("dependency", F.lit(dependency)), "warning", "INDEX_DEEP_CHECK_UNAVAILABLE", "dependency")]


def result_rules(used: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """uids of a result (doc_id, evidence_uid, place: support or render, expected_type) against the graph."""
    known = nodes.select("evidence_uid", F.col("node_type").alias("is")).distinct()
    lost, there = used.join(known, "evidence_uid", "left_anti"), used.join(known, "evidence_uid")
    return [
        _find(lost.where("place = 'support'"), "error", "RESULT_SUPPORT_UID_UNRESOLVED", "evidence_uid"),
        _find(lost.where("place = 'render'"), "error", "RESULT_RENDER_UID_UNRESOLVED", "evidence_uid"),
        _find(there.where("place = 'render' and expected_type <> is"), "error", "RESULT_RENDER_TYPE_MISMATCH", "evidence_uid", "is"),
    ]


def findings(rules: list[DataFrame], keep: str | None = None) -> DataFrame:
    """All findings. With `keep`, a folder, each rule's are written there in turn and read again: together the rules make a plan of
    hundreds of stages, which the driver holds at once and which each use of the findings runs again."""
    if not keep:
        return reduce(DataFrame.unionByName, rules)
    for k, rule in enumerate(rules):
        shared.write(rule, f"{keep}/rule={k}")
    return rules[0].sparkSession.read.schema(FINDING).parquet(*[f"{keep}/rule={k}" for k in range(len(rules))])


def _with_examples(found: DataFrame, keys: list[str], shown: DataFrame) -> DataFrame:
    """Counts with examples; a null doc_id is a key too."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"), F.array().cast("array<string>").alias("examples"))
    both = counts.unionByName(shown.withColumn("n", F.lit(0).cast("long")).select(*counts.columns))
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.flatten(F.collect_list("examples")).alias("examples"))


def report(found: DataFrame, examples: int = 10, strict: bool = False) -> DataFrame:
    """Findings by document and code with counts and first examples; `strict` adds an error where there are warnings."""
    keys = ["doc_id", "severity", "code"]
    first = found.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("context"))).where(F.col("i") <= examples)  # before anything is collected
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list("context")).alias("examples"))
    out = _with_examples(found, keys, shown)
    if strict:
        warned = found.where("severity = 'warning'").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("error").alias("severity"), F.lit("STRICT_WARNING_FAILURE").alias("code"), "n", F.array().cast("array<string>").alias("examples"))
        out = out.unionByName(warned)
    return out


def verdict(found: DataFrame) -> DataFrame:
    """Per document: errors, warnings, and whether it passed."""
    return found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)
