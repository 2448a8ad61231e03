"""Metadata profiles: a document's front matter as a typed profile, its embedding text, its node and its search row.

A profile is JSON. profiled() merges what a model said into the default one, field by field. What a model is, is a callable
from a pandas Series of prompts to one of answers; a null answer means that it couldn't be asked.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json as J
from ..functions import text as X
from ..functions.models import model
from .chunk import SPECIAL, TOKEN, token_count

NODE_ID, NODE_TYPE = "metadata_structured", "metadata_structured"
NO_TITLE = "Structured document metadata"
MAX_TOKENS = 480
# The fields of a profile, and those of its embedding text in the order of their priority.
_LISTS = ("authors", "affiliations", "keywords", "main_findings", "material_systems", "alloy_family", "core_elements", "property_topics", "method_tags", "application_tags", "temperature_context")
FIELDS = {
    "bibliography": ("title", "authors", "affiliations", "corresponding_author", "email", "journal", "publisher", "year", "article_history", "keywords"),
    "abstract_profile": ("abstract", "research_goal", "method_summary", "main_findings", "significance"),
    "retrieval_profile": ("material_systems", "alloy_family", "core_elements", "property_topics", "method_tags", "application_tags", "task_type", "document_type", "temperature_context"),
}
HISTORY = ("received", "revised", "accepted", "available_online")
EMBEDDED = (
    ("Title", "title"), ("Keywords", "keywords"), ("Material systems", "material_systems"), ("Alloy family", "alloy_family"), ("Core elements", "core_elements"),
    ("Property topics", "property_topics"), ("Method tags", "method_tags"), ("Application tags", "application_tags"), ("Task type", "task_type"), ("Document type", "document_type"),
    ("Temperature context", "temperature_context"), ("Research goal", "research_goal"), ("Method summary", "method_summary"), ("Main findings", "main_findings"),
    ("Significance", "significance"), ("Abstract", "abstract"),
)
_GROUP = {field: group for group, fields in FIELDS.items() for field in fields}


def _kind(field: str) -> T.DataType:
    if field == "article_history":
        return T.StructType([T.StructField(h, T.StringType()) for h in HISTORY])
    return T.ArrayType(T.StringType()) if field in _LISTS else T.IntegerType() if field == "year" else T.StringType()


SCHEMA = T.StructType([T.StructField(group, T.StructType([T.StructField(f, _kind(f)) for f in fields])) for group, fields in FIELDS.items()])


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_default(f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit("") if isinstance(kind, T.StringType) else F.lit(None).cast(kind)


def _merged(said: Column, kind: T.StructType) -> Column:
    """A struct of `kind` from a JSON object: its values where it has the key, explicit nulls too; defaults elsewhere. Objects are
    merged in turn; a value of another kind than the field's is null. An object and its keys are read once, not for each of its fields."""

    def fields(x: Column) -> Column:
        out = []
        for field in kind:
            value = F.get_json_object(x["said"], f"$.{field.name}")
            if isinstance(field.dataType, T.StructType):
                typed = _merged(value, field.dataType)
            elif isinstance(field.dataType, T.ArrayType):
                typed = F.from_json(value, "array<string>")
            else:
                typed = value.try_cast(field.dataType)
            out.append(F.when(F.array_contains(x["keys"], field.name), typed).otherwise(_default(field.dataType)).alias(field.name))
        return F.struct(*out)

    keys = lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))
    return J.once(said, lambda x: J.once(F.struct(x.alias("said"), keys(x).alias("keys")), fields))


def profiled(answer: Column, called: Column | None = None) -> Column:
    """The profile in a model's answer, over the default one, with parse_status: llm_called, json_parsed, fallback_used."""
    called = answer.isNotNull() if called is None else called
    status = lambda said: F.struct(called.alias("llm_called"), said.isNotNull().alias("json_parsed"), said.isNull().alias("fallback_used"))
    return J.once(J.first_object(answer), lambda said: F.struct(_merged(F.coalesce(said, F.lit("{}")), SCHEMA).alias("profile"), status(said).alias("parse_status")))


def prompt(doc_id: Column, block: Column) -> Column:
    """What a model is asked: the front matter, and the fields that its answer must have."""
    wanted = "; ".join(f"{group}: {', '.join(fields)}" for group, fields in FIELDS.items())
    rules = (
        "Read the front matter of a scientific document and answer with one JSON object and nothing else. Take facts from the text alone; leave a field empty "
        f"(\"\", [] or null for the year) if the text doesn't give it. Tags are short terms, findings short statements. Objects and fields: {wanted}."
    )
    return F.concat(F.lit(f"{rules}\n\nDocument: "), doc_id, F.lit("\n\nFront matter:\n"), block)


def structured(parsed: DataFrame, client: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """doc_id, source_file, raw_metadata_block, llm_raw_response, profile and parse_status of documents with a metadata block."""
    rows = parsed.where(F.trim(F.coalesce("metadata_block", F.lit(""))) != "").select("doc_id", "source_file", F.col("metadata_block").alias("raw_metadata_block"))
    asked = prompt(F.col("doc_id"), F.col("raw_metadata_block"))
    answer = model(client, "string")(asked) if client else F.lit(None).cast("string")
    rows = rows.withColumn("llm_raw_response", answer)
    return rows.withColumn("p", profiled(F.col("llm_raw_response"))).select("doc_id", "source_file", "raw_metadata_block", F.coalesce("llm_raw_response", F.lit("")).alias("llm_raw_response"), "p.*")


def extraction(answer: Column) -> Column:
    """The four fields of an extraction, from a model's answer; minor variants of the keys count, others are left out."""
    said = J.first_object(answer)
    conditions = J.any_key(said, "experimental conditions", "experimental_conditions", "experimental condition")
    return F.struct(*[F.get_json_object(said, f"$.{k}").alias(k) for k in ("composition", "processing")], conditions.alias("experimental conditions"), F.get_json_object(said, "$.property").alias("property"))


def _value(profile: Column, field: str) -> Column:
    x = profile[_GROUP[field]][field]
    return X.joined(x) if field in _LISTS else x


_STATE = "struct<used:int,lines:array<string>,included:array<string>,truncated:string,omitted:array<string>,full:boolean>"


def embedding_text(profile: Column, budget: int = MAX_TOKENS) -> Column:
    """Struct of the text and its report: fields as `label: value` lines in the order of priority while they fit; the first that
    doesn't is cut at a token, if one of its value fits, and those after it are left out.

    Tokens are the default tokenizer's: they don't cross white space, so counts of lines add up.
    """
    piece = rf"(?U)\s*(?:{TOKEN})"
    room = budget - SPECIAL
    every = F.array(*[F.struct(F.lit(label).alias("label"), X.normalize_text(_value(profile, field)).alias("value")) for label, field in EMBEDDED])
    tokens = lambda x: F.size(F.regexp_extract_all(x, F.lit(piece), F.lit(0)))
    names = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        head, n = tokens(x["label"]) + 1, tokens(x["value"])
        rest = room - a["used"] - head
        cut = F.trim(F.array_join(F.slice(F.regexp_extract_all(x["value"], F.lit(piece), F.lit(0)), 1, F.greatest(rest, F.lit(0))), ""))
        add = lambda kept, value: F.concat(kept, F.array(value))
        line = lambda value: F.concat(x["label"], F.lit(": "), value)
        state = lambda used, lines, included, truncated, omitted, full: F.struct(
            used.cast("int").alias("used"), lines.alias("lines"), included.alias("included"), truncated.alias("truncated"), omitted.alias("omitted"), full.alias("full")
        ).cast(_STATE)
        whole = state(a["used"] + head + n, add(a["lines"], line(x["value"])), add(a["included"], x["label"]), a["truncated"], a["omitted"], F.lit(False))
        part = state(F.lit(room), add(a["lines"], line(cut)), add(a["included"], x["label"]), x["label"], a["omitted"], F.lit(True))
        none = state(a["used"], a["lines"], a["included"], a["truncated"], add(a["omitted"], x["label"]), F.lit(True))
        return F.when(a["full"], none).when(n <= rest, whole).when(rest > 0, part).otherwise(none)

    first = F.struct(F.lit(0).alias("used"), names.alias("lines"), names.alias("included"), F.lit(None).cast("string").alias("truncated"), names.alias("omitted"), F.lit(False).alias("full"))
    start = F.when(F.lit(budget) > SPECIAL, first.cast(_STATE))
    done = F.aggregate(F.filter(every, lambda x: x["value"] != ""), start, step)
    text = lambda d: F.coalesce(F.nullif(F.array_join(d["lines"], "\n"), F.lit("")), F.lit(NO_TITLE))
    report = lambda d: F.struct(text(d).alias("text"), token_count(text(d)).alias("token_count"), F.lit(budget).alias("max_embedding_tokens"), d["included"].alias("included_fields"), d["truncated"].alias("truncated_field"), d["omitted"].alias("omitted_fields"))
    return F.element_at(F.transform(F.array(done), report), 1)


def nodes(profiles: DataFrame, budget: int = MAX_TOKENS) -> DataFrame:
    """The structured metadata node of each row (doc_id, source_file, profile), with flat fields, report and profile in its metadata."""
    p = F.col("profile")
    flat = [F.col(f"profile.{group}.{f}").alias(f) for group in ("bibliography", "retrieval_profile") for f in FIELDS[group]]
    report = F.struct(*[F.col(f"e.{c}").alias(c) for c in ("max_embedding_tokens", "token_count", "included_fields", "truncated_field", "omitted_fields")])
    rows = profiles.withColumn("e", embedding_text(p, budget))
    title = F.coalesce(F.nullif(F.col("profile.bibliography.title"), F.lit("")), F.lit(NO_TITLE))
    meta = F.struct(F.lit("front_matter_structured").alias("block_type"), *flat, report.alias("embedding_config"), p.alias("structured_profile"))
    return rows.select("doc_id", "source_file", F.lit(NODE_ID).alias("node_id"), F.lit(NODE_TYPE).alias("node_type"), X.evidence_uid(F.col("doc_id"), F.lit(NODE_ID)).alias("evidence_uid"), title.alias("title"), F.col("e.text").alias("content"), F.to_json(meta, {"ignoreNullFields": "false"}).alias("metadata"))


def upgraded(cached: DataFrame, budget: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Cached nodes (doc_id, source_file, node_type, node_doc_id, metadata, raw_content) built again from the profile they hold,
    without a model; and the rows that can't be, which must be structured anew."""
    kept = F.nullif(F.get_json_object("metadata", "$.structured_profile"), F.lit("{}"))
    raw = F.when(F.get_json_object("raw_content", "$.metadata_type") == "document_profile", F.col("raw_content"))
    own = (F.col("node_type") == NODE_TYPE) & (F.trim(F.coalesce("node_doc_id", F.lit(""))).isin("") | (F.trim("node_doc_id") == F.col("doc_id")))
    rows = cached.withColumn("__said", F.when(own, F.coalesce(kept, raw)))
    good = rows.where("__said is not null").select("doc_id", "source_file", _merged(F.col("__said"), SCHEMA).alias("profile"))
    return nodes(good, budget), rows.where("__said is null").drop("__said")


def documents(all_nodes: DataFrame) -> DataFrame:
    """Search rows of structured metadata nodes with text: fields of the profile where it has the key, else the flat ones; bucket `metadata`."""
    rows = all_nodes.where(F.col("node_type") == NODE_TYPE).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    out = []
    for group in ("bibliography", "retrieval_profile", "abstract_profile"):
        said = F.get_json_object("metadata", f"$.structured_profile.{group}")
        keys = F.coalesce(F.json_object_keys(said), F.array().cast("array<string>"))
        for f in FIELDS[group]:
            if f in ("affiliations", "corresponding_author", "email", "article_history", "abstract"):
                continue
            here, flat = F.get_json_object(said, f"$.{f}"), F.get_json_object("metadata", f"$.{f}")
            value = F.when(F.array_contains(keys, f), here).otherwise(F.lit(None) if group == "abstract_profile" else flat)
            out.append((F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>")) if f in _LISTS else F.coalesce(value, F.lit(""))).alias(f))
    node = F.coalesce(F.nullif(F.trim("node_id"), F.lit("")), F.lit(NODE_ID))
    return rows.select("doc_id", "source_file", node.alias("node_id"), X.evidence_uid(F.col("doc_id"), node, F.col("evidence_uid")).alias("evidence_uid"), "node_type", F.trim("content").alias("text"), *out, F.lit("metadata").alias("bucket"))


def paper_citation(all_nodes: DataFrame) -> DataFrame:
    """doc_id and citation (title, year, journal) of every structured metadata node."""
    field = lambda f: F.get_json_object("metadata", f"$.{f}")
    return all_nodes.where(F.col("node_type") == NODE_TYPE).select("doc_id", J.citation(field("title"), field("year"), field("journal")).alias("citation"))
