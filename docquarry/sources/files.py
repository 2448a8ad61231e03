"""Sources and sinks: Markdown, JSON, JSON lines under three error policies, archives, images and assets."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import model


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source_file, source_markdown and md_text of every file under a path."""
    rows = spark.read.text(path, wholetext=True).withColumn("source_markdown", F.input_file_name())
    label = T.source_label(F.col("source_markdown"))
    stem = F.regexp_replace(label, r"\.[^.]*$", "")
    return rows.select(T.document_id(stem).alias("doc_id"), label.alias("source_file"), "source_markdown", F.col("value").alias("md_text"))


def write_text(df: DataFrame, path: str, text: str = "md_text") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per file; a file that isn't one is an error."""
    rows = spark.read.text(path, wholetext=True)
    kind = F.coalesce(F.schema_of_variant(F.try_parse_json("value")), F.lit(""))
    checked = rows.withColumn("bad", F.assert_true(kind.startswith("OBJECT"), F.concat(F.lit("no JSON object: "), F.input_file_name())))
    return checked.where("bad is null").select(F.from_json("value", schema).alias("x")).select("x.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, policy: str = "strict") -> DataFrame:
    """JSON lines; blank lines are skipped. strict: every line must be an object; objects: lines must parse, those that aren't
    objects are skipped; lenient: any other line is skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    if policy not in ("strict", "objects", "lenient"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy != "lenient":
        must = is_object if policy == "strict" else parsed.isNotNull()
        lines = lines.withColumn("bad", F.assert_true(must, F.concat(F.lit("bad JSON line: "), F.substring("value", 1, 100)))).where("bad is null")
    return lines.where(is_object).select(F.from_json("value", schema).alias("x")).select("x.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def markdown_of_archive(data: bytes) -> str | None:
    """The Markdown of a ZIP archive: output.md, else the first by name; entries that leave the folder are refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") for n in names):
            raise ValueError("an entry leaves the folder")
        found = sorted((n for n in names if n.lower().endswith(".md")), key=lambda n: (n.rsplit("/", 1)[-1] != "output.md", n))
        return z.read(found[0]).decode() if found else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """As read_markdown, from ZIP archives that a converter made; archives without Markdown are left out."""

    def opened(batches):
        for b in batches:
            b["md_text"] = [markdown_of_archive(bytes(x)) for x in b.content]
            yield b.dropna(subset=["md_text"])[["path", "md_text"]]

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(opened, "path string, md_text string")
    label = T.source_label(F.col("path"))
    return rows.select(T.document_id(F.regexp_replace(label, r"\.[^.]*$", "")).alias("doc_id"), label.alias("source_file"), F.col("path").alias("source_markdown"), "md_text")


def converted(found: DataFrame, client: Callable[[pd.Series], pd.Series], done: DataFrame | None = None) -> DataFrame:
    """As read_markdown, from files (path, content) that a service turns into Markdown: `client` maps contents to texts, and null
    leaves a file out. Documents in `done` (doc_id) aren't sent again."""
    label = T.source_label(F.col("path"))
    rows = found.select(T.document_id(F.regexp_replace(label, r"\.[^.]*$", "")).alias("doc_id"), label.alias("source_file"), F.col("path").alias("source_markdown"), "content")
    if done is not None:
        rows = rows.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.withColumn("md_text", model(client, "string")("content")).drop("content").where("md_text is not null")


def image_uris(figures: DataFrame, images: DataFrame, base: str = "base_dir") -> DataFrame:
    """Figures with image_uri: a remote address as it is, else the data URI of the first image that is there of: an absolute path, the
    path under the document's folder, under that folder's parent, and the path alone. images: rows of the binaryFile source."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, "^file:/+", "/"), "/(?:[.]/)+", "/")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "jpg", "jpeg").when(ext == "", "png").otherwise(ext)
    data = images.select(plain(F.col("path")).alias("__path"), F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("content")).alias("__data")).dropDuplicates(["__path"])
    there = F.coalesce(F.nullif(F.trim("image_url"), F.lit("")), F.lit("")) if "image_url" in figures.columns else F.lit("")
    said = F.coalesce(F.nullif(F.trim("image_path"), F.lit("")), there)
    home = F.rtrim(F.coalesce(F.col(base), F.lit("")), F.lit("/")) if base in figures.columns else F.lit("")
    parent = F.regexp_replace(home, "/[^/]+$", "")
    tried = F.when(said.startswith("/"), F.array(said)).when(home == "", F.array(said)).otherwise(F.array(F.concat(home, F.lit("/"), said), F.concat(parent, F.lit("/"), said), said))
    rows = figures.withColumn("__row", F.monotonically_increasing_id()).withColumn("__remote", F.when(T.is_remote(there), there).when(T.is_remote(said), said))
    asked = rows.where(F.col("__remote").isNull() & (said != "")).select("__row", F.posexplode(tried).alias("__at", "__path")).withColumn("__path", plain(F.col("__path")))
    first = asked.join(data, "__path").groupBy("__row").agg(F.min_by("__data", "__at").alias("__data"))
    return rows.join(first, "__row", "left").withColumn("image_uri", F.coalesce("__remote", "__data")).drop("__row", "__remote", "__data")


def copy_assets(spark: SparkSession, source: str, target: str) -> int:
    """Copies a Markdown file and the `images` folder beside it (which replaces one that is there) into a folder, by the store's own
    file system; the number of files copied."""
    jvm = spark.sparkContext._jvm
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    copy = jvm.org.apache.hadoop.fs.FileUtil.copy
    file, folder = path(source), path(target)
    fs, out = file.getFileSystem(conf), folder.getFileSystem(conf)
    out.mkdirs(folder)
    copy(fs, file, out, path(folder, file.getName()), False, True, conf)
    images, kept = path(file.getParent(), "images"), path(folder, "images")
    if not fs.exists(images):
        return 1
    out.delete(kept, True)
    copy(fs, images, out, kept, False, True, conf)
    return 1 + fs.getContentSummary(images).getFileCount()


def write_json(df: DataFrame, path: str) -> None:
    """Each row as an indented JSON object in a file of its own; text beyond ASCII stays as it is."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).repartition(F.spark_partition_id()).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def secret(names: tuple[str, ...], env_file: str | None = None) -> tuple[str, str]:
    """The first of some environment variables that is set, and its name; a file of NAME=value lines fills in those that aren't."""
    values = dict(os.environ)
    if env_file:
        with open(env_file, encoding="utf-8") as f:
            pairs = (line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#"))
            for name, _, value in pairs:
                values.setdefault(name.strip(), value.strip().strip("\"'"))
    for name in names:
        if values.get(name):
            return values[name], name
    raise ValueError(f"none of {', '.join(names)} is set")
