import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.operators import validate
from docquarry.plans import pipeline
from docquarry.sources import files, index, shared
from docquarry.streaming.ingest import ingest


def test_jsonl_policies(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n[2]\n')
    (tmp_path / "b.jsonl").write_text('{"a":1}\nnope\n')
    read = lambda name, policy: files.read_jsonl(spark, str(tmp_path / name), "a int", policy).count()
    assert read("a.jsonl", "objects") == 1 and read("a.jsonl", "lenient") == 1 and read("b.jsonl", "lenient") == 1
    for name, policy in (("a.jsonl", "strict"), ("b.jsonl", "objects")):
        with pytest.raises(Exception, match="bad JSON line"):
            files.read_jsonl(spark, str(tmp_path / name), "a int", policy).collect()


def test_archives(spark, tmp_path):
    def packed(names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, f"# {n}")
        return b.getvalue()

    assert files.markdown_of_archive(packed(["a.md", "x/output.md"])) == "# x/output.md"
    assert files.markdown_of_archive(packed(["b.md", "a.md", "c.txt"])) == "# a.md"
    with pytest.raises(ValueError):
        files.markdown_of_archive(packed(["../a.md"]))
    (tmp_path / "p_cleaned.zip").write_bytes(packed(["a.md"]))
    assert files.read_archives(spark, str(tmp_path)).first().doc_id == "p"


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("d", "f", "## Introduction\nFig. 1 is here.\n")], "doc_id string, source_file string, md_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, source_file string, md_text string").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 2


def test_assets_and_secrets(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    (source / "images").mkdir(parents=True)
    (source / "p.md").write_text("x")
    (source / "images" / "a.png").write_bytes(b"1")
    out = tmp_path / "out"
    assert files.copy_assets(spark, f"file://{source}/p.md", f"file://{out}") == 2
    assert (out / "p.md").read_text() == "x" and (out / "images" / "a.png").read_bytes() == b"1"
    (source / "images" / "a.png").unlink()
    (source / "images" / "b.png").write_bytes(b"2")
    assert files.copy_assets(spark, f"file://{source}/p.md", f"file://{out}") == 2 and not (out / "images" / "a.png").exists()
    env = tmp_path / ".env"
    env.write_text("# no\nexport ONE='1'\nTWO=2\n")
    monkeypatch.setenv("TWO", "3")
    assert files.secret(("ZERO", "ONE"), str(env)) == ("1", "ONE") and files.secret(("TWO",), str(env)) == ("3", "TWO")
    with pytest.raises(ValueError, match="ZERO"):
        files.secret(("ZERO",))


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "f.md", "c1", "intro", [1.0, 0.0]), ("d", "f.md", "c2", "results", [0.0, 1.0])], "doc_id string, source_file string, node_id string, bucket string, v array<double>")
    index.write(rows.union(rows.limit(1)), str(tmp_path / "i"), "m")
    index.write(rows, str(tmp_path / "i"), "m", {"limit": "9"})  # the former index is gone
    vectors, manifest = index.read(spark, str(tmp_path / "i"), "intro")
    assert [r.node_id for r in vectors.collect()] == ["c1"]
    said = {r.bucket: (r.documents, r.created, r.dimensions) for r in manifest.collect()}
    assert said["intro"] == (1, True, 2) and said["metadata"] == (0, False, None) and len(said) == len(index.EVERY)
    assert index.listed(spark, str(tmp_path / "i")).where("path like '%parquet'").count() >= 3


def test_steps_leave_nothing_in_the_driver(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    shuffles = lambda: sum("shuffle" in str(f) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|"))
    collected = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before, times, mode = shuffles(), collected(), spark.conf.get(shared.CLEANUP, None)
    docs = spark.range(4).select(F.col("id").cast("string").alias("doc_id"), F.lit("f").alias("source_file"), F.lit("# A\n\n## 1. Introduction\nText.").alias("md_text"))
    parsed = pipeline.build(docs, keep=str(tmp_path)).parsed
    assert collected() > times and shuffles() <= before and spark.conf.get(shared.CLEANUP, None) == mode and parsed.count() == 4
    rules = [docs.select("doc_id", F.lit("error").alias("severity"), F.lit("X").alias("code"), "md_text").groupBy("doc_id", "severity", "code").agg(F.max("md_text").alias("context"))]
    before, times = shuffles(), collected()
    found = validate.findings(rules, str(tmp_path))
    assert collected() > times and shuffles() <= before and found.count() == 4
