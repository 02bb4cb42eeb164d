"""The stages of the pipeline, each on its own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from tests.llm.test_operators import jaccard_brute, lines_brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "mixture"]
    by = dict(P.STAGES)

    one = by["language"](spark, docs, sf)
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()

    two = by["line_dedup"](spark, docs, sf)
    want = lines_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == docs.columns
    assert all(want[d] == t for d, t in got.items())
    assert all(not want[d].strip() for d in set(want) - set(got))

    three = by["near_dedup"](spark, docs, sf)
    brute = jaccard_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in three.collect()} == {d for d, (_, c) in brute.items() if c == d}

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    four = {r["doc_id"] for r in by["decontamination"](spark, docs, sf).collect()}
    leaks = {r["doc_id"] for r in docs.collect() if any(i in r["text"] for i in items)}
    assert leaks and not leaks & four and len(four) > 0.8 * docs.count()

    last = by["mixture"](spark, docs, sf)
    assert last.count() > 0 and last.where(F.col("copy_no") < 0).count() == 0


def test_near_dedup_rows(spark):
    long = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = long("a") + " end"
    rows = [
        (None, long("n"), "clean"),
        (None, long("m"), "pair"),
        (None, long("m") + " end", "pair"),
        (None, "", "empty"),
        (7, long("a"), "one"),
        (7, long("a"), "one"),
        (7, near, "one"),
        (5, near, "least"),
        (9, long("b"), "other"),
        (9, long("c"), "other"),
        (8, long("n") + " end", "late"),
        (4, None, "wordless"),
        (4, None, "wordless"),
        (3, None, "wordless"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = P.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r["source"], str(r["doc_id"])) for r in out.collect())
    assert got == [("clean", "None"), ("empty", "None"), ("least", "5"), ("other", "9"), ("other", "9"), ("pair", "None"), ("wordless", "3"), ("wordless", "4")]


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert {"doc_id", "text", "copy_no", "mix_key"} <= set(out.columns) and out.count() > 0
