"""The corpus pipeline, stage by stage, on each stage's own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from verdictmill.llm import exact_dedup, near_dedup
from verdictmill.llm.common import Scratch


def test_stages(spark, small):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, small))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 0:
            clean = labels.filter("quality = 1 and toxic = 0")
            assert docs.join(clean, "doc_id", "left_semi").count() >= 0.98 * before.join(clean, "doc_id", "left_semi").count()
        if k == 1:
            assert docs.count() == before.select(exact_dedup.text_digest(before["text"]).alias("d")).distinct().count()
        if k == 2:
            assert docs.count() == near_dedup.near_dedup(before).select("component_id").distinct().count()
        if k == 3:  # a row per copy, none beyond its text
            assert docs.count() > docs.select("doc_id").distinct().count() and docs.count() <= 2 * before.count()
            whole = before.select("doc_id", F.col("text").alias("all"))
            assert docs.join(whole, "doc_id").filter(~F.col("all").startswith(F.col("text"))).count() == 0
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[5] > 0


def test_registered(spark, small):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_on_odd_rows(spark, small):
    """Null and repeated ids, equal and different texts, long and empty ones: each stage gives its columns, and loses no text but by its decision."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = [r.text for r in docs.orderBy("doc_id").limit(12).collect()]
    rows = [(None, some[0], "en", "a", 1), (None, some[0], "en", "a", 1), (None, some[1], None, None, None), (3, some[2], "en", "a", 1), (3, some[3], "en", "b", 1), (3, some[3], "en", "b", 1), (4, "", "en", "a", 0), (5, None, None, None, None), (6, some[4] * 60, "en", "a", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, none = stage(spark, odd, small), stage(spark, odd.limit(0), small)
        assert none.count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {None, 3, 4, 5, 6} and {None, 3, 6} <= ids, name
    exact = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, odd, small).collect()]
    assert len(exact) == len(set(exact)) == 6 and {t for _, t in exact if t} == {t for _, t, *_ in rows if t}


CLASHES = "_other _hash _held _passes _rest _rests _size _key _row _id _lang _of _copy id hash lang_ keep_id n size group bin v".split()


def test_stages_with_columns_of_internal_names(spark, small):
    """Further columns pass every stage unread; ties (equal texts, equal lengths) are broken the same way on any partitioning."""
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60)
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    wide = wide.unionByName(wide.filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1000))  # copies, which tie in everything but their ids
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, again = stage(spark, wide, small), stage(spark, wide.repartition(3), small)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert out.agg(F.sum("length")).first() == again.agg(F.sum("length")).first()
            continue
        assert out.columns == wide.columns, name
        told = lambda df: sorted((r.doc_id, r._other, r.hash, r.text) for r in df.collect())
        assert told(out) == told(again) and all(o == f"_other{i if i < 1000 else i - 1000}" for i, o, _, _ in told(out)), name
