import corpus_pipeline as cp

from tidemark.llm.registry import QUERIES


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs, _ = cp.written(out, "step")
        assert 0 < docs.count() <= before
    last = sorted(map(tuple, cp.STAGES[-1][1](spark, docs, sf).collect()))
    assert last == sorted(map(tuple, cp.run(spark, sf).collect()))


def test_stages_on_awkward_tables(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    cols = docs.columns
    odd = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for c in ("text", "lang", "source", "n_chars"):
        odd = odd.unionByName(docs.limit(2).withColumn(c, F.lit(None).cast(docs.schema[c].dataType)).select(*cols))
    odd = odd.withColumn("text", F.when(F.col("doc_id") == 7, "").otherwise(F.col("text")))
    for c in ("bucket", "measured", "rep_key", "sig", "kept"):
        odd = odd.withColumn(c, F.lit(1))
    for table in (odd, odd.limit(0)):
        d, _ = cp.written(table, "step")
        for _, stage in cp.STAGES[:-1]:
            out, _ = cp.written(stage(spark, d, sf), "step")
            assert out.columns == table.columns and out.count() <= d.count()
            d = out
        assert cp.STAGES[-1][1](spark, d, sf).count() >= d.where("text is not null").count()


def test_stages_hand_few_texts_to_python_at_once(spark, sf):
    import pyarrow as pa
    from pyspark.sql import functions as F

    def batch_mb(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes / 1e6])], ["mb"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))  # 30 MB in one task
    sizes = cp.bounded(lambda spark, docs, sf: cp.written(docs.mapInArrow(batch_mb, "mb double"), "sizes")[0])
    for own in (None, str(1 << 20)):
        if own:
            spark.conf.set(name, own)
        try:
            mb = [r["mb"] for r in sizes(spark, texts, sf).collect()]
            assert sum(mb) > 29 and max(mb) < (1.2 if own else 4.5)
            assert spark.conf.get(name, None) == own  # the session's setting comes back
        finally:
            spark.conf.unset(name)
    assert all(hasattr(stage, "__wrapped__") for _, stage in cp.STAGES)


def test_classifier_stage_leaves_no_texts_for_python(spark, sf):
    out = dict(cp.STAGES)["quality classifier"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
