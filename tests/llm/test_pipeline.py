import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{k}")
        docs, last = spark.read.parquet(f"file://{tmp_path}/{k}"), docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first and docs.dtypes == last.dtypes and docs.count() <= last.count()
    assert 0.5 * before < last.count() < before
    assert docs.select("doc_id").distinct().count() == last.count()


def test_odd_rows_pass_all_stages(spark, odd_docs):
    """Nulls in any column, empty and long texts, repeated rows and clashing names: clean rows stay, columns are kept."""
    docs = odd_docs.selectExpr("*", "'a' AS _n_lines", "'b' AS _n_dropped", "'c' AS _bad", "'d' AS key", "1.5D AS score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "5", "5", "7", "None"], name
        assert {(r._n_lines, r._n_dropped, r._bad, r.key, r.score) for r in rows} == {("a", "b", "c", "d", 1.5)}, name
        docs = spark.createDataFrame(rows, out.schema)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {str(p.doc_id) for p in pieces} == {"1", "2", "3", "4", "5", "7", "None"}
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_planted_cases_are_decided(spark):
    """Copies, repeated passages and benchmark items planted among clean texts, against what each stage must do."""
    import random

    rng = random.Random(12)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").first().text
    passage, base = text(60), text(200)
    rows = [(i, text(150)) for i in range(50)]
    rows += [(100 + i, f"{text(120)}\n{passage}\n{text(30)}") for i in range(5)]
    rows += [(200, base), (201, base), (202, base + " more"), (203, base.replace(" ", "  "))]
    rows += [(300, f"{text(40)} {item} {text(40)}")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    run = dict(corpus_pipeline.STAGES)
    lines = run["line dedup"](spark, docs, SF)
    assert [r.doc_id for r in lines.filter(lines.text.contains(passage)).collect()] == [104]
    groups = {r.doc_id for r in run["n-gram Jaccard join"](spark, lines, SF).collect()}
    assert groups == {i for i, _ in rows} - {201, 202, 203}
    kept = {r.doc_id for r in run["benchmark decontamination"](spark, lines, SF).collect()}
    assert kept == {i for i, _ in rows} - {300}


def test_workers_get_bounded_batches(spark):
    """However long the texts, an Arrow batch stays small: an executor holds one for each task in its JVM and in Python."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64()), "rows": pa.array([batch.num_rows], pa.int64())})

    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('some text ', 5000) AS text", "'en' AS lang", "'a' AS source", "50000L AS n_chars")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name != "line dedup":  # which runs no Python
            spark.conf.unset(setting)
            stage(spark, docs.limit(0), SF)
            got = docs.mapInArrow(sizes, "bytes long, rows long").collect()
            assert sum(r.rows for r in got) == 400 and max(r.bytes for r in got) < 4_000_000, name
    spark.conf.unset(setting)
