import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        names.append(name)
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert len(rows) == len({r.doc_id for r in rows}) > 0 and all(r.lossless for r in rows)
    assert names == ["toxicity", "near_dedup", "decontamination"]


def test_stages_take_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.fixture()
def small(spark, tmp_path, odd):
    """A folder of tables with null ids and texts, repeats, a long text, a secret, a benchmark item and columns of clashing names."""
    words = [f"w{i}x{k}" for i in range(40) for k in range(12)]
    texts = [*odd, " ".join(words[:200]), " ".join(words[:200] + ["end"]), "before " + " ".join(words[300:312]) + " after it", 'some words token = "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c" and more']
    texts += [f"you are a filthy stupid moron number {i} and pathetic scum" if i % 10 == 1 else f"a quiet walk along river number {i} in spring " * (1 + i % 30) for i in range(100)]
    rows = [(None if i == 3 else i, t, "en", "s", len(t or ""), "clash", 1, 2, [3]) for i, t in enumerate(texts)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, mark int, bits array<int>"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int((i - 12) % 10 == 1)) for i in range(12, 112)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[300:312])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_rows_run_through(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = corpus_pipeline.run(spark, small).collect()
    ids = {r.doc_id for r in rows}
    assert 8 in ids and 9 not in ids  # near copies: the least id stays
    assert 10 not in ids and 11 in ids  # the benchmark item goes, the secret's document stays
    assert len([r for r in rows if r.doc_id in range(5, 7)]) <= 2 and all(r.lossless is not False for r in rows)
    assert len(rows) < docs.count()


def test_stages_equal_brute_force(spark, small):
    from cairn.llm import common, secret_scan, toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit_on_tables(docs, common.table(spark, small, "labels"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = corpus_pipeline.toxicity_stage(spark, docs, small).collect()
    assert {r.doc_id for r in kept} == {i for i, s in score.items() if s < corpus_pipeline.TOXIC}
    forest = secret_scan.fit_forest(secret_scan.builtin_findings(spark))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in secret_scan.scan(docs, forest).filter("is_secret").orderBy("doc_id", "start", ascending=[True, False]).collect():
        t = text[r.doc_id]
        text[r.doc_id] = t[: r.start] + "[SECRET]" + t[r.start + r.length :]
    got = corpus_pipeline.secret_stage(spark, docs, small)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == text
    assert sum("[SECRET]" in (t or "") for t in text.values()) == 1
    out = {r.doc_id: r for r in corpus_pipeline.pieces_stage(spark, docs, small).collect()}
    from cairn.llm import pieces, queries

    m = pieces.load(queries.PIECE_MODEL)
    assert all(pieces.decode(out[r.doc_id].ids, m) == r.text for r in docs.collect())
