import corpus_pipeline
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and all(any(map(str.isalpha, t)) for t in texts.values())
    unique = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, c in brute(texts, 5, 80, 100).values()})
    clean = corpus_pipeline.decontamination(spark, unique, SF)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and not any(i in " ".join(t.split()) for t in left.values() for i in items)
    private = corpus_pipeline.privacy(spark, clean, SF)
    rows = private.collect()
    assert private.columns == docs.columns and {r.doc_id for r in rows} == left.keys()
    assert not any("@mail" in r.text for r in rows) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in corpus_pipeline.packing(spark, private, SF).collect()} == left.keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]


def test_odd_documents_pass_through(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "mail a@b.co", None, "s", 11), (3, "mail a@b.co", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {(r.doc_id, r.text) for r in corpus_pipeline.privacy(spark, docs, SF).collect()}
    assert out == {(1, None), (2, ""), (None, "mail <email>"), (3, "mail <email>")}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), SF).collect()) == [1, 2, 3]
    unnamed = docs.where("doc_id is null")
    assert [r.text for r in corpus_pipeline.near_duplicates(spark, unnamed.unionByName(unnamed), SF).collect()] == ["mail a@b.co"]


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_one_id_with_several_texts_and_repeated_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 600").orderBy("doc_id").limit(3).collect()]
    rows = [(1, prose[0]), (1, None), (1, item), (2, prose[1]), (2, prose[1]), (3, prose[1]), (3, prose[2])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    unique = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert texts(unique) == sorted({(1, prose[0]), (1, None), (1, item), (2, prose[1]), (3, prose[2])}, key=str)
    assert (1, prose[0]) in texts(corpus_pipeline.decontamination(spark, unique, SF)) and (1, item) not in texts(corpus_pipeline.decontamination(spark, unique, SF))
    named = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))
    known = [x for x in texts(corpus_pipeline.language(spark, named, SF)) if x[0] == 1]
    assert (1, prose[0]) in known and (1, None) not in known


def test_extra_columns_of_any_name_stay(spark):
    names = ["row_key", "text_key", "spans", "slot", "own", "row", "comp", "first", "kept", "copies", "base", "sid", "batch"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    wide = docs.selectExpr("*", *(f"concat('{n}-', doc_id) as {n}" for n in names))
    plain, extra = docs, wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, extra = stage(spark, plain, SF), stage(spark, extra, SF)
        assert extra.columns == wide.columns, name
        rows = extra.collect()
        assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names), name
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect()), name
    assert corpus_pipeline.packing(spark, extra, SF).count() == corpus_pipeline.packing(spark, plain, SF).count()
