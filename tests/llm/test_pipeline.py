"""The pipeline stage by stage."""

from collections import Counter

from compare import SMALL

import corpus_pipeline
from stowage.llm import exact_dedup, minhash, mixing, packing, quality_rules


def test_each_stage_takes_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(path)
        docs_after = spark.read.parquet(path)
        held.append((docs, docs_after))
        docs = docs_after
    names = held[0][0].columns
    assert all(after.columns == names for _, after in held[:-1])
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    kept = lambda df: Counter(r.doc_id for r in df.filter("kept").select("doc_id").collect())
    assert ids(held[0][1]) == kept(quality_rules.judge(held[0][0]))
    assert ids(held[1][1]) == kept(exact_dedup.classes(held[1][0]))
    assert ids(held[2][1]) == kept(minhash.classes(held[2][0]))
    copies = {r.doc_id: r.copies for r in mixing.curriculum(held[3][0]).collect() if r.copies}
    assert ids(held[3][1]) == Counter(copies)
    want = packing.pieces(held[4][0], packing.tokenizer_path())
    assert ids(held[4][1]) == ids(want)
    assert corpus_pipeline.run(spark, SMALL).count() == held[4][1].count()


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns with working names; then the same columns without a row."""
    long_text = ". ".join(f"Word{i} tells{i} us{i} of{i} things{i}" for i in range(4000)) + "."
    plain = ". ".join(f"Fact{i} tells{i} us{i} new{i} things{i}" for i in range(30)) + "."
    rows = [(1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain + " More of it.", None, None), (None, plain + " x", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, long_text, "en", "b"), (6, long_text + " End.", "en", "b"), (7, "home " * 50_000, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars", "'x' AS row", "'x' AS uid", "'x' AS at", "'x' AS `__row`", "'x' AS size")
    for name, table in (("rows", docs), ("none", docs.limit(0))):
        kept = []
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, table, SMALL).write.parquet(f"{tmp_path}/{name}/{step}")
            after = spark.read.parquet(f"{tmp_path}/{name}/{step}")
            assert step == "bestfit_packing" or after.columns == docs.columns
            table = after
            kept.append(Counter(r.doc_id for r in after.select("doc_id").collect()))
        if name == "none":
            assert kept == [Counter()] * 5
        else:
            assert kept[0] == Counter({1: 2, 2: 1, None: 1, 5: 1, 6: 1}) and kept[1] == Counter([1, 2, None, 5, 6]) and kept[2] == Counter([1, 5])
    # stages may follow each other without a written table between them
    assert Counter(r.doc_id for r in corpus_pipeline.near(spark, corpus_pipeline.exact(spark, docs.filter("doc_id IN (1, 2)"), SMALL), SMALL).collect()) == Counter([1])
