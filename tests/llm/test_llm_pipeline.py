"""The pipeline's stages against what their operators say on the same rows."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_llm_operators import ODD, alike_groups, docs, five_word_sets
from textloom.llm import langid, pii, queries, sentencepieces

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    one = cp.language(spark, base, SF)
    judged = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(base, langid.fit(base)).collect()}
    kept = {r.doc_id for r in one.collect()}
    assert kept == {i for i, (lang, score) in judged.items() if lang != "und" and score >= cp.LEAST_SCORE}
    assert len(kept) >= 0.98 * base.count()

    two = cp.near_duplicates(spark, one, SF)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    group, pairs = alike_groups(five_word_sets(rows))
    left = {r.doc_id for r in two.collect()}
    assert set(group.values()) <= left  # nothing goes but near copies of what stays
    assert len(left - set(group.values())) <= 0.05 * max(1, len(pairs))

    three = cp.personal_data(spark, two, SF).collect()
    before = {r.doc_id: r.text for r in two.collect()}
    assert all(r.text == pii.mask(before[r.doc_id]) and r.n_chars == len(r.text) for r in three)
    assert not any(pii.plain(r.text) for r in three)

    four = cp.mix(spark, cp.personal_data(spark, two, SF), SF)
    assert four.columns == cp.COLUMNS and 0 < four.count() < len(three)

    encoder = sentencepieces.encoder_of(queries.piece_vocabulary())
    texts = {r.doc_id: r.text for r in four.collect()}
    for r in cp.encode(spark, four, SF).collect():
        assert r.ids == encoder.encode_all([texts[r.doc_id]]).to_pylist()[0]


def test_run_is_all_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


def test_stages_take_no_rows(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        assert f(spark, none, SF).count() == 0


def test_stages_take_odd_rows(spark):
    """Null, empty, blank, very long, repeated and null-id rows, with clashing extra columns."""
    base = docs(spark, ODD, extra=True).withColumn("n_chars", F.lit(0).cast("long")).withColumns({"lang_pred": F.lit("x"), "score": F.lit(0.0), "spans": F.lit("y")})
    for name, f in cp.STAGES:
        out = f(spark, base, SF)
        assert out.count() <= len(ODD), name
        assert out.columns == (cp.COLUMNS if name != cp.STAGES[-1][0] else ["doc_id", "n_tokens", "ids"])
