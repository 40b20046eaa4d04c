"""The operators of this subpackage as queries over the driver tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import embeddings, fingerprints, langid, materialize, mixing, pii, resample, sentencepieces, simhash, substrings, toxicity, urls, variants

#: Target shares of the mix; sources tend to equal shares.
MIX = {"_lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "_topic": {"prose": 0.85}}
MIX_SHARE = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in the folder that TEXTLOOM_TOKENIZERS names, or of the public package."""
    folder = os.environ.get("TEXTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_vocabulary() -> sentencepieces.Vocabulary:
    return sentencepieces.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))


def byte_pairs() -> materialize.BytePairs:
    import public_tokenizers

    return materialize.BytePairs.load(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.vector_components(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page's URL: the part of op3 that SQL can say too."""
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents' ids with cell, tokens and sampling probability, and the documents left out."""
    made = mixing.mixed(table(spark, sf_dir, "documents"), MIX, MIX_SHARE)
    return made.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_weight").alias("probability"),
        F.col("_sampled").alias("sampled"),
    )


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sentencepieces.encode_documents(table(spark, sf_dir, "documents"), piece_vocabulary())
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to a new folder in the shared one; returns their index, a row a sequence."""
    return materialize.materialize(table(spark, sf_dir, "documents"), byte_pairs())


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["added"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def plain_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many plain e-mail and IP addresses each text has: the part of op9 that SQL can say too."""
    return op9_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_phone")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = langid.predict(docs, langid.fit(docs))
    return made.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_fingerprints, op2_embedding_dedup, op3_url_filter, op4_source_mixing, op5_simhash_dedup,
            op6_substring_dedup, op7_sentencepiece, op8_training_order, op9_personal_data, op10_language_id,
            op11_importance_resampling, op12_toxicity, op13_spelling_variants, url_rules, plain_identifiers,
        )
    }


#: The longest rule that fits, as in ``urls.RULES``.
_URL_SQL = r"""WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
    h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u)
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h"""

_PLAIN_SQL = r"""WITH m AS (SELECT doc_id,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e,
    regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS i,
    regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]') AS p FROM documents)
    SELECT doc_id, len(e)::BIGINT AS n_email,
    len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: len(ltrim(y, '0')) > 3 OR coalesce(try_cast(right(y, 3) AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
    len(list_filter(p, lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))::BIGINT AS n_phone FROM m"""


#: CRC-32 of every string of a relation ``feed`` (x), one byte a round.
_CRC = r"""tab AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
    steps AS (SELECT x, hex(encode(x)) AS hx, 0 AS k, 4294967295::BIGINT AS c FROM feed
        UNION ALL SELECT x, hx, k + 1, xor(c >> 8, v) FROM steps JOIN tab ON i = xor(c, ('0x' || hx[2 * k + 1 : 2 * k + 2])::BIGINT) & 255 WHERE 2 * k < length(hx)),
    crc AS (SELECT x, xor(c, 4294967295) AS h FROM steps WHERE 2 * k = length(hx))"""
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11_SQL = rf"""WITH RECURSIVE w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
        UNION ALL SELECT 1, item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') FROM benchmark),
    f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
    feed AS (SELECT DISTINCT x FROM f), {_CRC},
    b AS (SELECT side, id, h % 10000 AS b FROM f JOIN crc USING (x)),
    total AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM b),
    gain AS (SELECT b, floor(1000 * ln((count(*) FILTER (side = 1) + 1)::DOUBLE * (any_value(s) + 10000) / ((count(*) FILTER (side = 0) + 1)::DOUBLE * (any_value(t) + 10000))))::BIGINT AS g FROM b, total GROUP BY b),
    d AS (SELECT id, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM b JOIN gain USING (b) WHERE side = 0 GROUP BY id),
    a AS (SELECT id AS doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d USING (id) WHERE side = 0),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a WHERE n >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)"""

_OP13_SQL = rf"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    o AS (SELECT doc_id || ':' || run AS x, any_value(run) AS run, count(*) AS times FROM t GROUP BY 1),
    feed AS (SELECT x FROM o), {_CRC},
    e AS (SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM o JOIN crc USING (x)),
    word AS (SELECT word, sum(times)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
    cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
    less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM cut),
    near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b USING (d, i) WHERE a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.d = b.word),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
    form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM word LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.at = form.word WHERE form.form IS NOT NULL)
    SELECT f.word, n, n_near, form, form_n, walk.at AS root FROM form f JOIN walk ON walk.word = f.word WHERE walk.at NOT IN (SELECT word FROM form WHERE form IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    """op11 and op13 in full, op3's rules and counts of op9's plain identifiers can be said in SQL. The rest rests on
    hashes, models or byte work that SQL lacks, or on all pairs or windows of whole tables; their tests
    compare with brute force instead."""
    return {"op11_importance_resampling": _OP11_SQL, "op13_spelling_variants": _OP13_SQL, "url_rules": _URL_SQL, "plain_identifiers": _PLAIN_SQL}
