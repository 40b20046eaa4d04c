"""Further entries of the catalogue, composed from the same operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import documents as dc
from textloom.operators import frequency as fr
from textloom.operators import models as md
from textloom.operators import retrieval as rt
from textloom.operators import similarity as sm
from textloom.operators import weighed as wd
from textloom.operators.relations import dfm, prepared, token_rel
from textloom.plans import annotation as an
from textloom.plans import documents as pd_docs
from textloom.plans import models as pm
from textloom.plans import similarity as ps
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import ORACLE, QUERIES, query, table
from textloom.tables import written


def _also(name: str, of: str) -> None:
    """A second catalogue entry that the same query serves."""
    QUERIES[name] = QUERIES[of]
    if of in ORACLE:
        ORACLE[name] = ORACLE[of]


for _name, _of in {
    "token_estimate": "token_estimates", "join_lsh_candidates": "dup_lsh", "kwic_hit": "kwic_word", "rt_rank_metrics_alt": "win_rank_metrics",
    "join_parent_child": "rt_parent", "ev_predict": "ml_fit_eval", "clu_run": "clu_kmeans",
}.items():
    _also(_name, _of)


@query(" SELECT d.doc_id AS unit_id, p.score FROM documents d JOIN pred p ON p.unit_id = d.doc_id SEMI JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'en'", uses="pred")
def join_published(spark, d):
    published = table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"))
    return pm.predictions(spark, d).where("lang = 'en'").join(published, "unit_id", "left_semi").select("unit_id", "score")


@query(", v AS (SELECT DISTINCT lang, term FROM tok), n AS (SELECT lang, count(*) AS n FROM v GROUP BY lang) SELECT a.lang AS i, b.lang AS j, a.n AS n_i, b.n AS n_j, (SELECT count(*) FROM v x JOIN v y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = b.lang) AS both FROM n a JOIN n b ON a.lang < b.lang", uses="tk tok")
def join_cross_allpairs(spark, d):
    """All pairs of groups, also those that share no term; pairs of units go through shared terms (``sim_*``)."""
    terms = written(token_rel(prep(spark, d, "lang"), "lang").select("lang", "term").distinct(), "terms")
    n = terms.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    a, b = n.select(F.col("lang").alias("i"), F.col("n").alias("n_i")), n.select(F.col("lang").alias("j"), F.col("n").alias("n_j"))
    shared = terms.select(F.col("lang").alias("i"), "term").join(terms.select(F.col("lang").alias("j"), "term"), "term").where("i < j").groupBy("i", "j").agg(F.count("*").alias("both"))
    return a.join(b, F.col("i") < F.col("j")).join(shared, ["i", "j"], "left").na.fill(0, ["both"])


@query(
    f"""WITH {pd_docs._PAGES}, b AS (SELECT doc_id, page_number, length(trim(text, E' \\t\\r\\n')) AS n FROM pg WHERE trim(text, E' \\t\\r\\n') <> ''),
    c AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM b),
    u AS (SELECT doc_id, unnest(range(0, length(text), 400))::INT AS start FROM documents)
    SELECT u.doc_id, u.start, c.page_number FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.s <= u.start AND u.start < c.s + c.n"""
)
def join_page_lookup(spark, d):
    units = docs(spark, d).where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(400))).alias("start"))
    return dc.lookup_page(units, dc.canonical_pages(pd_docs.pages(spark, d))).select("doc_id", "start", "page_number")


@query(", x AS (SELECT DISTINCT term FROM tok WHERE lang = 'en'), y AS (SELECT DISTINCT term FROM tok WHERE lang = 'de') SELECT term, (term IN (SELECT term FROM x))::INT AS in_a, (term IN (SELECT term FROM y))::INT AS in_b FROM (SELECT term FROM x UNION SELECT term FROM y)", uses="tk tok")
def set_vocab_union(spark, d):
    rel = token_rel(prep(spark, d, "lang"), "lang").where(F.col("lang").isin("en", "de"))
    return rel.groupBy("term").agg(F.max((F.col("lang") == "en").cast("int")).alias("in_a"), F.max((F.col("lang") == "de").cast("int")).alias("in_b"))


@query("SELECT item_id AS claim_id, list_filter([item_id, item_id + 1, item_id + 2], lambda x: x % 2 = 0) AS kept FROM benchmark")
def set_claims_filter(spark, d):
    x = F.col("item_id")
    return table(spark, d, "benchmark").select(x.alias("claim_id"), F.filter(F.array(x, x + 1, x + 2), lambda v: v % 2 == 0).alias("kept"))


@query(r"SELECT doc_id AS unit_id, regexp_replace(text, '[0-9]+', '#', 'g') AS text FROM documents")
def clean_custom_regex(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.regexp_replace("text", "[0-9]+", "#").alias("text"))


@query(
    r"""SELECT doc_id AS unit_id, CASE WHEN i IS NULL THEN text ELSE array_to_string(l[1 : i - 1], E'\n') END AS text FROM (SELECT doc_id, text, l,
      list_min(list_filter(range(4, len(l) + 1), lambda k: regexp_matches(l[k], '(?i)^\s*(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list|endnotes)\s*:?\s*$'))) AS i
    FROM (SELECT doc_id, text, string_split(text, E'\n') AS l FROM documents))"""
)
def clean_bibliography(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.clean_bibliography(F.col("text")).alias("text"))


def _cleaned(c):  # noqa: ANN001, ANN202
    return tx.clean_tables(tx.clean_page_numbers(tx.clean_whitespace(tx.clean_dehyphenate(c))))


_KEEP = "array_to_string(list_filter(string_split({x}, E'\\n'), lambda y: NOT regexp_matches(y, {p})), E'\\n')"
_CLEANED = r"""a AS (SELECT doc_id, text, regexp_replace(text, '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g') AS c FROM documents),
    b AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, E'\r\n?', E'\n', 'g'), E'[ \t]+', ' ', 'g'), E'\n{3,}', E'\n\n', 'g'), E' ?\n ?', E'\n', 'g'), E' \t\n') AS c FROM a),
    p AS (SELECT doc_id, text, """ + _KEEP.format(x="c", p=r"'(?i)^\s*(?:page\s+)?(?:\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])\s*$'") + """ AS c FROM b),
    cl AS (SELECT doc_id, text, """ + _KEEP.format(x="c", p=r"E'^\\s*\\|.+\\|\\s*$|^\\s*\\|?[\\s:-]+\\|[\\s|:-]*$|(?:\t[^\t]*){3,}'") + """ AS cleaned FROM p)"""


@query("WITH " + _CLEANED + " SELECT doc_id AS unit_id, cleaned, sha256(text) AS before, sha256(cleaned) AS after FROM cl")
def clean_pipeline(spark, d):
    """The steps in order, with checksums before and after."""
    made = docs(spark, d).select(F.col("doc_id").alias("unit_id"), "text", _cleaned(F.col("text")).alias("cleaned"))
    return made.select("unit_id", "cleaned", tx.checksum(F.col("text")).alias("before"), tx.checksum(F.col("cleaned")).alias("after"))


@query("WITH " + _CLEANED + " SELECT doc_id, text, cleaned FROM cl ORDER BY doc_id LIMIT 20")
def clean_preview(spark, d):
    return docs(spark, d).orderBy("doc_id").limit(20).select("doc_id", "text", _cleaned(F.col("text")).alias("cleaned"))


@query("SELECT doc_id AS unit_id, lower(text) AS text FROM documents")
def tx_lower(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.lower("text").alias("text"))


@query(r"SELECT doc_id AS unit_id, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def tx_ws(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.normalized(F.col("text")).alias("text"))


@query("SELECT doc_id AS unit_id, nfc_normalize(text) AS text FROM documents")
def tx_unicode(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.nfc("text").alias("text"))


@query(r"SELECT doc_id AS unit_id, list_filter(t, lambda x: x NOT IN ('the','of') AND NOT regexp_matches(x, '^\p{N}+([.,]\p{N}+)*$')) AS tokens FROM tk", uses="tk")
def tok_full(spark, d):
    toks = tx.without_terms(tx.without_numbers(tx.tokens(F.col("text"))), ("the", "of"))
    return prepared(docs(spark, d), toks=toks)


@query(r"SELECT doc_id AS unit_id, list_filter(t, lambda x: x NOT IN ('the','of') AND NOT regexp_matches(x, '^\p{N}+([.,]\p{N}+)*$')) AS tokens FROM tk", uses="tk")
def tx_compose(spark, d):
    """The same by composing transforms of the whole relation."""
    steps = (
        lambda df: df.withColumn("tokens", tx.tokens(F.col("text"))),
        lambda df: df.withColumn("tokens", tx.without_numbers(F.col("tokens"))),
        lambda df: df.withColumn("tokens", tx.without_terms(F.col("tokens"), ("the", "of"))),
    )
    df = docs(spark, d)
    for step in steps:
        df = df.transform(step)
    return df.select(F.col("doc_id").alias("unit_id"), "tokens")


_PHRASES = (("of", "the"), ("in", "the"), ("the", "of", "the"))


@query(
    """, j AS (SELECT doc_id, len(t) AS n, regexp_replace(' ' || array_to_string(t, '  ') || ' ', ' (the)  (of)  (the) | (of)  (the) | (in)  (the) ', chr(1) || '\\0' || chr(1), 'g') AS s FROM tk),
    m AS (SELECT doc_id, n, array_to_string(list_transform(list_zip(string_split(s, chr(1)), range(0, len(string_split(s, chr(1))))), lambda x: CASE WHEN x[2] % 2 = 1 THEN ' ' || replace(trim(x[1]), '  ', '_') || ' ' ELSE x[1] END), '') AS s FROM j)
    SELECT doc_id AS unit_id, CASE WHEN n = 0 THEN [] ELSE string_split(trim(s), '  ') END AS tokens FROM m""",
    uses="tk",
)
def nlp_phrase_merge(spark, d):
    """Known phrases become one token, longest first, left to right."""
    return prep(spark, d).select("unit_id", tx.merged_phrases(F.col("tokens"), _PHRASES).alias("tokens"))


@query(
    "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(DISTINCT lang) FROM documents) AS n_languages, (SELECT count(*) FROM labels) AS n_labelled, (SELECT sum(n_chars)::BIGINT FROM documents) AS n_chars"
)
def agg_dashboard(spark, d):
    one = docs(spark, d).agg(F.count("*").alias("n_documents"), F.countDistinct("lang").alias("n_languages"), F.sum("n_chars").alias("n_chars"))
    return one.crossJoin(table(spark, d, "labels").agg(F.count("*").alias("n_labelled")))  # one row each


_SCHEMES = {"count": "wt_count", "binary": "wt_binary", "log_count": "wt_log_count", "tf": "wt_tf", "tfidf": "wt_tfidf", "sublinear_tfidf": "wt_sublinear", "bm25": "wt_bm25"}


@query(" UNION ALL ".join(f"SELECT '{scheme}' AS scheme, count(*) AS n, round(sum(weight), 1)::DOUBLE AS total FROM ({ORACLE[name]})" for scheme, name in _SCHEMES.items()))
def wt_catalog(spark, d):
    """Every weighting of the catalogue with its weights over the whole corpus."""
    return rounded(wd.scheme_totals(prep(spark, d)), 1)


@query(ps._W + " SELECT doc_id AS unit_id, term, round(w, 6) AS weight FROM v", uses="tk tok")
def vec_word_tfidf(spark, d):
    p = prep(spark, d)
    return rounded(sm.unit_tfidf(dfm(token_rel(p)), p.count()))


@query(" SELECT doc_id AS unit_id, ('0x' || left(md5(term), 8))::BIGINT % 262144 AS slot, count(*) AS count FROM tok GROUP BY ALL", uses="tk tok")
def agg_dfm_hashing(spark, d):
    """(unit_id, slot, count) over 2^18 hashed features."""
    slot = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 8), 16, 10).cast("long") % (1 << 18)
    return token_rel(prep(spark, d)).withColumn("slot", slot).groupBy("unit_id", "slot").agg(F.count("*").alias("count"))


@query(
    """WITH x AS (SELECT conv_id, turn, length(text) // 4 AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM x)
    SELECT conv_id, (t - n) // 200 AS pack, count(*) AS items, sum(n)::BIGINT AS tokens FROM s GROUP BY 1, 2"""
)
def rt_pack_reduce(spark, d):
    """Turns packed by the budget step that they start in."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("n"))
    t = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    return x.withColumn("pack", F.floor((t - F.col("n")) / 200)).groupBy("conv_id", "pack").agg(F.count("*").alias("items"), F.sum("n").alias("tokens"))


@query(rt.DIGEST_SQL.format(line="doc_id::VARCHAR", out="scope"))
def rt_scope_hash(spark, d):
    return rt.digests(docs(spark, d), "lang", "doc_id", F.col("doc_id").cast("string"), "scope")


@query(
    """, c AS (SELECT unit_id, value, count(*) AS c FROM ann GROUP BY 1, 2) SELECT value, count(*) AS n, round(sum(c) / (SELECT count(*) FROM ann), 8) AS share FROM c GROUP BY value""", uses="ann"
)
def rel_dominant(spark, d):
    ann = an.annotations(spark, d)
    total = ann.agg(F.count("*").alias("t"))
    by = ann.groupBy("value").agg(F.countDistinct("unit_id").alias("n"), F.count("*").alias("c")).crossJoin(F.broadcast(total))  # one row
    return rounded(by.select("value", "n", (F.col("c") / F.col("t")).alias("share")), 8)


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 5")
def split_values(spark, d):
    return docs(spark, d).where("lang IS NOT NULL").groupBy(F.col("lang").alias("value")).agg(F.count("*").alias("n")).where("n >= 5")


@query(", x AS (SELECT t, list_distinct(t) AS u FROM tk WHERE doc_id = 3), y AS (SELECT doc_id, list_distinct(t) AS u FROM tk WHERE doc_id <> 3) SELECT y.doc_id AS j, round(len(list_intersect(x.u, y.u)) / (len(x.u) + len(y.u) - len(list_intersect(x.u, y.u))), 6) AS score FROM x, y WHERE len(x.u) + len(y.u) > 0", uses="tk")
def dup_pair_score(spark, d):
    p = prep(spark, d).select("unit_id", F.array_distinct("tokens").alias("u"))
    one = p.where("unit_id = 3").select(F.col("u").alias("v"))
    both = F.size(F.array_intersect("u", "v"))
    made = p.where("unit_id <> 3").crossJoin(F.broadcast(one)).where(F.size("u") + F.size("v") > 0)  # one row
    return rounded(made.select(F.col("unit_id").alias("j"), (both / (F.size("u") + F.size("v") - both)).alias("score")))


@query(f"WITH {pm._TSQL}, n AS (SELECT topic, count(*) AS n FROM tp GROUP BY topic), p AS (SELECT x.topic AS i, y.topic AS j, count(*) AS s FROM tp x JOIN tp y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL) SELECT i, j, round(s / (a.n + b.n - s), 8) AS score FROM p JOIN n a ON a.topic = i JOIN n b ON b.topic = j")
def top_overlap(spark, d):
    made = sm.jaccard_pairs(pm._topic_terms(spark, d).select(F.col("topic").alias("unit_id"), "term"), 0.0)
    return rounded(made, 8)


@query()
def clu_reps(spark, d):
    """The three units nearest to the mean vector of their language."""
    groups = docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("group_key"))
    p = prep(spark, d)
    near = sm.item_to_group(sm.unit_tfidf(dfm(token_rel(p)), p.count()), groups)
    order = Window.partitionBy("group_key").orderBy(F.desc("score"), "unit_id")
    return near.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


@query()
def ml_embedding(spark, d):
    """A classifier on the supplied vectors: is the label even?"""
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    rows = md.grouped_split(e, "unit_id")
    made = md.classifier("logistic_regression").fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'"))
    return md.binary_metrics(made.withColumn("predicted", F.col("prediction").cast("int")), "label", "predicted")


@query()
def ev_coefficients(spark, d):
    """The ten terms that speak most for and against good quality."""
    fitted = md.fit(pm._labelled(spark, d))
    terms, weights = fitted.stages[0].vocabulary, fitted.stages[-1].coefficients.toArray()
    rows = sorted(zip(map(float, weights), terms))
    return spark.createDataFrame([(t, w) for w, t in rows[:10] + rows[-10:]], "term string, weight double")


@query("SELECT lower(source) AS a, lower(lang) AS b, count(*) AS n FROM documents GROUP BY ALL")
def opt_aliases(spark, d):
    return docs(spark, d).groupBy(F.lower("source").alias("a"), F.lower("lang").alias("b")).agg(F.count("*").alias("n"))


@query(", f AS (SELECT doc_id AS unit_id, term, count(*) AS count FROM tok GROUP BY ALL) SELECT * FROM f ORDER BY unit_id, term LIMIT 200", uses="tk tok")
def dfm_preview(spark, d):
    return dfm(token_rel(prep(spark, d))).orderBy("unit_id", "term").limit(200)



@query(ps._W + " SELECT b.doc_id AS unit_id, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b ON a.term = b.term AND b.doc_id <> 7 WHERE a.doc_id = 7 GROUP BY 1 ORDER BY round(sum(a.w * b.w), 9) DESC, unit_id LIMIT 10", uses="tk tok")
def win_topk_heap(spark, d):
    """The ten units most like one: only ten rows are kept in order."""
    scores = sm.query_scores(ps._weights(spark, d), 7).withColumn("order", F.round("score", 9))
    return rounded(scores.orderBy(F.desc("order"), "unit_id").limit(10).select("unit_id", "score"))


@query(" SELECT unit_id, ['ann', 'bea', 'cem'][(row_number() OVER (ORDER BY 1 - 2 * abs(score - 0.5) DESC, unit_id) - 1) % 3 + 1] AS annotator FROM (SELECT * FROM pred ORDER BY 1 - 2 * abs(score - 0.5) DESC, unit_id LIMIT 20)", uses="pred")
def al_assign(spark, d):
    """The 20 least certain units, dealt to three annotators in turn."""
    queue = pm.predictions(spark, d).select("unit_id", md.uncertainty(F.col("score")).alias("u")).orderBy(F.desc("u"), "unit_id").limit(20)
    place = (F.row_number().over(Window.orderBy(F.desc("u"), "unit_id")) - 1) % 3  # 20 rows
    return queue.select("unit_id", F.get(F.array(*[F.lit(n) for n in ("ann", "bea", "cem")]), place).alias("annotator"))


@query(" SELECT doc_id // 100 AS batch, count(*) AS n_units, sum(len(t))::BIGINT AS n_tokens FROM tk GROUP BY 1", uses="tk")
def tok_batched(spark, d):
    """Tokens by batches of a hundred ids, as they would be reported while a run goes on."""
    p = prep(spark, d)
    return p.groupBy(F.floor(F.col("unit_id") / 100).alias("batch")).agg(F.count("*").alias("n_units"), F.sum(F.size("tokens")).alias("n_tokens"))


@query(" SELECT doc_id AS unit_id, len(list_distinct(t))::BIGINT AS n_features, len(t)::BIGINT AS total FROM tk WHERE len(t) > 0", uses="tk")
def vec_word_count(spark, d):
    """The rows of the count matrix by their sizes."""
    return dfm(token_rel(prep(spark, d))).groupBy("unit_id").agg(F.count("*").alias("n_features"), F.sum("count").alias("total"))


@query(f"SELECT a.*, b.* EXCLUDE (n_units) FROM ({ORACLE['rel_fleiss']}) a, ({ORACLE['rel_diagnostics']}) b")
def rel_service(spark, d):
    """What a report of agreement holds: the coefficient beside what it rests on."""
    return QUERIES["rel_fleiss"](spark, d).crossJoin(QUERIES["rel_diagnostics"](spark, d).drop("n_units"))  # one row each


@query(f"SELECT l.tvd, l.psi, s.ks FROM ({ORACLE['dr_labels']}) l, ({ORACLE['dr_scores']}) s")
def dr_service(spark, d):
    """All drift of labels and scores in one row."""
    return QUERIES["dr_labels"](spark, d).crossJoin(QUERIES["dr_scores"](spark, d).select("ks"))  # one row each


@query(
    """, c AS (SELECT lang AS subgroup, count(*)::DOUBLE AS n, sum((truth = (score >= 0.5)::INT)::INT) / count(*) AS po, avg(truth) AS t, avg((score >= 0.5)::INT) AS p FROM pred WHERE truth IS NOT NULL GROUP BY lang)
    SELECT subgroup, round(CASE WHEN t * p + (1 - t) * (1 - p) >= 1 THEN 1 ELSE (po - (t * p + (1 - t) * (1 - p))) / (1 - (t * p + (1 - t) * (1 - p))) END, 6) AS kappa FROM c""",
    uses="pred",
)
def ms_agreement(spark, d):
    """Chance-corrected agreement of predictions with the truth in each group."""
    t, p = F.avg("truth").alias("t"), F.avg("predicted").alias("p")
    by = pm.judged(spark, d).groupBy(F.col("lang").alias("subgroup")).agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("po"), t, p)
    chance = F.col("t") * F.col("p") + (1 - F.col("t")) * (1 - F.col("p"))
    return rounded(by.select("subgroup", F.when(chance >= 1, 1.0).otherwise((F.col("po") - chance) / (1 - chance)).alias("kappa")))


@query("SELECT 'l_quantity' AS outcome, CASE WHEN count(DISTINCT l_quantity) = 2 THEN 'logit' ELSE 'ols' END AS model FROM lineitem UNION ALL SELECT 'l_linestatus', CASE WHEN count(DISTINCT l_linestatus) = 2 THEN 'logit' ELSE 'ols' END FROM lineitem")
def st_dispatch(spark, d):
    """Which regression an outcome calls for: two values a logistic one, more a linear one."""
    made = table(spark, d, "lineitem").agg(*[F.countDistinct(c).alias(c) for c in ("l_quantity", "l_linestatus")])
    kinds = F.array(*[F.struct(F.lit(c).alias("outcome"), F.when(F.col(c) == 2, "logit").otherwise("ols").alias("model")) for c in ("l_quantity", "l_linestatus")])
    return made.select(F.explode(kinds).alias("k")).select("k.*")
