"""Queries on scans, facets, joins, cleaning, quality and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import documents as dc
from textloom.operators.memory import SECRETS, matches

from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import query, table


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 500")
def scan_documents(spark, d):
    return dc.select_documents(docs(spark, d), {"lang": "de"}, {"n_chars": 500}).select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE source = 'src3'")
def flt_equality(spark, d):
    return dc.select_documents(docs(spark, d), {"source": "src3"}).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 300 AND n_chars <= 900")
def flt_year_range(spark, d):
    return dc.select_documents(docs(spark, d), None, {"n_chars": 300}, {"n_chars": 900}).select("doc_id", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (1, 5, 8, 13)")
def flt_doc_ids(spark, d):
    return dc.with_ids(docs(spark, d), [1, 5, 8, 13]).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(source), 'thing')")
def flt_search(spark, d):
    return dc.select_documents(docs(spark, d), search="Thing", among=("text", "source")).select("doc_id")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def set_allow_list(spark, d):
    return dc.with_ids(docs(spark, d), table(spark, d, "labels")).select("doc_id", "source")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facet_counts(spark, d):
    return dc.facets(docs(spark, d), ["lang", "source"])


@query("""WITH c AS (SELECT count(d.lang) / count(*) AS lang, count(l.quality) / count(*) AS quality FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'lang' AS field, round(lang, 8) AS coverage FROM c UNION ALL SELECT 'quality', round(quality, 8) FROM c UNION ALL SELECT 'overall', round((lang + quality) / 2, 8) FROM c""")
def meta_coverage(spark, d):
    joined = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(dc.coverage(joined, ["lang", "quality"]), 8)


@query("SELECT coalesce(lang, 'unknown') AS language, count(*) AS count FROM documents GROUP BY 1")
def language_counts(spark, d):
    return docs(spark, d).groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count("*").alias("count"))


@query("SELECT doc_id AS unit_id, coalesce(nullif(source, ''), 'unspecified') AS group_key FROM documents")
def group_key(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unspecified")).alias("group_key"))


@query("SELECT event_type AS run_type, user_id % 3 AS status, count(*) AS n FROM events GROUP BY 1, 2")
def runs_grouped(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run_type"), (F.col("user_id") % 3).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS run_type, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def win_latest(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run_type")).agg(F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT source, max(doc_id) + 1 AS next_version FROM documents GROUP BY source")
def win_next_version(spark, d):
    return docs(spark, d).groupBy("source").agg((F.max("doc_id") + 1).alias("next_version"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def win_page(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 100 OFFSET 0")
def result_paging(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(100)


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS rank FROM documents ORDER BY rank, doc_id LIMIT 400")
def win_case_order(spark, d):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return docs(spark, d).select("doc_id", rank.alias("rank")).orderBy("rank", "doc_id").limit(400)


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l USING (doc_id)")
def join_inner(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.source, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def join_left_count(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("one"))
    return docs(spark, d).select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(F.count("one").alias("n"))


@query("SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id OR (d.doc_id IS NULL AND l.doc_id IS NULL)")
def join_revision(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return docs(spark, d).join(labels, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "source", "toxic")


@query("SELECT l.doc_id AS unit_id, d.source FROM labels l JOIN documents d USING (doc_id)")
def join_hash_lookup(spark, d):
    return table(spark, d, "labels").join(docs(spark, d).select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("unit_id"), "source")


@query("""WITH a AS (SELECT lang AS k, count(*) AS a FROM documents WHERE source = 'src1' GROUP BY lang), b AS (SELECT lang AS k, count(*) AS b FROM documents WHERE source = 'src2' GROUP BY lang)
    SELECT k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (k)""")
def join_full_outer_counts(spark, d):
    of = lambda s, n: docs(spark, d).where(F.col("source") == s).groupBy(F.col("lang").alias("k")).agg(F.count("*").alias(n))
    return of("src1", "a").join(of("src2", "b"), "k", "full_outer").na.fill(0, ["a", "b"])


@query("""WITH p AS (SELECT lang, avg(quality) AS prevalence FROM labels JOIN documents USING (doc_id) GROUP BY lang), i AS (SELECT lang, avg(n_chars) AS indicator FROM documents GROUP BY lang)
    SELECT lang AS group_key, round(prevalence, 8) AS prevalence, round(indicator, 6) AS indicator FROM p JOIN i USING (lang)""")
def join_context(spark, d):
    p = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("prevalence"))
    i = docs(spark, d).groupBy("lang").agg(F.avg("n_chars").alias("indicator"))
    return p.join(i, "lang").select(F.col("lang").alias("group_key"), F.round("prevalence", 8).alias("prevalence"), F.round("indicator", 6).alias("indicator"))


@query(r"""SELECT doc_id AS unit_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, E'\r\n?', E'\n', 'g'), E'[ \t]+', ' ', 'g'), E' ?\n ?', E'\n', 'g'), E'\n{3,}', E'\n\n', 'g'), E' \n') AS text FROM documents""")
def clean_whitespace(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.clean_whitespace(F.col("text")).alias("text"))


@query(r"SELECT doc_id AS unit_id, regexp_replace(text, '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g') AS text FROM documents")
def clean_dehyphenate(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.clean_dehyphenate(F.col("text")).alias("text"))


@query(r"SELECT doc_id AS unit_id, array_to_string(list_filter(string_split(text, E'\n'), lambda x: NOT regexp_matches(x, '(?i)^\s*(?:page\s+)?(?:\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—])\s*$')), E'\n') AS text FROM documents")
def clean_page_numbers(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.clean_page_numbers(F.col("text")).alias("text"))


@query(r"SELECT doc_id AS unit_id, array_to_string(list_filter(string_split(text, E'\n'), lambda x: NOT regexp_matches(x, E'^\\s*\\|.+\\|\\s*$|^\\s*\\|?[\\s:-]+\\|[\\s|:-]*$|(?:\t[^\t]*){3,}')), E'\n') AS text FROM documents")
def clean_tables(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), tx.clean_tables(F.col("text")).alias("text"))


@query(r"""SELECT doc_id AS unit_id, length(text) AS n_chars, len(regexp_extract_all(text, '\p{L}'))::BIGINT AS letters, len(regexp_extract_all(text, '[\s\x{0B}\x{A0}\x{85}\x{2028}\x{2029}]|\p{Zs}'))::BIGINT AS blanks FROM documents""")
def qa_document(spark, d):
    return dc.quality(docs(spark, d)).select("unit_id", "n_chars", "letters", "blanks")


@query("SELECT sha256(text) AS key, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) >= 2")
def qa_exact_dups(spark, d):
    return docs(spark, d).groupBy(tx.checksum(F.col("text")).alias("key")).agg(F.count("*").alias("count")).where("count >= 2")


@query(""", l AS (SELECT doc_id AS unit_id, len(t) AS n_tokens FROM tk), s AS (SELECT avg(n_tokens) AS m, stddev_pop(n_tokens) AS s FROM l)
    SELECT unit_id, n_tokens, round((n_tokens - m) / s, 6) AS z FROM l, s WHERE abs((n_tokens - m) / s) >= 3""", uses="tk")
def qa_token_outliers(spark, d):
    return rounded(dc.length_outliers(prep(spark, d).select("unit_id", F.size("tokens").alias("n_tokens"))))


# Signs of text written to steer a model.
INJECTION = (
    "(?i)ignore (all )?(previous|prior|system) (instructions|rules)|ignore (all )?(previous|prior) (system )?(instructions|rules)"
    "|you are now (in )?developer mode|reveal (the )?(secret|password|api[_-]?key|token)|override (system|developer|safety)"
)


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{INJECTION}')")
def policy_injection(spark, d):
    return docs(spark, d).where(F.col("text").rlike(INJECTION)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in SECRETS))
def policy_secrets(spark, d):
    return docs(spark, d).where(matches(F.col("text"), SECRETS)).select("doc_id")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, E'\n\\s*\n+'), lambda x: trim(x, E' \t\n\r\v\f')), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, generate_subscripts(p, 1) - 1 AS position, sha256(unnest(p)) AS text_hash FROM p""")
def seg_paragraph(spark, d):
    return dc.segment(docs(spark, d), "paragraph").select("doc_id", F.col("position").cast("long").alias("position"), "text_hash")


@query()
def seg_sentence(spark, d):
    return dc.segment(docs(spark, d), "sentence")


@query("SELECT doc_id, 0 AS position, sha256(text) AS text_hash FROM documents")
def seg_document(spark, d):
    return dc.segment(docs(spark, d), "document").select("doc_id", "position", "text_hash")


@query()
def seg_dispatch(spark, d):
    one = docs(spark, d)
    return dc.segment(one, "document").unionAll(dc.segment(one, "paragraph")).unionAll(dc.segment(one, "sentence"))


@query("SELECT 'document' AS unit_type, count(*) AS n FROM documents")
def count_units_by_type(spark, d):
    return dc.segment(docs(spark, d), "document").groupBy("unit_type").agg(F.count("*").alias("n"))


@query(""", s AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 30, 1), 170)) AS s FROM tk WHERE len(t) > 0)
    SELECT doc_id AS unit_id, (s // 170)::INT AS chunk_index, array_to_string(t[s + 1 : s + 200], ' ') AS content FROM s""", uses="tk")
def seg_chunks(spark, d):
    return dc.token_chunks(prep(spark, d), 200, 30)


_PAGES = "pg AS (SELECT doc_id, i AS page_number, substr(text, i * 500 + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500))::INT AS i FROM documents))"


def pages(spark, d):
    """Whole documents cut into pages of 500 characters, in one pass over each text."""
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,500}"), F.lit(0))
    return docs(spark, d).select("doc_id", F.posexplode(cut).alias("page_number", "text"))


@query(f"""WITH {_PAGES}, b AS (SELECT doc_id, page_number, length(trim(text, E' \\t\\r\\n')) AS n FROM pg WHERE trim(text, E' \\t\\r\\n') <> ''),
    c AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM b)
    SELECT doc_id, page_number, s AS char_start, s + n AS char_end FROM c""")
def canon_pages(spark, d):
    made = dc.canonical_pages(pages(spark, d))
    return made.withColumns({c: F.col(c).cast("long") for c in ("char_start", "char_end")})


@query(f"""WITH {_PAGES}, l AS (SELECT doc_id, page_number, trim(unnest(string_split(text, E'\\n')), ' ') AS line FROM pg), n AS (SELECT doc_id, count(DISTINCT page_number) AS n FROM pg GROUP BY 1),
    k AS (SELECT doc_id, line, count(DISTINCT page_number) AS k FROM l WHERE line <> '' AND length(line) <= 120 GROUP BY 1, 2)
    SELECT doc_id, line FROM k JOIN n USING (doc_id) WHERE n >= 3 AND k >= greatest(2, floor(n * 0.6))""")
def page_header_footer(spark, d):
    return dc.repeated_lines(pages(spark, d))


@query("SELECT doc_id, lang, CASE WHEN n_chars > 5000 THEN 1200 WHEN n_chars < 600 THEN 400 ELSE 1000 END AS chunk_size FROM documents")
def chunk_policy(spark, d):
    size = F.when(F.col("n_chars") > 5000, 1200).when(F.col("n_chars") < 600, 400).otherwise(1000)
    return docs(spark, d).select("doc_id", "lang", size.alias("chunk_size"))


_LISTS = {"en": ["the", "of", "and", "in", "to"], "de": ["der", "die", "und", "den", "das"], "fr": ["le", "la", "les", "et", "des"], "es": ["el", "los", "que", "y", "del"]}


@query(""", s AS (SELECT doc_id, greatest(len(t), 1) AS n, len(list_filter(t, lambda x: x IN ('the','of','and','in','to'))) AS en, len(list_filter(t, lambda x: x IN ('der','die','und','den','das'))) AS de,
      len(list_filter(t, lambda x: x IN ('le','la','les','et','des'))) AS fr, len(list_filter(t, lambda x: x IN ('el','los','que','y','del'))) AS es FROM tk), b AS (SELECT *, greatest(en, de, fr, es) AS m FROM s)
    SELECT doc_id AS unit_id, CASE WHEN m = 0 THEN 'und' WHEN en = m THEN 'en' WHEN de = m THEN 'de' WHEN fr = m THEN 'fr' ELSE 'es' END AS language, round(least(1.0, 4 * m / n), 6)::DOUBLE AS confidence FROM b""", uses="tk")
def lang_detect_heuristic(spark, d):
    made = prep(spark, d).select("unit_id", dc.detect_language(F.col("tokens"), _LISTS).alias("x"))
    return made.select("unit_id", "x.language", F.round(F.least(F.lit(1.0), 4 * F.col("x.share")), 6).alias("confidence"))


_SEEN = """SELECT doc_id, source, lang, CASE WHEN m = 0 THEN 'und' WHEN en = m THEN 'en' WHEN de = m THEN 'de' WHEN fr = m THEN 'fr' ELSE 'es' END AS seen FROM (SELECT *, greatest(en, de, fr, es) AS m FROM (SELECT doc_id, source, lang,
    len(list_filter(t, lambda x: x IN ('the','of','and','in','to'))) AS en, len(list_filter(t, lambda x: x IN ('der','die','und','den','das'))) AS de,
    len(list_filter(t, lambda x: x IN ('le','la','les','et','des'))) AS fr, len(list_filter(t, lambda x: x IN ('el','los','que','y','del'))) AS es FROM tk))"""


def _seen(spark, d):
    return prep(spark, d, "source", "lang").select("unit_id", "source", "lang", dc.detect_language(F.col("tokens"), _LISTS)["language"].alias("seen"))


@query(f" SELECT doc_id AS unit_id, coalesce(CASE WHEN source = 'src1' THEN lang END, seen) AS language FROM ({_SEEN})", uses="tk")
def lang_detect_units(spark, d):
    """What is detected, but for one source whose own mark wins."""
    manual = F.when(F.col("source") == "src1", F.col("lang"))
    return _seen(spark, d).select("unit_id", F.coalesce(manual, "seen").alias("language"))


@query(f" SELECT doc_id, CASE seen WHEN 'und' THEN 'generic' ELSE 'list-' || seen END AS profile FROM ({_SEEN})", uses="tk")
def lang_router(spark, d):
    """Each document goes to the profile of the language that was detected, and without one to the generic profile."""
    return _seen(spark, d).select(F.col("unit_id").alias("doc_id"), F.when(F.col("seen") == "und", "generic").otherwise(F.concat(F.lit("list-"), "seen")).alias("profile"))


@query("SELECT doc_id, regexp_replace(text, E'\\r\\n?', E'\\n', 'g') AS text FROM documents")
def canon_full_text(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text"))


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def chunk_neighbours(spark, d):
    """Each turn with the role after it, as parent and neighbour lookups need."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"))


