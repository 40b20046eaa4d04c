"""Queries on files that are written and read back, on run settings, and on the steps around retrieval."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import documents as dc
from textloom.operators import models as md
from textloom.operators import retrieval as rt
from textloom.operators import lexical as lx
from textloom.operators import settings as st
from textloom.operators import similarity as sm
from textloom.operators.relations import dfm, token_rel
from textloom.plans.annotation import annotations
from textloom.plans.documents import INJECTION
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.models import _labelled
from textloom.plans.registry import query, table
from textloom.plans.retrieval import _DENSE, _EVAL, _REL, _dense, _relevant
from textloom.sources import files
from textloom.tables import new_path

# --- files -----------------------------------------------------------------------------------


@query("SELECT doc_id || ':document:0' AS unit_id, sha256(text) AS text_hash FROM documents")
def sink_units_csv(spark, d):
    """Units as CSV, read back: quotes, line ends and blanks survive."""
    path = new_path(spark, "units")
    files.write_units(dc.segment(docs(spark, d), "document").select("unit_id", "text"), path, "csv")
    back = spark.read.schema("unit_id string, text string").option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(path)
    return back.select("unit_id", tx.checksum(F.col("text")).alias("text_hash"))


@query("SELECT doc_id || ':document:0' AS unit_id, sha256(text) AS text_hash FROM documents")
def sink_parquet_units(spark, d):
    path = new_path(spark, "units")
    files.write_units(dc.segment(docs(spark, d), "document").select("unit_id", "text"), path)
    return spark.read.parquet(path).select("unit_id", tx.checksum(F.col("text")).alias("text_hash"))


@query("SELECT unit_id, coder_id, value FROM ann", uses="ann")
def sink_annotations_csv(spark, d):
    path = new_path(spark, "annotations")
    files.write_units(annotations(spark, d).select("unit_id", "coder_id", "value"), path, "csv")
    return spark.read.schema("unit_id long, coder_id int, value int").option("header", True).csv(path)


@query("SELECT doc_id, lang || '|' || source AS labels, '{\"' || lang || '\":0.5}' AS scores FROM documents")
def sink_predictions_csv(spark, d):
    path = new_path(spark, "predictions")
    rows = docs(spark, d).select("doc_id", F.array("lang", "source").alias("labels"), F.create_map("lang", F.lit(0.5)).alias("scores"))
    files.write_units(files.prediction_rows(rows), path, "csv")
    return spark.read.schema("doc_id long, labels string, scores string").option("header", True).option("escape", '"').csv(path)


@query(", v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS j FROM (SELECT DISTINCT term FROM tok)) SELECT doc_id AS i, j, count(*) AS value FROM tok JOIN v USING (term) GROUP BY doc_id, j", uses="tk tok")
def sink_sparse_matrix(spark, d):
    """The matrix as row, column and value, beside a file that names the columns; both read back."""
    path = new_path(spark, "matrix")
    files.write_matrix(dfm(token_rel(prep(spark, d))), path)
    return spark.read.parquet(f"{path}/cells")


@query("SELECT lang, source, sha256(max(text)) AS text_hash FROM documents GROUP BY lang, source HAVING regexp_matches(max(text), '\\S')")
def src_text(spark, d):
    """A text of each language and source, written as one file each and read as documents."""
    path = new_path(spark, "texts")
    by = docs(spark, d).groupBy("lang", "source").agg(F.max("text").alias("text"))
    by.write.partitionBy("lang", "source").option("lineSep", "\x00\n").text(path)
    back = files.read_text(spark, f"{path}/*/*/*.txt")
    clean = F.btrim(F.regexp_replace("text", "\x00\n?$", ""), F.lit(" \t\r\n"))
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1).alias(name)
    return back.select(part("lang"), part("source"), tx.checksum(clean).alias("text_hash"))


@query("SELECT 'doc_id: ' || doc_id || ' | lang: ' || lang || ' | source: ' || source AS text FROM documents")
def src_csv(spark, d):
    path = new_path(spark, "rows")
    docs(spark, d).select("doc_id", "lang", "source").write.option("header", True).csv(path)
    return files.read_csv(spark, path).select("text")


@query("SELECT position, heading, count(*) AS n FROM (SELECT unnest([0, 1]) AS position, unnest([lang, source]) AS heading FROM (SELECT DISTINCT lang, source FROM documents)) GROUP BY ALL")
def src_markdown(spark, d):
    """A file for each language and source, of two sections headed by them."""
    path = new_path(spark, "markdown")
    text = F.concat(F.lit("# "), "lang", F.lit("\n\none\n\n## "), "source", F.lit("\n\ntwo\n"))
    both = docs(spark, d).select("lang", "source").distinct()
    both.select("lang", "source", text.alias("text")).write.partitionBy("lang", "source").text(path)
    back = files.read_markdown(spark, f"{path}/*/*/*.txt")
    return back.groupBy("position", "heading").agg(F.count("*").alias("n"))


@query("SELECT n_name AS country, 2000 + n_regionkey AS year, 'size' AS indicator, (n_nationkey * 1000)::DOUBLE AS value FROM nation WHERE n_nationkey > 0")
def ctx_import_csv(spark, d):
    """A wide table with thousands commas and marks of absence."""
    path = new_path(spark, "indicators")
    size = F.when(F.col("n_nationkey") == 0, "N/A").otherwise(F.format_number(F.col("n_nationkey") * 1000, 0))
    table(spark, d, "nation").select(F.col("n_name").alias("country"), (F.col("n_regionkey") + 2000).alias("year"), size.alias("size"), F.lit("..").alias("none")).write.option("header", True).csv(path)
    return files.read_indicators(spark, path)


@query("SELECT user_id % 5 AS run, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1")
def sink_run_json(spark, d):
    """Runs as JSON lines, read back."""
    path = new_path(spark, "runs")
    by = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("run")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    files.write_units(by, path, "json")
    return spark.read.schema("run long, events long, total double").json(path)


@query("SELECT doc_id, doc_id // 100 AS page, (row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id))::INT AS place FROM documents")
def scan_units_paged(spark, d):
    """Every unit with its page of a hundred ids, and its place there."""
    page = F.floor(F.col("doc_id") / 100)
    place = F.row_number().over(Window.partitionBy("page").orderBy("doc_id"))
    return docs(spark, d).select("doc_id", page.alias("page")).withColumn("place", place)


# --- settings --------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT unnest(map_entries(json_transform(props, '"MAP(VARCHAR, VARCHAR)"'))) AS e FROM events WHERE event_id = 0), b AS (SELECT unnest(map_entries(json_transform(props, '"MAP(VARCHAR, VARCHAR)"'))) AS e FROM events WHERE event_id = 1),
    x AS (SELECT e.key AS k, e.value AS v FROM a), y AS (SELECT e.key AS k, e.value AS v FROM b)
    SELECT coalesce(x.k, y.k) AS parameter, x.v AS run_a, y.v AS run_b, x.v IS DISTINCT FROM y.v AS changed FROM x FULL JOIN y ON x.k = y.k"""
)
def run_compare(spark, d):
    """The settings of two runs side by side."""
    e = table(spark, d, "events")
    return st.compared(e.where("event_id = 0"), e.where("event_id = 1"), "props")


@query("SELECT conv_id, turn, CASE WHEN contains(w, '*') OR contains(w, '?') THEN 'wildcard' WHEN contains(w, ' ') THEN 'phrase' ELSE 'word' END AS mode FROM (SELECT conv_id, turn, trim(text) AS w FROM conversations)")
def kwic_auto(spark, d):
    asked = F.btrim("text")
    return table(spark, d, "conversations").select("conv_id", "turn", st.query_mode(asked).alias("mode"))


@query(
    ", s AS (SELECT (SELECT count(*) FROM documents) AS n_units, count(DISTINCT term) AS n_features, (SELECT count(*) FROM (SELECT DISTINCT doc_id, term FROM tok)) AS nnz FROM tok) SELECT n_units * n_features * 8 AS dense_bytes, nnz * 16 AS sparse_bytes, least(n_units * n_features * 8, nnz * 16) AS preferred_bytes FROM s",
    uses="tk tok",
)
def agg_memory_dfm(spark, d):
    p = prep(spark, d)
    cells = dfm(token_rel(p)).agg(F.count("*").alias("nnz"), F.countDistinct("term").alias("n_features"))
    dense, sparse = F.lit(p.count()) * F.col("n_features") * 8, F.col("nnz") * 16
    return cells.select(dense.alias("dense_bytes"), sparse.alias("sparse_bytes"), F.least(dense, sparse).alias("preferred_bytes"))


@query("SELECT lang, count(*) AS n, CASE WHEN count(*) <= 256 THEN 'dense' WHEN count(*) <= 2000 THEN 'exact_pairs' ELSE 'prefix_filter' END AS way FROM documents GROUP BY lang")
def sim_ceilings(spark, d):
    """How a catalogue's service would compare each group's units. Here all three ways give the same pairs."""
    n = F.col("n")
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")).withColumn("way", F.when(n <= 256, "dense").when(n <= 2000, "exact_pairs").otherwise("prefix_filter"))


@query("SELECT DISTINCT split_part(lower(replace(lang || '_XX', '_', '-')), '-', 1) AS code, lang IN ('en', 'de', 'fr', 'es', 'it', 'pt', 'tr') AS has_list FROM documents")
def lang_list(spark, d):
    return docs(spark, d).select(st.language_code(F.concat("lang", F.lit("_XX"))).alias("code")).distinct().withColumn("has_list", F.col("code").isin(*st.STOPWORD_LANGUAGES))


@query("SELECT lang, CASE WHEN lang IN ('en', 'de', 'fr', 'es', 'it', 'pt', 'tr') THEN 'full' ELSE 'degraded' END AS capability, count(*) AS n FROM documents GROUP BY 1, 2")
def lang_profile(spark, d):
    return docs(spark, d).groupBy("lang", st.capability(F.col("lang")).alias("capability")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id AS unit_id, nfc_normalize(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM documents")
def tx_scalar(spark, d):
    one = docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.btrim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return one.select("unit_id", tx.nfc("text").alias("text"))


@query(" SELECT doc_id AS unit_id, len(list_filter(t, lambda x: x NOT IN ('the', 'of', 'and')))::BIGINT AS n FROM tk", uses="tk")
def tx_tokenops(spark, d):
    """Tokenised, then without stop words; each step a function of a column."""
    steps = (tx.tokens, lambda c: tx.without_terms(c, ("the", "of", "and")))
    c = F.col("text")
    for step in steps:
        c = step(c)
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.size(c).cast("long").alias("n"))


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda x: lower(trim(x, '.,;'))), '_') AS phrase FROM benchmark")
def nlp_morph_phrase(spark, d):
    """The parts of a phrase in their normal form, joined."""
    parts = F.transform(F.split("text", " "), lambda x: F.lower(F.btrim(x, F.lit(".,;"))))
    return table(spark, d, "benchmark").select("item_id", F.array_join(parts, "_").alias("phrase"))


@query("SELECT source AS name, to_json(list_sort(list_distinct(list_filter(list(trim(lang)), lambda x: x <> ''))))::VARCHAR AS value FROM documents GROUP BY source")
def flt_normalise(spark, d):
    """Each source's languages as a filter's list: trimmed, without blanks and repeats, sorted, as JSON."""
    lists = docs(spark, d).groupBy(F.col("source").alias("name")).agg(F.collect_set("lang").alias("value"))  # a few languages
    return lists.select("name", st.normalised_list(F.col("value")).alias("value"))


@query(
    r"""SELECT doc_id AS unit_id, list_filter([CASE WHEN regexp_matches(text, '[A-Za-z]-\s*\n\s*[A-Za-z]') THEN 'dehyphenate' END, CASE WHEN regexp_matches(text, '[ \t]{2,}|\r|\n{3,}') THEN 'whitespace' END,
    CASE WHEN regexp_matches(text, '(^|\n)\s*[0-9]{1,4}\s*(\n|$)') THEN 'page_numbers' END, CASE WHEN regexp_matches(text, '\|') THEN 'tables' END], lambda x: x IS NOT NULL) AS steps FROM documents"""
)
def cfg_cleaning(spark, d):
    """The cleaning steps that a document asks for, in the order in which they run."""
    has = lambda p: F.col("text").rlike(p)
    wanted = {"page_numbers": has(r"(^|\n)\s*[0-9]{1,4}\s*(\n|$)"), "whitespace": has(r"[ \t]{2,}|\r|\n{3,}"), "tables": has(r"\|"), "dehyphenate": has(r"[A-Za-z]-\s*\n\s*[A-Za-z]")}
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), st.ordered_steps(wanted).alias("steps"))


def _entries(spark, d):
    """A dictionary as a table: each region is a category, each nation's name an expression of it."""
    made = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return made.select(F.concat_ws("/", F.lit("places"), F.lower("r_name")).alias("path"), F.col("n_nationkey").alias("k"), F.concat(F.when(F.col("n_nationkey") % 5 == 0, "re:^").otherwise(""), F.lower("n_name"), F.when(F.col("n_nationkey") % 7 == 0, "*").otherwise("")).alias("expression"))


_ENTRIES = "e AS (SELECT 'places/' || lower(r_name) AS path, n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 're:^' ELSE '' END || lower(n_name) || CASE WHEN n_nationkey % 7 = 0 THEN '*' ELSE '' END AS expression FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_ENTRIES} SELECT path, to_json(list(expression ORDER BY k))::VARCHAR AS expressions FROM e GROUP BY path")
def dict_serialize(spark, d):
    """A dictionary's entries as one list for each path."""
    return st.serialized(_entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT expression, CASE WHEN starts_with(expression, 're:') THEN 'regex' WHEN contains(expression, '*') OR contains(expression, '?') THEN 'wildcard' WHEN contains(expression, ' ') THEN 'phrase' ELSE 'token' END AS match_type, string_split(path, '/')[1] AS category, string_split(path, '/')[2] AS subcategory, string_split(path, '/') AS path FROM e")
def dict_parse(spark, d):
    """A table of entries in the form that a dictionary's matching takes."""
    return lx.parsed_entries(_entries(spark, d))


# --- quality of a corpus ---------------------------------------------------------------------


@query(
    f"""WITH f AS (SELECT 'empty' AS code, count(*) AS n FROM documents WHERE trim(text) = '' UNION ALL SELECT 'short', count(*) FROM documents WHERE length(text) < 40
    UNION ALL SELECT 'injection', count(*) FROM documents WHERE regexp_matches(text, '{INJECTION}') UNION ALL SELECT 'exact_duplicate', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) >= 2)
    UNION ALL SELECT 'no_language', count(*) FROM documents WHERE lang IS NULL) SELECT * FROM f WHERE n > 0"""
)
def qa_corpus(spark, d):
    """All findings of a corpus, by code."""
    t, one = F.col("text"), docs(spark, d)
    codes = {"empty": F.btrim(t) == "", "short": F.length(t) < 40, "injection": t.rlike(INJECTION), "no_language": F.col("lang").isNull()}
    found = one.select(F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in codes.items()]))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    copies = sm.checksum_groups(one).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("exact_duplicate").alias("code"), "n")
    return found.unionAll(copies)


# --- around retrieval ------------------------------------------------------------------------

_PLAN = "CASE WHEN intent = 'define' THEN 5 ELSE 12 END AS top_k, CASE WHEN intent = 'define' THEN 15 ELSE 40 END AS candidates, intent = 'compare' AS diversify"
_INTENT = "CASE WHEN regexp_matches(text, '(?i)compare|versus') THEN 'compare' WHEN regexp_matches(text, '(?i)what is|define') THEN 'define' WHEN regexp_matches(text, '(?i)list|which') THEN 'list' ELSE 'lookup' END"


@query(f"SELECT conv_id, turn, {_PLAN} FROM (SELECT conv_id, turn, {_INTENT} AS intent FROM conversations)")
def rt_plan(spark, d):
    from textloom.plans.retrieval import _INTENTS

    made = table(spark, d, "conversations").select("conv_id", "turn", rt.intents(F.col("text"), _INTENTS).alias("intent"))
    return made.select("conv_id", "turn", *st.retrieval_plan(F.col("intent")))


@query(
    """SELECT item_id, label, CASE label WHEN 'neutral' THEN q WHEN 'support' THEN 'Evidence supporting or agreeing with: ' || q ELSE 'Evidence contradicting, challenging, or presenting counter-arguments to: ' || q END AS text
    FROM (SELECT item_id, trim(text) AS q FROM benchmark), (SELECT unnest(['neutral', 'support', 'contradict']) AS label)"""
)
def rt_expand(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(st.expanded(F.btrim("text"))).alias("v")).select("item_id", "v.label", "v.text")


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, rank FROM dn WHERE rank <= 4")
def rt_noop_rerank(spark, d):
    return _dense(spark, d).where("rank <= 4").select("query_id", "chunk_id", "rank")


@query(f"WITH {_DENSE} SELECT query_id, chunk_id FROM dn WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 1)")
def rt_revision_guard(spark, d):
    """Retrieved chunks that the revision doesn't allow: any row is an error."""
    allowed = table(spark, d, "embeddings").where("label <> 1").select(F.col("vec_id").alias("chunk_id"))
    return _dense(spark, d).join(allowed, "chunk_id", "left_anti").select("query_id", "chunk_id")


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, '[' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || ']' AS mark FROM dn")
def rt_citation_list(spark, d):
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return _dense(spark, d).select("query_id", "chunk_id", F.concat(F.lit("["), number.cast("string"), F.lit("]")).alias("mark"))


@query(f"WITH {_DENSE}, c AS (SELECT query_id, unnest([query_id, query_id + 1, query_id + 2]) AS chunk_id FROM (SELECT DISTINCT query_id FROM dn)) SELECT c.query_id, round(avg((dn.chunk_id IS NOT NULL)::INT), 6) AS validity FROM c LEFT JOIN dn ON dn.query_id = c.query_id AND dn.chunk_id = c.chunk_id GROUP BY c.query_id")
def rt_struct_validity(spark, d):
    """The part of each query's cited chunks that was retrieved."""
    found = _dense(spark, d).select("query_id", "chunk_id")
    q = F.col("query_id")
    cited = found.select("query_id").distinct().select("query_id", F.explode(F.array(q, q + 1, q + 2)).alias("chunk_id"))
    hit = cited.join(found.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return rounded(hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("validity")))


@query(
    f"""WITH {_DENSE}, {_REL}, x AS (SELECT query_id, chunk_id, depth, CASE WHEN rank <= depth THEN depth + 1 - rank ELSE rank END AS rank FROM dn, (SELECT unnest([0, 3, 6]) AS depth)),
    f AS (SELECT depth, x.query_id, min(CASE WHEN rv.chunk_id IS NOT NULL THEN x.rank END) AS f FROM x LEFT JOIN rv ON rv.query_id = x.query_id AND rv.chunk_id = x.chunk_id GROUP BY ALL)
    SELECT depth, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM f GROUP BY depth"""
)
def rt_rerank_depths(spark, d):
    """Mean reciprocal rank when the first ranks of several depths are turned round."""
    depth = F.explode(F.array(F.lit(0), F.lit(3), F.lit(6)))
    moved = _dense(spark, d).select("query_id", "chunk_id", "rank", depth.alias("depth"))
    moved = moved.withColumn("rank", F.when(F.col("rank") <= F.col("depth"), F.col("depth") + 1 - F.col("rank")).otherwise(F.col("rank")))
    hit = moved.join(_relevant(spark, d).withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    first = hit.groupBy("depth", "query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("f"))
    return rounded(first.groupBy("depth").agg(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))).alias("mrr")))


@query(f"SELECT count(*) AS n_cases, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr, count(*) FILTER (WHERE recall = 0) AS n_missed FROM ({_EVAL})")
def rt_e2e_eval(spark, d):
    """All cases in one run: what was found, and how many cases had no relevant chunk."""
    made = rounded(md.ranked_metrics(_dense(spark, d), _relevant(spark, d), 10))
    return rounded(made.agg(F.count("*").alias("n_cases"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.count_if(F.col("recall") == 0).alias("n_missed")), 5)


@query()
def ml_persist(spark, d):
    """A classifier written, read back, and still giving the same predictions."""
    path, rows = new_path(spark, "model"), _labelled(spark, d)
    model = md.fit(rows)
    model.write().overwrite().save(path)
    test = rows.where("split = 'test'")
    one, two = (md.scored(m, test).select("unit_id", F.col("predicted").alias(n)) for m, n in ((model, "before"), (PipelineModel.load(path), "after")))
    return one.join(two, "unit_id").groupBy((F.col("before") == F.col("after")).alias("same")).agg(F.count("*").alias("n"))


@query("SELECT 4 AS n_checks, (SELECT 'stopifnot(nrow(units) == ' || count(*) || ')' FROM documents) AS expected, 10 AS n_lines")
def sink_quanteda_script(spark, d):
    """The replication script, written and read back: its check of the number of units, and how long it is."""
    path = new_path(spark, "script")
    files.replication_script(docs(spark, d), "units.csv", ["lang", "source"]).orderBy("line").coalesce(1).select("text").write.text(path)
    back = spark.read.text(path)
    return back.agg(F.count_if(F.col("value").startswith("print(") | F.col("value").startswith("stopifnot(")).cast("int").alias("n_checks"), F.max(F.when(F.col("value").startswith("stopifnot("), F.col("value"))).alias("expected"), F.count("*").cast("int").alias("n_lines"))
