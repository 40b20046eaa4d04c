"""Queries on headings, parents, overlap and edge lines of chunks, and on what to remember of conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import chunks as ch
from textloom.operators import documents as dc
from textloom.operators import memory as mm
from textloom.plans.frequency import docs, prep, rounded
from textloom.plans.registry import query, table

_TRIM = r"E' \t\n\r\v\f'"
_PARAGRAPHS = rf"""p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS p FROM documents),
    u AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS position, unnest(p) AS text FROM p),
    h AS (SELECT *, nullif(trim(coalesce(nullif(regexp_extract(text, '^#{{1,6}}[ \t]+(\S[^\n]*)', 1), ''), regexp_extract(text, '^([^\n]{{1,80}})\n[=-]{{3,}}[ \t]*(?:\n|$)', 1))), '') AS head FROM u)"""


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, position, sha256(text) AS text_hash, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS heading FROM h")
def seg_headings(spark, d):
    made = ch.with_headings(docs(spark, d))
    return made.select("doc_id", F.col("position").cast("long").alias("position"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "heading")


_TURNS = "t AS (SELECT conv_id AS doc_id, turn AS position, role FROM conversations)"


@query(
    f"""WITH {_TURNS}, n AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR lag(position) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY position) AS run FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY position) AS k FROM r)
    SELECT doc_id, position, role, -sum(CASE WHEN (k - 1) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position)::BIGINT AS parent FROM k"""
)
def seg_parent_windows(spark, d):
    """Turns of one speaker in a row, three at most to a parent."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), "role")
    return ch.parent_windows(turns, F.col("role"))


@query(
    """, c AS (SELECT doc_id, i AS chunk_index, array_to_string(t[i * 170 + 1 : i * 170 + 200], ' ') AS content FROM (SELECT doc_id, t, unnest(range(0, greatest(1, ceil((len(t) - 30) / 170.0)::BIGINT))) AS i FROM tk WHERE len(t) > 0)),
    n AS (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next FROM c)
    SELECT doc_id AS unit_id, chunk_index, coalesce(list_max(list_filter(range(32, least(4000, length(content), length(next)) + 1), lambda k: right(content, k) = left(next, k))), 0)::INT AS overlap FROM n WHERE next IS NOT NULL""",
    uses="tk",
)
def chunk_overlap_check(spark, d):
    """How much of each chunk's end the next one begins with."""
    made = dc.chunk_neighbours(prep(spark, d), 200, 30)
    return made.select("unit_id", F.col("chunk_index").cast("long").alias("chunk_index"), ch.overlap_chars(F.col("content"), F.col("next")).alias("overlap"))


@query(
    """, s AS (SELECT sum(greatest(1, length(array_to_string(t, ' ')) // 4)) AS source FROM tk WHERE len(t) > 0),
    c AS (SELECT greatest(1, length(array_to_string(t[i * 170 + 1 : i * 170 + 200], ' ')) // 4) AS n FROM (SELECT t, unnest(range(0, greatest(1, ceil((len(t) - 30) / 170.0)::BIGINT))) AS i FROM tk WHERE len(t) > 0))
    SELECT count(*) AS n_chunks, sum(n)::BIGINT AS n_tokens, round(greatest(0, (sum(n) - any_value(source)) / any_value(source)), 6) AS duplicate_ratio FROM c, s""",
    uses="tk",
)
def rt_chunk_dup_ratio(spark, d):
    """Tokens of all chunks beyond those of their sources."""
    size = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4))
    p = prep(spark, d).where(F.size("tokens") > 0)
    source = p.agg(F.sum(size(F.array_join("tokens", " "))).alias("s"))
    chunks = dc.token_chunks(p, 200, 30).agg(F.count("*").alias("n_chunks"), F.sum(size("content")).alias("n_tokens"))
    ratio = F.greatest(F.lit(0.0), (F.col("n_tokens") - F.col("s")) / F.col("s"))
    return rounded(chunks.crossJoin(source).select("n_chunks", "n_tokens", ratio.alias("duplicate_ratio")))  # one row each


@query(
    rf"""WITH p AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\n\s*\n+'), lambda x: trim(x, {_TRIM}) <> '') AS p FROM documents),
    l AS (SELECT *, list_transform(p, lambda x: string_split(x, E'\n')) AS l FROM p),
    f AS (SELECT *, list_transform(l, lambda x: list_filter(list_transform(x, lambda y: trim(y, {_TRIM})), lambda y: y <> '')) AS f FROM l),
    e AS (SELECT *, list_filter(list_transform(f, lambda x: x[1]), lambda y: length(y) >= 8) AS hs, list_filter(list_transform(f, lambda x: x[-1]), lambda y: length(y) >= 8) AS ts FROM f),
    c AS (SELECT *, list_filter(hs, lambda y: len(list_filter(hs, lambda z: z = y)) >= 3) AS heads, list_filter(ts, lambda y: len(list_filter(ts, lambda z: z = y)) >= 3) AS tails FROM e),
    k AS (SELECT doc_id, text, p, heads, tails, list_transform(list_transform(l, lambda x: CASE WHEN list_contains(heads, trim(x[1], {_TRIM})) THEN x[2:] ELSE x END), lambda x: CASE WHEN len(x) > 0 AND list_contains(tails, trim(x[-1], {_TRIM})) THEN x[:len(x) - 1] ELSE x END) AS l FROM c)
    SELECT doc_id AS unit_id, sha256(CASE WHEN len(p) < 4 OR len(heads) + len(tails) = 0 THEN text ELSE array_to_string(list_filter(list_transform(l, lambda x: trim(coalesce(array_to_string(x, E'\n'), ''), {_TRIM})), lambda x: x <> ''), E'\n\n') END) AS text_hash FROM k"""
)
def clean_edge_lines(spark, d):
    cleaned = ch.without_edge_lines(F.col("text"))
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), F.sha2(cleaned.cast("binary"), 256).alias("text_hash"))


_SCORE = r"""q AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - len(regexp_extract_all(text, '[\p{Cc}\p{Cf}\p{Co}]')) + len(regexp_extract_all(text, '[\t-\r\x{1c}-\x{1f}\x{85}]'))) / length(text)
    * least(1.0, length(text) / 80.0) * (1 - len(regexp_extract_all(text, '\x{FFFD}')) / length(text)) END AS score FROM documents)"""


@query(f"WITH {_SCORE} SELECT doc_id AS unit_id, round(score, 6)::DOUBLE AS score FROM q")
def pdf_text_quality(spark, d):
    return rounded(docs(spark, d).select(F.col("doc_id").alias("unit_id"), dc.text_score(F.col("text")).alias("score")))


@query(f"WITH {_SCORE} SELECT doc_id AS unit_id, (n < 40 OR score < 0.65) AS should_ocr, CASE WHEN n < 40 OR score < 0.65 THEN 'low_quality_or_sparse_native_text' ELSE 'native_text_sufficient' END AS reason FROM q")
def pdf_ocr_gate(spark, d):
    poor = (F.length("text") < 40) | (dc.text_score(F.col("text")) < 0.65)
    reason = F.when(poor, "low_quality_or_sparse_native_text").otherwise("native_text_sufficient")
    return docs(spark, d).select(F.col("doc_id").alias("unit_id"), poor.alias("should_ocr"), reason.alias("reason"))


# --- memory ----------------------------------------------------------------------------------


def _any(column, patterns):
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def _has(column, words):
    return "(" + " OR ".join(f"contains(lower({column}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


# the conversations are invented words, so facts of the kinds that are looked for are put behind them
_FACTS = (
    "The user prefers concise answers.", "We are building a search service.", "For project X, the chosen db is postgres.", "Never mind the project.",
    "My password: hunter2 for the project.", "Next step: finish the plan for today.", "It was completed using fastapi.", "He likes detailed examples of the project.",
)
_FACT_LIST = "[" + ", ".join(f"'{f}'" for f in _FACTS) + "]"
_SAID = f"said AS (SELECT conv_id, turn, text || E'\\n' || ({_FACT_LIST})[(conv_id + turn) % {len(_FACTS)} + 1] AS text FROM conversations)"
# the pattern of sentence ends, without a look-behind
_MEMORIES = f"""{_SAID}, parts AS (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', E'\\\\1\\n', 'g'), '\\n+') AS p FROM said),
    sent AS (SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS position, trim(unnest(p), {_TRIM}) AS content FROM parts),
    kept AS (SELECT * FROM sent WHERE length(content) >= 12 AND NOT {_any("content", mm.SECRETS)} AND NOT {_has("content", mm.EPHEMERAL)} AND ({_has("content", mm.MARKERS)} OR {_any("content", mm.DURABLE)})
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(content) ORDER BY position) = 1)"""


def _memories(spark, d):
    facts = F.array(*[F.lit(f) for f in _FACTS])
    at = ((F.col("conv_id") + F.col("turn")) % len(_FACTS)).cast("int")
    said = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n"), F.get(facts, at)).alias("text"))
    return said, mm.extracted(said, ["conv_id", "turn"])


@query(f"WITH {_MEMORIES} SELECT conv_id, turn, content FROM kept")
def mem_extract(spark, d):
    return _memories(spark, d)[1].select("conv_id", "turn", "content")


def _route_sql():
    cases = [f"WHEN {_any('content', patterns)} THEN {{'level': '{level}', 'type': '{kind}', 'confidence': {sure}}}" for level, kind, sure, patterns in mm.ROUTES]
    level, kind, sure = mm.OTHERWISE
    return f"CASE {' '.join(cases)} ELSE {{'level': '{level}', 'type': '{kind}', 'confidence': {sure}}} END"


@query(f"WITH {_MEMORIES}, r AS (SELECT conv_id, turn, content, {_route_sql()} AS r FROM kept) SELECT conv_id, turn, content, r.level AS level, r.type AS type, r.confidence::DOUBLE AS confidence FROM r")
def mem_route(spark, d):
    made = _memories(spark, d)[1].withColumn("r", mm.routed(F.col("content")))
    return made.select("conv_id", "turn", "content", "r.level", "r.type", "r.confidence")


@query(
    f"""WITH {_SAID}, r AS (SELECT conv_id, turn, {_route_sql().replace("content", "text")} AS r, text FROM said), v AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'sensitive' ELSE CASE WHEN turn % 5 = 0 THEN 'do_not_store' ELSE 'normal' END END AS privacy FROM r),
    w AS (SELECT *, CASE WHEN privacy = 'do_not_store' THEN 'privacy_do_not_store' WHEN {_any("text", mm.SECRETS)} THEN 'secret_detected' WHEN {_has("text", mm.EPHEMERAL)} AND r.level <> 'session' THEN 'ephemeral_statement'
      WHEN r.level = 'user' AND r.type NOT IN ({", ".join(f"'{t}'" for t in mm.LONG_TERM)}) THEN 'invalid_user_memory_type' WHEN r.confidence < 0.75 AND r.level IN ('user', 'agent', 'project') THEN 'confidence_below_threshold' END AS reason FROM v)
    SELECT conv_id, turn, reason IS NULL AS allowed, reason, CASE WHEN reason IS NULL THEN CASE WHEN privacy = 'sensitive' AND r.level = 'user' THEN least(r.confidence, 0.75) ELSE r.confidence END END::DOUBLE AS confidence FROM w"""
)
def mem_policy(spark, d):
    """Whole turns, with a privacy that follows their numbers."""
    privacy = F.when(F.col("conv_id") % 3 == 1, "sensitive").when((F.col("conv_id") % 3 == 2) & (F.col("turn") % 5 == 0), "do_not_store").otherwise("normal")
    said = _memories(spark, d)[0].select("conv_id", "turn", "text", mm.routed(F.col("text")).alias("r"), privacy.alias("privacy"))
    made = said.withColumn("p", mm.policy(F.col("text"), F.col("r.level"), F.col("r.type"), F.col("r.confidence"), F.col("privacy"), 0.75))
    return made.select("conv_id", "turn", "p.allowed", "p.reason", "p.confidence")




@query(
    """WITH i AS (SELECT conv_id, turn, role AS kind, CASE WHEN turn % 2 = 1 THEN text ELSE 'not ' || text END AS content FROM conversations),
    w AS (SELECT conv_id, kind, arg_max(turn, turn) AS top, arg_max(content, turn) AS won FROM i GROUP BY conv_id, kind)
    SELECT i.conv_id, i.turn FROM i JOIN w USING (conv_id, kind) WHERE i.turn = w.top OR NOT (""" + " OR ".join(
        f"(contains(lower(won), '{n.replace(chr(39), chr(39) * 2)}') AND contains(lower(won), replace(lower(content), '{n.replace(chr(39), chr(39) * 2)}', ''))) OR (contains(lower(content), '{n.replace(chr(39), chr(39) * 2)}') AND contains(lower(content), replace(lower(won), '{n.replace(chr(39), chr(39) * 2)}', '')))"
        for n in mm.NEGATIONS
    ) + ")"
)
def mem_contradict(spark, d):
    """Of each kind the newest item, and the older ones that it doesn't contradict."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(F.concat(F.lit("not "), "text")).alias("content"))
    return mm.without_contradicted(said, ["conv_id", "kind"], "turn").select("conv_id", "turn")
