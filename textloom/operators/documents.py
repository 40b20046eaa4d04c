"""Scans, facets, joins, quality findings and segments of documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import checksum
from textloom.operators.relations import ratio

SEARCHED = ("title", "organization", "country")


def select_documents(docs: DataFrame, equal: Mapping[str, object] | None = None, least: Mapping[str, object] | None = None, most: Mapping[str, object] | None = None, search: str | None = None, among: Sequence[str] = SEARCHED) -> DataFrame:
    """Documents by equality, ranges (null is never in range) and a case-blind substring of any searched column."""
    for c, v in (equal or {}).items():
        docs = docs.where(F.col(c) == F.lit(v))
    for c, v in (least or {}).items():
        docs = docs.where(F.col(c) >= F.lit(v))
    for c, v in (most or {}).items():
        docs = docs.where(F.col(c) <= F.lit(v))
    if search:
        hit = F.lit(False)
        for c in among:
            hit |= F.coalesce(F.contains(F.lower(c), F.lower(F.lit(search))), F.lit(False))
        docs = docs.where(hit)
    return docs


def with_ids(df: DataFrame, ids: DataFrame | Sequence, key: str = "doc_id") -> DataFrame:
    """Rows of the listed ids; an empty list means none."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(*ids)) if ids else df.limit(0)


def facets(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, count) of the non-null values of each field, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return docs.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("count"))


def coverage(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, coverage): share of rows with a value, and "overall", their mean."""
    shares = docs.agg(*[ratio(F.count(f).cast("double"), F.count("*")).alias(f) for f in fields])
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("coverage")) for f in fields]
    overall = F.struct(F.lit("overall").alias("field"), (sum((F.col(f) for f in fields), F.lit(0.0)) / len(fields)).alias("coverage"))
    return shares.select(F.explode(F.array(*pairs, overall)).alias("p")).select("p.*")


def quality(docs: DataFrame, unit: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text and the findings they give."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    count = lambda p: F.regexp_count(t, F.lit(p))
    made = docs.select(
        F.col(unit).alias("unit_id"), n.cast("long").alias("n_chars"), count(r"\p{L}").cast("long").alias("letters"),
        count(r"(?U)\s").cast("long").alias("blanks"), count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]").cast("long").alias("controls"),
        count("�").cast("long").alias("replaced"), count(r"\p{L}-\n\p{L}").cast("long").alias("breaks"),
    )
    c = F.col
    found = F.array(
        F.when(c("n_chars") == 0, "empty"), F.when((c("n_chars") > 0) & (c("n_chars") < 40), "short"), F.when(c("n_chars") > 2_000_000, "large"),
        F.when((c("replaced") >= 5) | ((c("n_chars") > 0) & (c("replaced") / F.greatest(c("n_chars"), F.lit(1)) >= 0.01)), "replacement"),
        F.when((c("n_chars") > 0) & (c("blanks") / F.greatest(c("n_chars"), F.lit(1)) >= 0.45), "blank"),
        F.when(c("controls") >= 3, "control"), F.when(c("breaks") >= 8, "hyphens"),
    )
    return made.withColumn("findings", F.array_compact(found))


def length_outliers(sizes: DataFrame, size: str = "n_tokens", z: float = 3.0, least: int = 5) -> DataFrame:
    """Rows at least z population deviations from the mean; none for fewer than ``least`` rows or no spread."""
    stats = sizes.agg(F.avg(size).alias("_m"), F.stddev_pop(size).alias("_s"), F.count("*").alias("_n"))  # one row
    score = (F.col(size) - F.col("_m")) / F.col("_s")
    return (
        sizes.crossJoin(F.broadcast(stats)).where((F.col("_n") >= least) & (F.col("_s") > 0)).withColumn("z", score).where(F.abs("z") >= z).drop("_m", "_s", "_n")
    )


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def _cut(text: str, ends: list[tuple[int, int]]) -> list[dict]:
    """Stripped pieces between breaks, at their places."""
    out, start = [], 0
    for a, b in [*ends, (len(text), len(text))]:
        piece = text[start:a]
        body = piece.strip()
        if body:
            at = start + len(piece) - len(piece.lstrip())
            out.append({"start": at, "end": at + len(body), "text": body})
        start = b
    return out


@F.pandas_udf(_SPAN)
def paragraphs(texts: pd.Series) -> pd.Series:
    """Spans between blank lines, stripped."""
    import re

    gap = re.compile(r"\n\s*\n+")
    return texts.map(lambda t: _cut(t or "", [m.span() for m in gap.finditer(t or "")]))


# Words whose full stop ends no sentence, in all languages and in each.
ABBREVIATIONS = {
    "": "e.g i.e etc dr prof fig vs cf u.s u.k e.u",
    "en": "e.g i.e etc vs viz cf approx dept dr mr mrs ms mssrs prof fig figs eq eqs vol vols no nos pp ch sec al ed eds rev gen lt col sgt jr sr st ave "
    "blvd rd jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k e.u ph.d m.d b.a m.a inc ltd co corp assn",
    "de": "z.b u.a u.ä d.h bzw ca dr prof usw vgl evtl inkl exkl nr abs art s bd hrsg",
    "fr": "m mme mlle dr pr prof c.-à-d c.a.d etc cf ex fig vol p pp n ste st",
    "es": "dr dra sr sra srta prof etc pág pags vol fig ee.uu u.s núm cap",
    "tr": "dr prof doç yrd vb vd örn vs no mad sf bkz",
}


def abbreviations_of(language: str | None) -> frozenset[str]:
    """Those of all languages and of one; without a language the English ones."""
    code = (language or "und").lower().replace("_", "-").split("-")[0]
    return frozenset(f"{ABBREVIATIONS['']} {ABBREVIATIONS.get('en' if code == 'und' else code, '')}".split())


@F.pandas_udf(_SPAN)
def sentences(texts: pd.Series, languages: pd.Series) -> pd.Series:
    """Spans up to terminal marks, but not at the language's abbreviations, decimals, initials, addresses and list numbers."""
    import re

    end = re.compile(r"[.!?…。！？]+[\"'”’)\]]*(?=\s|$)")

    def false_end(t: str, m: re.Match, known: frozenset[str]) -> bool:
        if "." not in m[0]:
            return False
        # only the word before the mark and the blanks around are looked at, so the work goes with the text's length
        begin, after = m.start(), m.end()
        while begin and not t[begin - 1].isspace():
            begin -= 1
        while after < len(t) and t[after].isspace():
            after += 1
        word = t[begin : m.start()]
        low = word.lower().lstrip("([\"'“‘")
        if low in known or "://" in low or "@" in low or low.startswith("www."):
            return True
        rest = t[after : after + 1]
        if re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", word):
            return rest.islower()
        if re.fullmatch(r"\d{1,3}", word):
            while begin and t[begin - 1].isspace():
                begin -= 1
            return not begin or t[begin - 1] in ".!?…\"'”’)"
        return len(word) == 1 and word.isupper() and rest.isupper()

    given = [v if isinstance(v, str) else None for v in languages]
    lists = {v: abbreviations_of(v) for v in set(given)}

    def one(t: str | None, language: str | None) -> list[dict]:
        t = t or ""
        return _cut(t, [(m.end(), m.end()) for m in end.finditer(t) if not false_end(t, m, lists[language])])

    return pd.Series([one(t, v) for t, v in zip(texts, given)])


def segment(docs: DataFrame, unit_type: str, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Units of each document: (doc_id, unit_id, unit_type, position, start, end, text, text_hash).

    Sentences follow the language in ``lang``, where there is such a column.
    """
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.col(text).alias("text")))
    spans = {"document": whole, "paragraph": paragraphs(F.col(text)), "sentence": sentences(F.col(text), language)}[unit_type]
    made = docs.select(F.col(doc).alias("doc_id"), F.posexplode(spans).alias("position", "s"))
    return made.select(
        "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(unit_type), F.col("position").cast("string")).alias("unit_id"),
        F.lit(unit_type).alias("unit_type"), "position", "s.start", "s.end", "s.text", checksum(F.col("s.text")).alias("text_hash"),
    )


def chunk_contents(toks: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens that step by size less overlap, each joined by blanks; one empty window for no tokens."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(toks) - overlap - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.array_join(F.slice(toks, s + 1, F.lit(size)), " "))


def token_chunks(prep: DataFrame, size: int, overlap: int) -> DataFrame:
    """(unit_id, chunk_index, content): windows of ``size`` tokens that step by size less overlap."""
    return prep.where(F.size("tokens") > 0).select("unit_id", F.posexplode(chunk_contents(F.col("tokens"), size, overlap)).alias("chunk_index", "content"))


def chunk_neighbours(prep: DataFrame, size: int, overlap: int) -> DataFrame:
    """(unit_id, chunk_index, content, next): each window but the last with the one after it, out of the unit's own row."""

    def paired(made: Column) -> Column:
        return F.transform(F.slice(made, F.lit(2), F.size(made) - 1), lambda x, k: F.struct(F.get(made, k).alias("content"), x.alias("next")))

    # a one-element transform binds the windows; the outer form of explode doesn't make the planner tokenise twice
    both = F.element_at(F.transform(F.array(chunk_contents(F.col("tokens"), size, overlap)), paired), 1)
    return prep.select("unit_id", F.posexplode_outer(both).alias("chunk_index", "c")).where("c IS NOT NULL").select("unit_id", "chunk_index", "c.*")


def lookup_page(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Units with the page that their start falls in: within a document by its pages' array, no range join."""
    by = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "page_number"))).alias("pages"))
    hit = F.get(F.filter("pages", lambda p: (p["char_start"] <= F.col("start")) & (F.col("start") < p["char_end"])), F.lit(0))
    return units.join(by, "doc_id", "left").withColumn("page_number", hit["page_number"]).drop("pages")


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Pages stripped and joined by blank lines: (doc_id, page_number, char_start, char_end) in the joined text."""
    body = pages.withColumn("body", F.btrim("text", F.lit(" \t\r\n"))).where("body <> ''")
    order = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("body") + 2).over(order), F.lit(0))
    return body.select("doc_id", "page_number", start.alias("char_start"), (start + F.length("body")).alias("char_end"))


def repeated_lines(pages: DataFrame, share: float = 0.6, least_pages: int = 3, longest: int = 120) -> DataFrame:
    """(doc_id, line): short lines on most pages of a document, such as running heads."""
    lines = pages.select("doc_id", "page_number", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.btrim("line"))
    n = pages.groupBy("doc_id").agg(F.countDistinct("page_number").alias("n"))
    on = lines.where((F.col("line") != "") & (F.length("line") <= longest)).groupBy("doc_id", "line").agg(F.countDistinct("page_number").alias("k"))
    return on.join(n, "doc_id").where((F.col("n") >= least_pages) & (F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") * share)))).select("doc_id", "line")


def text_score(text: Column) -> Column:
    """Share of printable characters and white space, times how near the text is to 80 characters, times one less the replacement share."""
    n = F.length(text)
    printable = 1 - F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}\p{Co}&&[^\t-\r\x1c-\x1f\x85]]")) / n
    dense = F.least(F.lit(1.0), n / 80)
    return F.when(n == 0, 0.0).otherwise(printable * dense * (1 - F.regexp_count(text, F.lit("�")) / n))


def detect_language(toks: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """struct(language, share): the word list that most tokens are in; und without a hit."""
    n = F.greatest(F.size(toks), F.lit(1))

    def scored(i: int, name: str, words: Sequence[str]) -> Column:
        hits = F.size(F.filter(toks, lambda t: t.isin(*words)))
        return F.struct((hits / n).alias("share"), F.lit(-i).alias("o"), F.lit(name).alias("language"))

    best = F.array_max(F.array(*[scored(i, k, w) for i, (k, w) in enumerate(lists.items())]))
    return F.when(best["share"] > 0, F.struct(best["language"].alias("language"), best["share"].alias("share"))).otherwise(F.struct(F.lit("und").alias("language"), F.lit(0.0).alias("share")))
