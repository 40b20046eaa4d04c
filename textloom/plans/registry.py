"""Registration of queries beside their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions that the SQL may use by name.
COMMON = {
    "tk": r"""tk AS (SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(text),
        '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}]+)?'), lambda x: x <> '') AS t FROM documents)""",
    "tok": "tok AS (SELECT doc_id, lang, source, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk)",
    "ann": """ann AS (SELECT doc_id AS unit_id, c.coder_id,
        CASE WHEN (doc_id * 31 + c.coder_id * 17) % 10 < 2 THEN 1 - quality ELSE quality END AS value
        FROM labels, (SELECT unnest([0, 1, 2]) AS coder_id) c WHERE (doc_id + c.coder_id) % 7 <> 0)""",
    "pred": """pred AS (SELECT d.doc_id AS unit_id, d.lang, d.source, ((d.doc_id * 7919 + 13) % 1000) / 1000.0 AS score,
        ((d.doc_id * 6007 + 101) % 1000) / 1000.0 AS score_b, l.quality AS truth
        FROM documents d LEFT JOIN labels l USING (doc_id))""",
}


def query(sql: str | None = None, uses: str = "", name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``uses`` names the common tables its SQL reads."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            head = ", ".join(COMMON[u] for u in uses.split())
            ORACLE[key] = (f"WITH {head}{', ' if sql.lstrip().startswith(',') else ' '}{sql.lstrip().lstrip(',')}") if head else sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
