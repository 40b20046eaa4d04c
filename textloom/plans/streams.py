"""Queries on sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import documents as dc
from textloom.plans.frequency import docs, rounded
from textloom.plans.registry import query, table
from textloom.sources import files
from textloom.streaming.counts import stream_term_counts, stream_windows
from textloom.streaming.tables import LatestCounts, kept_up
from textloom.tables import new_path


def table_stream(spark, d, name, schema):  # noqa: ANN001, ANN201
    """A table as a stream. The pattern fits its name alone, and so a file as well as a folder of files; as a plain path a stream takes folders only."""
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def drained(stream, mode):  # noqa: ANN001, ANN201
    """What a stream gives once it has read all that is there now: each batch replaces the table in the shared folder."""
    spark = stream.sparkSession
    path, state = new_path(spark, "stream"), new_path(spark, "state")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT term, count(*) AS count FROM tok GROUP BY term", uses="tk tok")
def tok_stream_counts(spark, d):
    one = docs(spark, d)
    stream = table_stream(spark, d, "documents", one.schema)
    counts = LatestCounts(spark, new_path(spark, "counts"))
    kept_up(stream_term_counts(stream), counts, new_path(spark, "state"))
    return counts.read()


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    one = table(spark, d, "events")
    stream = table_stream(spark, d, "events", one.schema)
    if one.schema["ts"].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(drained(stream_windows(stream), "complete"), 4)


@query("SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def sink_manifest(spark, d):
    """The counts of the manifest, read back from its JSON."""
    one = docs(spark, d)
    made = files.manifest(one, dc.segment(one, "document"))
    back = made.select(F.get_json_object("manifest", "$.documents").cast("long").alias("n"))
    return back.crossJoin(one.agg(F.sum("n_chars").alias("chars")))  # one row each


@query("SELECT doc_id, lang, source, n_chars, (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) > 250 FROM documents) AS truncated FROM documents ORDER BY doc_id LIMIT 250")
def sink_row_budget(spark, d):
    """The first 250 rows, with how many there were and whether some are left out."""
    one = docs(spark, d).select("doc_id", "lang", "source", "n_chars")
    n = one.agg(F.count("*").alias("n_rows")).withColumn("truncated", F.col("n_rows") > 250)
    return one.orderBy("doc_id").limit(250).crossJoin(F.broadcast(n))  # one row


@query("SELECT doc_id, doc_id || ':document:0' AS unit_id, sha256(text) AS text_hash FROM documents")
def scan_units(spark, d):
    return dc.segment(docs(spark, d), "document").select("doc_id", "unit_id", "text_hash")
