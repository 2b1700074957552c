"""Queries on texts, pages, conversations, vectors and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieve, text
from ..streaming import jobs
from .base import query, table


@query("SELECT md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS copy_key, MIN(doc_id) AS first_doc, COUNT(*) AS n_docs FROM documents GROUP BY 1")
def exact_copies(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(text.copy_key(F.col("text")).alias("copy_key")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


@query()
def bottom_sketches(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.bottom_sketch(F.col("text")).alias("sketch"))


@query()
def document_chunks(spark, sf_dir):
    return text.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1200)


MARKERS = ["because", "therefore", "however", "the "]


@query("WITH p AS (SELECT doc_id, text, greatest(length(text), 1) AS n FROM documents), q AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) * 1.0 / n AS letters, 1 - least(abs(len(list_filter(string_split(text, ' '), lambda w: w <> '')) * 1.0 / greatest(length(regexp_replace(text, '[^.!?]', '', 'g')), 1) - 20) / 20, 1.0) AS len, (contains(lower(text), 'because')::INT + contains(lower(text), 'therefore')::INT + contains(lower(text), 'however')::INT + contains(lower(text), 'the ')::INT) / 4.0 AS found, 1 - length(regexp_replace(text, '[^0-9]', '', 'g')) * 1.0 / n AS digits FROM p) SELECT doc_id, ROUND((letters + len + found + digits) / 4, 6) AS density FROM q")
def prose_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.density(F.col("text"), MARKERS), 6).alias("density"))


FORMS = ["the", "stupid", "license", "token", "public"]


@query("SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), ['the', 'stupid', 'license', 'token', 'public'])) AS INTEGER) AS hits FROM documents")
def dictionary_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.dictionary_hits(F.col("text"), FORMS).alias("hits"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[?]') THEN 'question' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' ELSE 'other' END AS label FROM conversations")
def regex_route(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.route(F.col("text"), [("[?]", "question"), ("[0-9]{4}", "number")], "other").alias("label"))


@query("SELECT conv_id, turn, ROW_NUMBER() OVER w AS place, LAG(role) OVER w AS role_before, length(text) AS chars, CAST(SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chars_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_turns(spark, sf_dir):
    return text.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", F.col("place").cast("bigint").alias("place"), "role_before", F.col("chars").cast("bigint").alias("chars"), "chars_so_far")


@query()
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS h FROM pages) SELECT page_id, CAST(i - 1 AS INTEGER) AS position, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM l)")
def html_links(spark, sf_dir):
    return text.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


_COSINE = "q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id)"


@query(f"WITH {_COSINE} SELECT query_id, vec_id, cosine, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def cosine_top(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieve.cosine_top(rows.where("vec_id % 20 = 0"), rows, 10, "vec_id", "embedding")


@query(f"WITH {_COSINE}, t AS (SELECT query_id, vec_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c QUALIFY rank <= 10), h AS (SELECT DISTINCT query_id FROM t JOIN embeddings a ON a.vec_id = t.query_id JOIN embeddings b ON b.vec_id = t.vec_id WHERE a.label = b.label AND rank <= 5) SELECT COUNT(*) AS n_queries, AVG(CASE WHEN h.query_id IS NULL THEN 0 ELSE 1 END) AS hit_rate FROM q LEFT JOIN h USING (query_id)")
def hit_at_five(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = cosine_top(spark, sf_dir)
    of = lambda name: rows.select(F.col("vec_id").alias(name), F.col("label").alias(f"{name}_label"))
    true = found.join(of("query_id"), "query_id").join(of("vec_id"), "vec_id").where("query_id_label = vec_id_label").select("query_id", "vec_id")
    every = of("query_id").where("query_id % 20 = 0").select("query_id")
    truth = every.join(true, "query_id", "left").withColumn("vec_id", F.coalesce("vec_id", F.lit(-1)))
    return retrieve.hit_rate(found, truth, "query_id", "vec_id", 5)


_LEXICAL = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x IN ('{0}', '{1}')) AS h FROM documents), s AS (SELECT doc_id, len(list_distinct(h)) AS t, len(h) AS n FROM w WHERE len(h) > 0)"


@query("WITH a AS (WITH " + _LEXICAL.format("stupid", "trash") + " SELECT doc_id, ROW_NUMBER() OVER (ORDER BY t DESC, n DESC, doc_id) AS r FROM s QUALIFY r <= 20), b AS (WITH " + _LEXICAL.format("license", "public") + " SELECT doc_id, ROW_NUMBER() OVER (ORDER BY t DESC, n DESC, doc_id) AS r FROM s QUALIFY r <= 20), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT doc_id, ROUND(SUM(1.0 / (60 + r)), 8) AS fused, COUNT(*) AS n_lists FROM u GROUP BY 1")
def hybrid_fusion(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    ranked = [retrieve.lexical_top(documents, "doc_id", "text", terms, 20) for terms in (["stupid", "trash"], ["license", "public"])]
    return retrieve.fuse(ranked, "doc_id").withColumn("fused", F.round("fused", 8))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    rows = jobs.replay(spark, f"{sf_dir}/events.parquet", lambda df: jobs.tumbling(df, "ts", "1 hour", ["event_type"], "value"), "complete")
    return rows.withColumn("value", F.round("value", 4))


@query("WITH b AS (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events), g AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM b) SELECT user_id, CAST(MIN(ts) AS TIMESTAMP) AS session_start, COUNT(*) AS n FROM g GROUP BY user_id, g")
def stream_sessions(spark, sf_dir):
    return jobs.replay(spark, f"{sf_dir}/events.parquet", lambda df: jobs.sessions(df, "ts", "6 hours", ["user_id"]), "complete")


@query("SELECT user_id, event_type, COUNT(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    rows = jobs.replay(spark, f"{sf_dir}/events.parquet", lambda df: df.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
