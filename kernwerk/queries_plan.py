"""Queries over models, conversations and the whole question plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from kernwerk.operators import conversation as C
from kernwerk.operators import factstore as K
from kernwerk.operators import models as M
from kernwerk.plans.ask import Library
from kernwerk.queries_retrieval import stored_index
from kernwerk.queries_text import micro
from kernwerk.session import table
from kernwerk.sources.packs import get_passages, notices
from kernwerk.sources.readers import cards, encode_cards, infobox_lines, views
from kernwerk.streaming import telemetry as ST


def _library(spark, d):
    docs = table(spark, d, "documents")
    return Library(docs.select(F.col("doc_id").alias("pid"), F.coalesce("collection", F.lit("")).alias("article"), F.coalesce("title", F.lit("")).alias("title"), "section_path", F.coalesce("text", F.lit("")).alias("text")), index=stored_index(spark, d))


def _questions(spark, d):
    return table(spark, d, "robust").where("trim(query) <> ''").select(F.col("id").alias("query_id"), "query").distinct()


def ask_pool(spark, d):
    return _library(spark, d).pool(_questions(spark, d)).select("query_id", "pid", "pool_rank")


def ask_evidence(spark, d):
    return _library(spark, d).ask(_questions(spark, d)).select("query_id", "evidence", F.size("segments").alias("n_segments"))


def label_vectors(spark, d):
    m = M.mean_vectors(table(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return m.select("label", F.posexplode("vector").alias("d", "v")).select("label", F.col("d").cast("long").alias("d"), micro(F.col("v")).alias("v_micro"))


def property_relevance(spark, d):
    e = table(spark, d, "embeddings")
    props = M.mean_vectors(e.select("label", "embedding"), "label", "embedding").select(F.col("label").alias("pid"), F.col("vector").alias("p"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return K.relevance(q, props).select("query_id", "pid", micro(F.col("relevance")).alias("relevance_micro"))


def softmax_head(spark, d):
    w = [[1.0, -0.5], [0.2, 0.3], [-1.0, 0.1]]
    p = M.softmax_head(F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0), w, [0.1, 0.0, 0.5])
    return table(spark, d, "part").select("p_partkey", micro(p[0]).alias("a"), micro(p[1]).alias("b"), M.choose_label(p, ["x", "y", "z"], {"x": 0.9}, "y").alias("label"))


def compared_attribute(spark, d):
    q = table(spark, d, "query_record").where("query <> ''").select("record_id", "query", "topics").distinct()
    return q.select("record_id", C.attribute(F.col("query"), F.coalesce("topics", F.array().cast("array<string>"))).alias("attribute")).distinct()


def class_match(spark, d):
    n = table(spark, d, "nation")
    a = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("inner planet"), F.lit("river"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("dwarf planet"))).otherwise(F.array(F.lit("lake")))
    return n.select("n_nationkey", C.kind_match(a, F.array(F.lit("river"), F.lit("giant planet"))).alias("match"))


def proper_titles(spark, d):
    return table(spark, d, "articles").select("article_id", C.proper_name(F.col("title")).alias("proper"), C.qualified(F.col("title")).alias("qualified")).distinct()


def resolved_turns(spark, d):
    r = table(spark, d, "query_record").where("query <> ''").dropDuplicates(["record_id"])
    return C.resolve(r.select(F.col("record_id").alias("turn_id"), F.col("intent").alias("conversation"), F.struct("ts_ms", "record_id").alias("turn"), "query", F.coalesce("topics", F.array().cast("array<string>")).alias("names")))


def sub_queries(spark, d):
    r = table(spark, d, "query_record").where("query <> ''").select(F.col("record_id").alias("query_id"), "query", F.coalesce("topics", F.array().cast("array<string>")).alias("names")).distinct()
    return C.sub_queries(r).distinct()


def reused_codes(spark, d):
    """Passages whose text is known from an earlier build, and those that must be encoded."""
    docs = table(spark, d, "documents").where("text is not null")
    old = docs.where("collection like 'wikipedia%'").select(F.sha2("text", 256).alias("_h"), F.lit("c").alias("code"))
    reused, missing = ST.changed_texts(docs.select("doc_id", "text"), old)
    return reused.select("doc_id", F.lit(True).alias("reused")).unionByName(missing.select("doc_id", F.lit(False).alias("reused")))


def event_windows(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("record_id"), F.col("ts"), F.when(F.col("event_type") == "error", "error").alias("error"), F.col("value").alias("total_ms"))
    w = ST.windowed(e, "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "errors", micro(F.col("mean_ms")).alias("mean_micro"))


def passages_by_id(spark, d):
    c = table(spark, d, "cand").select("passage_id").distinct()
    return get_passages(table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "title"), c)


def title_views(spark, d):
    pv = table(spark, d, "redirects").where("article_id is not null").select(F.translate("from_title", " ", "_").alias("title"), (F.col("redirect_id") % 100).alias("views"))
    return views(table(spark, d, "articles").select("title").distinct(), pv).select("title", F.col("views").cast("long").alias("views"))


def card_codec(spark, d):
    line = F.concat(F.coalesce("label", F.lit("")), F.lit("\t1,x,"), F.regexp_extract("qid", r"(\d+)", 1))
    c = cards(line)
    return table(spark, d, "entities").select("qid", F.size(c[0]["ids"]).cast("long").alias("n"), encode_cards(c).alias("back")).distinct()


def infoboxes(spark, d):
    box = F.concat(F.lit('[{"data": {"qid": "'), "qid", F.lit('", "empty": " "}}]'))
    return table(spark, d, "entities").select("qid", infobox_lines(box).alias("lines")).distinct()


def credits(spark, d):
    s = table(spark, d, "documents").where("collection is not null").select(F.col("collection").alias("book"), F.coalesce("title", F.lit("")).alias("url"), F.coalesce("source", F.lit("")).alias("author"), F.coalesce("lang", F.lit("")).alias("licence"))
    return notices(s)


QUERIES = {f.__name__: f for f in (ask_pool, ask_evidence, label_vectors, property_relevance, softmax_head, compared_attribute, class_match, proper_titles, resolved_turns, sub_queries, reused_codes, event_windows, passages_by_id, title_views, card_codec, infoboxes, credits)}

from kernwerk.queries_retrieval import _ASKED, _POST, _bm25  # noqa: E402

_M = "CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
_MEAN = "e AS (SELECT label, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, d, avg(v) AS v FROM e GROUP BY 1, 2), u AS (SELECT label, d, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM m)"
_STOP = ", ".join(f"'{w}'" for w in (*C.STOP_WORDS, *C.COMPARE_WORDS, "both", "between", "which"))
ORACLE = {
    "ask_pool": f"WITH {_POST}, {_ASKED}, " + _bm25("top", "'title', 'section', 'body'", 200) + ", a AS (SELECT top.*, coalesce(collection, '') AS article FROM top JOIN documents ON doc_id = pid WHERE rank <= 120), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY rank) AS n FROM a QUALIFY n <= 4) SELECT query_id, pid, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS pool_rank FROM b QUALIFY pool_rank < 40",
    "label_vectors": f"WITH {_MEAN} SELECT label, d, {_M.format(x='v')} AS v_micro FROM u",
    "property_relevance": f"WITH {_MEAN}, q AS (SELECT vec_id AS query_id, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS w FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query_id, label AS pid, sum(v * w) AS cos FROM q JOIN u ON q.d = u.d GROUP BY 1, 2) SELECT query_id, pid, {_M.format(x='cos - avg(cos) OVER (PARTITION BY query_id)')} AS relevance_micro FROM c",
    "softmax_head": f"WITH z AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS s, p_retailprice / 1000.0::DOUBLE AS r FROM part), y AS (SELECT p_partkey, exp(s - 0.5 * r + 0.1) AS a, exp(0.2 * s + 0.3 * r) AS b, exp(-s + 0.1 * r + 0.5) AS c FROM z), p AS (SELECT p_partkey, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM y) SELECT p_partkey, {_M.format(x='a')} AS a, {_M.format(x='b')} AS b, CASE WHEN a >= b AND a >= c THEN CASE WHEN a < 0.9 THEN 'y' ELSE 'x' END WHEN b >= c THEN 'y' ELSE 'z' END AS label FROM p",
    "compared_attribute": r"SELECT DISTINCT record_id, array_to_string(list_filter(regexp_split_to_array(list_reduce(list_concat([lower(query)], coalesce(topics, [])), lambda a, n: replace(a, lower(n), ' ')), '[^\p{L}\p{N}]+'), lambda w: length(w) > 2 AND w NOT IN (" + _STOP + ")), ' ') AS attribute FROM query_record WHERE query <> ''",
    "class_match": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS match FROM nation",
    "proper_titles": r"SELECT DISTINCT article_id, len(string_split(regexp_extract(title, '^(.*?)(?: \(.*)?$', 1), ' ')) > 1 AND len(list_filter(string_split(regexp_extract(title, '^(.*?)(?: \(.*)?$', 1), ' '), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^\p{Lu}'))) = 0 AS proper, ends_with(title, ')') AND contains(title, ' (') AS qualified FROM articles",
    "reused_codes": "WITH o AS (SELECT DISTINCT text FROM documents WHERE collection LIKE 'wikipedia%' AND text IS NOT NULL) SELECT doc_id, text IN (SELECT text FROM o) AS reused FROM documents WHERE text IS NOT NULL",
    "event_windows": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, {_M.format(x='avg(value)')} AS mean_micro FROM events GROUP BY 1",
    "passages_by_id": "SELECT doc_id AS passage_id, title FROM documents WHERE doc_id IN (SELECT passage_id FROM cand)",
    "title_views": "WITH p AS (SELECT lower(replace(from_title, ' ', '_')) AS k, sum(redirect_id % 100)::BIGINT AS v FROM redirects WHERE article_id IS NOT NULL GROUP BY 1) SELECT title, coalesce(v, 0) AS views FROM (SELECT DISTINCT title FROM articles) a LEFT JOIN p ON p.k = lower(replace(title, ' ', '_'))",
    "card_codec": r"SELECT DISTINCT qid, 2::BIGINT AS n, coalesce(label, '') || chr(9) || '1,' || regexp_extract(qid, '(\d+)', 1)::BIGINT::VARCHAR AS back FROM entities",
    "infoboxes": "SELECT DISTINCT qid, 'qid: ' || qid AS lines FROM entities",
    "credits": "WITH s AS (SELECT collection AS book, coalesce(title, '') AS url, coalesce(source, '') AS author, coalesce(lang, '') AS licence FROM documents WHERE collection IS NOT NULL), u AS (SELECT book, url FROM (SELECT book, url, count(*) AS n FROM s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, url) = 1) SELECT s.book, count(*) AS chapters, string_agg(DISTINCT author, ', ' ORDER BY author) AS authors, string_agg(DISTINCT licence, ', ' ORDER BY licence) AS licences, min(u.url) AS url FROM s JOIN u ON s.book = u.book GROUP BY 1",
}
