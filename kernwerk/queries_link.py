"""Queries over linking, evidence, units of facts and small indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kernwerk.functions.text import normalize_title
from kernwerk.operators import dense as D
from kernwerk.operators import evidence as EV
from kernwerk.operators import factstore as K
from kernwerk.operators import linking as LI
from kernwerk.operators import models as M
from kernwerk.operators import titles as TI
from kernwerk.queries_facts import _articles, _facts
from kernwerk.queries_text import micro
from kernwerk.session import table


def disambiguated(spark, d):
    """Names of two letters more or less against all titles that begin with their first two letters: which article each means."""
    a = _articles(spark, d).where("key <> ''")
    names = a.select(F.substring("key", 1, 2).alias("name"), (F.col("article_id") % 5 == 0).alias("lowercase"), F.col("article_id").alias("mention"))
    title = F.when(F.col("article_id") % 3 == 0, F.concat("name", F.lit(" (place)"))).when(F.col("article_id") % 3 == 1, F.col("name")).otherwise(F.col("title"))
    c = a.select("article_id", "title", "popularity", F.substring("key", 1, 2).alias("name"))
    rows = names.join(c, "name").withColumn("title", title).withColumn("key", normalize_title(F.col("title"))).withColumn("score", (F.col("article_id") % 7) / 2.0).withColumn("kind", F.when(F.col("article_id") % 4 == 0, 1.0).otherwise(0.0))
    return LI.disambiguate(rows, ["mention"]).select("mention", "article_id")


def evidence_blocks(spark, d):
    """Evidence of bundles of articles: their one-liners as passages, statements of their entities, and one computed line."""
    a = _articles(spark, d).join(table(spark, d, "articles").groupBy("article_id").agg(F.min("oneliner").alias("text")), "article_id").withColumn("query_id", F.col("article_id") % 40)
    hits = a.where("text is not null").select("query_id", F.lit("q").alias("query"), F.col("article_id").alias("rank"), F.col("article_id").alias("pid"), "title", F.when(F.col("article_id") % 2 == 0, "Lead").otherwise("").alias("section"), F.lit("wikipedia").alias("pack"), "text", F.when(F.col("article_id") % 5 == 0, F.array(F.lit("a card"), F.lit("another"))).alias("cards"))
    f = _facts(spark, d).where("value_text is not null and pid = 'P9201'").groupBy("qid").agg(F.min("value_text").alias("v"))
    facts = a.join(f, "qid").select("query_id", F.col("article_id").alias("ord"), F.col("title").alias("entity"), F.concat(F.lit("country: "), "v").alias("line"))
    computed = a.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(0).alias("ord"), F.concat(F.col("n").cast("string"), F.lit(" articles")).alias("line"))
    got = EV.render(EV.assemble(hits, facts, computed, 1_000_000, "2024-01-01"), dated="2024-01-01")
    return got.select("query_id", "evidence", F.size("sources").cast("long").alias("n_sources"))


def unit_labels(spark, d):
    u = table(spark, d, "unit_name")
    short, long_ = u.where("length(trim(unit)) <= 3"), u.where("length(trim(unit)) > 6")
    return K.unit_shown(_facts(spark, d).select("fact_id", "unit"), short.where("unit like '%m%'"), short, long_).select("fact_id", "unit_shown")


def comparison_lines(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.floor(F.col("p_partkey") / 2).alias("query_id"), (F.col("p_partkey") % 2).cast("int").alias("place"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity"), F.lit("size").alias("label"), F.col("p_size").cast("double").alias("value"), F.lit("cm").alias("unit"))
    return K.comparison_lines(rows).where("ord < 2").select("query_id", F.col("ord").cast("long").alias("ord"), "line")


def single_list_index(spark, d):
    e = table(spark, d, "embeddings")
    one = D.single_list(e.select(F.col("embedding").alias("vector")))
    return one.select("n", F.posexplode("centroid").alias("d", "x")).select("n", F.col("d").cast("long").alias("d"), micro(F.col("x")).alias("x_micro"))


def label_bytes(spark, d):
    """The mean vector of each label as whole numbers of a byte."""
    m = M.mean_vectors(table(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return m.select("label", F.posexplode(D.quantized(F.transform("vector", lambda x: F.round(x.cast("double"), 5)))).alias("d", "v")).select("label", F.col("d").cast("long").alias("d"), F.col("v").cast("long").alias("v"))


QUERIES = {f.__name__: f for f in (disambiguated, evidence_blocks, unit_labels, comparison_lines, single_list_index, label_bytes)}

from kernwerk.queries_facts import _ART, _F, _KEY  # noqa: E402

_M = "CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
ORACLE = {
    "disambiguated": f"""WITH {_ART}, a AS (SELECT article_id, title, popularity, substr(key, 1, 2) AS name FROM art WHERE key <> ''), n AS (SELECT article_id AS mention, name, article_id % 5 = 0 AS lowercase FROM a),
c AS (SELECT n.*, a.article_id, a.popularity, CASE a.article_id % 3 WHEN 0 THEN a.name || ' (place)' WHEN 1 THEN a.name ELSE a.title END AS title, (a.article_id % 7) / 2.0::DOUBLE AS score, CASE WHEN a.article_id % 4 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS kind FROM n JOIN a USING (name)),
s AS (SELECT *, {_KEY.format(c='title')} = name OR starts_with({_KEY.format(c='title')}, name || ' (') AS same FROM c), r AS (SELECT *, row_number() OVER w AS place, first(popularity) OVER w AS top FROM s WHERE NOT lowercase OR (same AND NOT (ends_with(title, ')') AND contains(title, ' ('))) WINDOW w AS (PARTITION BY mention ORDER BY same DESC, popularity DESC, article_id)),
k AS (SELECT *, score + kind + CASE WHEN same THEN least(ln(greatest(popularity, 1) / greatest(top, 1)::DOUBLE), 0) ELSE 0 END AS total FROM r WHERE place = 1 OR popularity >= floor(top * 0.1::DOUBLE)), f AS (SELECT *, first(total) OVER (PARTITION BY mention ORDER BY place) AS base FROM k)
SELECT mention, article_id FROM f QUALIFY row_number() OVER (PARTITION BY mention ORDER BY CASE WHEN total >= base + 1 THEN total END DESC NULLS LAST, place) = 1""",
    "evidence_blocks": f"""WITH {_ART}, {_F}, a AS (SELECT art.*, art.article_id % 40 AS query_id, o.text FROM art JOIN (SELECT article_id, min(oneliner) AS text FROM articles GROUP BY 1) o USING (article_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY article_id) AS n FROM a WHERE text IS NOT NULL), hs AS (SELECT query_id, count(*) AS k, string_agg('[' || n || '] ' || title || CASE WHEN article_id % 2 = 0 THEN ' — Lead' ELSE '' END || ' (wikipedia):' || chr(10) || CASE WHEN article_id % 5 = 0 THEN '- a card' || chr(10) || '- another' ELSE text END, chr(10) || chr(10) ORDER BY n) AS t FROM h GROUP BY 1),
v AS (SELECT qid, min(value_text) AS v FROM f WHERE value_text IS NOT NULL AND pid = 'P9201' GROUP BY 1), g AS (SELECT query_id, title, min(article_id) AS ord, string_agg('- country: ' || v, chr(10) ORDER BY article_id) AS l FROM a JOIN v USING (qid) GROUP BY 1, 2),
gs AS (SELECT query_id, string_agg('[' || (coalesce(k, 0) + i) || '] ' || title || ' (wikidata, as of 2024-01-01):' || chr(10) || l, chr(10) || chr(10) ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, title) AS i FROM g) LEFT JOIN hs USING (query_id) GROUP BY 1)
SELECT c.query_id, concat_ws(chr(10) || chr(10), hs.t, gs.t, 'COMPUTED: ' || c.n || ' articles') AS evidence, coalesce(hs.k, 0) AS n_sources FROM (SELECT query_id, count(*) AS n FROM a GROUP BY 1) c LEFT JOIN hs USING (query_id) LEFT JOIN gs USING (query_id)""",
    "unit_labels": f"""WITH {_F}, u AS (SELECT qid, trim(unit) AS u FROM unit_name WHERE trim(unit) <> ''), k AS (SELECT DISTINCT qid, min(u) FILTER (length(u) <= 3 AND contains(u, 'm')) OVER w AS a, min(u) FILTER (length(u) <= 3) OVER w AS b, min(u) FILTER (length(u) > 6) OVER w AS c FROM u WINDOW w AS (PARTITION BY qid))
SELECT fact_id, coalesce(a, b, c, nullif(regexp_extract(coalesce(unit, ''), 'Q[0-9]+$'), ''), unit) AS unit_shown FROM f LEFT JOIN k ON k.qid = nullif(regexp_extract(coalesce(unit, ''), 'Q[0-9]+$'), '')""",
    "comparison_lines": """WITH j AS (SELECT a.p_partkey // 2 AS query_id, a.p_partkey AS x, b.p_partkey AS y, a.p_size AS v, b.p_size AS w FROM part a JOIN part b ON a.p_partkey // 2 = b.p_partkey // 2 AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1)
SELECT query_id, 0::BIGINT AS ord, 'size: part ' || x || CASE WHEN v > w THEN ' > ' WHEN v < w THEN ' < ' ELSE ' = ' END || 'part ' || y AS line FROM j UNION ALL SELECT query_id, 1, 'size of part ' || x || ' − part ' || y || ' = ' || (v - w) || ' cm' FROM j""",
    "single_list_index": f"WITH m AS (SELECT d, avg(x) AS m, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1) SELECT n, d::BIGINT AS d, {_M.format(x='m / sqrt((SELECT sum(m * m) FROM m))')} AS x_micro FROM m",
    "label_bytes": "WITH m AS (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY 1, 2), n AS (SELECT *, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS v FROM m) SELECT label, d::BIGINT AS d, greatest(-127, least(127, round(round(v, 5) * 127, 0)))::BIGINT AS v FROM n",
}
