"""Queries over picks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kernwerk.functions.text import normalize_title
from kernwerk.operators import blocksearch as BS
from kernwerk.operators import selection as X
from kernwerk.operators import titles as TI
from kernwerk.queries_retrieval import _hits
from kernwerk.queries_text import micro
from kernwerk.session import table

BY, ART, TIES = ["record_id"], ["pack", "article"], ["pack", "passage_id"]


def gap_cut(spark, d):
    return X.gap_cut(_hits(spark, d), BY, "score", TIES, 4000).select("record_id", "pack", "passage_id")


def article_scores(spark, d):
    s = X.article_scores(_hits(spark, d), BY, ART, "score", TIES)
    return s.select("record_id", "pack", "article", (F.col("article_score") * 2).cast("long").alias("twice"))


def card_choice(spark, d):
    return X.card(_hits(spark, d).withColumn("named", F.col("article") == 5), BY, ART, "score", TIES, "named").select("record_id", "pack", "passage_id")


def fresh_first(spark, d):
    h = _hits(spark, d)
    return X.fresh_first(h, h.where("passage_id % 3 = 0"), BY, TIES, "score", 8).select("record_id", "pack", "passage_id", "place")


def teacher_scores(spark, d):
    h = _hits(spark, d).withColumn("teacher", (F.col("passage_id") % 17).cast("long"))
    return X.teacher_scores(h, BY, "score", TIES).select("record_id", "pack", "passage_id", "teacher")


def holdout_split(spark, d):
    return X.holdout(table(spark, d, "eval_req").select("id").distinct(), "id")


def numbers_known(spark, d):
    a = table(spark, d, "articles").where("oneliner is not null").select("article_id", "oneliner").distinct()
    return a.select("article_id", X.numbers_known(F.concat("oneliner", F.lit(" 77")), F.col("oneliner")).alias("plus"), X.numbers_known(F.col("oneliner"), F.concat("oneliner", F.lit(" 77"))).alias("same")).distinct()


def trainable_pools(spark, d):
    h = _hits(spark, d).withColumn("pack_id", F.when(F.col("pack") == 1, "stackexchange-x").otherwise("wikipedia"))
    return X.trainable(h, "record_id", "pack_id", 6).select("record_id", "pack", "passage_id")


def training_questions(spark, d):
    q = table(spark, d, "query_record").where("query <> ''").dropDuplicates(["record_id"])
    held = table(spark, d, "eval_req").select(F.col("query").alias("text")).where("text is not null")
    return X.training_questions(q.select("record_id", "intent", "query"), "intent", "record_id", "query", held, 12).select("record_id")


def pool_recall(spark, d):
    h = _hits(spark, d).withColumn("t", F.col("passage_id") % 13).withColumn("inside", F.col("score") > 9000)
    return X.pool_recall(h, "record_id", "t", "inside", TIES).select(micro(F.col("recall")).alias("recall_micro"), "questions")


def replayed_cut(spark, d):
    h = _hits(spark, d).withColumn("t", F.col("passage_id") % 13)
    return X.replayed_cut(h, "record_id", "t", "score", TIES, (8, 24, 40)).select(F.col("keep").cast("long").alias("keep"), micro(F.col("recall")).alias("recall_micro"), "questions")


def gold_pages(spark, d):
    arts = TI.current_articles(table(spark, d, "articles")).where("key <> ''")
    titles = arts.select("key", "article_id", F.lit(0).alias("how")).unionByName(TI.redirect_keys(table(spark, d, "redirects")).withColumn("how", F.lit(1)))
    urls = table(spark, d, "articles").where(F.col("url_title").rlike("^[A-Za-z_()]+$")).select(F.col("article_id").cast("string").alias("query_id"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("url_title")).alias("url")).distinct()
    return X.gold_pages(urls, titles)


def card_facts(spark, d):
    f = table(spark, d, "facts").select("qid", "pid").distinct().join(table(spark, d, "props").select("pid", "priority"), "pid")
    q = f.withColumn("query_id", F.substring("qid", -2, 1))
    asked = q.select("query_id").distinct().withColumn("pid", F.lit("P9203")).withColumn("relevance", F.lit(0.2))
    return X.card_facts(q, asked)


def human_agreement(spark, d):
    r = table(spark, d, "events").select((F.col("event_id") % 5 + 1).alias("score"), F.when(F.col("event_type") == "click", "yes").otherwise("no").alias("human"))
    return X.human_agreement(r)


def similar_to_any(spark, d):
    """Vectors that are nearly one of the held-out vectors (cosine of 0.8 or more), themselves included: what must not be trained on."""
    e = table(spark, d, "embeddings")
    near = BS.block_top_k(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 1, BS.dot, keep_self=True)
    return near.where("score_micro >= 800000").select(F.col("query_id").alias("vec_id"))


def sentence_targets(spark, d):
    n = table(spark, d, "nation")
    t = X.sentence_targets(F.array(F.lit("1.2:needed"), F.lit("1.2:helpful"), F.concat(F.lit("1."), (F.col("n_nationkey") % 4 + 1).cast("string"), F.lit(":helpful"))), F.lit(4))
    return n.select("n_nationkey", F.array_join(F.transform(t, lambda x: F.format_string("%.1f", x)), ",").alias("targets"))


def evidence_budgets(spark, d):
    r = table(spark, d, "query_record").select("record_id", X.evidence_budget(F.col("think"), F.col("is_complex"), F.col("evidence_tokens")).cast("long").alias("budget"))
    return r.distinct()


def title_keys(spark, d):
    return table(spark, d, "articles").select("article_id", normalize_title(F.col("title")).alias("key")).distinct()


QUERIES = {f.__name__: f for f in (gap_cut, article_scores, card_choice, fresh_first, teacher_scores, holdout_split, numbers_known, trainable_pools, training_questions, pool_recall, replayed_cut, gold_pages, card_facts, human_agreement, similar_to_any, sentence_targets, evidence_budgets, title_keys)}

from kernwerk.queries_facts import _ART, _KEY, _RED  # noqa: E402
from kernwerk.queries_retrieval import _EMB, _HITS  # noqa: E402
from kernwerk.queries_text import _NUM  # noqa: E402

_M = "CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
_W = "PARTITION BY record_id ORDER BY score DESC, pack, passage_id"
_S = f"{_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY record_id, pack, article ORDER BY score DESC, pack, passage_id) AS n FROM h), s AS (SELECT record_id, pack, article, sum(CASE WHEN n = 1 THEN 2 * score ELSE score END)::BIGINT AS twice FROM n GROUP BY 1, 2, 3)"
_NORM = r"lower(trim(regexp_replace({c}, '[\s!-/:-@\[-`{{-~]+', ' ', 'g')))"
ORACLE = {
    "gap_cut": f"WITH {_HITS} SELECT record_id, pack, passage_id FROM h QUALIFY row_number() OVER ({_W}) <= 3 OR score >= max(score) OVER (PARTITION BY record_id) - 4000",
    "article_scores": f"WITH {_S} SELECT * FROM s",
    "card_choice": f"WITH {_S} SELECT h.record_id, h.pack, h.passage_id FROM h JOIN s ON h.record_id = s.record_id AND h.pack = s.pack AND h.article = s.article QUALIFY row_number() OVER (PARTITION BY h.record_id ORDER BY (h.article = 5) DESC, twice DESC, h.pack, h.article, score DESC, passage_id) = 1",
    "fresh_first": f"WITH {_HITS} SELECT record_id, pack, passage_id, row_number() OVER (PARTITION BY record_id ORDER BY passage_id % 3 = 0, score DESC, pack, passage_id) AS place FROM h QUALIFY place <= 8",
    "teacher_scores": f"WITH {_HITS}, p AS (SELECT *, passage_id % 17 AS t, row_number() OVER ({_W}) AS p FROM h) SELECT record_id, pack, passage_id, CASE WHEN p <= 48 THEN t ELSE min(CASE WHEN p <= 48 THEN t END) OVER (PARTITION BY record_id) - 100 END AS teacher FROM p",
    "holdout_split": "SELECT DISTINCT id, ('0x' || substr(md5(id || ':0'), 1, 7))::BIGINT % 100 < 20 AS held FROM eval_req",
    "numbers_known": "WITH a AS (SELECT DISTINCT article_id, oneliner AS text FROM articles WHERE oneliner IS NOT NULL) SELECT DISTINCT article_id, list_contains(" + _NUM + ", '77') AS plus, true AS same FROM a",
    "trainable_pools": f"WITH {_HITS} SELECT record_id, pack, passage_id FROM h WHERE pack <> 1 QUALIFY count(*) OVER (PARTITION BY record_id) >= 6",
    "training_questions": "WITH q AS (SELECT DISTINCT ON (record_id) record_id, intent, " + _NORM.format(c="query") + " AS k FROM query_record WHERE query <> ''), f AS (SELECT * FROM q WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY intent, record_id) = 1) SELECT record_id FROM f WHERE k NOT IN (SELECT " + _NORM.format(c="query") + " FROM eval_req WHERE query IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY intent ORDER BY md5(record_id::VARCHAR), record_id) <= 12",
    "pool_recall": f"WITH {_HITS}, b AS (SELECT record_id, score > 9000 AS inside FROM h QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY passage_id % 13 DESC, pack, passage_id) <= 8), r AS (SELECT record_id, avg(inside::INT) AS share FROM b GROUP BY 1) SELECT {_M.format(x='avg(share)')} AS recall_micro, count(*) AS questions FROM r",
    "replayed_cut": f"WITH {_HITS}, b AS (SELECT record_id, row_number() OVER ({_W}) AS p, row_number() OVER (PARTITION BY record_id ORDER BY passage_id % 13 DESC, pack, passage_id) AS t FROM h), k AS (SELECT unnest([8, 24, 40])::BIGINT AS keep), r AS (SELECT keep, record_id, avg((p <= keep)::INT) AS share FROM b, k WHERE t <= 8 GROUP BY 1, 2) SELECT keep, {_M.format(x='avg(share)')} AS recall_micro, count(*) AS questions FROM r GROUP BY 1",
    "gold_pages": f"WITH {_ART}, {_RED}, t AS (SELECT key, article_id, 0 AS how FROM art WHERE key <> '' UNION ALL SELECT key, article_id, 1 FROM red), u AS (SELECT DISTINCT article_id::VARCHAR AS query_id, lower(replace(url_title, '_', ' ')) AS key FROM articles WHERE regexp_full_match(url_title, '[A-Za-z_()]+')), j AS (SELECT query_id, key, article_id FROM u JOIN t USING (key) QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY how, article_id) = 1) SELECT DISTINCT query_id, article_id FROM j",
    "card_facts": "WITH f AS (SELECT DISTINCT qid, pid FROM facts), q AS (SELECT f.*, priority, substr(qid, -2, 1) AS query_id FROM f JOIN props USING (pid)), c AS (SELECT query_id, pid, count(DISTINCT qid) AS c FROM q GROUP BY 1, 2), n AS (SELECT query_id, count(DISTINCT qid) AS n FROM q GROUP BY 1) SELECT q.query_id, q.qid, q.pid, row_number() OVER (PARTITION BY q.query_id, q.qid ORDER BY q.pid = 'P9203' DESC, (c = n AND n > 1) DESC, priority, q.pid) AS place FROM q JOIN c ON q.query_id = c.query_id AND q.pid = c.pid JOIN n ON q.query_id = n.query_id QUALIFY place <= 3",
    "human_agreement": "WITH r AS (SELECT CASE WHEN event_id % 5 + 1 >= 3.5 THEN 'yes' WHEN event_id % 5 + 1 <= 1.5 THEN 'no' END AS said, CASE WHEN event_type = 'click' THEN 'yes' ELSE 'no' END AS human FROM events) SELECT count(said) AS decided, count(*) FILTER (said = human) AS agree FROM r",
    "similar_to_any": f"WITH {_EMB} SELECT DISTINCT r.id AS vec_id FROM q, r WHERE {_M.format(x='list_dot_product(v, w)')} >= 800000",
    "sentence_targets": "SELECT n_nationkey, array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN i = 2 THEN '1.0' WHEN i = n_nationkey % 4 + 1 THEN '0.3' ELSE '0.0' END), ',') AS targets FROM nation",
    "evidence_budgets": "SELECT DISTINCT record_id, greatest(200, least(CASE WHEN is_complex THEN 400 WHEN think THEN 450 ELSE 600 END, evidence_tokens))::BIGINT AS budget FROM query_record",
    "title_keys": "SELECT DISTINCT article_id, " + _KEY.format(c="title") + " AS key FROM articles",
}
