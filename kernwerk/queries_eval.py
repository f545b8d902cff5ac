"""Queries over evaluation, telemetry and passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kernwerk.functions.keys import spelling
from kernwerk.operators import evaluation as E
from kernwerk.operators import history as H
from kernwerk.operators import passages as P
from kernwerk.plans.ask import stated_lines
from kernwerk.queries_text import micro
from kernwerk.session import table


def _ranked(spark, d):
    c = table(spark, d, "cand").distinct().where("rrf is not null and not isnan(rrf)")
    r = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("rrf"), "cand_id"))
    return c.select("record_id", "cand_id", "passage_id", "e", "rrf", r.cast("long").alias("rank"))


def recall_at_k(spark, d):
    r = _ranked(spark, d)
    return E.recall_at(r, r.where("e is not null"), "record_id", "cand_id", (10, 40)).select("record_id", "n_gold", micro(F.col("recall_10")).alias("r10"), micro(F.col("recall_40")).alias("r40"))


def hit_at_k(spark, d):
    return E.hit_at(_ranked(spark, d).withColumn("rel", F.col("e") == 0), "record_id", "rel", (1, 5))


def ndcg_at_k(spark, d):
    g = _ranked(spark, d).withColumn("grade", F.when(F.col("e").isNotNull(), F.greatest(3 - F.col("e"), F.lit(1))))
    return E.ndcg_at(g, "record_id", 8, ["cand_id"]).select("record_id", micro(F.col("ndcg")).alias("ndcg"), micro(F.col("precision")).alias("p8"))


def auc_pairwise(spark, d):
    return E.auc(_ranked(spark, d).withColumn("pos", F.col("e").isNotNull()), "record_id", "rrf", "pos").select("record_id", micro(F.col("auc")).alias("auc_micro"))


def _records(spark, d):
    return table(spark, d, "query_record").dropDuplicates(["record_id"])


def _runs(spark, d):
    r = _records(spark, d).where("query <> ''")
    side = lambda even: r.where((F.col("think") == F.lit(even))).groupBy("query").agg(micro(F.avg("total_ms")).alias("v"))
    return side(True), side(False)


def pairwise_summary(spark, d):
    a, b = _runs(spark, d)
    return E.pairwise_summary(E.pairwise(a, b, "query", "v")).select("n", "win", "tie", "loss", "identical", micro(F.col("sign_p")).alias("sign_micro"))


def change_list(spark, d):
    a, b = _runs(spark, d)
    return E.pairwise(a, b, "query", "v").where("outcome <> 'tie'").select("query", "outcome")


def sign_test(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", micro(E.sign_p(F.col("n_nationkey"), F.col("n_regionkey") + 3)).alias("p_micro"))


def order_outcomes(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", E.order_outcome(F.col("n_nationkey") % 3 - 1, F.col("n_regionkey") % 3 - 1).alias("outcome"))


def latency_percentiles(spark, d):
    return _records(spark, d).groupBy("intent").agg(F.count("*").alias("n"), micro(F.percentile("total_ms", F.lit(0.5))).alias("p50"), micro(F.percentile("total_ms", F.lit(0.9))).alias("p90"), micro(F.avg("ttft_ms")).alias("mean_first"))


def latency_nearest_rank(spark, d):
    at = E.nearest_rank(_records(spark, d), "intent", "total_ms", (0.5, 0.9))
    return at.groupBy("intent").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("p90"))


def _judged(spark, d):
    """Records with verdicts made up from their own numbers: the tables hold no judgments."""
    r = _records(spark, d)
    k = F.col("record_id")
    return r.select(
        "record_id", "intent", "error", "n_sources", (k % 5).cast("double").alias("ours"), (k % 4 + 1).cast("double").alias("baseline"),
        F.when(k % 7 == 0, None).when(k % 5 > k % 4 + 1, "win").when(k % 5 < k % 4 + 1, "loss").otherwise("tie").alias("outcome"),
        F.when(k % 3 == 0, "full").when(k % 3 == 1, "partial").when(k % 6 == 2, "none").alias("sufficiency"), F.least(F.col("n_sources"), k % 4).alias("n_relevant"),
        (k % 9 + 1).alias("sentences"), (k % 2).alias("unverified"), (k % 3).alias("uncited"), (k % 6).alias("cites"), F.when(k % 4 == 0, k % 8 == 0).alias("expect_ok"), F.when(k % 5 == 0, k % 10 == 0).alias("abstain_ok"),
        F.when(k % 5 == 0, k % 2).alias("invented"), "evidence_tokens", F.col("evidence_tokens").alias("gen_tokens"), F.col("total_ms").alias("decode_ms"), (k % 11 == 0).alias("canary"), "think",
    )


def judged_report(spark, d):
    s = E.judged_summary(_judged(spark, d), "intent")
    rates = ("ours", "baseline", "score_ratio", "relevant_share", "unverified_rate", "uncited_rate", "cites", "expect_rate", "decode_rate")
    return s.select(*[c for c in s.columns if c not in rates], *[micro(F.col(c)).alias(c) for c in rates])


def gate_checks(spark, d):
    r = _judged(spark, d)
    return E.gate_checks(r.where("think"), r.where("not think"), r.where("outcome is not null").select("outcome", (F.col("ours") - F.col("baseline")).alias("diff")))


def stage_times(spark, d):
    s = _records(spark, d).select("record_id", F.explode("stages").alias("s"))
    return s.groupBy("s.stage").agg(F.count("*").alias("n"), micro(F.percentile("s.ms", F.lit(0.5))).alias("p50"), F.max("s.ms").alias("most"))


def run_summary_rollup(spark, d):
    s = E.run_summary(_records(spark, d), "intent")
    return s.select("intent", "overall", "n", "errors", "no_sources", micro(F.col("mean_sources")).alias("sources"), micro(F.col("mean_tokens")).alias("tokens"), micro(F.col("p50")).alias("p50"), micro(F.col("p90")).alias("p90"), micro(F.col("first_p50")).alias("first_p50"))


def release_gate(spark, d):
    r = _records(spark, d)
    return E.release_gate(r.where("think"), r.where("not think"))


def stratified_sample(spark, d):
    q = table(spark, d, "eval_req").select("id", "category").distinct()
    return E.stratified(q, "category", "id", 60).select("id")


def round_robin_sheet(spark, d):
    q = table(spark, d, "eval_req").select("id", "category").distinct()
    return E.round_robin(q, "category", "id", 30).select("id", "category", "turn")


def bootstrap_ci(spark, d):
    return E.bootstrap(_records(spark, d), "total_ms", "record_id")


def most_common_source(spark, d):
    """Per collection: documents, the most common source (ties to the smaller name) and all sources by frequency."""
    c = table(spark, d, "documents").where("collection is not null").groupBy("collection", spelling(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "source")))
    return c.where("source <> ''").groupBy("collection").agg(F.sum("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["source"]), ",").alias("sources"))


def run_islands(spark, d):
    return H.runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def history_lookback(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("event_type")))
    return H.look_back(e, "user_id", ["ts", "event_id"], "v").select("event_id", "previous", "recent")


def recent_ring(spark, d):
    r = _records(spark, d).withColumn("all", F.lit(0))
    return H.ring(r, "intent", [F.desc("ts_ms"), F.desc("record_id")], 20).select("intent", "record_id", "place")


def telemetry_windows(spark, d):
    """Tumbling hours of record time."""
    t = F.window(F.timestamp_millis("ts_ms"), "1 day")
    return _records(spark, d).groupBy(t.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors")).select(F.unix_millis("w.start").alias("day_ms"), "n", "errors")


def history_turns(spark, d):
    """The last turn of each request's history, and how many there are."""
    h = table(spark, d, "eval_req").select("id", F.size("history").cast("long").alias("n"), F.try_element_at("history", F.lit(-1)).alias("last"))
    return h.select("id", "n", F.col("last.query").alias("last_query")).distinct()


def followup_join(spark, d):
    """Records whose search text was rewritten, joined to the requests that asked the same words."""
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), r"[?.! ]+$", ""))
    r = _records(spark, d).where("query <> '' and search_query <> query").select(key(F.col("query")).alias("k"), "record_id")
    q = table(spark, d, "query_record").where("query <> ''").select(key(F.col("search_query")).alias("k")).distinct()
    return r.join(q, "k", "left_semi").select("record_id")


def chunk_documents(spark, d):
    p = P.passages(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return p.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "section", "text")


def pack_articles(spark, d):
    docs = table(spark, d, "documents").where("text is not null and title is not null")
    rows = P.passages(docs, "doc_id", "text").withColumnRenamed("doc_id", "key")
    return P.pack_tables(docs.select(F.col("doc_id").alias("key"), "title", F.lit(None).cast("string").alias("qid"), F.col("n_chars").alias("popularity"), F.translate("title", " ", "_").alias("url_title")), rows)[0]


def dense_ids(spark, d):
    s = table(spark, d, "sections").select("section_id", "article_id", "ordinal").distinct()
    return P.dense_ids(s, ["article_id", "ordinal", "section_id"], "dense_id").select("section_id", "dense_id")


def first_passages(spark, d):
    """Where the passages of each article start and how many they are, from the sections in order."""
    s = P.dense_ids(table(spark, d, "sections").select("section_id", "article_id", "ordinal").distinct(), ["article_id", "ordinal", "section_id"], "dense_id")
    return s.groupBy("article_id").agg(F.min("dense_id").alias("first_passage"), F.count("*").alias("n_passages"))


def top_articles(spark, d):
    """The subset of a pack: the most popular articles, renumbered."""
    a = table(spark, d, "articles").groupBy("article_id").agg(F.max("popularity").alias("popularity")).orderBy(F.desc("popularity"), "article_id").limit(100)
    return a.select("article_id", (F.row_number().over(Window.orderBy(F.desc("popularity"), "article_id")) - 1).cast("long").alias("new_id"))


def evidence_pack(spark, d):
    from kernwerk.queries_retrieval import _asked, _passages, stored_index
    from kernwerk.operators import sparse as S

    p = _passages(spark, d)
    i = stored_index(spark, d)
    hits = S.bm25(i.postings, i.stats, _asked(spark, d), 24)
    full = hits.join(p.select("pid", F.coalesce("text", F.lit("")).alias("text")), "pid").join(_asked(spark, d), "query_id")
    return P.evidence(full, 600)


def citation_check(spark, d):
    a = table(spark, d, "eval_req").where("query is not null").select("id", F.concat("query", F.lit(" It has 12.5 million [1]. It cost 77 coins. [9]")).alias("a")).distinct()
    seg = a.select("id", P.citation_segments()(F.col("a"), F.lit(3), F.array(F.lit("12483000"))).alias("segments"))
    return P.citation_stats(seg)


def sentence_claims(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(P.core_sentences("text")).cast("long").alias("sentences"), F.size(P.claims("text")).cast("long").alias("claims"))


def computed_lines(spark, d):
    p = table(spark, d, "part")
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    forms = ("what is {n}% of 240?", "what is {n},5 percent of 200", "convert {n} ft to in", "{n}-60 miles in km", "how many cups are in {n} gallons?", "what is {n}% of {n} people")
    asked = F.element_at(F.array(*[F.regexp_replace(F.lit(f), r"\{n\}", n) for f in forms]), (kind + 1).cast("int"))
    return p.select("p_partkey", F.array_join(stated_lines(asked), ";").alias("line"))


QUERIES = {f.__name__: f for f in (recall_at_k, hit_at_k, ndcg_at_k, auc_pairwise, pairwise_summary, change_list, sign_test, order_outcomes, latency_percentiles, latency_nearest_rank, stage_times, judged_report, gate_checks, run_summary_rollup, release_gate, stratified_sample, round_robin_sheet, bootstrap_ci, most_common_source, run_islands, history_lookback, recent_ring, telemetry_windows, history_turns, followup_join, chunk_documents, pack_articles, dense_ids, first_passages, top_articles, evidence_pack, citation_check, sentence_claims, computed_lines)}

_M = "CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rrf DESC, cand_id) AS rank FROM (SELECT DISTINCT * FROM cand WHERE rrf IS NOT NULL AND NOT isnan(rrf)))"
_Q = "q AS (SELECT DISTINCT ON (record_id) * FROM query_record)"
_AB = f"{_Q}, a AS (SELECT query, {_M.format(x='avg(total_ms)')} AS v FROM q WHERE query <> '' AND think GROUP BY 1), b AS (SELECT query, {_M.format(x='avg(total_ms)')} AS v FROM q WHERE query <> '' AND NOT think GROUP BY 1), j AS (SELECT a.query, a.v - b.v AS diff FROM a JOIN b ON a.query = b.query)"
_SEC = "s AS (SELECT *, row_number() OVER (ORDER BY article_id, ordinal, section_id) - 1 AS dense_id FROM (SELECT DISTINCT section_id, article_id, ordinal FROM sections))"
_SP = r"nullif(lower(trim(regexp_replace(source, '[\s\x{00A0}]+', ' ', 'g'))), '')"
_TAIL = "least(1.0, 2 * list_sum(list_transform(range(0, least({w}, {l})::BIGINT + 1), lambda i: exp(lgamma({w} + {l} + 1) - lgamma(i + 1) - lgamma({w} + {l} - i + 1) - ({w} + {l}) * ln(2)))))"
ORACLE = {
    "sign_test": f"SELECT n_nationkey, {_M.format(x=_TAIL.format(w='n_nationkey', l='(n_regionkey + 3)'))} AS p_micro FROM nation",
    "pairwise_summary": f"WITH {_AB}, s AS (SELECT count(*) AS n, count(*) FILTER (diff > 0) AS win, count(*) FILTER (diff = 0) AS tie, count(*) FILTER (diff < 0) AS loss FROM j) SELECT n, win, tie, loss, tie AS identical, {_M.format(x=_TAIL.format(w='win', l='loss'))} AS sign_micro FROM s",
    "recall_at_k": f"WITH {_R} SELECT record_id, count(*) AS n_gold, {_M.format(x='count(*) FILTER (rank <= 10) / count(*)::DOUBLE')} AS r10, {_M.format(x='count(*) FILTER (rank <= 40) / count(*)::DOUBLE')} AS r40 FROM r WHERE e IS NOT NULL GROUP BY 1",
    "hit_at_k": f"WITH {_R} SELECT record_id, min(rank) FILTER (e = 0) AS first, coalesce(min(rank) FILTER (e = 0) <= 1, false) AS hit_1, coalesce(min(rank) FILTER (e = 0) <= 5, false) AS hit_5 FROM r GROUP BY 1",
    "ndcg_at_k": f"WITH {_R}, g AS (SELECT *, coalesce(CASE WHEN e IS NOT NULL THEN greatest(3 - e, 1) END, 0) AS grade FROM r), i AS (SELECT *, 2 ** grade - 1 AS gain, row_number() OVER (PARTITION BY record_id ORDER BY grade DESC, cand_id) AS ideal FROM g), s AS (SELECT record_id, sum(CASE WHEN rank <= 8 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 8 THEN gain / log2(ideal + 1) ELSE 0 END) AS best, count(*) FILTER (rank <= 8 AND gain > 0) AS n FROM i GROUP BY 1) SELECT record_id, CASE WHEN best > 0 THEN {_M.format(x='dcg / best')} END AS ndcg, {_M.format(x='n / 8.0::DOUBLE')} AS p8 FROM s",
    "auc_pairwise": f"WITH {_R}, w AS (SELECT a.record_id, avg(CASE WHEN a.rrf > b.rrf THEN 1.0 WHEN a.rrf = b.rrf THEN 0.5 ELSE 0 END) AS auc FROM r a JOIN r b ON a.record_id = b.record_id WHERE a.e IS NOT NULL AND b.e IS NULL GROUP BY 1) SELECT record_id, {_M.format(x='auc')} AS auc_micro FROM w",
    "change_list": f"WITH {_AB} SELECT query, CASE WHEN diff > 0 THEN 'win' ELSE 'loss' END AS outcome FROM j WHERE diff <> 0",
    "order_outcomes": "WITH t AS (SELECT n_nationkey, n_nationkey % 3 - 1 AS a, n_regionkey % 3 - 1 AS b FROM nation) SELECT n_nationkey, CASE WHEN a >= 0 AND b >= 0 AND a + b > 0 THEN 'win' WHEN a <= 0 AND b <= 0 AND a + b < 0 THEN 'loss' ELSE 'tie' END AS outcome FROM t",
    "latency_percentiles": f"WITH {_Q} SELECT intent, count(*) AS n, {_M.format(x='quantile_cont(total_ms, 0.5)')} AS p50, {_M.format(x='quantile_cont(total_ms, 0.9)')} AS p90, {_M.format(x='avg(ttft_ms)')} AS mean_first FROM q GROUP BY 1",
    "latency_nearest_rank": f"WITH {_Q}, l AS (SELECT intent, list(total_ms ORDER BY total_ms) AS l FROM q GROUP BY 1) SELECT intent, l[1 + floor((len(l) - 1) * 0.5 + 0.5)::INT] AS p50, l[1 + floor((len(l) - 1) * 0.9 + 0.5)::INT] AS p90 FROM l",
    "stage_times": f"WITH {_Q}, s AS (SELECT unnest(stages) AS s FROM q) SELECT s.stage AS stage, count(*) AS n, {_M.format(x='quantile_cont(s.ms, 0.5)')} AS p50, max(s.ms) AS most FROM s GROUP BY 1",
    "run_summary_rollup": f"WITH {_Q} SELECT intent, grouping(intent)::BIGINT AS overall, count(*) AS n, count(error) AS errors, count(*) FILTER (n_sources = 0) AS no_sources, {_M.format(x='avg(n_sources)')} AS sources, {_M.format(x='avg(evidence_tokens)')} AS tokens, {_M.format(x='quantile_cont(total_ms, 0.5)')} AS p50, {_M.format(x='quantile_cont(total_ms, 0.9)')} AS p90, {_M.format(x='quantile_cont(ttft_ms, 0.5)')} AS first_p50 FROM q GROUP BY ROLLUP (intent)",
    "release_gate": f"WITH {_Q}, s AS (SELECT think, count(error) AS e, count(*) FILTER (n_sources = 0) / count(*)::DOUBLE AS u, quantile_cont(total_ms, 0.5) AS t FROM q GROUP BY 1), j AS (SELECT n.e AS ne, o.e AS oe, n.u AS nu, o.u AS ou, n.t AS nt, o.t AS ot FROM s n, s o WHERE n.think AND NOT o.think) SELECT 'errors' AS \"check\", ne <= oe AS ok FROM j UNION ALL SELECT 'unsourced', nu <= ou + 0.01 FROM j UNION ALL SELECT 'median_time', nt <= ot * 1.01 FROM j",
    "computed_lines": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '% of 240 = ' || _t(p_size * 2.4) WHEN 1 THEN p_size || '.5% of 200 = ' || (2 * p_size + 1) WHEN 2 THEN p_size || ' ft = ' || (12 * p_size) || ' in' WHEN 4 THEN p_size || ' US gal = ' || (16 * p_size) || ' US cups' ELSE '' END AS line FROM part".replace("_t(p_size * 2.4)", "regexp_replace(printf('%.1f', p_size * 2.4), '\\.0$', '')"),
    "judged_report": f"""WITH {_Q}, k AS (SELECT *, record_id AS k FROM q), j AS (SELECT intent, error, n_sources, (k % 5)::DOUBLE AS ours, (k % 4 + 1)::DOUBLE AS baseline, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 > k % 4 + 1 THEN 'win' WHEN k % 5 < k % 4 + 1 THEN 'loss' ELSE 'tie' END AS o,
  CASE WHEN k % 3 = 0 THEN 'full' WHEN k % 3 = 1 THEN 'partial' WHEN k % 6 = 2 THEN 'none' END AS s, k, evidence_tokens / total_ms * 1000 AS rate FROM k)
SELECT intent, grouping(intent)::BIGINT AS overall, count(*) AS n, count(o) AS n_judged, {_M.format(x='avg(ours) FILTER (o IS NOT NULL)')} AS ours, {_M.format(x='avg(baseline) FILTER (o IS NOT NULL)')} AS baseline, {_M.format(x='avg(ours) FILTER (o IS NOT NULL) / avg(baseline) FILTER (o IS NOT NULL)')} AS score_ratio,
  count(*) FILTER (o = 'win') AS win, count(*) FILTER (o = 'tie') AS tie, count(*) FILTER (o = 'loss') AS loss, count(*) FILTER (s = 'full') AS evidence_full, count(*) FILTER (s = 'partial') AS evidence_partial, count(*) FILTER (s = 'none') AS evidence_none,
  count(*) FILTER (o = 'loss' AND s = 'full') AS lost_with_full, count(*) FILTER (o = 'loss' AND s <> 'full') AS lost_with_thin, {_M.format(x='avg(least(n_sources, k % 4) / nullif(n_sources, 0)::DOUBLE)')} AS relevant_share, {_M.format(x='sum(k % 2) / sum(k % 9 + 1)::DOUBLE')} AS unverified_rate, {_M.format(x='sum(k % 3) / sum(k % 9 + 1)::DOUBLE')} AS uncited_rate, {_M.format(x='avg(k % 6)')} AS cites,
  count(*) FILTER (k % 4 = 0) AS expect_n, count(*) FILTER (k % 8 = 0) AS expect_pass, {_M.format(x='count(*) FILTER (k % 8 = 0) / nullif(count(*) FILTER (k % 4 = 0), 0)::DOUBLE')} AS expect_rate, count(*) FILTER (k % 5 = 0) AS abstain_n, count(*) FILTER (k % 10 = 0) AS abstain_pass, sum(CASE WHEN k % 5 = 0 THEN k % 2 ELSE 0 END)::BIGINT AS invented,
  {_M.format(x='quantile_cont(rate, 0.5)')} AS decode_rate, count(error) AS errors FROM j GROUP BY ROLLUP (intent)""",
    "gate_checks": f"""WITH {_Q}, k AS (SELECT *, record_id AS k, record_id % 11 = 0 AS canary FROM q), g AS (SELECT think, count(error) AS e, count(*) FILTER (canary) AS c, count(*) FILTER (canary AND k % 8 = 0) AS r, sum(CASE WHEN NOT canary THEN k % 2 END) / sum(CASE WHEN NOT canary THEN k % 9 + 1 END)::DOUBLE AS u,
  count(*) FILTER (NOT canary AND k % 8 = 0) AS x, count(*) FILTER (NOT canary AND k % 10 = 0) AS a FROM k GROUP BY 1), p AS (SELECT count(*) FILTER (k % 5 > k % 4 + 1) AS win, count(*) FILTER (k % 5 < k % 4 + 1) AS loss FROM k WHERE k % 7 <> 0), t AS (SELECT win, loss, {_TAIL.format(w='win', l='loss')} AS sign FROM p)
SELECT 'errors' AS "check", e = 0 AS ok FROM g WHERE think UNION ALL SELECT 'canary', c > 0 AND r = c FROM g WHERE think UNION ALL SELECT 'unverified', n.u <= o.u + 0.01 FROM g n, g o WHERE n.think AND NOT o.think UNION ALL SELECT 'expected', n.x >= o.x FROM g n, g o WHERE n.think AND NOT o.think
UNION ALL SELECT 'abstention', n.a >= o.a - 1 FROM g n, g o WHERE n.think AND NOT o.think UNION ALL SELECT 'pairs', NOT (loss > win AND sign < 0.05) FROM t""",
    "stratified_sample": "WITH q AS (SELECT DISTINCT id, category FROM eval_req), s AS (SELECT category, count(*) * 60.0::DOUBLE / sum(count(*)) OVER () AS quota FROM q GROUP BY 1), t AS (SELECT category, floor(quota) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, category) <= 60 - sum(floor(quota)) OVER () THEN 1 ELSE 0 END AS take FROM s) SELECT id FROM (SELECT q.id, take, row_number() OVER (PARTITION BY q.category ORDER BY md5(id || ':0'), id) AS p FROM q JOIN t ON q.category = t.category) WHERE p <= take",
    "round_robin_sheet": "WITH q AS (SELECT DISTINCT id, category FROM eval_req) SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS turn FROM q ORDER BY turn, category LIMIT 30",
    "most_common_source": f"WITH c AS (SELECT collection, {_SP} AS source, count(*) AS n FROM documents WHERE collection IS NOT NULL GROUP BY 1, 2) SELECT collection, sum(n)::BIGINT AS n, string_agg(source, ',' ORDER BY n DESC, source) AS sources FROM c WHERE source IS NOT NULL GROUP BY 1",
    "run_islands": "WITH a AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a), c AS (SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM b GROUP BY 1, 2) SELECT user_id, event_type, count(*) AS runs, max(n) AS longest FROM c GROUP BY 1, 2",
    "history_lookback": "WITH e AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM events) SELECT event_id, lag(v) OVER w AS previous, coalesce(lag(v) OVER w, lag(v, 2) OVER w) AS recent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "recent_ring": f"WITH {_Q} SELECT intent, record_id, row_number() OVER (PARTITION BY intent ORDER BY ts_ms DESC, record_id DESC) AS place FROM q QUALIFY place <= 20",
    "telemetry_windows": f"WITH {_Q} SELECT (ts_ms // 86400000) * 86400000 AS day_ms, count(*) AS n, count(error) AS errors FROM q GROUP BY 1",
    "history_turns": "SELECT DISTINCT id, len(history)::BIGINT AS n, history[-1].query AS last_query FROM eval_req",
    "followup_join": r"WITH q AS (SELECT DISTINCT ON (record_id) * FROM query_record), k AS (SELECT DISTINCT lower(regexp_replace(trim(search_query), '[?.! ]+$', '')) AS k FROM query_record WHERE query <> '') SELECT record_id FROM q WHERE query <> '' AND search_query <> query AND lower(regexp_replace(trim(query), '[?.! ]+$', '')) IN (SELECT k FROM k)",
    "dense_ids": f"WITH {_SEC} SELECT section_id, dense_id FROM s",
    "first_passages": f"WITH {_SEC} SELECT article_id, min(dense_id) AS first_passage, count(*) AS n_passages FROM s GROUP BY 1",
    "top_articles": "SELECT article_id, row_number() OVER (ORDER BY popularity DESC, article_id) - 1 AS new_id FROM (SELECT article_id, max(popularity) AS popularity FROM articles GROUP BY 1 ORDER BY popularity DESC, article_id LIMIT 100)",
}
