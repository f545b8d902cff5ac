"""Queries over facts, titles, redirects and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kernwerk.functions.keys import spelling
from kernwerk.functions.text import SKIPPED_SECTIONS, normalize_title, strip_markdown
from kernwerk.operators import factstore as K
from kernwerk.operators import selection as X
from kernwerk.operators import titles as TI
from kernwerk.queries_text import micro
from kernwerk.session import small, table


def _facts(spark, d):
    clean = F.when(~F.isnan("value_num"), F.col("value_num"))
    return table(spark, d, "facts").distinct().withColumn("value_num", clean).withColumn("ended", F.col("source") == "userpack")


def facts_best_rank(spark, d):
    return K.best_rank(_facts(spark, d), ["qid", "pid"]).select("fact_id")


def facts_current(spark, d):
    return K.current(K.best_rank(_facts(spark, d), ["qid", "pid"]), ["qid", "pid"], "ended", "point_in_time").select("fact_id")


def facts_select(spark, d):
    """The whole selection: best rank, current, one row per property."""
    rows = _facts(spark, d).join(table(spark, d, "props").select("pid", "datatype"), "pid")
    one = K.one_per_property(K.current(K.best_rank(rows, ["qid", "pid"]), ["qid", "pid"], "ended", "point_in_time"), "fact_id")
    return one.select("qid", "pid", micro(F.col("value_num")).alias("value_micro"), "value_text", "unit", "point_in_time", F.col("rank").cast("long").alias("rank"))


def entity_facts(spark, d):
    props = table(spark, d, "props").select("pid", "label", "priority")
    return K.entity_facts(_facts(spark, d), props, 8).select("qid", "pid", "fact_id", "place")


def fact_values(spark, d):
    props = table(spark, d, "props").select("pid", "label", "priority")
    rows = K.entity_facts(_facts(spark, d), props, 60)
    return K.lines(rows.withColumn("shown", K.shown_value()), "qid", "label", "shown", "point_in_time").select("qid", "pid", "line")


def facts_informative(spark, d):
    p = table(spark, d, "props").select("pid", "label")
    e = table(spark, d, "entities").groupBy("qid").agg(F.min("label").alias("entity"))
    rows = _facts(spark, d).where("value_text is not null").join(p, "pid").join(e, "qid")
    return rows.where(K.informative(F.col("entity"), F.col("label"), F.col("value_text"))).select("fact_id")


def labels_min_by(spark, d):
    e = table(spark, d, "entities").where("label is not null")
    return K.labels(e, "qid", "label", F.when(F.col("deleted_at").isNull(), 0).otherwise(1))


def aliases_joined(spark, d):
    a = table(spark, d, "entities").select("qid", F.explode(F.split("aliases", r"\|")).alias("alias"))
    return a.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))


def unit_filtered_agg(spark, d):
    u = table(spark, d, "unit_name")
    return u.groupBy("qid").agg(F.coalesce(F.min(F.when(F.length(F.trim("unit")) <= 3, F.trim("unit"))), F.min(F.trim("unit"))).alias("unit"), F.count_if(F.col("unit").isNull()).alias("n_null"))


def two_hop_facts(spark, d):
    """From the thing an entity is named after to the entities with that motto, and on to their countries, kinds and currencies."""
    f = _facts(spark, d).withColumn("value_num", F.lit(None).cast("double"))
    names = f.where("pid = 'P9207' and value_text is not null").select("qid", F.col("value_text").alias("label")).distinct()
    return K.two_hops(f.where("value_text is not null"), names, ["P9205"], ["P9201", "P9203", "P9209"])


def derived_ratio(spark, d):
    return K.ratio(_facts(spark, d), "P9015", "P9004").select("qid", micro(F.col("ratio")).alias("ratio_micro"))


def compare_values(spark, d):
    v = _facts(spark, d).where("value_num is not null").groupBy("pid", "qid").agg(F.max("value_num").alias("value"))
    return K.compare(v).select("pid", micro(F.col("difference")).alias("difference_micro"), F.col("larger"), F.col("smaller"))


def fact_semi_join(spark, d):
    return table(spark, d, "entities").join(table(spark, d, "facts").select("qid").distinct(), "qid", "left_semi").select("qid").distinct()


def resume_anti_join(spark, d):
    """What an interrupted run still has to do: questions without an answer row."""
    done = table(spark, d, "query_record").where("query is not null").select(normalize_title(F.col("query")).alias("k")).distinct()
    return table(spark, d, "eval_req").where("query is not null").withColumn("k", normalize_title(F.col("query"))).join(done, "k", "left_anti").select("id").distinct()


def _articles(spark, d):
    return TI.current_articles(table(spark, d, "articles"))


def _names(spark, d):
    r = table(spark, d, "redirects").select(F.col("from_title").alias("name"))
    return r.unionByName(table(spark, d, "articles").select(F.col("title").alias("name"))).distinct()


def title_or_redirect(spark, d):
    return TI.lookup(_names(spark, d), _articles(spark, d), table(spark, d, "redirects")).withColumn("how", F.col("how").cast("long"))


def title_prefix_candidates(spark, d):
    return TI.prefix_candidates(_names(spark, d), _articles(spark, d))


def title_senses(spark, d):
    return TI.senses(_names(spark, d), _articles(spark, d))


def code_lookup(spark, d):
    return TI.codes(table(spark, d, "redirects"))


def alias_redirects(spark, d):
    return TI.alias_redirects(table(spark, d, "entities"), _articles(spark, d))


def safe_aliases(spark, d):
    a = table(spark, d, "entities").select(F.explode(F.split("aliases", r"\|")).alias("alias")).distinct()
    return a.select("alias", TI.safe_alias(F.col("alias")).alias("safe"))


def linkable_articles(spark, d):
    lead = F.when(F.col("article_id") % 9 == 0, F.concat("title", F.lit(" may refer to:"))).otherwise(F.col("oneliner"))
    return table(spark, d, "articles").select("article_id", TI.linkable(F.col("title"), lead).alias("linkable"), TI.skip_article(F.col("title"), F.coalesce(lead, F.lit(""))).alias("skipped")).distinct()


def entity_spans(spark, d):
    """Mentions in questions about an article and a redirect."""
    r = table(spark, d, "redirects").where("from_title is not null and article_id is not null").groupBy("article_id").agg(F.min("from_title").alias("other"))
    asked = _articles(spark, d).join(r, "article_id").select(F.col("article_id").cast("string").alias("query_id"), F.concat(F.lit("how far is "), "title", F.lit(" from "), "other", F.lit("?")).alias("query"))
    return TI.link(asked, _articles(spark, d), table(spark, d, "redirects"))


def sections_kept(spark, d):
    skipped = F.exists("path", lambda p: F.lower(p).isin(*SKIPPED_SECTIONS, "economy"))
    return table(spark, d, "sections").where(~F.coalesce(skipped, F.lit(False))).select("section_id").distinct()


def pack_scope(spark, d):
    """Requests against the packs in their scope; an empty or null scope means all packs."""
    packs = table(spark, d, "documents").select(spelling(F.col("source")).alias("pack")).where("pack <> ''").distinct()
    req = table(spark, d, "eval_req").select("id", F.coalesce("packs", F.array()).cast("array<string>").alias("packs")).distinct()
    scoped = req.where("size(packs) > 0").select("id", F.explode("packs").alias("pack")).join(packs, "pack", "left_semi")
    whole = req.where("size(packs) = 0").select("id").crossJoin(small(packs, 255, "packs"))
    return scoped.unionByName(whole.select("id", "pack"), allowMissingColumns=False).select("id", "pack").distinct()


def dedupe_first(spark, d):
    """The first document of each text, by normalised text; the first id wins."""
    k = F.lower(F.trim("text"))
    return table(spark, d, "documents").where("trim(text) <> ''").groupBy(F.md5(k).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def near_duplicate_questions(spark, d):
    """Pairs of questions, as asked and as searched, that share six words in ten or more."""
    r = table(spark, d, "query_record")
    q = r.select(F.col("query").alias("q")).unionByName(r.select(F.col("search_query").alias("q"))).where("trim(q) <> ''").distinct()
    return X.near_duplicates(q.withColumn("k", F.col("q")), "k", "q")


def namespace_filter(spark, d):
    t = F.when(F.col("article_id") % 4 == 0, F.concat(F.lit("Category:"), "title")).otherwise(F.col("title"))
    return table(spark, d, "articles").select("article_id", t.alias("title")).where(~F.col("title").rlike("^(Category|Template|Wikipedia|Portal|Module|Help|Draft|File|MediaWiki|TimedText|Book):")).select("article_id").distinct()


def plain_titles(spark, d):
    return table(spark, d, "articles").select("article_id", strip_markdown(F.col("title")).alias("title")).distinct()


QUERIES = {f.__name__: f for f in (facts_best_rank, facts_current, facts_select, entity_facts, fact_values, facts_informative, labels_min_by, aliases_joined, unit_filtered_agg, two_hop_facts, derived_ratio, compare_values, fact_semi_join, resume_anti_join, title_or_redirect, title_prefix_candidates, title_senses, code_lookup, alias_redirects, safe_aliases, linkable_articles, entity_spans, sections_kept, pack_scope, dedupe_first, near_duplicate_questions, namespace_filter, plain_titles)}

_M = "CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
_F = "f AS (SELECT DISTINCT * REPLACE (CASE WHEN NOT isnan(value_num) THEN value_num END AS value_num), source = 'userpack' AS ended FROM facts)"
_BEST = "best AS (SELECT * FROM {src} QUALIFY rank = max(rank) OVER (PARTITION BY qid, pid))"
_CUR = "cur AS (SELECT * FROM best WINDOW w AS (PARTITION BY qid, pid) QUALIFY ended::INT = min(ended::INT) OVER w AND coalesce(point_in_time, '') = max(coalesce(point_in_time, '')) OVER w)"
_KEY = r"lower(trim(regexp_replace(translate({c}, '_', ' '), '\s+', ' ', 'g')))"
_ART = "art AS (SELECT article_id, title, popularity, linkable, qid, CASE WHEN linkable THEN " + _KEY.format(c="title") + " ELSE '' END AS key FROM (SELECT article_id, arg_max(title, added_at) AS title, max(popularity) AS popularity, bool_or(coalesce(linkable, true)) AS linkable, min(qid) AS qid FROM articles GROUP BY 1))"
_RED = "red AS (SELECT key, arg_min(article_id, (loaded_at, redirect_id)) AS article_id FROM (SELECT *, " + _KEY.format(c="from_title") + " AS key FROM redirects WHERE article_id IS NOT NULL) GROUP BY 1)"
_NAM = "nam AS (SELECT name, " + _KEY.format(c="name") + " AS key FROM (SELECT from_title AS name FROM redirects UNION SELECT title FROM articles))"
_TOPN = "SELECT name, article_id, row_number() OVER (PARTITION BY name ORDER BY popularity DESC, article_id) AS place FROM ({j}) QUALIFY place <= {n}"
_SAFE = r"(length({c}) <= 80 AND (len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')) >= 2 OR regexp_full_match({c}, '[A-Z]{{2,5}}') OR regexp_matches({c}, '^[A-Z].{{3,}}$')))"
ORACLE = {
    "facts_best_rank": f"WITH {_F}, {_BEST.format(src='f')} SELECT fact_id FROM best",
    "facts_current": f"WITH {_F}, {_BEST.format(src='f')}, {_CUR} SELECT fact_id FROM cur",
    "facts_select": f"WITH {_F}, g AS (SELECT f.*, datatype FROM f JOIN props USING (pid)), {_BEST.format(src='g')}, {_CUR}, agg AS (SELECT qid, pid, arg_min(value_num, fact_id) AS v, list(value_text ORDER BY fact_id) FILTER (value_text IS NOT NULL) AS l, min(datatype) AS dt, arg_min(value_text, fact_id) AS t, arg_min(unit, fact_id) AS unit, min(point_in_time) AS point_in_time, max(rank)::BIGINT AS rank FROM cur GROUP BY 1, 2) SELECT qid, pid, {_M.format(x='v')} AS value_micro, CASE WHEN dt IN ('wikibase-item', 'monolingualtext') THEN nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], ', '), '') ELSE t END AS value_text, unit, point_in_time, rank FROM agg",
    "entity_facts": f"WITH {_F}, one AS (SELECT f.*, priority FROM f JOIN props USING (pid) WHERE value_num IS NOT NULL OR value_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid, pid ORDER BY rank DESC, point_in_time DESC NULLS LAST, fact_id) = 1) SELECT qid, pid, fact_id, row_number() OVER (PARTITION BY qid ORDER BY priority, pid) AS place FROM one QUALIFY place <= 8",
    "facts_informative": f"WITH {_F} SELECT fact_id FROM f JOIN props USING (pid) JOIN (SELECT qid, min(label) AS entity FROM entities GROUP BY 1) e USING (qid) WHERE value_text IS NOT NULL AND label NOT IN ('instance of', 'official name', 'country') AND lower(value_text) <> lower(entity)",
    "labels_min_by": "SELECT qid, arg_min(label, (CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END, label)) AS label FROM entities WHERE label IS NOT NULL GROUP BY 1",
    "aliases_joined": "SELECT qid, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM (SELECT qid, unnest(string_split(aliases, '|')) AS alias FROM entities) GROUP BY 1",
    "unit_filtered_agg": "SELECT qid, coalesce(min(trim(unit)) FILTER (length(trim(unit)) <= 3), min(trim(unit))) AS unit, count(*) FILTER (unit IS NULL) AS n_null FROM unit_name GROUP BY 1",
    "two_hop_facts": f"WITH {_F} SELECT DISTINCT a.qid, a.pid AS via_pid, e.qid AS bridge, c.pid, c.value_text AS value FROM f a JOIN (SELECT DISTINCT qid, value_text AS label FROM f WHERE pid = 'P9207' AND value_text IS NOT NULL) e ON lower(a.value_text) = lower(e.label) JOIN f c ON c.qid = e.qid WHERE a.pid = 'P9205' AND c.pid IN ('P9201', 'P9203', 'P9209') AND c.value_text IS NOT NULL",
    "derived_ratio": f"WITH {_F}, g AS (SELECT qid, arg_min(value_num, fact_id) FILTER (pid = 'P9015') AS a, arg_min(value_num, fact_id) FILTER (pid = 'P9004') AS b FROM f WHERE value_num IS NOT NULL GROUP BY 1) SELECT qid, {_M.format(x='a / b')} AS ratio_micro FROM g WHERE a IS NOT NULL AND b <> 0",
    "compare_values": f"WITH {_F}, v AS (SELECT pid, qid, max(value_num) AS value FROM f WHERE value_num IS NOT NULL GROUP BY 1, 2) SELECT pid, {_M.format(x='max(value) - min(value)')} AS difference_micro, max(value) AS larger, min(value) AS smaller FROM v GROUP BY 1 HAVING count(*) >= 2",
    "fact_semi_join": "SELECT DISTINCT qid FROM entities WHERE qid IN (SELECT qid FROM facts)",
    "resume_anti_join": "SELECT DISTINCT id FROM eval_req WHERE query IS NOT NULL AND " + _KEY.format(c="query") + " NOT IN (SELECT " + _KEY.format(c="query") + " FROM query_record WHERE query IS NOT NULL)",
    "title_or_redirect": f"WITH {_ART}, {_RED}, {_NAM}, u AS (SELECT name, article_id, popularity, 0 AS how FROM nam JOIN art ON nam.key = art.key AND art.key <> '' UNION ALL SELECT name, red.article_id, popularity, 1 FROM nam JOIN red USING (key) JOIN art ON art.article_id = red.article_id) SELECT name, article_id, how::BIGINT AS how FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY how, popularity DESC, article_id) = 1",
    "title_prefix_candidates": f"WITH {_ART}, {_NAM} " + _TOPN.format(j="SELECT name, article_id, popularity FROM nam JOIN art ON art.key <> '' AND (art.key = nam.key OR starts_with(art.key, nam.key || ' '))", n=6),
    "title_senses": f"WITH {_ART}, {_NAM} " + _TOPN.format(j=r"SELECT name, article_id, popularity FROM nam JOIN art ON art.key <> '' AND regexp_extract(art.key, '^(.*?)(?: \(.*)?$', 1) = nam.key", n=12),
    "code_lookup": "SELECT from_title AS code, arg_min(article_id, (loaded_at, redirect_id)) AS article_id FROM redirects WHERE regexp_full_match(from_title, '[A-Z]{2,5}') AND article_id IS NOT NULL GROUP BY 1",
    "alias_redirects": f"WITH {_ART}, n AS (SELECT qid, unnest(list_concat([label], string_split(coalesce(aliases, ''), '|'))) AS name FROM entities), k AS (SELECT DISTINCT qid, {_KEY.format(c='name')} AS key FROM n WHERE name <> '' AND {_SAFE.format(c='name')}) SELECT k.key, arg_min(article_id, (-popularity, article_id)) AS article_id FROM k JOIN art ON art.qid = k.qid WHERE k.key NOT IN (SELECT key FROM art) GROUP BY 1",
    "safe_aliases": f"SELECT DISTINCT alias, {_SAFE.format(c='alias')} AS safe FROM (SELECT unnest(string_split(aliases, '|')) AS alias FROM entities)",
    "linkable_articles": "SELECT DISTINCT article_id, NOT (contains(title, '(disambiguation)') OR contains(substr(coalesce(lead, ''), 1, 400), 'may refer to') OR contains(substr(coalesce(lead, ''), 1, 400), 'may also refer to')) AS linkable, contains(title, '(disambiguation)') OR starts_with(title, 'List of') OR contains(substr(coalesce(lead, ''), 1, 300), 'may refer to') AS skipped FROM (SELECT *, CASE WHEN article_id % 9 = 0 THEN title || ' may refer to:' ELSE oneliner END AS lead FROM articles)",
    "sections_kept": "SELECT DISTINCT section_id FROM sections WHERE coalesce(len(list_filter(path, lambda p: lower(p) IN (" + ", ".join(f"'{x}'" for x in (*SKIPPED_SECTIONS, "economy")) + "))), 0) = 0",
    "pack_scope": r"WITH p AS (SELECT DISTINCT lower(trim(regexp_replace(source, '[\s\x{00A0}]+', ' ', 'g'))) AS pack FROM documents WHERE trim(source) <> '') SELECT DISTINCT id, pack FROM (SELECT id, unnest(packs) AS pack FROM eval_req WHERE len(packs) > 0) WHERE pack IN (SELECT pack FROM p) UNION SELECT DISTINCT id, pack FROM eval_req, p WHERE coalesce(len(packs), 0) = 0",
    "dedupe_first": "SELECT min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY md5(lower(trim(text)))",
    "near_duplicate_questions": r"WITH t AS (SELECT min(q) AS id, w FROM (SELECT q, list_sort(list_filter(list_distinct(regexp_split_to_array(lower(q), '[^\p{L}\p{N}]+')), lambda w: w <> '')) AS w FROM (SELECT query AS q FROM query_record UNION SELECT search_query FROM query_record) WHERE trim(q) <> '') WHERE len(w) > 0 GROUP BY w) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) * 10 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 6",
    "namespace_filter": "SELECT DISTINCT article_id FROM articles WHERE article_id % 4 <> 0",
    "plain_titles": r"SELECT DISTINCT article_id, trim(regexp_replace(replace(replace(replace(title, '*', ''), '__', ''), '`', ''), '\s+', ' ', 'g')) AS title FROM articles",
}
