"""Queries over text, number, date and unit functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernwerk.functions import dates as D
from kernwerk.functions import text as T
from kernwerk.session import table

L = F.lit


def micro(c):
    """A double as micro units, so that two engines agree in every digit that counts."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def txt_normalize_title(spark, d):
    return table(spark, d, "redirects").select("from_title", T.normalize_title(F.col("from_title")).alias("key")).distinct()


def txt_squash(spark, d):
    return table(spark, d, "eval_req").where("query is not null").select("id", T.squash(F.col("query")).alias("query")).distinct()


def txt_terms(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"), F.md5(F.array_join(T.terms(F.col("text")), " ")).alias("terms_md5"))


def txt_token_cost(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.token_cost(F.col("text")).alias("tokens"))


def txt_word_count(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"))


def txt_numbers(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.numbers(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.numbers(F.col("text")), "|")).alias("numbers_md5"))


def txt_sentences(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def txt_first_sentence(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.length(T.first_sentence(F.col("text"))).cast("long").alias("n"), F.md5(T.first_sentence(F.col("text"))).alias("first_md5"))


def txt_paragraphs(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


def txt_strip_html(spark, d):
    t = F.concat(L("<p>"), F.replace(F.col("text"), L("\n"), L("<br>")), L("</p><div>&amp; "), F.coalesce("title", L("")), L("</div>"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.regexp_count(T.strip_html(t), L("\\S+")).cast("long").alias("words"))


def txt_strip_markdown(spark, d):
    return _docs(spark, d).where("title is not null").select("doc_id", T.strip_markdown(F.concat(L("**"), F.col("title"), L("** `x`"))).alias("plain"))


def txt_licence(spark, d):
    url = F.concat(L("Creative Commons - https://creativecommons.org/licenses/"), F.when(F.col("doc_id") % 3 == 0, "by").when(F.col("doc_id") % 3 == 1, "by-sa").otherwise("by-nc"), L("/4.0/"))
    return _docs(spark, d).select("doc_id", T.licence_name(F.when(F.col("doc_id") % 7 == 0, L("MIT - https://x.org/mit")).otherwise(url)).alias("licence"))


def txt_page_url(spark, d):
    """Page addresses of all articles, as if they were of packs of several kinds, some with characters that would end a path."""
    packs = F.array(*[L(p) for p in ("wikipedia", "wiktionary-en", "medlineplus", "devdocs-en", "factbook", "stackexchange")])
    k = F.col("article_id")
    name = F.when(k % 7 == 0, F.concat("url_title", L(" 50%? #1"))).when(k % 11 == 0, L("__unknown__/x")).otherwise(F.col("url_title"))
    title = F.when(k % 5 == 0, F.col("title")).otherwise(F.concat(L("Set: "), "title"))
    return table(spark, d, "articles").select("article_id", T.page_url(F.element_at(packs, (k % 6 + 1).cast("int")), title, name).alias("url")).distinct()


def txt_url_page(spark, d):
    page = T.url_page(F.concat(L("https://en.wikipedia.org/wiki/"), F.col("url_title")))
    return table(spark, d, "articles").where(F.col("url_title").rlike("^[A-Za-z_()]+$")).select("article_id", page["pack"].alias("pack"), page["title"].alias("title")).distinct()


def txt_format_number(spark, d):
    return table(spark, d, "part").select("p_partkey", T.format_number(F.col("p_retailprice") * 1000).alias("a"), T.format_number(F.floor(F.col("p_retailprice")).cast("double")).alias("b"))


def txt_coordinates(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.coordinates((F.col("s_suppkey") % 180 - 90).cast("double"), (F.col("s_suppkey") % 360 - 180).cast("double")).alias("at"))


def txt_content_id(spark, d):
    return _docs(spark, d).where("text is not null and title is not null").select("doc_id", T.content_id(F.col("title"), F.split("text", "\f")).alias("content_id"))


def txt_normalize_answer(spark, d):
    return table(spark, d, "eval_req").where("query is not null").select("id", T.normalize_answer(F.col("query")).alias("answer")).distinct()


def txt_search_query(spark, d):
    return table(spark, d, "query_record").where("query is not null").select("record_id", T.search_query(F.col("query")).alias("cleaned")).distinct()


def txt_rerank_text(spark, d):
    return _docs(spark, d).where("text is not null and title is not null").select("doc_id", F.md5(T.rerank_text(F.col("title"), F.col("section_path"), F.col("text"))).alias("md5"))


def txt_snippet(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(T.snippet(F.col("text"))).alias("md5"))


def txt_tidy(spark, d):
    a = F.concat(L("<think>plan</think>COMPUTED: \\(x\\) "), F.coalesce("query", L("")), L(" It is so. And then"))
    s = T.split_thinking(a)
    return table(spark, d, "eval_req").select("id", s["thinking"].alias("thinking"), T.complete_part(T.tidy(s["answer"])).alias("answer")).distinct()


def txt_expected_answer(spark, d):
    q = F.coalesce("query", L(""))
    ok = T.answer_found(F.concat(q, L(" The Answer is 12.5 million.")), F.array(L("answer IS"), L("nothing")), 3)
    return table(spark, d, "robust").select("id", ok.alias("found"), T.number_found(L("about 12.5 million"), L(12_510_000.0)).alias("near"), T.number_found(q, L(7.0)).alias("seven")).distinct()


def txt_fact_line(spark, d):
    return table(spark, d, "facts").where("value_text is not null").select("fact_id", T.fact_line(F.col("qid"), F.col("pid"), F.col("value_text"), F.col("point_in_time")).alias("line")).distinct()


def fmt_time(spark, d):
    t = F.concat(L("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), L("T00:00:00Z"))
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[D.time_text(t, L(p)).alias(f"p{p}") for p in (7, 8, 9, 10, 11)], D.time_text(F.concat(L("-0"), F.lpad((F.col("o_orderkey") % 900 + 1).cast("string"), 3, "0"), L("-00-00T00:00:00Z")), L(7)).alias("bc"))


def fmt_ordinal(spark, d):
    return table(spark, d, "nation").select("n_nationkey", D.ordinal(F.col("n_nationkey") + 1).alias("ord"), D.ordinal(F.col("n_nationkey") + 101).alias("ord100"))


def text_hash_groups(spark, d):
    """Texts that occur more than once, by hash then by text: the reuse join of unchanged passages."""
    return _docs(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


QUERIES = {f.__name__: f for f in (txt_normalize_title, txt_squash, txt_terms, txt_token_cost, txt_word_count, txt_numbers, txt_sentences, txt_first_sentence, txt_paragraphs, txt_strip_html, txt_strip_markdown, txt_licence, txt_page_url, txt_url_page, txt_format_number, txt_coordinates, txt_content_id, txt_normalize_answer, txt_search_query, txt_rerank_text, txt_snippet, txt_tidy, txt_expected_answer, txt_fact_line, fmt_time, fmt_ordinal, text_hash_groups)}

_SQ = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_TERMS = f"list_transform(list_filter({_TOK.format(c='text')}, lambda w: w NOT IN ({_STOP})), lambda w: substr(w, 1, 6))"
_SENT = r"list_filter(string_split(regexp_replace({c}, '([.!?])\s+([\x22''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')"
_NUM = r"list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[\p{L}\p{N}]*[\p{L}\p{No}\p{Nl}][\p{L}\p{N}]*', 'x', 'g'), '[0-9](?:[0-9]|[.,][0-9])*'), lambda x: replace(x, ',', '')), lambda x: length(x) >= 2 OR contains(x, '.'))"
_ORD = "({n})::VARCHAR || CASE WHEN ({n}) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN ({n}) % 10 = 1 THEN 'st' WHEN ({n}) % 10 = 2 THEN 'nd' WHEN ({n}) % 10 = 3 THEN 'rd' ELSE 'th' END"
_FMT = "regexp_replace(regexp_replace(format('{{:,.4f}}', {x}), '0+$', ''), '\\.$', '')"
ORACLE = {
    "txt_format_number": f"SELECT p_partkey, {_FMT.format(x='p_retailprice * 1000')} AS a, {_FMT.format(x='floor(p_retailprice)')} AS b FROM part",
    "txt_normalize_title": "SELECT DISTINCT from_title, lower(" + _SQ.format(c="translate(from_title, '_', ' ')") + ") AS key FROM redirects",
    "txt_squash": "SELECT DISTINCT id, " + _SQ.format(c="query") + " AS query FROM eval_req WHERE query IS NOT NULL",
    "txt_terms": f"SELECT doc_id, len({_TERMS})::BIGINT AS n_terms, md5(array_to_string({_TERMS}, ' ')) AS terms_md5 FROM documents WHERE text IS NOT NULL",
    "txt_token_cost": "SELECT doc_id, (ceil((strlen(text) - length(regexp_replace(text, '[^0-9]', '', 'g'))) / 4.0) + length(regexp_replace(text, '[^0-9]', '', 'g')))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "txt_word_count": r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS words FROM documents WHERE text IS NOT NULL",
    "txt_sentences": f"SELECT doc_id, len({_SENT.format(c='text')})::BIGINT AS n_sentences FROM documents WHERE text IS NOT NULL",
    "txt_first_sentence": "WITH s AS (SELECT doc_id, substr(coalesce(" + _SENT.format(c="translate(text, chr(10), ' ')") + "[1], text), 1, 300) AS f FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(f)::BIGINT AS n, md5(f) AS first_md5 FROM s",
    "txt_paragraphs": r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*(?:\n[ \t]*)+'), lambda p: " + _SQ.format(c="p") + "), lambda p: p <> ''))::BIGINT AS n_paragraphs FROM documents WHERE text IS NOT NULL",
    "txt_strip_markdown": r"SELECT doc_id, " + _SQ.format(c=r"regexp_replace(replace(replace(replace('**' || title || '** `x`', '*', ''), '__', ''), '`', ''), '\\([\\`*_{}\[\]()#+.!-])', '\1', 'g')") + " AS plain FROM documents WHERE title IS NOT NULL",
    "txt_licence": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'MIT' WHEN doc_id % 3 = 0 THEN 'CC BY 4.0' WHEN doc_id % 3 = 1 THEN 'CC BY-SA 4.0' ELSE 'CC BY-NC 4.0' END AS licence FROM documents",
    "txt_page_url": r"""WITH a AS (SELECT DISTINCT article_id, article_id % 6 AS p, CASE WHEN article_id % 5 = 0 THEN title ELSE 'Set: ' || title END AS title, CASE WHEN article_id % 7 = 0 THEN url_title || ' 50%? #1' WHEN article_id % 11 = 0 THEN '__unknown__/x' ELSE url_title END AS u FROM articles),
e AS (SELECT *, replace(replace(replace(replace(u, '%', '%25'), ' ', '_'), '?', '%3F'), '#', '%23') AS t FROM a)
SELECT DISTINCT article_id, CASE WHEN coalesce(u, '') = '' OR contains(u, '__unknown__') THEN NULL WHEN starts_with(u, 'https://') OR starts_with(u, 'http://') THEN u WHEN p = 0 THEN 'https://en.wikipedia.org/wiki/' || t WHEN p = 1 THEN 'https://en.wiktionary.org/wiki/' || t WHEN p = 2 THEN 'https://medlineplus.gov/' || t || '.html'
  WHEN p = 3 AND contains(title, ': ') THEN 'https://devdocs.io/' || lower(split_part(title, ': ', 1)) || '/' || t WHEN p = 5 THEN 'https://' || t END AS url FROM e""",
    "txt_url_page": "SELECT DISTINCT article_id, 'wikipedia' AS pack, replace(url_title, '_', ' ') AS title FROM articles WHERE regexp_full_match(url_title, '[A-Za-z_()]+')",
    "txt_coordinates": "SELECT s_suppkey, printf('%.4f°%s, %.4f°%s', abs(s_suppkey % 180 - 90)::DOUBLE, CASE WHEN s_suppkey % 180 >= 90 THEN 'N' ELSE 'S' END, abs(s_suppkey % 360 - 180)::DOUBLE, CASE WHEN s_suppkey % 360 >= 180 THEN 'E' ELSE 'W' END) AS at FROM supplier",
    "txt_content_id": "SELECT doc_id, 'doc-' || substr(sha256(title || chr(0) || replace(text, chr(12), chr(0))), 1, 10) AS content_id FROM documents WHERE text IS NOT NULL AND title IS NOT NULL",
    "txt_normalize_answer": r"SELECT DISTINCT id, ' ' || " + _SQ.format(c=r"regexp_replace(lower(query), '[^\p{L}\p{N}_\s]', ' ', 'g')") + " || ' ' AS answer FROM eval_req WHERE query IS NOT NULL",
    "txt_search_query": r"SELECT DISTINCT record_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(query, '[^\p{L}\p{N}]', ' ', 'g'), '\s+'), lambda w: w NOT IN ('', 'AND', 'OR', 'NOT')), ' ') AS cleaned FROM query_record WHERE query IS NOT NULL",
    "txt_rerank_text": "SELECT doc_id, md5(CASE WHEN coalesce(section_path, '') = '' THEN title || ': ' || text ELSE title || ' — ' || section_path || ': ' || text END) AS md5 FROM documents WHERE text IS NOT NULL AND title IS NOT NULL",
    "txt_snippet": "SELECT doc_id, md5(substr(text, 1, 160)) AS md5 FROM documents WHERE text IS NOT NULL",
    "txt_tidy": "SELECT DISTINCT id, 'plan' AS thinking, 'x ' || coalesce(query, '') || ' It is so.' AS answer FROM eval_req",
    "txt_fact_line": "SELECT DISTINCT fact_id, coalesce(qid, '') || ' — ' || coalesce(pid, '') || ': ' || value_text || coalesce(' (' || point_in_time || ')', '') AS line FROM facts WHERE value_text IS NOT NULL",
    "txt_numbers": f"SELECT doc_id, len({_NUM})::BIGINT AS n, md5(array_to_string({_NUM}, '|')) AS numbers_md5 FROM documents WHERE text IS NOT NULL",
    "fmt_ordinal": f"SELECT n_nationkey, {_ORD.format(n='n_nationkey + 1')} AS ord, {_ORD.format(n='n_nationkey + 101')} AS ord100 FROM nation",
    "fmt_time": f"""SELECT o_orderkey, {_ORD.format(n='(year(o_orderdate) - 1) // 100 + 1')} || ' century' AS p7, (year(o_orderdate) // 10 * 10)::VARCHAR || 's' AS p8, year(o_orderdate)::VARCHAR AS p9,
  monthname(o_orderdate) || ' ' || year(o_orderdate)::VARCHAR AS p10, day(o_orderdate)::VARCHAR || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate)::VARCHAR AS p11, {_ORD.format(n='(o_orderkey % 900) // 100 + 1')} || ' century BC' AS bc FROM orders""",
    "text_hash_groups": "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}
