"""Readers of the source formats, each to (key, title, text, …) or to the rows of its table. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from kernwerk.functions.text import strip_html, word_count

CHUNK_SITES_MIN_AUTHORS = 5


def page_articles(df: DataFrame) -> DataFrame:
    """Encyclopedia pages in Parquet (title, text, url, wikidata_id, infoboxes, bytes_html): popularity is the size in KB, the URL's end the slug."""
    return df.select("title", "text", F.substring_index("url", "/", -1).alias("url_title"), F.col("wikidata_id").alias("qid"), F.floor(F.col("bytes_html") / 1000).cast("long").alias("popularity"), "infoboxes")


def infobox_lines(c: Column) -> Column:
    """Up to thirty "key: value" lines of the first infobox of a JSON array; null where there is none."""
    data = F.from_json(c, "array<struct<data: map<string, string>>>")
    pairs = F.filter(F.map_entries(F.get(data, F.lit(0))["data"]), lambda e: (F.trim(e["value"]) != "") & (F.length(e["value"]) < 300))
    return F.nullif(F.array_join(F.slice(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), 1, 30), "\n"), F.lit(""))


def views(titles: DataFrame, pageviews: DataFrame) -> DataFrame:
    """(title, views): monthly views summed by the underscored lower-case title; 0 where there are none."""
    key = F.lower(F.translate("title", " ", "_"))
    needed = titles.select("title", key.alias("k"))
    got = pageviews.select(F.lower("title").alias("k"), "views").join(needed.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.sum("views").alias("views"))
    return needed.join(got, "k", "left").select("title", F.coalesce("views", F.lit(0)).alias("views"))


DISAMBIGUATION = r"(?i)\{\{\s*(?:disambiguation|disambig|dab|hndis|geodis|set index)"


def wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, redirect, text, revision) of namespace 0 of an XML dump; disambiguation pages and the main page are dropped."""
    schema = "title STRING, ns INT, id LONG, redirect STRUCT<_title: STRING>, revision STRUCT<id: LONG, text: STRING>"
    p = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).where("ns = 0")
    rows = p.select(F.col("id").alias("page_id"), "title", F.substring_index("redirect._title", "#", 1).alias("redirect"), F.col("revision.text").alias("text"), F.col("revision.id").alias("revision"))
    ends = F.concat(F.substring("text", 1, 3000), F.lit("\n"), F.substring("text", -3000, 3000))
    listed = F.coalesce(ends.rlike(DISAMBIGUATION), F.lit(False)) & F.col("redirect").isNull()
    return rows.where((F.col("title") != "Main Page") & ~F.col("title").contains("(disambiguation)") & ~listed)


def page_props(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, qid) from the INSERT lines of an SQL dump."""
    found = F.regexp_extract_all("value", F.lit(r"\((\d+,'wikibase_item','Q\d+)'"), 1)
    row = spark.read.text(path).select(F.explode(found).alias("x"))
    return row.select(F.substring_index("x", ",", 1).cast("long").alias("page_id"), F.substring_index("x", "'", -1).alias("qid"))


def build_wiki(pages: DataFrame, props: DataFrame, pageviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, redirects): pages with QID and views, and redirects whose target is an article."""
    own = pages.where("redirect is null")
    articles = own.join(props, "page_id", "left").join(views(own.select("title"), pageviews), "title", "left")
    redirects = pages.where("redirect is not null").select(F.col("title").alias("from_title"), F.col("redirect").alias("title")).join(own.select("title", "page_id"), "title").select("from_title", "page_id")
    return articles, redirects


def forum_threads(df: DataFrame, min_authors: dict[str, int] | None = None) -> DataFrame:
    """Threads (site, url, text, popularity) under a Creative Commons licence with enough authors; short and "@" segments dropped."""
    least = F.lit(CHUNK_SITES_MIN_AUTHORS)
    for site, n in (min_authors or {}).items():
        least = F.when(F.col("metadata.site") == site, n).otherwise(least)
    authors = F.size(F.array_distinct(F.filter("metadata.authors", lambda a: a.contains("/users/"))))
    parts = F.filter(F.split("text", r"\n\s*\n"), lambda s: (F.length(s) >= 40) & ~s.startswith("@"))
    kept = df.where(F.col("metadata.license").startswith("Creative Commons") & (authors >= least))
    return kept.select(F.col("metadata.site").alias("site"), F.col("metadata.url").alias("url"), authors.alias("popularity"), F.array_join(F.slice(parts, 1, 5), "\n\n").alias("text"))


FORUM_SCHEMA = "text STRING, metadata STRUCT<site: STRING, authors: ARRAY<STRING>, license: STRING, url: STRING>"


def abstracts(df: DataFrame) -> DataFrame:
    """Paper abstracts (id, title, text, year): long author lists are cut at a comma, and the author line ends the text."""
    authors = F.when(F.length("authors") > 200, F.concat(F.regexp_extract(F.substring("authors", 1, 200), r"^(.*),", 1), F.lit(" et al."))).otherwise(F.col("authors"))
    year = F.element_at(F.split(F.try_element_at("versions", F.lit(1))["created"], r"\s+"), 4)
    return df.where("abstract is not null").select("id", F.regexp_replace("title", r"\s+", " ").alias("title"), F.concat(F.trim("abstract"), F.lit("\n\nAuthors: "), authors, F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit(""))).alias("text"), year.alias("year"))


def health_topics(spark: SparkSession, path: str) -> DataFrame:
    """English health topics (title, url, text, groups) from XML; the institute's credit line at the end is dropped."""
    schema = "_title STRING, _url STRING, _language STRING, `full-summary` STRING, `also-called` ARRAY<STRING>, `group` ARRAY<STRUCT<_VALUE: STRING>>"
    t = spark.read.format("xml").option("rowTag", "health-topic").schema(schema).load(path).where("_language = 'English'")
    body = strip_html(F.col("full-summary"))
    last = F.element_at(F.split(body, "\n\n"), -1)
    body = F.when((word_count(last) < 15) & last.rlike("(?i)institute|center|NIH"), F.regexp_replace(body, r"\n\n[^\n]*$", "")).otherwise(body)
    also = F.when(F.size("also-called") > 0, F.concat(F.lit("Also called: "), F.array_join("also-called", ", "), F.lit("\n\n"))).otherwise("")
    return t.select(F.col("_title").alias("title"), F.col("_url").alias("url"), F.concat(also, body).alias("text"), F.array_join(F.transform("group", lambda g: g["_VALUE"]), "; ").alias("groups"))


BOOK_SCHEMA = "id STRING, source STRING, text STRING, metadata STRUCT<title: STRING, author: STRING, institution: STRING, license: STRING, book_url: STRING>"
SKIPPED_CHAPTERS = r"(?i)\b(index|glossary|answer key|acknowledg|about the author|front matter|back matter|table of contents|references|bibliography|copyright|licens)"


def textbook_chapters(df: DataFrame, least: int = 80) -> DataFrame:
    """Chapters (host, book, title, text) of at least ``least`` words that are prose."""
    head = F.trim(F.substring_index(F.trim("text"), "\n", 1))
    press = F.col("source") == "pressbooks"
    path = F.parse_url("id", F.lit("PATH"))
    book = F.when(press, F.col("metadata.title")).otherwise(F.url_decode(F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), 1)))
    title = F.when(press, head).otherwise(F.coalesce("metadata.title", head))
    rows = df.select(F.parse_url("id", F.lit("HOST")).alias("host"), book.alias("book"), F.substring(title, 1, 300).alias("title"), "text", "metadata")
    return rows.where(~F.col("title").rlike(SKIPPED_CHAPTERS) & (word_count(F.col("text")) >= least))


WORD_SCHEMA = "word STRING, pos STRING, lang_code STRING, senses ARRAY<STRUCT<glosses: ARRAY<STRING>, tags: ARRAY<STRING>>>, sounds ARRAY<STRUCT<ipa: STRING>>, etymology_text STRING, translations ARRAY<STRUCT<lang: STRING>>"


def dictionary_entries(df: DataFrame, senses: int = 8) -> DataFrame:
    """One article per English word (title, text, popularity): parts of speech with their first senses, sound and origin; never linkable.

    The lines of a word may lie apart: they are brought together by the word, in file order.
    """
    gloss = F.slice(F.filter(F.transform("senses", lambda s: F.try_element_at(s["glosses"], F.lit(-1))), lambda g: g.isNotNull()), 1, senses)
    ipa = F.get(F.filter(F.transform("sounds", lambda s: s["ipa"]), lambda x: x.isNotNull()), F.lit(0))
    line = F.concat_ws("\n", F.concat("pos", F.coalesce(F.concat(F.lit(" "), ipa), F.lit(""))), F.array_join(F.transform(gloss, lambda g, i: F.concat((i + 1).cast("string"), F.lit(". "), g)), "\n"))
    rows = df.where((F.col("lang_code") == "en") & (F.size(gloss) > 0)).select("word", F.monotonically_increasing_id().alias("n"), line.alias("t"), F.substring("etymology_text", 1, 600).alias("e"), F.coalesce(F.size("translations"), F.lit(0)).alias("p"))
    got = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("l"), F.min_by("e", F.when(F.col("e").isNotNull(), F.col("n"))).alias("e"), F.sum(F.greatest("p", F.lit(0))).alias("popularity"))
    return got.select(F.col("word").alias("title"), F.concat_ws("\n\n", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n"), F.concat(F.lit("Etymology: "), F.col("e"))).alias("text"), "popularity", F.lit(False).alias("linkable"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, priority) of a two-column TSV; blank and "#" lines are skipped, the order of lines is the priority."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "t")).where("trim(t) <> '' and t not like '#%'")
    return rows.select(F.substring_index("t", "\t", 1).alias("key"), F.when(F.instr("t", "\t") > 0, F.substring_index("t", "\t", -1)).alias("value"), "line").orderBy("line")


def user_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of text files; a form feed ends a page, an empty last page is dropped."""
    t = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    pages = t.select("path", F.posexplode(F.split("value", "\f", -1)).alias("i", "text"), F.size(F.split("value", "\f", -1)).alias("n"))
    return pages.where((F.col("i") < F.col("n") - 1) | (F.trim("text") != "")).select("path", (F.col("i") + 1).alias("page"), "text")


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text) of HTML files."""
    t = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return t.select("path", F.trim(F.regexp_extract("value", r"(?is)<(?:h1|h3|title)[^>]*>([^<]*)<", 1)).alias("title"), strip_html(F.regexp_extract("value", r"(?is)<body[^>]*>(.*)</body>", 1)).alias("text"))


def _book_chapters(doc: str) -> list[dict]:
    """Sections of a recursive chapter tree as {title, text}, in order; learning goals and marks of emphasis are dropped."""
    book = json.loads(doc)
    out: list[dict] = []

    def walk(chapters: list, path: list[str]) -> None:
        for c in chapters or []:
            here = [*path, c.get("title") or ""]
            parts = [c["abstract"]] if c.get("abstract") and not c["abstract"].lstrip().startswith("By the end of this section") else []
            for x in c.get("sections") or []:
                if not re.search(r"(?i)key terms|exercises|review questions|summary|references|further research", x.get("title") or ""):
                    parts.append(x.get("paragraph") or "")
            if any(p.strip() for p in parts):
                out.append({"title": " > ".join(h for h in here if h), "text": re.sub(r"\*\*|__", "", "\n\n".join(p for p in parts if p.strip()))})
            walk(c.get("chapters"), here)

    walk(book.get("chapters"), [book.get("book_title") or ""])
    return out if book.get("language", "en") == "en" else []


def _factbook_lines(doc: str) -> list[dict]:
    """{title, text} for each section of a country's JSON: "Field — sub: value" lines, notes last."""
    out = []
    for section, fields in json.loads(doc).items():
        lines, notes = [], []

        def walk(node, name: str) -> None:
            if not isinstance(node, dict):
                return
            if isinstance(node.get("text"), str) and node["text"].strip():
                lines.append(f"{name}: {node['text'].strip()}")
            for k, v in node.items():
                if k == "note" and isinstance(v, str):
                    notes.append(f"{name} — note: {v.strip()}")
                elif k != "text":
                    walk(v, f"{name} — {k}" if name else k)

        for k, v in fields.items() if isinstance(fields, dict) else ():
            walk(v, k)
        if lines or notes:
            out.append({"title": section, "text": "\n".join(lines + notes)})
    return out


_PARTS = ArrayType(StructType([StructField("title", StringType()), StructField("text", StringType())]))


def _parts(f):
    @F.pandas_udf(_PARTS)
    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([[] if d is None else f(d) for d in docs.tolist()], dtype="object")

    return run


def book_chapters(docs: DataFrame, column: str = "value", licences: DataFrame | None = None) -> DataFrame:
    """(title, text) of the chapters of books given as one JSON text each; their trees may be of any depth. With ``licences`` (book, licence),
    books, named by the column ``book`` of ``docs``, under a non-commercial licence are left out."""
    if licences is not None:
        closed = licences.where(F.lower("licence").rlike(r"\bnc\b|by-nc|non-?commercial")).select("book")
        docs = docs.join(closed, "book", "left_anti")
    return docs.select(F.explode(_parts(_book_chapters)(F.col(column))).alias("p")).select("p.title", "p.text")


def factbook(docs: DataFrame, column: str = "value") -> DataFrame:
    """(title, text, linkable) of the sections of country files given as one JSON text each; never linkable."""
    return docs.select(F.explode(_parts(_factbook_lines)(F.col(column))).alias("p")).select("p.title", "p.text", F.lit(False).alias("linkable"))


def archive_pages(pages: DataFrame, excluded: str = r"^(Category|Template|File|User|Talk|Special|Help):", least: int = 40) -> DataFrame:
    """(title, text, popularity) of an archive's entries (path, title, mimetype, redirect, content): HTML articles of enough words as markdown."""
    from kernwerk.functions.markup import html_to_markdown

    @F.pandas_udf(StringType())
    def markdown(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else html_to_markdown(h) for h in html.tolist()], dtype="object")

    rows = pages.where(F.col("redirect").isNull() & F.col("mimetype").startswith("text/html") & ~F.col("title").rlike(excluded))
    done = rows.select("title", markdown("content").alias("text"), F.floor(F.length("content") / 1000).cast("long").alias("popularity"))
    return done.where(word_count(F.col("text")) >= least)


_LISTING = re.compile(r"(?s)\{\{\s*(see|do|eat|drink|buy|sleep|listing|go)\s*\|(.*?)\}\}")


def _listings(text: str) -> str:
    """Listing templates of travel guides as "- name: content (price, hours)" items."""

    def show(m: re.Match) -> str:
        args = {k.strip(): v.strip() for k, _, v in (a.partition("=") for a in m[2].split("|"))}
        extra = ", ".join(args[k] for k in ("address", "price", "hours") if args.get(k))
        return "* " + args.get("name", "") + (f": {args['content']}" if args.get("content") else "") + (f" ({extra})" if extra else "")

    return _LISTING.sub(show, text)


def guide_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, popularity) of travel guide pages: listings as items, wikitext as markdown."""
    from kernwerk.functions.markup import wikitext_to_markdown

    @F.pandas_udf(StringType())
    def markdown(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else wikitext_to_markdown(_listings(t)) for t in texts.tolist()], dtype="object")

    return pages.where("redirect is null").select("page_id", "title", markdown("text").alias("text"), F.floor(F.length("text") / 1000).cast("long").alias("popularity"))


CLAIM_SCHEMA = "id STRING, property STRING, datatype STRING, rank STRING, datavalue STRUCT<id: STRING, string: STRING, text: STRING, language: STRING, amount: STRING, unit: STRING, time: STRING, precision: LONG, latitude: DOUBLE, longitude: DOUBLE>, qualifiers ARRAY<STRUCT<property: STRING, value: ARRAY<STRUCT<time: STRING>>>>"


def flatten_claims(claims: DataFrame, keep: list[str], *extra: str) -> DataFrame:
    """Statements of kept properties that are not deprecated, flat; ``pit`` is the first point-in-time qualifier, ``has_end`` whether an end is given."""
    q = lambda p: F.get(F.filter("qualifiers", lambda x: x["property"] == p), F.lit(0))
    rows = claims.where(F.col("property").isin(keep) & (F.col("rank") != "deprecated"))
    v = F.col("datavalue")
    return rows.select(
        F.col("id").alias("qid"), F.col("property").alias("pid"), "datatype", F.when(F.col("rank") == "preferred", 2).otherwise(1).alias("rank"), v["id"].alias("vid"), v["string"].alias("vstr"), v["text"].alias("text"), v["language"].alias("language"),
        v["amount"].try_cast("double").alias("amount"), F.regexp_extract(v["unit"], r"Q\d+$", 0).alias("unit"), v["time"].alias("time"), v["precision"].alias("prec"), v["latitude"].alias("lat"), v["longitude"].alias("lon"),
        F.get(q("P585")["value"], F.lit(0))["time"].alias("pit"), q("P582").isNotNull().alias("has_end"), *extra,
    )


def numbered_claims(claims: DataFrame, keep: list[str]) -> DataFrame:
    """``flatten_claims`` with ``ord``: the place of a statement in its file, so that rows of one group keep the file's order."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return flatten_claims(claims.withColumn("_ord", at), keep, "_ord").withColumnRenamed("_ord", "ord")


def revisions(pages: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """(page_id, revision) of the latest revision of each page; of ``absent`` page ids there are none."""
    rows = pages.where(F.col("revision").isNotNull()).groupBy("page_id").agg(F.max("revision").alias("revision"))
    return rows if absent is None else rows.join(absent.select("page_id"), "page_id", "left_anti")


def picked(rows: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """The rows of a test set with one of some ids or categories; all rows if neither is given."""
    wanted = [F.col(c).isin(v) for c, v in (("id", ids), ("category", categories)) if v]
    return rows.where(reduce(lambda a, b: a | b, wanted)) if wanted else rows


def jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines, plain or gzip; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def cards(c: Column) -> Column:
    """array<struct<text, ids>> of lines "text<TAB>1,2"; bad ids are skipped."""
    rows = F.filter(F.split(c, "\n"), lambda x: x != "")
    return F.transform(rows, lambda x: F.struct(F.substring_index(x, "\t", 1).alias("text"), F.filter(F.transform(F.split(F.substring_index(x, "\t", -1), ","), lambda i: i.try_cast("long")), lambda i: i.isNotNull()).alias("ids")))


def encode_cards(facts: Column) -> Column:
    flat = lambda t: F.regexp_replace(t, r"[\t\n]", " ")
    return F.array_join(F.transform(facts, lambda f: F.concat(flat(f["text"]), F.lit("\t"), F.array_join(f["ids"].cast("array<string>"), ","))), "\n")
