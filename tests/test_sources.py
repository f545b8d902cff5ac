import gzip
import json

import pytest
from pyspark.sql import functions as F

from kernwerk.operators import passages as P
from kernwerk.sources import packs as K
from kernwerk.sources import readers as R
from kernwerk.streaming import telemetry as T


def test_jsonl_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "x" * 50 + "\n\nshort\n\n@me " + "y" * 50, "metadata": {"site": "s", "authors": [f"https://s/users/{i}" for i in range(5)], "license": "Creative Commons - BY", "url": "u"}}) + "\n\nbroken\n")
        f.write(json.dumps({"text": "z" * 50, "metadata": {"site": "s", "authors": ["https://s/users/1"], "license": "Creative Commons", "url": "v"}}) + "\n")
    got = R.forum_threads(R.jsonl(spark, str(tmp_path / "a.jsonl.gz"), R.FORUM_SCHEMA)).collect()
    assert [(r.url, r.popularity, r.text) for r in got] == [("u", 5, "x" * 50)]
    assert R.forum_threads(R.jsonl(spark, str(tmp_path / "a.jsonl.gz"), R.FORUM_SCHEMA), {"s": 1}).count() == 2


def test_dictionary_and_books(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text("\n".join(json.dumps(x) for x in [{"word": "cat", "pos": "noun", "lang_code": "en", "senses": [{"glosses": ["animal"]}], "sounds": [{"ipa": "/kat/"}], "etymology_text": "old", "translations": [{"lang": "de"}]}, {"word": "dog", "pos": "noun", "lang_code": "en", "senses": []}, {"word": "cat", "pos": "verb", "lang_code": "en", "senses": [{"glosses": ["to hoist"]}]}]))
    (r,) = R.dictionary_entries(R.jsonl(spark, str(tmp_path / "w.jsonl"), R.WORD_SCHEMA)).collect()
    assert r.title == "cat" and r.text.startswith("noun /kat/\n1. animal") and r.text.endswith("Etymology: old") and r.popularity == 1 and not r.linkable
    rows = [{"id": "https://h.org/bk/ch1", "source": "pressbooks", "text": "Title A\n" + "w " * 90, "metadata": {"title": "Book"}}, {"id": "https://h.org/bk/ch2", "source": "pressbooks", "text": "Glossary\n" + "w " * 90, "metadata": {"title": "Book"}}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [(r.host, r.book, r.title) for r in R.textbook_chapters(R.jsonl(spark, str(tmp_path / "b.jsonl"), R.BOOK_SCHEMA)).collect()] == [("h.org", "Book", "Title A")]


def test_wiki_xml(spark, tmp_path):
    page = lambda i, t, body, extra="": f"<page><title>{t}</title><ns>0</ns><id>{i}</id>{extra}<revision><id>9</id><text>{body}</text></revision></page>"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page(1, "A", "text") + page(2, "B", "", '<redirect title="A#x"/>') + page(3, "C", "{{disambig}}") + page(4, "Main Page", "x") + "</mediawiki>")
    (tmp_path / "p.sql").write_text("INSERT INTO page_props VALUES (1,'wikibase_item','Q5',NULL),(2,'x','y',NULL);")
    pages = R.wiki_xml(spark, str(tmp_path / "d.xml"))
    props = R.page_props(spark, str(tmp_path / "p.sql"))
    assert [tuple(r) for r in props.collect()] == [(1, "Q5")]
    views = spark.createDataFrame([("a", 3), ("A", 4)], "title string, views long")
    articles, redirects = R.build_wiki(pages, props, views)
    assert [(r.title, r.qid, r.views) for r in articles.collect()] == [("A", "Q5", 7)]
    assert [tuple(r) for r in redirects.collect()] == [("B", 1)]


def test_small_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# c\nP1\tone\n\nP2\ttwo\n")
    assert [(r.key, r.value) for r in R.settings(spark, str(tmp_path / "c.tsv")).collect()] == [("P1", "one"), ("P2", "two")]
    (tmp_path / "u.txt").write_text("one\ftwo\f ")
    assert [(r.page, r.text) for r in R.user_documents(spark, str(tmp_path / "u.txt")).orderBy("page").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "h.html").write_text("<html><head><title>T</title></head><body><p>a</p></body></html>")
    (r,) = R.html_pages(spark, str(tmp_path / "h.html")).collect()
    assert (r.title, r.text) == ("T", "a")
    (tmp_path / "t.xml").write_text('<x><health-topic title="Flu" url="u" language="English"><full-summary>&lt;p&gt;Long text here.&lt;/p&gt;&lt;p&gt;NIH: National Institute&lt;/p&gt;</full-summary><also-called>Grippe</also-called><group>Lungs</group></health-topic></x>')
    (r,) = R.health_topics(spark, str(tmp_path / "t.xml")).collect()
    assert r.text == "Also called: Grippe\n\nLong text here." and r.groups == "Lungs"


def test_claims(spark):
    rows = [("Q1", "P1", "time", "normal", None, [("P585", [("+2001",)]), ("P582", [("+2002",)])]), ("Q1", "P2", "time", "deprecated", None, None), ("Q2", "P1", "time", "preferred", None, None)]
    got = {r.qid: r for r in R.flatten_claims(spark.createDataFrame(rows, R.CLAIM_SCHEMA), ["P1", "P2"]).collect()}
    assert got["Q1"].pit == "+2001" and got["Q1"].has_end and got["Q2"].rank == 2 and not got["Q2"].has_end


def test_pack_round_trip(spark, tmp_path):
    arts = spark.createDataFrame([(10, "A b", "Q1", 5, "A_b"), (20, "C", None, -3, None), (30, "empty", None, 1, None)], "key long, title string, qid string, popularity long, url_title string")
    rows = spark.createDataFrame([(10, 0, "", "x"), (10, 1, "S", "y"), (20, 0, "", "z")], "key long, ordinal int, section string, text string")
    a, p = P.pack_tables(arts, rows)
    assert [tuple(r)[:1] + (r.first_passage, r.n_passages, r.popularity) for r in a.orderBy("article_id").collect()] == [(0, 0, 2, 5), (1, 2, 1, 0)]
    assert K.violations(a, p).count() == 0
    assert K.violations(a, p.where("passage_id <> 1")).count() >= 2
    pack = str(tmp_path / "packs" / "demo")
    K.write_table(a, pack, "articles", ["article_id"])
    K.write_table(p, pack, "passages", ["passage_id"])
    with pytest.raises(ValueError):
        K.write_table(p, pack, "nonsense")
    K.write_manifest(spark, pack, pack_id="demo", build_date="2026-01-01", snapshot_date="2026-01-01", license="CC0", embedder=None, counts={"articles": 2, "passages": 3})
    assert K.verify(spark, pack).count() == 0
    parts = K.bundle(pack, str(tmp_path / "demo"), 4096)
    assert len(parts) > 1
    (tmp_path / "lib").mkdir()
    home = K.install(spark, parts, str(tmp_path / "lib"))
    assert K.read_table(spark, home, "passages").count() == 3
    with pytest.raises(ValueError):
        K.install(spark, [{**parts[0], "sha256": "0"}], str(tmp_path / "lib"))
    sub_a, sub_p = P.subset(a, p, 1)
    assert sub_a.count() == 1 and sub_p.count() == 2


def test_library(spark):
    packs = spark.createDataFrame([("a", "knowledge", "e1", []), ("b", "knowledge", "e1", ["a"]), ("c", "knowledge", "e2", []), ("d", "user", "e2", [])], "pack_id string, pack_type string, embedder string, replaces array<string>")
    assert sorted(r.pack_id for r in K.usable_packs(packs, []).collect()) == ["b", "d"]
    assert sorted(r.pack_id for r in K.usable_packs(packs, ["b"]).collect()) == ["a", "d"]
    cat = spark.createDataFrame([("a", "2", True), ("z", "1", False)], "pack_id string, build_date string, recommended boolean")
    old = spark.createDataFrame([("a", "1", False), ("b", "1", True)], "pack_id string, build_date string, recommended boolean")
    merged = K.merge_catalogs(cat, old)
    assert [r.pack_id for r in merged.collect()] == ["a", "b", "z"]
    assert [r.pack_id for r in K.updates(merged, old).collect()] == ["a"]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [{"record_id": i, "ts": f"2024-01-01T0{i % 5}:00:00", "query": f"q{i}", "search_query": "s", "intent": "x", "total_ms": 1.0 * i} for i in range(10)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows + rows[:2])))
    q = T.append_jsonl(T.without_text(T.read_records(spark, str(src))), str(out), str(tmp_path / "cp1"))
    q.awaitTermination(60)
    assert spark.read.json(str(out)).where("query = ''").count() == 12
    w = T.windowed(T.read_records(spark, str(src))).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    w.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 10
    r = T.recent(T.read_records(spark, str(src)), 3).writeStream.format("memory").queryName("r").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    r.awaitTermination(60)
    assert {x.query for x in spark.table("r").collect()} == {"q9", "q4", "q8"} or spark.table("r").count() == 3
    for _ in range(2):
        run = T.run_resumable(T.read_records(spark, str(src)).select(F.col("record_id").alias("id"), "query"), str(tmp_path / "done"), str(tmp_path / f"cp4{_}"), lambda df: df.select("id", F.upper("query").alias("answer")))
        run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "done")).count() == 10


def test_sessions_and_dense_ids(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:10:00", "a"), (3, "2024-01-01 02:00:00", "a")], "record_id long, ts string, intent string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in T.sessions(e).collect()) == [1, 2]
    d = P.dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "i")
    assert d.where("k = i").count() == 1000


def test_trees_archives_and_guides(spark):
    book = {"book_title": "B", "language": "en", "chapters": [{"title": "C", "abstract": "By the end of this section you can", "sections": [{"title": "Key terms", "paragraph": "x"}, {"title": "s", "paragraph": "**Hi** there"}], "chapters": [{"title": "D", "sections": [{"title": "t", "paragraph": "deep"}]}]}]}
    df = spark.createDataFrame([(json.dumps(book),), (json.dumps({**book, "language": "pl"}),), (None,)], "value string")
    assert [tuple(r) for r in R.book_chapters(df).collect()] == [("B > C", "Hi there"), ("B > C > D", "deep")]
    fact = {"Geography": {"Area": {"total": {"text": "5 km"}, "note": "approx"}, "Empty": {}}}
    assert [(r.title, r.text) for r in R.factbook(spark.createDataFrame([(json.dumps(fact),)], "value string")).collect()] == [("Geography", "Area — total: 5 km\nArea — note: approx")]
    pages = spark.createDataFrame([("p", "A", "text/html", None, "<h2>T</h2><p>" + "w " * 50 + "</p>"), ("q", "B", "text/html", "p", "x"), ("r", "File:C", "text/html", None, "x"), ("s", "D", "text/html", None, "short")], "path string, title string, mimetype string, redirect string, content string")
    assert [r.title for r in R.archive_pages(pages).collect()] == ["A"]
    guide = spark.createDataFrame([(1, "Town", "== See ==\n{{see|name=Tower|price=5|content=Old.}}", None)], "page_id long, title string, text string, redirect string")
    (r,) = R.guide_pages(guide).collect()
    assert "- Tower: Old. (5)" in r.text


def test_small_readers(spark, tmp_path):
    import json

    from kernwerk.sources import readers as R

    claim = lambda i, p, rank: {"id": f"Q{i}", "property": p, "datatype": "string", "rank": rank, "datavalue": {"string": f"v{i}"}}
    path = tmp_path / "claims.parquet"
    spark.createDataFrame([json.dumps(claim(i, "P1" if i % 2 else "P2", "deprecated" if i == 5 else "normal")) for i in range(8)], "string").select(F.from_json("value", R.CLAIM_SCHEMA).alias("c")).select("c.*").coalesce(1).write.parquet(str(path))
    got = R.numbered_claims(spark.read.parquet(str(path)), ["P1"]).orderBy("ord").collect()
    assert [r.qid for r in got] == ["Q1", "Q3", "Q7"] and [r.ord.row for r in got] == [1, 3, 7]
    pages = spark.createDataFrame([(1, 10), (1, 12), (2, None), (3, 7)], "page_id long, revision long")
    assert {tuple(r) for r in R.revisions(pages, spark.createDataFrame([(3,)], "page_id long")).collect()} == {(1, 12)}
    tests = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "id string, category string")
    assert {r.id for r in R.picked(tests, ["a"], ["y"]).collect()} == {"a", "b"} and R.picked(tests).count() == 3
    book = json.dumps({"title": "T", "chapters": []})
    docs = spark.createDataFrame([("b1", book), ("b2", book)], "book string, value string")
    assert R.book_chapters(docs, licences=spark.createDataFrame([("b1", "CC BY-NC-SA 4.0"), ("b2", "CC BY 4.0")], "book string, licence string")).columns == ["title", "text"]


def test_pruned_log(spark):
    import datetime as dt

    from kernwerk.streaming import telemetry as T

    rows = [(i, dt.datetime(2024, 1, 1 + i // 10, i % 10)) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, ts timestamp")
    sizes = {r.i: r.n for r in df.select("i", (F.octet_length(F.to_json(F.struct("i", "ts"))) + 1).alias("n")).collect()}
    want, used = set(), 0
    for i in range(49, -1, -1):
        used += sizes[i]
        if used > 700:
            break
        want.add(i)
    assert {r.i for r in T.pruned(df, 700).collect()} == want and T.pruned(df).count() == 50 and T.pruned(df.limit(0)).count() == 0


def test_dates_as_sql_functions(spark):
    from kernwerk.functions import dates as D

    D.register(spark)
    rows = [("+1952-03-11T00:00:00Z", 11, "11 March 1952"), ("+1952-03-00T00:00:00Z", 11, "March 1952"), ("+1952-03-11T00:00:00Z", 10, "March 1952"), ("+1952-00-00T00:00:00Z", 9, "1952"), ("+1952-00-00T00:00:00Z", 8, "1950s"), ("+1952-00-00T00:00:00Z", 7, "20th century"), ("-0044-03-15T00:00:00Z", 11, "15 March 44 BC"), ("-0044-00-00T00:00:00Z", 7, "1st century BC"), ("-0044-00-00T00:00:00Z", 8, "44 BC"), ("x", 11, None), (None, 9, None)]
    df = spark.createDataFrame(rows, "t string, p int, want string")
    bad = df.select("t", "p", "want", D.time_text(F.col("t"), F.col("p")).alias("a"), F.expr("kw_time_text(t, p)").alias("b")).collect()
    assert [(r.t, r.p, r.a, r.b) for r in bad if not r.want == r.a == r.b] == []
    assert spark.sql("SELECT kw_time_year('-0044-03-15T') AS y, kw_time_month('+1-02-03T') AS m, kw_time_day('+1-02-03T') AS d").first() == (-44, 2, 3)
