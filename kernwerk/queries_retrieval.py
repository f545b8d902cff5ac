"""Queries over retrieval: BM25, codes, inverted lists, fusion and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from kernwerk.functions import text as T
from kernwerk.operators import blocksearch as BS
from kernwerk.operators import dense as D
from kernwerk.operators import fusion as FU
from kernwerk.operators import sparse as S
from kernwerk.queries_text import micro
from kernwerk.session import cut_lineage, table

FIELDS = {"title": "title", "section": "section_path", "body": "text"}


def _passages(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "title", "section_path", "text")


def _asked(spark, d):
    return table(spark, d, "robust").where("trim(query) <> ''").select(F.col("id").alias("query_id"), "query").distinct()


def bm25_postings(spark, d):
    p = S.postings(_passages(spark, d), FIELDS)
    return p.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_field_stats(spark, d):
    return S.field_stats(_passages(spark, d), FIELDS).select("field", "n", micro(F.col("avg_len")).alias("avg_len_micro"))


_STORED: dict[tuple[str, str], S.Index] = {}


def stored_index(spark, d) -> S.Index:
    """The index of the documents of a data directory: written on the first question of an application, read by all."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = S.store(_passages(spark, d), FIELDS)
    return _STORED[key]


def bm25_topk(spark, d):
    i = stored_index(spark, d)
    return S.bm25(i.postings, i.stats, _asked(spark, d), 200)


def term_rarity(spark, d):
    p = _passages(spark, d)
    return S.rarity(S.postings(p, FIELDS), p).select("term", "df", micro(F.col("rarity")).alias("rarity_micro"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def dense_exact_topk(spark, d):
    q, r = _vectors(spark, d)
    return BS.block_top_k(q, r, 10, BS.dot)


def dense_hamming_topk(spark, d):
    q, r = (x.withColumn("vector", D.pack_bits("vector")) for x in _vectors(spark, d))
    return BS.block_top_k(q, r, D.HAMMING_K, BS.minus_hamming)


def dense_asym_topk(spark, d):
    q, r = _vectors(spark, d)
    return BS.block_top_k(q, r.withColumn("vector", D.pack_bits("vector")), D.DENSE_K, BS.asymmetric)


def dense_pack_words(spark, d):
    w = D.pack_words(F.col("embedding"), 64)
    return table(spark, d, "embeddings").select("vec_id", w[0].alias("w0"), w[1].alias("w1"), D.hamming(w, F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))).cast("long").alias("ones"))


def ivf_offsets(spark, d):
    return D.list_offsets(D.list_sizes(table(spark, d, "dense_index")))


def ivf_list_stats(spark, d):
    n = D.list_sizes(table(spark, d, "dense_index"))
    return n.groupBy("index_name").agg(F.count("*").alias("lists"), F.min("n").alias("lo"), F.max("n").alias("hi"), micro(F.percentile("n", F.lit(0.5))).alias("median_micro"))


def ivf_probe_budget(spark, d):
    n = table(spark, d, "dense_index").select("index_name", "passage_id").distinct().groupBy("index_name").agg(F.count("*").alias("codes"))
    info = table(spark, d, "dense_info").dropDuplicates(["index_name"])
    return n.join(info, "index_name").select("index_name", "codes", D.lists_for(F.col("codes"), F.col("n_lists").cast("long"), 300).alias("probe"), D.list_count(F.col("codes")).alias("lists"))


def ivf_probe_topk(spark, d):
    """The two-stage search of all indexes with the module's own limits; the centroids of the index "main" are the query vectors."""
    lists = table(spark, d, "dense_lists")
    queries = lists.where("index_name = 'main'").groupBy(F.col("list_id").cast("long").alias("query_id")).agg(F.min("centroids").alias("vector"))
    return D.probe_topk(queries, table(spark, d, "dense_index"), lists, table(spark, d, "dense_info"))


def ivf_assign(spark, d):
    """The list of each code of every index."""
    return D.assign_lists(table(spark, d, "dense_index"), table(spark, d, "dense_lists"), table(spark, d, "dense_info"))


def _cand(spark, d):
    return table(spark, d, "cand").distinct().where("rrf is not null and not isnan(rrf)")


def rrf_fusion(spark, d):
    return _cand(spark, d).select("cand_id", micro(FU.rrf(F.col("s.rank"), F.col("d.rank"), F.col("e"))).alias("rrf_micro"))


def rrf_with_prior(spark, d):
    a = table(spark, d, "articles").groupBy("article_id").agg(F.max("popularity").alias("popularity"))
    return a.select("article_id", micro(FU.prior(F.col("popularity"))).alias("prior_micro"))


def fusion_context(spark, d):
    c = FU.context(_cand(spark, d))
    return c.select("record_id", "pack", *[F.floor(F.col(f"{x}_{n}") * 1e5 + 0.37).cast("long").alias(f"{x}_{n}") for x in ("s", "d") for n in ("ptop", "mean", "sd", "top", "share")])


def fusion_features(spark, d):
    f = FU.cheap_features(_cand(spark, d), F.lit(7), (F.col("pack") + 1) * 1000, F.col("pack") == 3)
    return f.select("cand_id", *[micro(F.col(f"f_{n}")).alias(n) for n in FU.CHEAP])


def learned_fusion(spark, d):
    f = FU.cheap_features(_cand(spark, d), F.lit(7), (F.col("pack") + 1) * 1000, F.col("pack") == 3)
    cols = [F.col(f"f_{n}") for n in ("rrf", "s_rr60", "d_rr60")]
    return f.select("cand_id", micro(FU.learned_score(cols, [1.0, 2.0, 3.0], [[0.5, 0.1, 0.2]], [0.05], [0.7])).alias("score_micro"))


def global_and_pack_rank(spark, d):
    from pyspark.sql import Window

    c = _cand(spark, d).where("s is not null")
    o = [F.desc("s.score"), F.asc("cand_id")]
    return c.select("cand_id", (F.row_number().over(Window.partitionBy("record_id").orderBy(*o)) - 1).cast("long").alias("rank"), (F.row_number().over(Window.partitionBy("record_id", "pack").orderBy(*o)) - 1).cast("long").alias("prank"))


def _hits(spark, d):
    best = _cand(spark, d).groupBy("record_id", "pack", "passage_id").agg(F.max(micro(F.col("rrf"))).alias("score"))
    return best.withColumn("article", F.floor(F.col("passage_id") / 8))


def fused_pool(spark, d):
    return FU.fused_pool(_hits(spark, d), "score", ["record_id"], ["pack", "article"], ["pack", "passage_id"], keep=FU.FUSE_KEEP).select("record_id", "pack", "passage_id", "pool_rank", micro(F.col("rank_score")).alias("rank_score_micro"))


def select_diverse(spark, d):
    h = _hits(spark, d).withColumn("must", F.col("article") == 3)
    return FU.select_diverse(h, "score", ["record_id"], ["pack", "article"], ["pack", "passage_id"], 8, 3, "must").select("record_id", "pack", "passage_id", "pick_rank")


def near_top(spark, d):
    return FU.near_top(_cand(spark, d), micro(F.col("rrf")), ["record_id"]).select("cand_id")


def merge_pools(spark, d):
    q = table(spark, d, "query_record").where("query <> ''").select("record_id", "query").distinct()
    return FU.merge_pools(_hits(spark, d).join(q, "record_id"), ["query"], ["pack", "passage_id"], "record_id", "score").select("query", "pack", "passage_id", "record_id", "merged_rank")


def rank_blend(spark, d):
    return _hits(spark, d).select("record_id", "pack", "passage_id", micro(FU.rank_blend(["record_id"], [F.desc("score"), F.asc("pack"), F.asc("passage_id")], 0.3)).alias("blend_micro"))


def list_penalty(spark, d):
    t = F.concat(F.when(F.col("article_id") % 5 == 0, "Timeline of ").when(F.col("article_id") % 5 == 1, "1948 in ").otherwise(""), "title")
    return table(spark, d, "articles").select("article_id", FU.list_penalty(t).alias("penalty"), FU.pack_penalty(F.when(F.col("article_id") % 3 == 0, "wikiquote-en").otherwise("wikipedia")).alias("pack_penalty")).distinct()


def _dense_list(spark, d):
    """A dense list for each test question: the two-stage search of the index "main" with one of its centroids, picked by hash, as the vector."""
    place = (F.conv(F.substring(F.md5("query_id"), 1, 4), 16, 10).cast("long") % 64).alias("list_id")
    main = lambda name: table(spark, d, name).where("index_name = 'main'")
    centroids = main("dense_lists").groupBy(F.col("list_id").cast("long").alias("query_id")).agg(F.min("centroids").alias("vector"))
    found = D.probe_topk(centroids, main("dense_index"), main("dense_lists"), main("dense_info")).select(F.col("query_id").alias("list_id"), F.col("passage_id").alias("pid"), "score_micro", "rank")
    return _asked(spark, d).select("query_id", place).join(found, "list_id").select("query_id", "pid", "score_micro", "rank")


def hybrid_search(spark, d):
    """The flagship: BM25 of every test question over all fields and over titles, and a two-stage dense search, fused by reciprocal ranks,
    capped by collection, best eight. The index is stored once; asking reads the buckets of the questions' terms."""
    i = stored_index(spark, d)
    scores = cut_lineage(S.bm25_scores(i.postings, i.stats, _asked(spark, d), {"all": tuple(FIELDS), "title": ("title",)}))  # scored once for both lists
    body, title = S.ranked(scores, "all", 200), S.ranked(scores, "title", 200)
    merged = FU.merge_lists([(body, "sparse"), (title, "titles"), (_dense_list(spark, d), "dense")])
    scored = merged.withColumn("score", micro(FU.reciprocal(F.col("sparse")) + FU.reciprocal(F.col("titles")) + FU.reciprocal(F.col("dense"))))
    hits = scored.join(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.coalesce("collection", F.lit("")).alias("collection")), "pid")
    return FU.fused_pool(hits, "score", ["query_id"], ["collection"], ["pid"], keep=8).select("query_id", "pid", "score", "pool_rank")


QUERIES = {f.__name__: f for f in (hybrid_search, bm25_postings, bm25_field_stats, bm25_topk, term_rarity, dense_exact_topk, dense_hamming_topk, dense_asym_topk, dense_pack_words, ivf_offsets, ivf_list_stats, ivf_probe_budget, ivf_probe_topk, ivf_assign, rrf_fusion, rrf_with_prior, fusion_context, fusion_features, learned_fusion, global_and_pack_rank, fused_pool, select_diverse, near_top, merge_pools, rank_blend, list_penalty)}

_ISTOP = ", ".join(f"'{w}'" for w in S.INDEX_STOP_WORDS)
_AN = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND length(w) <= 40 AND w NOT IN (" + _ISTOP + "))"
_TOKS = " UNION ALL ".join(f"SELECT doc_id AS pid, '{f}' AS field, {_AN.format(c=c)} AS t FROM documents" for f, c in FIELDS.items())
_POST = f"toks AS ({_TOKS}), post AS (SELECT field, term, pid, l, count(*) AS tf FROM (SELECT pid, field, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY ALL), stat AS (SELECT field, count(*) AS n, avg(len(t)) AS avg_len FROM toks GROUP BY field)"


def _bm25(name: str, fields: str, k: int) -> str:
    w = "CASE p.field WHEN 'title' THEN 3.0::DOUBLE WHEN 'section' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""{name} AS (SELECT query_id, pid, score_micro, row_number() OVER (PARTITION BY query_id ORDER BY score_micro DESC, pid) AS rank FROM (
  SELECT q.query_id, p.pid, CAST(floor(sum({w} * ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.l / s.avg_len))) * 1e6 + 0.5) AS BIGINT) AS score_micro
  FROM asked q JOIN post p ON p.term = q.term AND p.field IN ({fields}) JOIN freq f ON f.field = p.field AND f.term = p.term JOIN stat s ON s.field = p.field GROUP BY 1, 2) QUALIFY rank <= {k})"""


_ASKED = f"asked AS (SELECT DISTINCT id AS query_id, unnest(list_distinct({_AN.format(c='query')})) AS term FROM (SELECT DISTINCT id, query FROM robust WHERE trim(query) <> '')), freq AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2)"
_M = "CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"
_C = "c AS (SELECT DISTINCT * FROM cand WHERE rrf IS NOT NULL AND NOT isnan(rrf))"
_RR = "coalesce(1.0::DOUBLE / ({k} + 1 + {r}), 0)"
_RRF = f"({_RR.format(k=60, r='s.rank')} + {_RR.format(k=60, r='d.rank')} + 2 * {_RR.format(k=60, r='e')})"
_EMB = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS w FROM embeddings)"
_TOP = "SELECT query_id, id, score_micro, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_micro DESC, id) AS rank FROM sc) WHERE rank <= {k}"
_CTX = f"""{_C}, p AS (SELECT record_id, pack, max(s.score) AS s_ptop, avg(s.score) AS s_mean, stddev_pop(s.score) AS s_sd, count(*) FILTER (s.rank < 50) AS s_best, max(d.score) AS d_ptop, avg(d.score) AS d_mean, stddev_pop(d.score) AS d_sd, count(*) FILTER (d.rank < 50) AS d_best FROM c GROUP BY 1, 2),
x AS (SELECT *, max(s_ptop) OVER r AS s_top, max(d_ptop) OVER r AS d_top, s_best / greatest(sum(s_best) OVER r, 1)::DOUBLE AS s_share, d_best / greatest(sum(d_best) OVER r, 1)::DOUBLE AS d_share FROM p WINDOW r AS (PARTITION BY record_id))"""
_LR = "ln(1 + coalesce({r}, 1000))"
_RATIO = "(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END)"
_Z = "(CASE WHEN {x}.score IS NULL THEN -3 WHEN {x}_sd > 0 THEN least(5, greatest(-3, ({x}.score - {x}_mean) / {x}_sd)) ELSE 0 END)"
_FEAT = {
    "rrf": f"{_RRF} * 100", "s_in": "(s.rank IS NOT NULL)::INT", "s_rr60": _RR.format(k=60, r="s.rank"), "s_rr5": _RR.format(k=5, r="s.rank"), "s_lr": _LR.format(r="s.rank"), "s_prr5": _RR.format(k=5, r="s.prank"), "s_plr": _LR.format(r="s.prank"),
    "s_pnorm": "coalesce(" + _RATIO.format(a="s.score", b="s_ptop") + ", 0)", "s_gnorm": "coalesce(" + _RATIO.format(a="s.score", b="s_top") + ", 0)", "d_in": "(d.rank IS NOT NULL)::INT", "d_rr60": _RR.format(k=60, r="d.rank"), "d_rr5": _RR.format(k=5, r="d.rank"),
    "d_lr": _LR.format(r="d.rank"), "d_prr5": _RR.format(k=5, r="d.prank"), "d_plr": _LR.format(r="d.prank"), "d_norm": "coalesce(" + _RATIO.format(a="d.score", b="d_top") + ", 0)", "both": "(s.rank IS NOT NULL AND d.rank IS NOT NULL)::INT", "e_in": "(e IS NOT NULL)::INT",
    "e_rr": "coalesce(1.0::DOUBLE / (1 + e), 0)", "kw_only": "(pack = 3)::INT", "s_share": "s_share", "d_share": "d_share", "pack_size": "ln(1 + (pack + 1) * 1000) / ln(10000001)", "s_rr60_share": _RR.format(k=60, r="s.rank") + " * s_share",
    "d_pnorm": "coalesce(" + _RATIO.format(a="d.score", b="d_ptop") + ", 0)", "s_pz": _Z.format(x="s"), "d_pz": _Z.format(x="d"), "s_ptop": "coalesce(" + _RATIO.format(a="s_ptop", b="s_top") + ", 0)", "d_ptop": "coalesce(" + _RATIO.format(a="d_ptop", b="d_top") + ", 0)",
    "q_len": "ln(8)", "s_top": "ln(1 + greatest(coalesce(s_top, 0), 0))", "d_top": "coalesce(d_top, 0)", "s_rr60_qlen": _RR.format(k=60, r="s.rank") + " * ln(8)", "d_rr60_qlen": _RR.format(k=60, r="d.rank") + " * ln(8)",
}
_JOINED = f"WITH {_CTX}, j AS (SELECT c.*, x.* EXCLUDE (record_id, pack) FROM c JOIN x ON c.record_id = x.record_id AND c.pack = x.pack)"
_HITS = f"{_C}, h AS (SELECT record_id, pack, passage_id, max({_M.format(x='rrf')}) AS score, passage_id // 8 AS article FROM c GROUP BY 1, 2, 3)"
_CAPPED = """a AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {t}) AS f FROM {h} QUALIFY f <= {three}),
b AS (SELECT *, row_number() OVER (PARTITION BY {by}, {art} ORDER BY score DESC, {t}) AS n FROM a QUALIFY n <= 4),
z AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {t}) - 1 AS pool_rank FROM b QUALIFY pool_rank < {keep})"""
ORACLE = {
    "bm25_postings": f"WITH {_POST} SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1, 2",
    "bm25_field_stats": f"WITH {_POST} SELECT field, n, {_M.format(x='avg_len')} AS avg_len_micro FROM stat",
    "bm25_topk": f"WITH {_POST}, {_ASKED}, " + _bm25("top", "'title', 'section', 'body'", 200) + " SELECT * FROM top",
    "term_rarity": f"WITH {_POST} SELECT term, count(*) AS df, {_M.format(x='greatest(ln((SELECT count(*) FROM documents) / (1 + count(*))::DOUBLE), 0)')} AS rarity_micro FROM post WHERE field = 'body' GROUP BY 1",
    "dense_exact_topk": f"WITH {_EMB}, sc AS (SELECT query_id, id, {_M.format(x='list_dot_product(v, w)')} AS score_micro FROM q JOIN r ON query_id <> id) {_TOP.format(k=10)}",
    "dense_hamming_topk": f"WITH {_EMB}, sc AS (SELECT query_id, id, -1000000 * len(list_filter(list_zip(v, w), lambda x: (x[1] > 0) <> (x[2] > 0)))::BIGINT AS score_micro FROM q JOIN r ON query_id <> id) {_TOP.format(k=1000)}",
    "dense_asym_topk": f"WITH {_EMB}, sc AS (SELECT query_id, id, {_M.format(x='list_dot_product(v, list_transform(w, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END))')} AS score_micro FROM q JOIN r ON query_id <> id) {_TOP.format(k=200)}",
    "dense_pack_words": "SELECT vec_id, " + ", ".join(f"list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i + {32 * w}] > 0 THEN 1::BIGINT << (32 - i) ELSE 0 END))::BIGINT AS w{w}" for w in (0, 1)) + ", len(list_filter(embedding, lambda x: x > 0))::BIGINT AS ones FROM embeddings",
    "ivf_offsets": "WITH n AS (SELECT index_name, list_id, count(*) AS n FROM (SELECT DISTINCT index_name, passage_id, list_id FROM dense_index WHERE list_id IS NOT NULL) GROUP BY 1, 2) SELECT index_name, list_id, n, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop FROM n WINDOW w AS (PARTITION BY index_name ORDER BY list_id)",
    "ivf_list_stats": f"WITH n AS (SELECT index_name, list_id, count(*) AS n FROM (SELECT DISTINCT index_name, passage_id, list_id FROM dense_index WHERE list_id IS NOT NULL) GROUP BY 1, 2) SELECT index_name, count(*) AS lists, min(n) AS lo, max(n) AS hi, {_M.format(x='quantile_cont(n, 0.5)')} AS median_micro FROM n GROUP BY 1",
    "ivf_probe_budget": "WITH n AS (SELECT index_name, count(DISTINCT passage_id) AS codes FROM dense_index GROUP BY 1) SELECT n.index_name, codes, greatest(1, least(ceil(300.0 * n_lists / codes), 48, n_lists))::BIGINT AS probe, (2 ** least(14, greatest(4, round_even(log2(codes / 1500.0), 0))))::BIGINT AS lists FROM n JOIN (SELECT DISTINCT * FROM dense_info) i ON i.index_name = n.index_name",
    "ivf_probe_topk": f"""WITH i AS (SELECT DISTINCT index_name, dims, n_lists FROM dense_info), l AS (SELECT DISTINCT index_name, list_id, centroids::DOUBLE[] AS c FROM dense_lists JOIN i USING (index_name) WHERE len(centroids) = dims),
s AS (SELECT DISTINCT index_name, passage_id, list_id, codes FROM dense_index JOIN i USING (index_name) SEMI JOIN l USING (index_name, list_id) WHERE octet_length(codes) * 8 = dims AND passage_id IS NOT NULL),
n AS (SELECT index_name, dims, greatest(1, least(ceil(48000.0::DOUBLE * n_lists / count(*)), 48, n_lists)) AS n_probe FROM s JOIN i USING (index_name) GROUP BY index_name, dims, n_lists),
q AS (SELECT list_id::BIGINT AS query_id, n.index_name, n_probe, c[1:dims] AS v FROM l JOIN n ON len(c) >= dims WHERE l.index_name = 'main'),
p AS (SELECT query_id, index_name, list_id, v, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS b FROM q JOIN l USING (index_name) QUALIFY row_number() OVER (PARTITION BY index_name, query_id ORDER BY {_M.format(x='list_dot_product(v, c)')} DESC, list_id) <= n_probe),
h AS (SELECT query_id, index_name, passage_id, list_id, v, codes, bit_count(xor(b, codes::BIT))::BIGINT AS distance FROM p JOIN s USING (index_name, list_id) QUALIFY row_number() OVER (PARTITION BY index_name, query_id ORDER BY distance, list_id, passage_id) <= 1000),
r AS (SELECT * EXCLUDE (v, codes), {_M.format(x="list_dot_product(v, list_transform(string_split(codes::BIT::VARCHAR, ''), lambda x: x::DOUBLE * 2 - 1))")} AS score_micro FROM h)
SELECT *, row_number() OVER (PARTITION BY index_name, query_id ORDER BY score_micro DESC, list_id, passage_id, distance) AS rank FROM r QUALIFY rank <= 200""",
    "ivf_assign": f"""WITH i AS (SELECT index_name, min(dims) AS dims FROM dense_info GROUP BY 1), l AS (SELECT DISTINCT index_name, list_id::BIGINT AS list_id, centroids::DOUBLE[] AS c FROM dense_lists JOIN i USING (index_name) WHERE len(centroids) = dims),
s AS (SELECT DISTINCT index_name, passage_id, codes FROM dense_index JOIN i USING (index_name) WHERE octet_length(codes) * 8 = dims AND passage_id IS NOT NULL)
SELECT index_name, passage_id, list_id, {_M.format(x="list_dot_product(c, list_transform(string_split(codes::BIT::VARCHAR, ''), lambda x: x::DOUBLE * 2 - 1))")} AS score_micro FROM s JOIN l USING (index_name) QUALIFY row_number() OVER (PARTITION BY index_name, passage_id, codes ORDER BY score_micro DESC, list_id) = 1""",
    "rrf_fusion": f"WITH {_C} SELECT cand_id, {_M.format(x=_RRF)} AS rrf_micro FROM c",
    "rrf_with_prior": f"SELECT article_id, {_M.format(x='0.005 * least(ln(1 + max(popularity)) / ln(10000001), 1)')} AS prior_micro FROM articles GROUP BY 1",
    "fusion_context": f"WITH {_CTX} SELECT record_id, pack, " + ", ".join(f"CAST(floor({x}_{n} * 1e5 + 0.37) AS BIGINT) AS {x}_{n}" for x in ("s", "d") for n in ("ptop", "mean", "sd", "top", "share")) + " FROM x",
    "fusion_features": f"{_JOINED} SELECT cand_id, " + ", ".join(f"{_M.format(x=v)} AS {k}" for k, v in _FEAT.items()) + " FROM j",
    "learned_fusion": f"{_JOINED} SELECT cand_id, " + _M.format(x=f"{_FEAT['rrf']} + 2 * {_FEAT['s_rr60']} + 3 * {_FEAT['d_rr60']} + 0.7 * tanh(0.05 + 0.5 * {_FEAT['rrf']} + 0.1 * {_FEAT['s_rr60']} + 0.2 * {_FEAT['d_rr60']})") + " AS score_micro FROM j",
    "global_and_pack_rank": f"WITH {_C} SELECT cand_id, row_number() OVER (PARTITION BY record_id ORDER BY s.score DESC, cand_id) - 1 AS rank, row_number() OVER (PARTITION BY record_id, pack ORDER BY s.score DESC, cand_id) - 1 AS prank FROM c WHERE s IS NOT NULL",
    "fused_pool": f"WITH {_HITS}, " + _CAPPED.format(by="record_id", art="pack, article", t="pack, passage_id", h="h", keep=40, three=120) + f" SELECT record_id, pack, passage_id, pool_rank, {_M.format(x='1.0::DOUBLE / (61 + pool_rank)')} AS rank_score_micro FROM z",
    "select_diverse": f"WITH {_HITS}, a AS (SELECT *, row_number() OVER (PARTITION BY record_id, pack, article ORDER BY score DESC, pack, passage_id) AS n FROM h QUALIFY n <= 3) SELECT record_id, pack, passage_id, row_number() OVER (PARTITION BY record_id ORDER BY (n = 1 AND article = 3) DESC, score DESC, pack, passage_id) AS pick_rank FROM a QUALIFY pick_rank <= 8",
    "near_top": f"WITH {_C} SELECT cand_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY {_M.format(x='rrf')} DESC, pack, passage_id) - 1 AS pos FROM c) WHERE pos < 150 OR coalesce(s.rank < 150, false) OR coalesce(d.rank < 150, false) OR coalesce(s.prank < 10, false) OR coalesce(d.prank < 10, false) OR e IS NOT NULL",
    "merge_pools": f"WITH {_HITS}, j AS (SELECT h.*, q.query FROM h JOIN (SELECT DISTINCT record_id, query FROM query_record WHERE query <> '') q ON q.record_id = h.record_id QUALIFY row_number() OVER (PARTITION BY query, pack, passage_id ORDER BY h.record_id) = 1) SELECT query, pack, passage_id, record_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, pack, passage_id) AS merged_rank FROM j QUALIFY merged_rank <= 80",
    "rank_blend": f"WITH {_HITS} SELECT record_id, pack, passage_id, {_M.format(x='0.3 * (1 - (row_number() OVER (PARTITION BY record_id ORDER BY score DESC, pack, passage_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY record_id))')} AS blend_micro FROM h",
    "list_penalty": "SELECT DISTINCT article_id, CASE WHEN article_id % 5 < 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS penalty, CASE WHEN article_id % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS pack_penalty FROM articles",
}
ORACLE["hybrid_search"] = f"WITH {_POST}, {_ASKED}, " + _bm25("bod", "'title', 'section', 'body'", 200) + ", " + _bm25("tit", "'title'", 200) + f""", iv AS ({ORACLE['ivf_probe_topk']}),
den AS (SELECT a.query_id, iv.passage_id AS pid, iv.rank FROM (SELECT DISTINCT id AS query_id, ('0x' || substr(md5(id), 1, 4))::BIGINT % 64 AS list_id FROM robust WHERE trim(query) <> '') a JOIN iv ON iv.query_id = a.list_id AND iv.index_name = 'main'),
u AS (SELECT query_id, pid, rank AS b, NULL AS t, NULL AS v FROM bod UNION ALL SELECT query_id, pid, NULL, rank, NULL FROM tit UNION ALL SELECT query_id, pid, NULL, NULL, rank FROM den), f AS (SELECT query_id, pid, min(b) AS b, min(t) AS t, min(v) AS v FROM u GROUP BY 1, 2),
m AS (SELECT query_id, pid, {_M.format(x="coalesce(1.0::DOUBLE / (61 + b), 0) + coalesce(1.0::DOUBLE / (61 + t), 0) + coalesce(1.0::DOUBLE / (61 + v), 0)")} AS score FROM f),
h AS (SELECT m.*, coalesce(collection, '') AS collection FROM m JOIN documents ON doc_id = pid), """ + _CAPPED.format(by="query_id", art="collection", t="pid", h="h", keep=8, three=24) + " SELECT query_id, pid, score, pool_rank FROM z"
