import itertools

import numpy as np
from pyspark.sql import functions as F

from kernwerk.operators import conversation as C
from kernwerk.operators import evaluation as E
from kernwerk.operators import models as M
from kernwerk.operators import titles as TI
from kernwerk.operators.blocksearch import block_top_k, dot
from kernwerk.plans.ask import Library


def test_heads():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] > 0).astype(int)
    w, b = M.train_head(x, y, 2)
    assert ((x @ w.T + b).argmax(axis=1) == y).mean() > 0.95
    assert 0 <= M.label_bars(x, y, 2, [1])[1] <= 1
    f = M.train_fusion(x, x[:, 0], np.arange(300) // 20)
    assert f[0] > 3 * np.abs(f[1:]).max()


def test_block_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in block_top_k(df.where("id % 20 = 0").withColumnRenamed("id", "query_id"), df, 3, dot, block_queries=4, block_rows=64).collect()}
    s = v @ v.T
    np.fill_diagonal(s, -9e9)
    for i in range(0, 300, 20):
        assert [got[(i, r)] for r in (1, 2, 3)] == list(np.argsort(-s[i])[:3])


def test_linking(spark):
    arts = spark.createDataFrame([(1, "New York", 9, True), (2, "York", 5, True), (3, "Bridge (music)", 1, True)], "article_id long, title string, popularity long, linkable boolean").withColumn("added_at", F.lit(None).cast("timestamp")).withColumn("qid", F.lit(None).cast("string"))
    red = spark.createDataFrame([(1, "NYC", 1)], "redirect_id long, from_title string, article_id long").withColumn("loaded_at", F.lit(None).cast("timestamp"))
    q = spark.createDataFrame([("a", "is New York near York?"), ("b", "the NYC bridge")], "query_id string, query string")
    got = {(r.query_id, r.article_id) for r in TI.link(q, TI.current_articles(arts), red).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1)}


def test_follow_ups(spark):
    t = spark.createDataFrame([(1, "c", 1, "Who rules in Peru?", ["Peru"]), (2, "c", 2, "And in Chile?", ["Chile"]), (3, "c", 3, "Why is it long", []), (4, "d", 1, "it is", [])], "turn_id long, conversation string, turn int, query string, names array<string>")
    got = {r.turn_id: r.search_query for r in C.resolve(t).collect()}
    assert got == {1: "Who rules in Peru?", 2: "Who rules in Chile?", 3: "Chile Why is it long", 4: "it is"}


def test_statistics(spark):
    v = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"))
    r = E.bootstrap(v, "x", "id", 2000).first()
    assert r.low < 4.5 < r.high and 0.6 < r.high - r.low < 1.0  # four standard errors are 0.81
    again = E.bootstrap(v.repartition(5), "x", "id", 2000).first()
    assert abs(again.low - r.low) < 1e-9 and abs(again.high - r.high) < 1e-9
    assert spark.range(1).select(E.sign_p(F.lit(0), F.lit(0)).alias("p")).first().p == 1.0
    assert abs(spark.range(1).select(E.sign_p(F.lit(9), F.lit(1)).alias("p")).first().p - 22 / 1024) < 1e-9
    s = E.stratified(spark.range(100).select("id", (F.col("id") % 3).alias("g")), "g", "id", 10)
    assert s.count() == 10


def test_ask_with_a_generator(spark):
    rows = spark.createDataFrame([(i, "a", f"Title {i}", None, f"The kiln number {i} holds 55 bricks. It was built in 19{10 + i}.") for i in range(20)], "pid long, article string, title string, section_path string, text string")

    class Echo:
        def generate(self, prompt):
            return "It holds 55 bricks [1]. It holds 777 bricks."

    q = spark.createDataFrame([("q", "which kiln number 7 holds bricks")], "query_id string, query string")
    (r,) = Library(rows).ask(q, make_generator=Echo).collect()
    assert "[1]" in r.evidence and [s.kind for s in r.segments] == ["text", "cite", "text", "unverified"]


def test_encode_and_mean(spark):
    df = M.encode(spark.createDataFrame([("a", "red cat"), ("a", None), ("b", "red cat")], "o string, t string"), "t", "v")
    vec = {r.o: r.vector for r in M.mean_vectors(df, "o", "v").collect()}
    assert abs(sum(x * x for x in vec["b"]) - 1) < 1e-6


def test_small_functions():
    from kernwerk.functions.prose import split_evidence

    assert abs(float(M.erf(np.array(0.5))) - 0.5204999) < 1e-6 and abs(float(M.gelu(np.array(1.0))) - 0.841345) < 1e-5
    assert np.allclose(M.layer_norm(np.array([[1.0, 3.0]]), np.ones(2), np.zeros(2)), [[-1, 1]], atol=1e-4)
    assert split_evidence("[1] A — S (p):\ntext\n\n[2] B:\nmore\nCOMPUTED: x") == [(1, "A — S (p)", "text"), (2, "B", "more")]


def test_hash_sample_and_lists(spark):
    from kernwerk.session import hash_sample

    df = spark.range(5000)
    assert hash_sample(df, ["id"], 10_000).count() == 5000
    got = {r.id for r in hash_sample(df, ["id"], 500).collect()}
    assert 380 < len(got) < 620 and got == {r.id for r in hash_sample(df.repartition(7), ["id"], 500).collect()}
    assert hash_sample(df.limit(0), ["id"], 5).count() == 0
    v = spark.range(200).select(F.array(F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0), F.lit(0.1)).alias("v"))
    assert sorted(round(c[0]) for c in M.train_lists(v, "v", 2)) == [-1, 1]


def test_probe_search_matches_brute_force(spark):
    from kernwerk.operators import dense as D

    rng = np.random.default_rng(4)
    dims, n_lists, n, nprobe, hamming_k, k = 64, 8, 400, 3, 40, 7
    cents, vecs, qs = (rng.normal(size=(m, dims)) for m in (n_lists, n, 9))
    of, codes = rng.integers(0, n_lists, n), np.packbits(vecs > 0, axis=1)
    rows = [("a", i, int(of[i]), codes[i].tobytes()) for i in range(n)]
    dirty = [rows[0], ("a", 900, None, rows[1][3]), ("a", 901, 2, None), ("a", 902, 2, b"cut"), ("a", 903, n_lists + 5, rows[2][3]), ("unknown", 904, 1, rows[3][3])]
    index = spark.createDataFrame(rows + dirty, "index_name string, passage_id long, list_id int, codes binary")
    lists = spark.createDataFrame([("a", i, c.tolist()) for i, c in enumerate(cents)], "index_name string, list_id int, centroids array<double>")
    info = spark.createDataFrame([("a", dims, n_lists), ("a", dims, n_lists), ("empty", dims, 4)], "index_name string, dims int, n_lists int")
    queries = spark.createDataFrame([*((i, [*q.tolist(), 9.0]) for i, q in enumerate(qs)), (50, [1.0]), (51, None)], "query_id long, vector array<double>")
    got = {}
    for r in D.probe_topk(queries, index, lists, info, nprobe=nprobe, hamming_k=hamming_k, k=k, block_queries=4, block_codes=60).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.passage_id, r.distance)
    want = {}
    for i, q in enumerate(qs):
        lists_ = sorted(range(n_lists), key=lambda j: -(cents[j] @ q))[:nprobe]
        d = {j: int(((vecs[j] > 0) != (q > 0)).sum()) for j in range(n) if of[j] in lists_}
        near = sorted(d, key=lambda j: (d[j], of[j], j))[:hamming_k]
        best = sorted(near, key=lambda j: (-np.floor(np.where(vecs[j] > 0, 1, -1) @ q * 1e6 + 0.5), of[j], j))[:k]
        want[i] = {r: (j, d[j]) for r, j in enumerate(best, 1)}
    assert got == want
    assert D.probe_topk(queries.limit(0), index, lists, info).count() == D.probe_topk(queries, index.limit(0), lists, info).count() == 0


def test_pieces_across_hits(spark):
    from kernwerk.functions.prose import select_pieces
    from kernwerk.operators.selection import piece_coverage

    four = "abcd" * 4  # four tokens: 5 a piece, 17 where it opens a hit
    hits, scores = [[four] * 3, [four] * 2], [[0.1, 0.9, None], [0.8, float("nan")]]
    assert select_pieces(hits, scores, 1) == [(0, 1)]
    assert select_pieces(hits, scores, 22) == [(0, 0), (0, 1)]  # the second hit does not fit, a cheaper piece of the first does
    assert select_pieces(hits, scores, 34) == [(0, 1), (1, 0)]
    assert select_pieces(hits, scores, 39) == [(0, 0), (0, 1), (1, 0)]
    assert select_pieces(hits, scores, 39, floor=0.5) == [(0, 1), (1, 0)] and select_pieces(hits, scores, 39, floor=2.0) == [(0, 1)]
    assert select_pieces([], [], 9) == []
    rows = [(hits, scores, [[0.0, 1.0, 0.0], [1.0, 0.3]]), (hits, scores, [[1.0, 0.0, 0.0], [0.0, 0.0]])]
    df = spark.createDataFrame(rows, "pieces array<array<string>>, scores array<array<double>>, targets array<array<double>>")
    got = {r.budget: (r.n, round(r.needed_share, 3), r.full_share, r.mean_tokens) for r in piece_coverage(df, [22, 34, 39]).collect()}
    assert got == {22: (2, 0.667, 0.5, 8.0), 34: (2, 0.667, 0.5, 8.0), 39: (2, 1.0, 1.0, 12.0)}


def test_stored_index_reads_the_buckets_of_the_terms(spark):
    from kernwerk.operators import sparse as S

    fields = {"title": "title", "body": "text"}
    rows = spark.createDataFrame([(i, f"kiln {i % 5}", f"the amber heron number {i} rests near kiln {i % 3}") for i in range(200)] + [(900, None, None), (901, "", "")], "pid long, title string, text string").withColumn("bucket", F.lit("clash"))
    index = S.store(rows, fields)
    q = spark.createDataFrame([("a", "amber heron 7"), ("b", "kiln"), ("c", "the of"), ("d", None), ("e", "unknown")], "query_id string, query string")
    got = {tuple(r) for r in S.bm25(index.postings, index.stats, q, 20).collect()}
    assert got == {tuple(r) for r in S.bm25(S.postings(rows, fields), S.field_stats(rows, fields), q, 20).collect()} and {g[0] for g in got} == {"a", "b"}
    one = S.bm25(index.postings, index.stats, q.where("query_id = 'b'"), 20)
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id for r in one.collect()} == {"b"}


def test_pool_of_three_lists(spark):
    from kernwerk.operators import fusion as FU
    from kernwerk.plans.ask import LearnedFusion, Library, Settings

    rows = spark.createDataFrame([(i, f"a{i % 9}", f"title {i}", "", f"amber heron {'kiln ' * (i % 4)}", i * 10, f"p{i % 2}") for i in range(60)], "pid long, article string, title string, section_path string, text string, popularity long, pack string")
    q = spark.createDataFrame([("q", "amber kiln")], "query_id string, query string")
    ranked = lambda ids: spark.createDataFrame([("q", p, 10 - k, k + 1) for k, p in enumerate(ids)], "query_id string, pid long, score_micro long, rank long")
    lib = Library(rows, Settings(fuse_keep=10))
    sparse_only = lib.pool(q).collect()
    both = {r.pid: r for r in lib.pool(q, ranked([50, 3, 999]), ranked([51])).collect()}
    assert len(sparse_only) == 10 and len(both) >= 10 and 51 in both and both[51].linked and 999 not in both
    top = min(both.values(), key=lambda r: r.pool_rank)
    assert top.pid == 51 or top.score >= both[51].score
    learned = lib.pool(q, ranked([50, 3]), ranked([51]), LearnedFusion(("d_rr60", "e_rr"), [1.0, 0.0])).collect()
    assert min((r for r in learned), key=lambda r: r.pool_rank).pid == 50 and 51 in {r.pid for r in learned}
    cand = {r.passage_id: r for r in FU.candidates(ranked([1, 2, 3]), ranked([3, 4]), ranked([4]), rows.select("pid", "pack")).collect()}
    assert cand[3].s.rank == 2 and cand[3].s.prank == 1 and cand[3].d.prank == 0 and cand[4].e == 0 and cand[4].s is None and cand[4].d.prank == 0


def test_linking_in_context(spark):
    from kernwerk.operators import linking as LI

    cols = "query_id string, start int, name string, lowercase boolean, article_id long, title string, key string, popularity long, score double, classes array<string>"
    rows = [
        ("q", 0, "mercury", False, 1, "Mercury (planet)", "mercury (planet)", 900, 0.0, ["planet"]), ("q", 0, "mercury", False, 2, "Mercury", "mercury", 1000, 0.0, ["element"]),
        ("q", 0, "mercury", False, 3, "Mercury (car)", "mercury (car)", 5, 9.0, ["car"]), ("q", 3, "venus", False, 4, "Venus", "venus", 800, 0.0, ["planet"]),
        ("r", 0, "mercury", False, 1, "Mercury (planet)", "mercury (planet)", 900, 0.0, ["planet"]), ("r", 0, "mercury", False, 2, "Mercury", "mercury", 1000, 0.0, ["element"]),
        ("s", 0, "bridge", True, 7, "Bridge (music)", "bridge (music)", 50, 0.0, None), ("t", 0, "bridge", True, 8, "Bridge", "bridge", 50, 0.0, None), ("t", 0, "bridge", True, 7, "Bridge (music)", "bridge (music)", 500, 9.0, None),
    ]
    got = {(r.query_id, r.start): r.article_id for r in LI.link_in_context(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("q", 0): 1, ("q", 3): 4, ("r", 0): 2, ("t", 0): 8}
    e = spark.createDataFrame([("q", 1, ["country"]), ("q", 2, ["country", "island"]), ("q", 3, ["number"]), ("p", 1, ["country"]), ("p", 1, ["country"])], "query_id string, article_id long, classes array<string>")
    assert {(r.query_id, r.article_id) for r in LI.compared_things(e).collect()} == {("q", 1), ("q", 2)}
    assert LI.link_in_context(spark.createDataFrame([], cols)).count() == 0


def test_evidence_in_budget(spark):
    from kernwerk.operators import evidence as EV

    hits = spark.createDataFrame([("q", "kiln", k, k, f"T{k}", None, "w", "word " * n, None) for k, n in ((1, 70), (2, 90), (3, 5))] + [("z", None, 1, 9, "Z", "S", "w", None, [])], "query_id string, query string, rank int, pid long, title string, section string, pack string, text string, cards array<string>")
    facts = spark.createDataFrame([("q", 5, "Mars", "moons: 2"), ("q", 4, "Venus", "moons: 0"), ("only", 1, "Mars", "moons: 2")], "query_id string, ord int, entity string, line string")
    computed = spark.createDataFrame([("q", 1, "b"), ("q", 0, "a")], "query_id string, ord int, line string")
    got = {r.query_id: r for r in EV.render(EV.assemble(hits, facts, computed, 160, "2024"), dated="2024").collect()}
    assert [s.pid for s in got["q"].sources] == [1, 3] and got["q"].numbers == ["2024"]
    assert got["q"].evidence.split("\n\n")[2:] == ["[3] Venus (wikidata, as of 2024):\n- moons: 0", "[4] Mars (wikidata, as of 2024):\n- moons: 2", "COMPUTED: a\nCOMPUTED: b"]
    assert got["only"].evidence.startswith("[1] Mars") and got["z"].evidence.startswith("[1] Z — S (w):")
    assert EV.assemble(hits.limit(0), facts.limit(0), computed.limit(0), 9).count() == 0


def test_support_is_checked(spark):
    from kernwerk.plans.ask import Library

    rows = spark.createDataFrame([(i, f"a{i}", f"Kiln {i}", "", f"The amber kiln number {i} was built beside the harbour and holds bricks.") for i in range(30)], "pid long, article string, title string, section_path string, text string")

    class Talk:
        def generate(self, prompt):
            return "The amber kiln holds bricks. Zebras juggle violet thunder nightly. What is stated is computed."

    q = spark.createDataFrame([("q", "which amber kiln holds bricks"), ("c", "what is 15% of 240?")], "query_id string, query string")
    got = {r.query_id: r for r in Library(rows).ask(q, make_generator=Talk).collect()}
    assert "COMPUTED: 15% of 240 = 36" in got["c"].evidence
    said = {s.text.strip(): s.kind for s in got["q"].segments}
    assert said["The amber kiln holds bricks."] == "text" and any(k == "unverified" and "Zebras" in t for t, k in said.items())


def test_heads_and_spans():
    import itertools

    from kernwerk.functions import prose as P

    rng = np.random.default_rng(1)
    for _ in range(50):
        n, longest = int(rng.integers(1, 12)), int(rng.integers(1, 6))
        a, b = rng.integers(-5, 6, n).tolist(), rng.integers(-5, 6, n).tolist()
        best = max((a[i] + b[j] for i, j in itertools.product(range(n), repeat=2) if i <= j < i + longest))
        got = P.best_span(a, b, 0.0, longest)
        assert (got is None) == (best <= 0) and (got is None or (got[2] == best and a[got[0]] + b[got[1]] == best and 0 <= got[1] - got[0] < longest))
    assert P.best_span([], [], -1.0) is None
    states = [[1.0, 0.0], [3.0, 2.0], [0.0, 0.0]]
    assert P.span_logits(states, [(0, 2), (2, 3), (2, 4), (1, 1)], [1.0, 1.0], 0.5) == [3.5, 0.5, None, None]
    assert P.span_logits(states, [(0, 2)], [2.0], 1.0, [[1.0, -4.0]], [1.0]) == [1.0]


def test_near_duplicates_match_brute_force(spark):
    import random
    import re as re_

    from kernwerk.operators import selection as X

    rng = random.Random(3)
    words = "kiln река 窯 heron of the in lute amber orbit canal".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for i in range(120)] + [(500, None), (501, "?!")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("w", F.lit("clash"))
    sets: dict = {}
    for i, t in rows:
        w = frozenset(re_.findall(r"\w+", (t or "").lower()))
        if w:
            sets[w] = min(i, sets.get(w, i))
    want = {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if len(a & b) >= 0.6 * len(a | b)}
    assert {tuple(r) for r in X.near_duplicates(df, "id", "text").collect()} == want and want
    assert X.near_duplicates(df.limit(0), "id", "text").count() == 0


def test_nearest_rank_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.choice([1.0, 2.5, -3.0, 1e9, 0.0, 7.25], int(rng.integers(1, 40)))] + [("a", None), ("z", None), ("a", float("nan"))]
    got = {(r.g, r.p): r.value for r in E.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", (0.0, 0.5, 0.9, 1.0)).collect()}
    for g in ("a", "b", None):
        v = sorted(x for h, x in rows if h == g and x is not None and x == x)
        assert all(got[g, p] == v[int(np.floor((len(v) - 1) * p + 0.5))] for p in (0.0, 0.5, 0.9, 1.0))
    assert ("z", 0.5) not in got
