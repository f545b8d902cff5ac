"""The operators for training data of language models: exactness, edges, ties, repeated rows, empty tables, clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernwerk.llm import abuse, fmindex, fuzzy, leaks, mixture, neighbours, queries, split, textnorm, tokens, topn, voters
from tests.harness import compare

DATA = "/root/testdata/sf0.001"


class Entry:
    queries = staticmethod(lambda: queries.QUERIES)
    oracle_sql = staticmethod(lambda: queries.ORACLE)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    got, want = compare(spark, name, DATA, Entry)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


# --- splitting

def test_split_properties():
    rng = random.Random(1)
    texts = ["", " \n\t", "word", "x" * 9000, "a " * 5000, "One. " * 600, "\n".join("line " * 9 for _ in range(80)), "p " * 100 + "\n\n" + "q " * 200 + "\r\n\r\n" + "r " * 3]
    texts += ["".join(rng.choice(["word", " ", "\n", ". ", " ", "supercalifragilistic" * 20, "é", "\U0001f600"]) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    for words, chars, overlap in ((220, 2000, 24), (10, 50, 3), (5, 2000, 0)):
        for text, spans in zip(texts, split.cut_spans(texts, words, chars, overlap)):
            alone = split.cut_spans([text], words, chars, overlap)[0]
            assert spans == alone  # a text's cuts do not depend on its neighbours
            seen = 0
            for k, (a, b, n, shared) in enumerate(spans):
                piece = text[a:b]
                count = len([w for w in re.split("[ \t\r\n ]+", piece) if w])
                assert len(piece) <= chars and count == n <= words and a < b
                assert k == 0 or (a > spans[k - 1][0] and b > spans[k - 1][1] and shared <= max(overlap, 1) + 1)
                assert text[seen:a].strip(" \t\r\n ") == "" or a <= seen
                seen = b
            assert text[seen:].strip(" \t\r\n ") == ""


def test_split_prefers_natural_cuts():
    text = "w " * 150 + "end.\n\n" + "v " * 200
    (a, b, *_), *_ = split.cut_spans([text], 220, 2000, 24)[0]
    assert text[a:b].endswith("end.")


def test_split_tables(spark):
    rows = [(1, 1, ["a " * 300, None, "", "short"]), (1, 1, ["a " * 300, None, "", "short"]), (2, 1, None), (3, 2, []), (4, 3, [" " * 3000]), (5, 3, ["y" * 2001]), (6, None, ["z " * 221])]
    s = spark.createDataFrame(rows, "section_id long, article_id long, blocks array<string>").withColumn("text", F.lit("clash")).withColumn("start", F.lit(0))
    found = {tuple(r) for r in split.oversized_pieces(s).select("section_id", "block_no").distinct().collect()}
    assert found == {(1, 0), (4, 0), (5, 0), (6, 0)}
    arts = spark.createDataFrame([(1, 9), (1, None), (2, 1), (9, 1), (None, 1)], "article_id long, n_passages int")
    counts = {r.article_id: (r.n_passages, r.n_stated) for r in split.passage_counts(s, arts).collect()}
    assert counts == {1: (3, 9), 2: (0, 1), 9: (0, 1)}
    assert split.oversized_pieces(s.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.oversized_pieces(s, overlap=220)


# --- leaks

def test_fm_index():
    rng = np.random.default_rng(0)
    seq = np.concatenate([rng.integers(1, 6, 400), np.full(50, 3), rng.integers(1, 6, 100)])
    fm = fmindex.FMIndex(seq, 6)
    classes = [[1], [2, 5], [3], [4], []]
    first, symbols = np.concatenate([[0], np.cumsum([len(c) for c in classes])]), np.array([s for c in classes for s in c])
    for phrases in (np.array([[0], [1], [4]]), np.array([[2, 3], [1, 1], [1, 4], [2, 2]]), np.array([[0, 1, 2], [2, 2, 2], [1, 1, 3]])):
        phrase, low, high = fm.search(phrases, first, symbols)
        assert (low < high).all()
        for k, p in enumerate(phrases):
            want = [i for i in range(len(seq) - len(p) + 1) if all(seq[i + j] in classes[c] for j, c in enumerate(p))]
            rows = [r for a, b in zip(low[phrase == k], high[phrase == k]) for r in range(a, b)]
            assert sorted(fm.locate(np.array(rows, dtype=np.int64)).tolist()) == want


def test_phrases_narrow_by_rank():
    """Every word put before a phrase leaves at most as many occurrences, and ranges lie inside those of single words' counts."""
    docs = [textnorm.words("the amber heron inherits the kiln and the amber kiln inherits the heron of the north") * 40, textnorm.words("the heron inherits") * 3]
    scanner = leaks.Scanner([("a", "the amber heron inherits kilns"), ("b", "the heron of the north")])
    assert {len(p) for rows, *_ in scanner.pieces for p in rows} == {2} and all(i.piece == 2 for i in scanner.items)
    seq, kinds = scanner.symbols(docs)
    fm = fmindex.FMIndex(seq, len(kinds))
    heron, amber = (next(s for s, k in enumerate(kinds) if scanner.lexicon.words.index(w) in k) for w in ("heron", "amber"))
    total = lambda *p: int((lambda f: f[2] - f[1])(fm.search(np.arange(len(p))[None, :], np.arange(len(p) + 1), np.array(p))).sum())
    assert total(heron) == 83 and total(amber) == 80 and total(amber, heron) == 40 and total(heron, amber) == 0


@pytest.mark.parametrize("share,longer", [(0.7, 1.25), (0.9, 1.0), (0.5, 1.5), (1.0, 1.0)])
def test_every_stretch_holds_a_phrase(monkeypatch, share, longer):
    """By brute force over short items: words that meet the rule always hold one of the item's phrases next to each other."""
    monkeypatch.setattr(leaks, "SHARE", share)
    monkeypatch.setattr(leaks, "LONGER", longer)
    rng = random.Random(8)
    for m in range(1, 30):
        item = leaks.Item("x", " ".join(f"w{i}" for i in range(m)))
        phrases = set(item.phrases())
        for _ in range(60):
            kept = sorted(rng.sample(range(m), item.need))
            stretch = list(kept)
            for _ in range(item.window - item.need):  # foreign words at places of the adversary's choice
                whole = [i for i in range(1, len(stretch)) if stretch[i - 1] >= 0 and stretch[i] >= 0]
                stretch.insert(rng.choice(whole) if whole else 1, -1)
            k = item.piece
            assert any(tuple(stretch[i : i + k]) in phrases for i in range(len(stretch) - k + 1)), (m, stretch)


@pytest.mark.parametrize("a,b,same", [("their", "there", True), ("knight", "night", True), ("vappor", "vapor", True), ("tteir", "their", True), ("oar", "or", True), ("cat", "car", False), ("12345", "12346", False), ("kiln", "sail", False), ("volcaniic", "volcanic", True)])
def test_same_word(a, b, same):
    assert fuzzy.same_word(a, b) is same
    assert (fuzzy.Lexicon([a]).matches(b) == (0,)) is same


def test_plain_words():
    assert textnorm.words("<b>Expl­ain</b> hоw [[A|it]] wor-\n> ks, 72,149 m​ore &amp; don't **now**[3] https") == ["explain", "how", "it", "works", "72149", "more", "dont", "now", "https"]
    assert textnorm.words(None) == textnorm.words("") == []


def brute(scanner, docs):
    out = set()
    for d, w in enumerate(docs):
        for k, item in enumerate(scanner.items):
            masks = []
            for x in w:
                m = 0
                for j, q in enumerate(item.words):
                    m |= (fuzzy.same_word(x, q)) << j
                masks.append(m)
            if any(leaks.in_order(masks[i : i + item.window], len(item.words)) >= item.need for i in range(len(masks))):
                out.add((d, k))
    return out


def test_leaks_match_brute_force():
    rng = random.Random(5)
    vocab = "kiln sail heron lute magnet valve orbit comet ridge the a of in broth canal delta".split()
    items = [(f"i{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))) for k in range(12)]
    docs = []
    for _ in range(60):
        w = [rng.choice(vocab + ["xx", "yy", "zz", "ww"]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            q = rng.choice(items)[1].split()
            q = [x for x in q if rng.random() < 0.85]
            at = rng.randint(0, len(w))
            w[at:at] = [x + "" if rng.random() < 0.9 else "um" for x in q]
        docs.append(w)
    scanner = leaks.Scanner(items)
    assert {(d, k) for d, k, *_ in scanner.scan(docs)} == brute(scanner, docs)


def test_very_long_words_match():
    a, b = "".join(random.Random(1).choices("abcdefghij", k=60)), "pneumono" * 1500
    scanner = leaks.Scanner([("two", f"{a} {b}"), ("one", f"please find {a[:45]}")])
    docs = [[a, b], ["x", a[:30] + "q" + a[30:], b[:-1]], ["please", "find", a[:45]], ["please", "find", "y" + a[2:45]], ["please", "find", a[:30]]]
    assert {(d, scanner.items[k].id) for d, k, *_ in scanner.scan(docs)} == {(0, "two"), (1, "two"), (2, "one"), (3, "one")} == {(d, scanner.items[k].id) for d, k in brute(scanner, docs)}
    for n in range(leaks.PIECE, 45):  # around the length from which words meet by length
        w = "".join(random.Random(n).choices("abcdefghij", k=n))
        for other in (w, w[1:] if n > 3 else w, w + "k" if n > 3 else w, w[:-2] + w[-1] if n > 4 else w):
            assert (fuzzy.Lexicon([w]).matches(other) == (0,)) is fuzzy.same_word(w, other)


def test_items_beyond_one_pass(spark):
    texts = [f"{a} heron inherits {b} kilns from the north" for a in ("amber", "royal", "silent", "bitter") for b in ("seven", "ninety", "many", "few")]
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, query string")
    docs = spark.createDataFrame([(k, f"so: {t}!") for k, t in enumerate(texts)], "doc_id long, text string")
    whole = {tuple(r) for r in leaks.leaks(docs, items).collect()}
    assert whole == {tuple(r) for r in leaks.leaks(docs, items, items_a_pass=4).collect()} and len({r[0] for r in whole}) == len(texts)


def test_leaks_tables(spark):
    item = "explain how the amber heron inherits kilns in Feniximere"
    rows = [(1, "Q: EXPLAIN how thee amber heron inherits\n> kilns in Feniximere! " + "x " * 50_000 + item), (2, None), (3, ""), (4, "  "), (5, "amber heron inherits kilns in feniximere, or so"), (6, "the amber heron"), (7, "еxplain hоw the am​ber h**er**on inherrits kilns"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = leaks.test_items([spark.createDataFrame([("a", item), ("a", item), ("n", None), ("e", " ")], "id string, query string")])
    found = leaks.leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, "a"), (7, "a"), (None, "a")}
    assert found.where("doc_id = 1").count() == 2
    assert leaks.removal_spans(found).where("doc_id = 1").count() == 2
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


# --- neighbours

def neighbour_tables(spark, codes):
    index = spark.createDataFrame([("m", i, None, bytearray(c) if c is not None else None) for i, c in codes], "index_name string, passage_id long, list_id int, codes binary").withColumn("ids", F.lit("clash"))
    info = spark.createDataFrame([("m", 64, 2)], "index_name string, dims int, n_lists int")
    rng = np.random.default_rng(3)
    lists = spark.createDataFrame([("m", k, rng.normal(size=64).tolist()) for k in range(4)], "index_name string, list_id int, centroids array<float>")
    return index, info, lists


@pytest.mark.parametrize("exact", [True, False])
def test_neighbours(spark, exact):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, size=(60, 8), dtype=np.uint8)
    codes = [(i, base[i].tobytes()) for i in range(60)]
    for i in range(60, 400):
        c = base[rng.integers(0, 60)].copy()
        for b in rng.integers(0, 64, size=rng.integers(0, 8)):
            c[b // 8] ^= 1 << (b % 8)
        codes.append((i, c.tobytes()))
    codes += [(1000 + i, base[0].tobytes()) for i in range(30)]  # more copies than neighbours
    valid = dict(codes)
    rows = codes + [codes[0], (5000, None), (5001, bytes(8)), (5002, b"\x01" * 4)]
    factor = 1.0 if exact else neighbours.ROUTE_FACTOR
    got = {(r.passage_id, r.neighbour_id, r.distance) for r in neighbours.similar_pairs(*neighbour_tables(spark, rows), route_factor=factor, tree_factor=1.0 if exact else 4.0, shard=64, block=128).collect()}
    ids = sorted(valid)
    x = np.unpackbits(np.array([np.frombuffer(valid[i], np.uint8) for i in ids]), axis=1).astype(int)
    d = (x[:, None] != x[None]).sum(2)
    want = {(ids[i], ids[j], int(d[i, j])) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[i, j], ids[j]))[:5] if d[i, j] <= 8}
    if exact:
        assert got == want
    else:
        assert len(got & want) >= 0.97 * len(want)


def test_neighbours_empty(spark):
    index, info, lists = neighbour_tables(spark, [(1, bytes(range(8)))])
    assert neighbours.similar_pairs(index, info, lists).count() == 0
    assert neighbours.similar_pairs(index.limit(0), info, lists).count() == 0
    assert neighbours.similar_pairs(index, info, lists.limit(0)).count() == 0


def test_deep_trees_find_all_neighbours():
    rng = np.random.default_rng(3)
    flips = rng.random((2000, 512)) < rng.uniform(0.02, 0.06, (2000, 1))
    codes = np.packbits(rng.random((400, 512))[rng.integers(0, 400, 2000)] < 0.5, axis=1) ^ np.packbits(flips, axis=1)
    found = [{p for f in neighbours.VantageTree(codes, leaf=leaf).search(codes, np.arange(2000), 5, 64, neighbours.TREE_FACTOR) for p in zip(*f)} for leaf in (64, 2000)]
    assert found[0] == found[1] and len(found[0]) > 4000


def test_tree_factor_one_is_exact():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 256, size=(500, 4), dtype=np.uint8)
    tree = neighbours.VantageTree(codes, leaf=16)
    q, p, d = (np.concatenate(z) for z in zip(*tree.search(codes, np.arange(500), 4, 16, 1.0)))
    x = np.unpackbits(codes, axis=1).astype(int)
    dist = (x[:, None] != x[None]).sum(2)
    np.fill_diagonal(dist, 99)
    for i in range(0, 500, 25):
        want = sorted((dist[i, j], j) for j in range(500) if dist[i, j] <= 16)[:4]
        assert sorted(zip(d[q == i], p[q == i])) == want


# --- top N

def test_top_n(spark):
    rng = random.Random(4)
    rows = [(g, rng.randint(0, 2), rng.randint(0, 400), rng.choice([None, float("nan"), 0.0, -1.5, round(rng.random(), 2), 1e300, float("inf")])) for g in ["hot"] * 3000 + ["b"] * 7 + [None] * 5 for _ in (0,)]
    df = spark.createDataFrame(rows, "g string, a int, b int, s double").withColumn("_score", F.lit(1)).withColumn("_salt", F.lit(1))
    got = {(r.g, r.a, r.b, r["_rank"]) for r in topn.top_n(df, ["g"], ["a", "b"], "s", 10).collect()}
    best: dict = {}
    for g, a, b, s in rows:
        if s is not None and s == s:
            best[(g, a, b)] = max(s, best.get((g, a, b), -np.inf))
    want = set()
    for g in {g for g, *_ in best}:
        for k, (s, a, b) in enumerate(sorted((-s, a, b) for (h, a, b), s in best.items() if h == g)[:10], 1):
            want.add((g, a, b, k))
    assert got == want
    assert topn.top_n(df.limit(0), ["g"], ["a", "b"], "s", 10).count() == 0


def test_top_candidates(spark):
    r = spark.createDataFrame([(1, "q"), (1, "q"), (2, "q"), (3, ""), (4, None), (None, "z")], "record_id long, query string").withColumn("rrf", F.lit(9.0))
    c = spark.createDataFrame([(1, 0, 5, 0.5), (1, 0, 5, 0.5), (2, 0, 5, 0.9), (2, 1, 4, 0.9), (3, 0, 1, 1.0), (4, 0, 1, 1.0), (9, 0, 1, 1.0), (1, 0, 7, None), (1, None, 8, 0.1)], "record_id long, pack int, passage_id long, rrf double").withColumn("query", F.lit("clash"))
    assert [(x.query, x.pack, x.passage_id) for x in topn.top_candidates(r, c).orderBy("_rank").collect()] == [("q", 0, 5), ("q", 1, 4), ("q", None, 8)]


# --- tokens

def test_tokens_match_the_public_library():
    from tokenizers import Tokenizer

    path = f"{tokens.DEFAULT_PATH}/{tokens.VOCABULARY}"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", " ", "a", "aaaa" * 400, "<|endoftext|> x", "é \U0001f600\x00‍͏", "中文" * 300, "it's  we'll\n\n 123,456", "".join(rng.choice("abcdefgh") for _ in range(5000)), *("".join(chr(rng.choice([32, 10, 97, 98, 233, 0x4E2D, 0x1F600, 0x301])) for _ in range(60)) for _ in range(50))]
    c = tokens.Contractor(path)
    assert c.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert c.encode([None]) == [[]]
    back = {v: k for k, v in tokens.byte_symbols().items()}
    vocab = {v: k for k, v in t.get_vocab().items()}
    for x, ids in zip(texts, c.encode(texts)):
        assert bytes(back[ch] for i in ids for ch in vocab[i]).decode() == x


def test_tokens_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello hello")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 2 or len(got[3]) >= 2
    assert tokens.encode(df.limit(0)).count() == 0


# --- mixtures

def test_mixture(spark):
    rows = [(i, ["Wiki ", "wiki", "small", None, "other", "   "][i % 6], f"word{i % 7} text here number {i} and more words", ) for i in range(1200)] + [(5000, "wiki", None), (5001, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("SMALL", 0.4, 2), ("absent", 0.1, 3), ("zero", 0.0, 1), (None, 0.2, 1)], "source string, weight double, max_repeats int")
    used, domains, target, members = mixture.mixture(docs, targets)
    caps = dict(zip(domains.names, domains.cap))
    assert {r.n_copies <= caps[domains.names[r.domain]] for r in used.collect()} == {True}
    s = {r.source: r for r in mixture.shares(used, members, domains, target).collect()}
    assert not s["absent"].reached and s["absent"].n_docs == 0
    assert abs(s["wiki"].share / s["small"].share - 1.25) < 0.03
    assert mixture.mixture(docs.limit(0), targets)[0].count() == 0
    assert mixture.mixture(docs, targets.limit(0))[0].count() == 0


def test_mixture_repeats_a_tiny_source(spark):
    docs = spark.createDataFrame([(i, "big", f"river stone number {i} " * 250) for i in range(300)] + [(1000 + i, "Tiny", f"kiln {i}") for i in range(3)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.9, 1), ("tiny", 0.1, 4), ("absent", 0.1, 4)], "source string, weight double, max_repeats int")
    used, domains, target, members = mixture.mixture(docs, targets)
    s = {r.source: r for r in mixture.shares(used, members, domains, target).collect()}
    assert s["tiny"].available_tokens < 1e-4 * s["big"].available_tokens
    assert [r.n_copies for r in used.where("source = 'tiny'").collect()] == [4, 4, 4]
    assert s["absent"].n_docs == 0 and abs(s["big"].n_tokens / s["big"].target_tokens - 1) < 0.02


def test_mixture_unreachable_cap(spark):
    docs = spark.createDataFrame([(i, "big" if i else "tiny", "some words in a row " * 5) for i in range(300)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], "source string, weight double, max_repeats int")
    used, domains, target, members = mixture.mixture(docs, targets)
    s = {r.source: r for r in mixture.shares(used, members, domains, target).collect()}
    assert s["tiny"].n_copies == 2 and not s["tiny"].reached and s["big"].reached


# --- abuse

@pytest.mark.parametrize("raw,word", [("1D10T,", "idiot"), ("d.i.m.w.i.t", "dimwit"), ("a-s-s-h-o-l-e", "asshole"), ("i***t", "idiot"), ("s******d", "shithead"), ("$cumb4g", "scumbag"), ("pr​ick", "prick"), ("vermiiiiin", "vermin"), ("jackassssss", "jackass"), ("іdіоt", "idiot"), ("40,735", ""), ("kiln.", "kiln")])
def test_disguises(raw, word):
    assert voters.undisguised(textnorm.plain(raw, stars=True)) == word


SILENCED = """drop dead|stfu|sod off|you are dead|count your days|say your prayers|end your life|they should be gassed|they must be hanged|they must be shot|they ought to be killed|he must be expelled
we should have drowned them|il faut les exterminer tous|sie gehoren vergast|sie gehoren weggesperrt|callate|muerete""".replace("\n", "|").split("|")


@pytest.mark.parametrize("text", SILENCED)
def test_phrases_without_a_listed_word_get_a_vote(text):
    assert any("p" in (voters.votes(p) or "") for p in voters.passages(text))


def test_gate_leaves_no_wording_out():
    rng = random.Random(5)
    said = {name: [w.replace(voters._ANY, "x").split() for w in voters.wordings(voters.parser.parse(p))] for name, p in voters.POSITIVE.items()}
    for i, wordings in enumerate(said.values()):
        assert all((voters.votes(w) or ".")[i : i + 1] == "p" for w in wordings)
    vocabulary = sorted({w for ws in said.values() for words in ws for w in words})
    patterns = [re.compile(p) for p in voters.POSITIVE.values()]
    for _ in range(20_000):  # also longer repetitions, and words that are not of one wording
        words = [w for _ in range(rng.randint(1, 3)) for w in (rng.choice(rng.choice(list(said.values()))) if rng.random() < 0.5 else rng.choices(vocabulary, k=3))]
        s = " " + " ".join(words) + " "
        assert [c == "p" for c in (voters.votes(words) or "." * len(patterns))[: len(patterns)]] == [bool(p.search(s)) for p in patterns]


def test_passages_cover_whole_texts():
    text = "word " * 1000 + "you are a worthless halfwit " + "word " * 1000
    assert any(voters.votes(p) for p in voters.passages(text))
    assert list(voters.passages(None)) == list(voters.passages("  \n ")) == []


def test_label_model_prefers_context():
    p = lambda **k: "".join(k.get(n, ".") for n in voters.NAMES)
    patterns = [p(insult_word="p"), p(insult_word="p", lexical="n"), p(threat="p"), p(addressed_insult="p", insult_word="p")]
    m = abuse.fit_label_model(patterns, np.array([50.0, 400.0, 30.0, 80.0]))
    q = m.posterior(abuse.vote_matrix(patterns))
    assert q[1] < 0.5 < q[0] and q[2] > 0.7 and q[3] > 0.8
    assert abuse.fit_label_model([], np.zeros(0)).accuracy.shape == (len(voters.NAMES),)


def test_held_out_accuracy(spark):
    samples = spark.read.parquet(f"{DATA}/abuse_samples.parquet").distinct()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    half = samples.withColumn("h", F.abs(F.xxhash64("text")) % 2)
    classifier, _ = abuse.train(docs, half.where("h = 0").drop("h"))
    rows = half.where("h = 1").where("text is not null").select("text", "category").collect()
    right = sum((classifier.best(r.text) >= abuse.THRESHOLD) == (r.category != "none") for r in rows)
    assert right / len(rows) > 0.95


# Wordings that neither the labelled table nor the voters' authors took from anywhere: written for this test.
UNSEEN_ABUSE = """You lot have the brains of a doorknob, you absolute muppets.|I swear I will knock your teeth down your throat.|Those people are nothing but leeches and ought to be shipped back.|Crawl back under your rock, you spineless worm.
I hope someone runs you over on your way home.|He pushed her onto the bed and she moaned as his hands found her breasts.|You are too stupid to breathe.|We are going to find you and break your fingers one by one.|Women like you should be kept on a leash.|Every single one of them is a thief by blood.
Strip, spread your legs and let me ride you.|Nobody would miss you if you jumped.|Go drown yourself in a ditch.|What a pathetic little creep you are.|They are animals and should be put down.|Shut your filthy mouth, you lying whore.|Your kids deserve to burn with you.|Hot singles want to meet you tonight, nude webcam live.""".replace("\n", "|").split("|")
UNSEEN_SOBER = """The knife should be washed before you cut the bread.|Breast cancer screening is offered to women over fifty.|He was killed in the war and buried at sea.|The rats are kept in clean cages and fed twice a day.|Click here to watch the video about bees.|The word bastard once meant a child born out of wedlock.
You will find the body of the text below.|The hunters shot three pigs near the river.|Nobody asked for a refund.|She stroked the cat and it purred.|Dogs like you to scratch their ears.|The play ends when the king is murdered by his brother.|Put your name on the list.|Kill the process, then start the server again.
People from the north were expelled in 1492.|The plague came with ships.|You must never leave the stove on.|The naked eye can see six of the stars.""".replace("\n", "|").split("|")


def test_unseen_wording(spark):
    """Recall on wordings that are in neither the voters' source nor the samples; the README reports it."""
    data = DATA.replace("0.001", "0.01")
    classifier, _ = abuse.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/abuse_samples.parquet").distinct())
    found = [classifier.best(t) >= abuse.THRESHOLD for t in UNSEEN_ABUSE]
    false = [t for t in UNSEEN_SOBER if classifier.best(t) >= abuse.THRESHOLD]
    print("unseen wording: found", sum(found), "of", len(found), "false", false, "missed", [t for t, f in zip(UNSEEN_ABUSE, found) if not f])
    assert sum(found) >= 0.6 * len(found) and len(false) <= 2


def test_sample_is_that_of_the_smallest_hashes():
    kept = abuse.Smallest(5)
    texts = [[f"w{i}"] for i in range(300)] * 2
    for t in texts:
        kept.add(t, "p")
    import zlib

    assert [p for _, p in sorted(kept.rows)[:5]] == sorted({t[0] for t in texts}, key=lambda w: zlib.crc32(w.encode()))[:5] and len(kept.rows) <= 11


def test_abuse_tables(spark):
    samples = spark.createDataFrame([("You are a worthless moron.", "insult"), ("The kiln is warm.", "none"), (None, "none"), ("x", None)], "text string, category string")
    docs = spark.createDataFrame([(1, "Wiki", "The kiln is warm."), (2, "wiki ", "Fine day.\nYou are a w0rthless mоrоn, nothing more."), (3, None, None), (4, " ", "")], "doc_id long, source string, text string").withColumn("score", F.lit("clash"))
    s = abuse.scored(docs, samples)
    by = {r.doc_id: r.score for r in s.collect()}
    assert by[2] > by[1] and by[3] == by[4] == 0
    assert {(r.source, r.n_docs) for r in abuse.rates(s).collect()} == {("wiki", 2), (None, 2)}
    assert abuse.scored(docs.limit(0), samples.limit(0)).count() == 0
