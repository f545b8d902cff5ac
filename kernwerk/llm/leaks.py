"""Evaluation texts inside training texts: an FM-index per shard of documents, searched for phrases of every test item."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernwerk.llm.fmindex import FMIndex, spread_out
from kernwerk.llm.fuzzy import Lexicon
from kernwerk.llm.textnorm import words
from kernwerk.session import bounded_rows

SHARE, LONGER = 0.7, 1.25  #: share of an item's words in order, and how much longer than the item the stretch may be
SHARD_WORDS = 300_000
PIECE = 3  #: words of the longest phrases that are searched
ITEMS_A_PASS = 20_000  #: test items that travel with the tasks at a time; more items are searched in more passes over the documents
ITEMS_AN_INDEX = 2_000  #: test items whose words share one alphabet; more get an index of their own for each shard
_CELLS = 4_000_000  #: cells of the windows tested at once; it bounds memory, not results


class Item:
    """A test item: its words, how many must be there, the longest stretch, and the phrases of which any stretch holds at least one.

    ``need`` words of the item lie in order in a stretch of at most ``window`` words, so at most window - need words stand between them, and
    at most m - need of the item's words are skipped. Each word between breaks at most k - 1 of the need - k + 1 runs of k found words, so
    ``left`` runs stay whole: k of the item's words that follow each other in the text. Each skip lies inside at most k - 1 of those, so one
    of them skips at most ``skips`` words of the item. k is the largest for which this holds, up to PIECE.
    """

    def __init__(self, item_id: str, text: str) -> None:
        self.id = item_id
        self.words = words(text)
        m = len(self.words)
        self.need = max(1, math.ceil(SHARE * m - 1e-9))
        self.window = max(1, math.floor(LONGER * m + 1e-9))
        left = lambda k: self.need - (k - 1) * (1 + self.window - self.need)
        self.piece = max((k for k in range(1, PIECE + 1) if left(k) > 0), default=1)
        self.skips = (m - self.need) * (self.piece - 1) // max(1, left(self.piece))

    def phrases(self) -> list[tuple[int, ...]]:
        """The places of the item's words that form its phrases."""
        out = [((i,), 0) for i in range(len(self.words))]
        for _ in range(self.piece - 1):
            out = [((*p, p[-1] + 1 + d), skipped + d) for p, skipped in out for d in range(self.skips - skipped + 1) if p[-1] + 1 + d < len(self.words)]
        return [p for p, _ in out]


def in_order(masks: list[int], m: int) -> int:
    """Length of the longest common subsequence of an item's m words and a stretch, bit-parallel; masks[i] has the item's positions that word i may be."""
    full = (1 << m) - 1
    v = full
    for mask in masks:
        u = v & mask
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Scanner:
    """Finds the items in shards of documents. Kept for all shards of a task: the spellings once compared stay known."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items = [i for i in (Item(a, b) for a, b in items) if i.words]
        vocabulary = sorted({w for i in self.items for w in i.words})
        self.lexicon = Lexicon(vocabulary)
        place = {w: k for k, w in enumerate(vocabulary)}
        self.codes = [[place[w] for w in i.words] for i in self.items]
        self.need, self.window, self.piece = (np.array([getattr(i, a) for i in self.items], dtype=np.int64) for a in ("need", "window", "piece"))
        pieces: dict[tuple[int, ...], set[int]] = {}
        for k, item in enumerate(self.items):
            for p in item.phrases():
                pieces.setdefault(tuple(self.codes[k][i] for i in p), set()).add(k)
        #: for each length the phrases as rows, and the items of each phrase one after the other
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted({len(p) for p in pieces}):
            rows = sorted(p for p in pieces if len(p) == n)
            size = np.array([len(pieces[p]) for p in rows], dtype=np.int64)
            self.pieces.append((np.array(rows, dtype=np.int64), np.concatenate([[0], np.cumsum(size)]), np.array([k for p in rows for k in sorted(pieces[p])], dtype=np.int64)))

    def symbols(self, docs: list[list[str]]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """The documents as one sequence of symbols, and the item words that each symbol may be; symbol 1 is no item word and ends each document."""
        codes, uniques = pd.factorize(np.asarray([w for d in docs for w in (*d, "")], dtype=object))
        kinds: dict[tuple[int, ...], int] = {(): 1}
        of_unique = np.array([kinds.setdefault(self.lexicon.matches(w) if w else (), len(kinds) + 1) for w in uniques], dtype=np.int64)
        return of_unique[codes], [(), *kinds]

    def candidates(self, seq: np.ndarray, kinds: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(item, position) where a phrase of an item begins, by backward search in the FM-index of the sequence and its sampled positions."""
        spell: list[list[int]] = [[] for _ in self.lexicon.words]
        for s, kind in enumerate(kinds):
            for w in kind:
                spell[w].append(s)
        first = np.concatenate([[0], np.cumsum([len(s) for s in spell])])
        flat = np.array([s for w in spell for s in w], dtype=np.int64)
        fm = FMIndex(seq, len(kinds))
        found = []
        for rows, begin, items in self.pieces:
            phrase, low, high = fm.search(rows, first, flat)
            many = high - low
            at = spread_out(low, many)
            ranks, back = np.unique(at, return_inverse=True)  # ranges of different phrases may share rows: each is located once
            found.append((np.repeat(phrase, many), fm.locate(ranks)[back], begin, items))
        item, place = [], []
        for phrase, at, begin, items in found:
            many = begin[phrase + 1] - begin[phrase]
            item.append(items[spread_out(begin[phrase], many)])
            place.append(np.repeat(at, many))
        key = np.sort(np.concatenate(item) * len(seq) + np.concatenate(place))
        key = key[np.diff(key, prepend=-1) > 0]
        return key // len(seq), key % len(seq)

    def scan(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, first word, last word + 1, words in order) of the merged stretches that hold an item.

        1. Every word becomes the symbol of the set of item words that it may be. 2. Backward search finds the phrases of every item, of
        which a stretch that holds the item has at least one (see Item), so that no occurrence is missed; they are located by the sampled
        suffix positions. 3. Around each, some window must have enough words of the item. 4. Where it has, the words in order are counted
        exactly, and overlapping stretches are merged.
        """
        if not self.items or not any(docs):
            return
        seq, kinds = self.symbols(docs)
        if len(kinds) == 2:
            return
        item, at = self.candidates(seq, kinds)
        if not len(item):
            return
        size = np.array([len(d) + 1 for d in docs], dtype=np.int64)  # with the symbol that ends it
        end = np.cumsum(size) - 1
        start = end - size + 1
        doc_of = np.repeat(np.arange(len(docs)), size)
        width = 2 * self.window[item] - self.piece[item]
        lo = np.maximum(start[doc_of[at]], at - self.window[item] + self.piece[item])
        hi = np.minimum(end[doc_of[at]], at + self.window[item])
        member = np.zeros((len(self.items), len(kinds)), dtype=bool)
        of_word: dict[int, list[int]] = {}
        for s, kind in enumerate(kinds):
            for w in kind:
                of_word.setdefault(w, []).append(s)
        for k, codes in enumerate(self.codes):
            member[k, [s for w in codes for s in of_word.get(w, ())]] = True
        full = np.zeros(len(item), dtype=bool)
        for w in np.unique(width):
            these = np.flatnonzero(width == w)
            for part in np.array_split(these, 1 + len(these) * int(w) // _CELLS):
                if not len(part):
                    continue
                idx = lo[part][:, None] + np.arange(w)[None, :]
                inside = idx < hi[part][:, None]
                has = member[item[part][:, None], seq[np.where(inside, idx, 0)]] & inside
                total = np.concatenate([np.zeros((len(part), 1), dtype=np.int32), np.cumsum(has, axis=1, dtype=np.int32)], axis=1)
                span = int(self.window[item[part]].min())  # the windows of items of one width differ only where their phrases do
                span = span if span == self.window[item[part]].max() else int(w)
                full[part] = (total[:, span:] - total[:, : total.shape[1] - span]).max(axis=1) >= self.need[item[part]]
        item, lo, hi = item[full], lo[full], hi[full]
        masks_of: dict[int, dict[int, int]] = {}
        i = 0
        while i < len(item):
            k, a, b, d = int(item[i]), int(lo[i]), int(hi[i]), int(doc_of[lo[i]])
            i += 1
            while i < len(item) and item[i] == k and lo[i] <= b and doc_of[lo[i]] == d:  # overlapping windows are read once
                b = max(b, int(hi[i]))
                i += 1
            masks = masks_of.get(k)
            if masks is None:
                masks = masks_of[k] = {}
                for j, w in enumerate(self.codes[k]):
                    for s in of_word.get(w, ()):
                        masks[s] = masks.get(s, 0) | (1 << j)
            for first, stop, best in self._stretches(self.items[k], [masks.get(s, 0) for s in seq[a:b].tolist()]):
                yield d, k, a + first - int(start[d]), a + stop - int(start[d]), best

    @staticmethod
    def _stretches(item: Item, got: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first, end, words in order) of the stretches of a region that hold an item, overlapping ones merged."""
        m = len(item.words)
        last: tuple[int, int, int] | None = None
        for j in [j for j, x in enumerate(got) if x]:
            stretch = got[j : j + item.window]
            if len(stretch) - stretch.count(0) < item.need:
                continue
            best = in_order(stretch, m)
            if best < item.need:
                continue
            stop = j + max(x for x, y in enumerate(stretch) if y) + 1
            if last and j <= last[1]:
                last = (last[0], max(last[1], stop), max(last[2], best))
            else:
                if last:
                    yield last
                last = (j, stop, best)
        if last:
            yield last


def test_items(tables: list[DataFrame]) -> DataFrame:
    """(item_id, query) once each; null and blank queries are no items."""
    out = None
    for t in tables:
        rows = t.select(F.col("id").alias("item_id"), "query").where(F.col("item_id").isNotNull() & (F.trim("query") != ""))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", shard_words: int = SHARD_WORDS, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, in_order): every stretch of a document that holds a test item, overlapping stretches merged.

    The documents are mapped where they are, whole, in shards of about ``shard_words`` words, and only findings leave a task. The items
    travel with the tasks, at most about ``items_a_pass`` at a time: of more items each pass takes those of one hash, over all documents.
    Null and empty texts hold nothing. A document id that occurs twice is searched twice and may give equal rows.
    """
    passes = -(-items.count() // items_a_pass) or 1
    part = F.pmod(F.xxhash64("item_id", "query"), F.lit(passes))
    rows = docs.select("doc_id", text).where(F.length(text) > 0)
    return reduce(DataFrame.unionByName, (_one_pass(rows, items.where(part == i) if passes > 1 else items, text, shard_words, 2 * items_a_pass) for i in range(passes)))


def _one_pass(docs: DataFrame, items: DataFrame, text: str, shard_words: int, most: int) -> DataFrame:
    fixed = sorted((r["item_id"], r["query"]) for r in bounded_rows(items, most, "test items of a pass"))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanners = [Scanner(fixed[i : i + ITEMS_AN_INDEX]) for i in range(0, len(fixed), ITEMS_AN_INDEX)]
        ids: list = []
        held: list[list[str]] = []
        n = 0

        def flush() -> pd.DataFrame:
            rows = [(ids[d], s.items[k].id, a, b, w) for s in scanners for d, k, a, b, w in s.scan(held)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "end_word", "in_order"])
            return out.assign(doc_id=pd.Series(out["doc_id"].tolist(), dtype="Int64"))

        for part in parts:
            for i, t in zip(part["doc_id"].tolist(), part[text].tolist()):
                w = words(t)
                if not w:
                    continue
                ids.append(None if i is None or i != i else int(i))
                held.append(w)
                n += len(w)
                if n >= shard_words:
                    yield flush()
                    ids, held, n = [], [], 0
        if held:
            yield flush()

    return docs.mapInPandas(search, "doc_id long, item_id string, first_word int, end_word int, in_order int")


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, n_items): the stretches of all items of a document, merged where they overlap or touch."""

    def merge(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"), F.array_union(last["i"], s["i"]).alias("i"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("first_word").alias("a"), F.col("end_word").alias("b"), F.array("item_id").alias("i")))).alias("s"))
    none = F.array().cast("array<struct<a:int,b:int,i:array<string>>>")
    safe = lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(merge(acc, s))
    return spans.select("doc_id", F.explode(F.aggregate("s", none, safe)).alias("m")).select("doc_id", F.col("m.a").alias("first_word"), F.col("m.b").alias("end_word"), F.size("m.i").alias("n_items"))
