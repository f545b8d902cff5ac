"""Cutting oversized blocks at natural boundaries, with overlap, by pointer doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MAX_WORDS, MAX_CHARS, OVERLAP = 220, 2000, 24
#: Word separators: spaces, tabs, line ends and no-break spaces.
BLANK = r"[ \t\r\n\u00a0]"
_WORD = re.compile("[^ \t\r\n\u00a0]+")
_SENTENCE_END = tuple(".!?。！？…")
_CLOSING = "\"'”’)]»*_"
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 3, 2, 1, 0, -1
FRAGMENT = 100  #: characters; longer words are made of such fragments
_SLICE = 256  #: blocks worked on at once; it bounds memory, not results


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda x: x != ""))


def is_oversized(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """More words or more characters (code points) than the limits. Null is not."""
    return F.coalesce((F.length(text) > max_chars) | (n_words(text) > max_words), F.lit(False))


def _units(text: str, fragment: int) -> tuple[list[int], list[int], list[int]]:
    """Start, end and class of the boundary after each word. A word longer than ``fragment`` may be cut inside, as a last resort."""
    starts, ends, kinds = [], [], []
    for m in _WORD.finditer(text):
        s, e = m.span()
        if starts:
            gap = text[ends[-1] : s]
            lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
            last = text[max(ends[-1] - 6, starts[-1]) : ends[-1]].rstrip(_CLOSING)
            kinds.append(PARAGRAPH if lines > 1 else LINE if lines else SENTENCE if last.endswith(_SENTENCE_END) else WORD)
        while e - s > fragment:
            starts.append(s)
            ends.append(s + fragment)
            kinds.append(INSIDE)
            s += fragment
        starts.append(s)
        ends.append(e)
    kinds.append(PARAGRAPH)
    return starts, ends, kinds


def cut_spans(texts: list[str], max_words: int, max_chars: int, overlap: int) -> list[list[tuple[int, int, int, int]]]:
    """(start, end, words, overlapping words with the piece before) of the pieces of each text.

    The overlap is ``overlap`` words, but at most half of a piece, so that pieces of few words still move on. In a word of more than FRAGMENT
    characters the overlap counts fragments.

    Every word of every text is a node. One vectorised step joins each node to its farthest legal cut (both limits), moves that cut back to
    the best natural boundary, and thence, minus the overlap, to the node where the next piece starts: its successor. Squaring the successor
    table doubles the reach of the start nodes each time, so that all greedy cuts of all texts are found in log2(pieces) steps at once.
    """
    units = [_units(t, min(FRAGMENT, max_chars)) for t in texts]
    size = [len(u[0]) for u in units]
    n = sum(size)
    if not n:
        return [[] for _ in texts]
    first = np.cumsum([0, *size])[:-1]
    starts, ends, kinds = (np.concatenate([np.asarray(u[k][:m], dtype=np.int64) for u, m in zip(units, size)]) for k in range(3))
    block = np.repeat(np.arange(len(texts)), size)
    stop = (first + size)[block]  # one past the last node of the text
    node = np.arange(n)
    shift = block * (int(ends.max()) + max_chars + 2)  # texts one after the other on one axis, so that one search serves all
    farthest = np.minimum(np.searchsorted(ends + shift, starts + shift + max_chars, side="right"), np.minimum(node + max_words, stop))
    farthest = np.maximum(farthest, node + 1)

    def last_cut(kind: int) -> np.ndarray:
        """For every position p in 0..n: the last cut c <= p whose boundary (after node c-1) is at least of this kind."""
        at = np.where(np.concatenate([[0], kinds]) >= kind, np.arange(n + 1), -1)
        return np.maximum.accumulate(at)

    ended = farthest == stop
    cut = np.where(ended, farthest, -1)
    new = node + overlap + 1  # a piece must reach beyond the words that it may share with the one before
    low = np.maximum(new, node + (farthest - node) // 2)  # first, any natural boundary in the second half of the reach, the strongest first
    for kind, least in ((PARAGRAPH, low), (LINE, low), (SENTENCE, low), (PARAGRAPH, new), (LINE, new), (SENTENCE, new), (WORD, low)):
        found = last_cut(kind)[farthest]
        cut = np.where((cut < 0) & (found >= least), found, cut)
    cut = np.where(cut < 0, farthest, cut)
    reaching = np.searchsorted(farthest, cut + 1)  # the first node whose piece can hold the word after the cut
    succ = np.where(cut == stop, n, np.maximum(cut - np.minimum(overlap, (cut - node) // 2), reaching))
    jump = np.append(succ, n)
    reached = np.zeros(n + 1, dtype=bool)
    reached[first[np.asarray(size) > 0]] = True
    while True:
        before = int(reached.sum())
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        if int(reached.sum()) == before:
            break
    begins = np.concatenate([[True], kinds[:-1] != INSIDE])  # the fragment is the first of its word
    so_far = np.concatenate([[0], np.cumsum(begins)])
    words = lambda a, b: int(so_far[b] - so_far[a] + (b > a and not begins[a]))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    prev_block, prev_cut = -1, 0
    for i in np.flatnonzero(reached[:n]):
        b = int(block[i])
        shared = max(0, prev_cut - i) if b == prev_block else 0
        out[b].append((int(starts[i]), int(ends[cut[i] - 1]), words(i, cut[i]), words(i, i + shared)))
        prev_block, prev_cut = b, int(cut[i])
    return out


SPANS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "end", "n_words", "n_overlap")]))


def spans_udf(max_words: int, max_chars: int, overlap: int):
    @F.pandas_udf(SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            values, got = texts.tolist(), []
            for i in range(0, len(values), _SLICE):
                got += [[dict(zip(("start", "end", "n_words", "n_overlap"), s)) for s in p] or [{"start": 0, "end": 0, "n_words": 0, "n_overlap": 0}] for p in cut_spans(values[i : i + _SLICE], max_words, max_chars, overlap)]
            yield pd.Series(got)

    return spans


def blocks_of(sections: DataFrame) -> DataFrame:
    """(section_id, article_id, block_no, block): every element of every list by its position from 0, null and empty ones counted in the position."""
    return sections.select("section_id", "article_id", F.posexplode("blocks").alias("block_no", "block"))


def oversized_pieces(sections: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (section_id, article_id, block_no, piece_no, start, end, n_words, n_overlap, text) of the oversized blocks.

    Only these go through Python; a block of blanks alone gives one empty piece. Two texts of one (section_id, block_no) both give pieces.
    A piece has at most ``max_words`` words and ``max_chars`` characters, also where a single word is longer than that.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be smaller than max_words")
    big = blocks_of(sections).where(is_oversized(F.col("block"), max_words, max_chars))
    cut = big.withColumn("_spans", spans_udf(max_words, max_chars, overlap)(F.col("block")))
    rows = cut.select("section_id", "article_id", "block_no", "block", F.posexplode("_spans").alias("piece_no", "s"))
    text = F.substring(F.col("block"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select("section_id", "article_id", "block_no", "piece_no", "s.start", "s.end", "s.n_words", "s.n_overlap", text.alias("text"))


def audit(sections: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(section_id, block_no, within_limits, covered, overlapping) of the oversized blocks, checked from the cut positions alone.

    Within the limits: every piece has at most ``max_words`` words and ``max_chars`` characters. Covered: nothing but blanks lies outside the
    pieces. Overlapping: each piece but the first begins before the one before it ends, with at least the words asked for or half of those of
    that piece (a word cut inside counts by its fragments, so there it is enough that the pieces touch). A map: no shuffle.
    """
    big = blocks_of(sections).where(is_oversized(F.col("block"), max_words, max_chars))
    cut = big.withColumn("_s", spans_udf(max_words, max_chars, overlap)(F.col("block")))
    part = lambda a, b: F.substring(F.col("block"), a + 1, F.greatest(b - a, F.lit(0)))
    blank = lambda a, b: F.regexp_replace(part(a, b), BLANK, "") == ""
    within = F.forall("_s", lambda s: (n_words(part(s["start"], s["end"])) <= max_words) & (s["end"] - s["start"] <= max_chars))
    pairs = F.arrays_zip(F.slice("_s", 1, F.size("_s") - 1).alias("a"), F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))).alias("b"))
    first, last = F.element_at("_s", 1), F.element_at("_s", -1)
    covered = blank(F.lit(0), first["start"]) & blank(last["end"], F.length("block")) & F.forall(pairs, lambda p: blank(p["a"]["end"], p["b"]["start"]))
    shared = lambda p: n_words(part(p["b"]["start"], p["a"]["end"]))
    long_word = F.col("block").rlike(f"[^ \\t\\r\\n\u00a0]{{{FRAGMENT + 1},}}")
    overlapping = F.forall(pairs, lambda p: (shared(p) >= F.least(F.lit(overlap), F.floor(p["a"]["n_words"] / 2))) | (long_word & (p["b"]["start"] <= p["a"]["end"])))
    return cut.select("section_id", "block_no", within.alias("within_limits"), covered.alias("covered"), overlapping.alias("overlapping")).distinct()


def passage_counts(sections: DataFrame, articles: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(article_id, n_passages, n_stated): passages counted from the pieces, beside the largest stated count; 0 for an article without sections.

    A block within the limits is one passage; null and blank blocks are none. Repeated rows of a section or an article count once.
    """
    size = n_words(F.col("block"))
    small = blocks_of(sections).where(F.col("block").isNotNull() & ~is_oversized(F.col("block"), max_words, max_chars) & (size > 0)).select("section_id", "article_id", "block_no", F.lit(0).alias("piece_no"))
    large = oversized_pieces(sections, max_words, max_chars, overlap).where(F.col("n_words") > 0).select("section_id", "article_id", "block_no", "piece_no")
    counted = small.unionByName(large).distinct().groupBy("article_id").agg(F.count("*").alias("n"))
    stated = articles.where(F.col("article_id").isNotNull()).groupBy("article_id").agg(F.max("n_passages").cast("long").alias("n_stated"))
    return stated.join(counted, "article_id", "left").select("article_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_passages"), "n_stated")
