"""Token ids of whole texts by a public byte-level BPE vocabulary, contracted by recursive queries inside each partition."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

DEFAULT_PATH = os.environ.get("KERNWERK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 256  #: bytes; longer words are merged by a heap, for the recursion's cost grows with the square of a word
_KEPT_WORDS = 400_000

CONTRACT = """
WITH RECURSIVE step AS (
  SELECT w, pos, id, false AS done FROM words
  UNION ALL
  SELECT w, pos, CASE WHEN pos = hit THEN m ELSE id END, best IS NULL FROM (
    SELECT *, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY w) AS hit FROM (
      SELECT p.*, g.rank, g.m, min(g.rank) OVER (PARTITION BY p.w) AS best
      FROM (SELECT w, pos, id, lead(id) OVER k AS next_id, lag(pos) OVER k AS last_pos FROM step WHERE NOT done WINDOW k AS (PARTITION BY w ORDER BY pos)) p
      LEFT JOIN merges g ON p.id = g.l AND p.next_id = g.r))
  WHERE hit IS NULL OR last_pos IS DISTINCT FROM hit)
SELECT w, list(id ORDER BY pos) AS ids FROM step WHERE done GROUP BY w
"""


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}


class Contractor:
    """The merge table and the words known so far; one for each Python worker."""

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.split = regex.compile(PATTERN).findall
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET memory_limit = '300MB'")
        self.con.execute("SET temp_directory = ''")  # a query that does not fit fails; nothing is spilled beside the worker
        table = pd.DataFrame([(a, b, r, m) for (a, b), (r, m) in self.merges.items()], columns=["l", "r", "rank", "m"], dtype="int32")
        self.con.register("_merges", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM _merges")
        self.con.unregister("_merges")
        byte_of = {c: b for b, c in byte_symbols().items()}
        pieces = pd.DataFrame({"id": pd.Series(list(vocab.values()), dtype="int32"), "piece": ["".join(f"{byte_of[c]:02x}" for c in t) if all(c in byte_of for c in t) else t.encode().hex() for t in vocab]})
        self.con.register("_pieces", pieces)
        self.con.execute("CREATE TABLE pieces AS SELECT * FROM _pieces")
        self.con.unregister("_pieces")
        self.known: dict[str, list[int]] = {}

    def decode(self, ids: list[list[int] | None]) -> list[str]:
        """The texts of id lists: token-position rows join the vocabulary, and one ordered aggregation joins each text's pieces. Unknown ids show nothing."""
        rows = [(d, p, i) for d, x in enumerate(ids) if x is not None for p, i in enumerate(x)]
        self.con.register("tokens", pd.DataFrame(rows, columns=["d", "pos", "id"], dtype="int32"))
        got = self.con.execute("SELECT d, string_agg(piece, '' ORDER BY pos) AS raw FROM tokens JOIN pieces USING (id) GROUP BY d").fetchall()
        self.con.unregister("tokens")
        texts = {d: bytes.fromhex(raw).decode("utf-8", "replace") for d, raw in got}
        return [texts.get(d, "") for d in range(len(ids))]

    def _heap(self, ids: list[int]) -> list[int]:
        """The same merges for one very long word: lowest rank first, leftmost among equals, in n log n."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and (got := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = m, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [x for x, ok in zip(ids, alive) if ok]

    def learn(self, words: set[str]) -> None:
        """Contract the words not yet known: token-position rows join the merge table, each round merges each word's leftmost pair of lowest rank."""
        todo = [w for w in words if w not in self.known]
        if len(self.known) + len(todo) > _KEPT_WORDS:
            self.known = {}
            todo = list(words)
        names, ws, pos, ids = [], [], [], []
        for w in todo:
            raw = [self.first[b] for b in w.encode("utf-8", "replace")]
            if len(raw) > LONG_WORD:
                self.known[w] = self._heap(raw)
            else:
                ws += [len(names)] * len(raw)
                pos += range(len(raw))
                ids += raw
                names.append(w)
        if names:
            self.con.register("words", pd.DataFrame({"w": pd.Series(ws, dtype="int32"), "pos": pd.Series(pos, dtype="int32"), "id": pd.Series(ids, dtype="int32")}))
            got = self.con.execute(CONTRACT).fetchnumpy()
            self.con.unregister("words")
            for w, x in zip(got["w"], got["ids"]):
                self.known[names[w]] = [int(i) for i in x]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        self.learn({w for s in split for w in s})
        known = self.known
        return [[i for w in s for i in known[w]] for s in split]


@lru_cache(maxsize=2)
def contractor(path: str) -> Contractor:
    return Contractor(path)


def ids_udf(path: str, batch: int = 2000):
    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = contractor(path)
        for texts in parts:
            values, out = texts.tolist(), []
            for i in range(0, len(values), batch):
                out += c.encode(values[i : i + batch])
            yield pd.Series(out, dtype="object")

    return ids


def text_udf(path: str, most: int = 500_000):
    @F.pandas_udf(StringType())
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = contractor(path)
        for ids in parts:
            out: list[str] = []
            held: list = []
            n = 0
            for x in ids.tolist():
                held.append(x)
                n += 0 if x is None else len(x)
                if n >= most:
                    out += c.decode(held)
                    held, n = [], 0
            yield pd.Series(out + c.decode(held), dtype="object")

    return texts


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", tokenizers: str = DEFAULT_PATH, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the text of each list of token ids; null and empty lists give an empty text. The inverse of ``encode``, but for lone surrogates."""
    return rows.withColumn(out, text_udf(f"{tokenizers}/{vocabulary}")(F.col(ids)))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", tokenizers: str = DEFAULT_PATH, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the token ids of each whole text, without special tokens; text that looks like one is ordinary text.

    Null and empty texts give an empty list. Lone surrogates, which UTF-8 cannot hold, count as question marks. A map over partitions: no
    shuffle, and every worker contracts each distinct word only once.
    """
    return docs.withColumn(out, ids_udf(f"{tokenizers}/{vocabulary}")(F.col(text)))
