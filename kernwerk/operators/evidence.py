"""The numbered evidence of a question: passages or their cards within a budget, then facts by entity, then computed lines; and its text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kernwerk.functions import prose
from kernwerk.functions.text import numbers

ENTITY_TOKENS, LINE_TOKENS = 14, 2
_PICK = ArrayType(StructType([StructField("place", IntegerType()), StructField("shown", StringType())]))


def assemble(hits: DataFrame, facts: DataFrame, computed: DataFrame, budget: int, dated: str = "") -> DataFrame:
    """(query_id, sources, facts, computed, numbers) of each question that has any evidence.

    ``hits`` has query_id, query, rank, pid, title, section, pack, text and cards (array, may be null or empty); ``facts`` has query_id, ord,
    entity, line; ``computed`` has query_id, ord, line. The facts of an entity are one source after the passages, and what they cost is spent
    before the first passage. A hit shows its cards if it has any, else the window of its text; one that does not fit is skipped, the first is
    always taken. ``numbers`` are those of whole passages, titles and lines, and of the facts' date.
    """

    @F.pandas_udf(_PICK)
    def pick(texts: pd.Series, queries: pd.Series, spent: pd.Series) -> pd.Series:
        out = []
        for rows, q, used in zip(texts.tolist(), queries.tolist(), spent.tolist()):
            shown = ["\n".join(f"- {c}" for c in r["cards"]) if r["cards"] is not None and len(r["cards"]) else prose.sentence_window(r["text"], q or "") for r in rows]
            out.append([{"place": i, "shown": s} for i, s in prose.fitting(shown, budget, int(used))])
        return pd.Series(out, dtype="object")

    cost = lambda c: F.call_function("ceil", (F.octet_length(c) - F.regexp_count(c, F.lit("[0-9]"))) / 4).cast("int") + F.regexp_count(c, F.lit("[0-9]"))
    lines = facts.groupBy("query_id", "entity").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    grouped = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "entity", F.transform("l", lambda x: x["line"]).alias("lines")))).alias("facts"))
    spent = F.aggregate("facts", F.lit(0), lambda acc, g: acc + cost(g["entity"]) + ENTITY_TOKENS + F.aggregate(g["lines"], F.lit(0), lambda a, x: a + cost(x) + LINE_TOKENS))
    worked = computed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("computed"))
    listed = hits.groupBy("query_id").agg(F.max("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "pid", "title", "section", "pack", F.coalesce("text", F.lit("")).alias("text"), "cards"))).alias("h"))  # a pool: some dozen hits
    rows = listed.join(grouped, "query_id", "full").join(worked, "query_id", "full")
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    rows = rows.select("query_id", "query", none(F.col("h"), listed.schema["h"].dataType).alias("h"), none(F.col("facts"), grouped.schema["facts"].dataType).alias("facts"), none(F.col("computed"), "array<string>").alias("computed"))
    got = rows.withColumn("p", pick(F.transform("h", lambda x: F.struct(x["text"].alias("text"), x["cards"].alias("cards"))), F.col("query"), spent))
    source = lambda p, i: F.struct((i + 1).alias("n"), *[F.get("h", p["place"])[c].alias(c) for c in ("pid", "title", "section", "pack", "text")], p["shown"].alias("shown"))
    got = got.withColumn("sources", F.transform("p", source))
    said = F.concat(F.flatten(F.transform("sources", lambda s: F.array(s["text"], s["title"]))), F.flatten(F.transform("facts", lambda g: g["lines"])), F.when(F.size("facts") > 0, F.array(F.lit(dated))).otherwise(F.array().cast("array<string>")))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(said, lambda s: s.isNotNull()), lambda s: numbers(s)))))
    return got.select("query_id", "query", "sources", "facts", "computed", found.alias("numbers"))


def render(evidence: DataFrame, fact_pack: str = "wikidata", dated: str = "") -> DataFrame:
    """``evidence`` with its text: "[n] Title — Section (pack):" blocks, fact blocks with their date, and COMPUTED lines."""
    head = lambda s: F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), s["title"], F.when(F.coalesce(s["section"], F.lit("")) != "", F.concat(F.lit(" — "), s["section"])).otherwise(""), F.lit(" ("), s["pack"], F.lit("):\n"))
    blocks = F.transform("sources", lambda s: F.concat(head(s), s["shown"]))
    known = F.transform("facts", lambda g, i: F.concat(F.lit("["), (F.size("sources") + i + 1).cast("string"), F.lit("] "), g["entity"], F.lit(f" ({fact_pack}, as of {dated}):\n"), F.array_join(F.transform(g["lines"], lambda x: F.concat(F.lit("- "), x)), "\n")))
    worked = F.when(F.size("computed") > 0, F.array(F.array_join(F.transform("computed", lambda x: F.concat(F.lit("COMPUTED: "), x)), "\n"))).otherwise(F.array().cast("array<string>"))
    return evidence.withColumn("evidence", F.array_join(F.concat(blocks, known, worked), "\n\n"))
