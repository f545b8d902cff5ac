"""Conversation: follow-ups, comparisons, classes, and what a question asks about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernwerk.functions.text import STOP_WORDS, squash

COMPARE_WORDS = ("compare", "compared", "comparison", "difference", "bigger", "larger", "smaller", "older", "younger", "taller", "longer", "faster", "than", "versus", "vs")


def attribute(query: Column, names: Column) -> Column:
    """What a comparison is about: the question without names, comparison words, function words and words of one or two letters."""
    q = F.aggregate(names, F.lower(query), lambda acc, n: F.replace(acc, F.lower(n), F.lit(" ")))
    drop = F.array(*[F.lit(w) for w in (*STOP_WORDS, *COMPARE_WORDS, "both", "between", "which")])
    return F.array_join(F.filter(F.split(q, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(drop, w)), " ")


def without_names(query: Column, names: Column) -> Column:
    return squash(F.aggregate(names, F.lower(query), lambda acc, n: F.replace(acc, F.lower(n), F.lit(" "))))


def reask(last: Column, follow_up: Column) -> Column:
    """A follow-up "And in Peru?" as the last question with its final phrase of the same preposition replaced; null where it does not apply."""
    prep = F.regexp_extract(F.lower(follow_up), r"^(?:and|what about|how about)?\s*(in|on|at|for|from|of|during)\s+", 1)
    rest = F.regexp_replace(F.regexp_replace(follow_up, r"(?i)^(?:and|what about|how about)\s+", ""), r"[?.!\s]+$", "")
    head = F.regexp_replace(F.trim(last), r"[?.!]+$", "")
    at = F.length(head) - F.length(F.call_function("substring_index", head, F.concat(F.lit(" "), prep, F.lit(" ")), F.lit(-1))) - F.length(prep) - 2
    return F.when((prep != "") & head.contains(F.concat(F.lit(" "), prep, F.lit(" "))), F.concat(F.substr(head, F.lit(1), at), F.lit(" "), rest, F.lit("?")))


def kind_match(a: Column, b: Column) -> Column:
    """1 if two class lists share a class, 0.5 if only a word of four letters or more, else 0."""
    words = lambda c: F.filter(F.flatten(F.transform(c, lambda x: F.split(x, r"[^\p{L}\p{N}]+"))), lambda w: F.length(w) >= 4)
    return F.when(F.arrays_overlap(a, b), 1.0).when(F.arrays_overlap(words(a), words(b)), 0.5).otherwise(0.0)


def classes(value: Column) -> Column:
    """The classes of an "instance of" value: parts at ", ", lower case."""
    return F.split(F.lower(value), ", ")


def outweighed_by_parts(part_views: Column, work_views: Column) -> Column:
    """A work "X and Y" loses if it has two parts or more and each has more views."""
    return (F.size(part_views) >= 2) & F.forall(part_views, lambda v: v > work_views)


def proper_name(title: Column) -> Column:
    """Two words or more, every one of four letters or more capitalised; a bracketed qualifier does not count."""
    w = F.filter(F.split(F.substring_index(title, " (", 1), r"\s+"), lambda x: x != "")
    return (F.size(w) > 1) & F.forall(F.filter(w, lambda x: F.length(x) >= 4), lambda x: x.rlike(r"^\p{Lu}"))


def qualified(title: Column) -> Column:
    return title.endswith(")") & title.contains(" (")


def shares_word(name: Column, title: Column) -> Column:
    """Whether a word that is no function word begins like a word of the title, in four letters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    heads = lambda c: F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~F.array_contains(stop, w)), lambda w: F.substring(w, 1, 4))
    return F.arrays_overlap(heads(name), heads(title))


def turn_kind(label: Column, has_history: Column, links: Column) -> Column:
    """question, reformat or chat, by the head's label: reformat needs history, chat must link to nothing."""
    return F.when((label == "reformat") & has_history, "reformat").when((label == "chat") & (links == 0), "chat").otherwise("question")


def is_complex(n_entities: Column, query: Column) -> Column:
    return (n_entities >= 2) | (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) > 14)


def sub_queries(questions: DataFrame) -> DataFrame:
    """One search for each compared entity: (query_id, part, query) from (query_id, query, names); part 0 is the question itself."""
    about = attribute(F.col("query"), F.col("names"))
    parts = F.when(F.size("names") >= 2, F.concat(F.array("query"), F.transform("names", lambda n: squash(F.concat_ws(" ", n, about))))).otherwise(F.array("query"))
    return questions.select("query_id", F.posexplode(parts).alias("part", "query"))


def resolve(turns: DataFrame) -> DataFrame:
    """(turn_id, search_query): each turn's question with what it inherits from the turn before, in order of the conversation.

    A question with its own names stands alone; one that only changes a phrase is asked again with it; one that only refers ("it", "they")
    takes the names of the turn before. Turns of a conversation meet by a window; no conversation is collected.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("conversation").orderBy("turn")
    rows = turns.withColumn("_q", F.lag("query").over(w)).withColumn("_n", F.last(F.when(F.size("names") > 0, F.col("names")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    refers = F.lower("query").rlike(r"\b(it|its|they|them|their|he|she|his|her|this|that|these|those)\b")
    again = reask(F.col("_q"), F.col("query"))
    text = F.when(again.isNotNull(), again).when((F.size("names") == 0) & refers & F.col("_n").isNotNull(), F.concat_ws(" ", F.array_join("_n", " "), "query")).otherwise(F.col("query"))
    return rows.select("turn_id", text.alias("search_query"))


def featured(margin: Column, span: Column, n_passages: Column, in_fact: Column) -> Column:
    """A snippet is shown if the reader is sure, the span is specific, and two passages or a fact hold it."""
    return (margin >= 3.0) & span.rlike(r"[\p{Lu}\p{N}]") & ((n_passages >= 2) | in_fact)
