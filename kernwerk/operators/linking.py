"""Which article a name means: senses of one name, the company it keeps in the question, and the things that a question compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernwerk.operators.conversation import kind_match, qualified

KIND_BONUS, VIEWS_PRIOR, MARGIN, SHARE = 2.0, 1.0, 1.0, 0.1


def disambiguate(candidates: DataFrame, mention: list[str], margin: float = MARGIN, share: float = SHARE) -> DataFrame:
    """One candidate of each mention, or none: the most viewed one of the name, unless the context clearly prefers another.

    ``candidates`` has the columns of ``mention``, name (normalised), lowercase, article_id, title, key (normalised title), popularity, score
    (of question and candidate) and kind (0 to 1: how its classes match those of the question's other names). A candidate has the same name
    if its key is the name, also with a bracketed qualifier; longer titles are other things, which win by context only. A lower-case mention
    takes neither. What has less than ``share`` of the first one's views drops out. A candidate must beat the first by ``margin``, where views
    weigh by the logarithm of their ratio among candidates of the name. Ties go to the more viewed, then to the smaller id.
    """
    same = (F.col("key") == F.col("name")) | F.startswith(F.col("key"), F.concat("name", F.lit(" (")))
    rows = candidates.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("lowercase") | (F.col("_same") & ~qualified(F.col("title"))))
    first = Window.partitionBy(*mention).orderBy(F.desc("_same"), F.desc("popularity"), "article_id")
    rows = rows.withColumn("_place", F.row_number().over(first)).withColumn("_top", F.first("popularity").over(first))
    rows = rows.where((F.col("_place") == 1) | (F.col("popularity") >= F.floor(F.col("_top") * share)))
    views = F.log(F.greatest("popularity", F.lit(1)) / F.greatest("_top", F.lit(1)).cast("double"))
    total = F.coalesce("score", F.lit(0.0)) + KIND_BONUS * F.coalesce("kind", F.lit(0.0)) + F.when(F.col("_same"), VIEWS_PRIOR * F.least(views, F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("_total", total).withColumn("_first", F.first("_total").over(first))
    clear = F.col("_total") >= F.col("_first") + margin
    pick = F.row_number().over(Window.partitionBy(*mention).orderBy(F.desc(F.when(clear, F.col("_total"))), "_place"))
    return rows.withColumn("_pick", pick).where("_pick = 1").select(*candidates.columns)


def link_in_context(candidates: DataFrame, passes: int = 3) -> DataFrame:
    """(query_id, start, article_id, …): one candidate of each mention (query_id, start), chosen in up to three passes.

    ``candidates`` is as for ``disambiguate``, with classes (array) in place of kind. The first pass looks at names and views alone; the next
    ones score each candidate, and prefer one whose classes match those that the pass before chose for the question's other names. A question
    has a few mentions, so its choices are listed.
    """
    blank = candidates.withColumn("kind", F.lit(0.0))
    chosen = disambiguate(blank.withColumn("score", F.lit(0.0)), ["query_id", "start"])
    for _ in range(passes - 1):
        around = chosen.groupBy("query_id").agg(F.collect_list(F.struct("start", "classes")).alias("_around"))
        match = F.aggregate("_around", F.lit(0.0), lambda acc, x: F.greatest(acc, F.when(x["start"] != F.col("start"), kind_match(F.col("classes"), x["classes"])).otherwise(0.0)))
        rows = candidates.join(around, "query_id", "left").withColumn("kind", F.coalesce(match, F.lit(0.0))).drop("_around")
        chosen = disambiguate(rows, ["query_id", "start"])
    return chosen.drop("kind")


def compared_things(entities: DataFrame) -> DataFrame:
    """The rows (query_id, article_id, classes) whose classes match those of another entity of the question: what it compares."""
    others = entities.groupBy("query_id").agg(F.collect_set(F.struct("article_id", "classes")).alias("_o"))
    paired = F.exists("_o", lambda x: (x["article_id"] != F.col("article_id")) & (kind_match(F.col("classes"), x["classes"]) > 0))
    return entities.join(others, "query_id").where(paired).drop("_o")
