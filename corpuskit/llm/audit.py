"""Filter interaction audit: every order of a set of filters, replayed on every document.

A document's outcome in an order follows from the set of filters it fails, a bit mask. Each mask is
crossed with the table of orders, which has a row for each permutation (120 of five filters) and is
broadcast; the five steps of an order are exploded, the first failing step is compared with each,
and counts are added up on the map side, so that only a row per part, order and step and task is
shuffled. Texts are read once: a table of masks, which holds no text, is cut before the replay.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.plans.durable import cut

#: Words are maximal runs of anything else.
BLANKS = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: str = "text", words: str = "words") -> dict[str, Column]:
    """Failure conditions on a text and its array of words, by letter."""
    n, distinct, own = F.size(words), F.size(F.array_distinct(words)), F.col(text)
    return {
        "A": n < 100,
        "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(own, F.lit("[A-Z]")).cast("long") > 10 * F.length(own).cast("long"),
        "D": own.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic)``, a row per document; bit i of the mask is set if it fails the i-th filter.

    The last filter, E, fails texts that equal that of any smaller id. Each text's smallest id is found
    by a digest, and a document is that first one or not by digest and id together, which copies do
    not share, so a text of many copies is dealt over all tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures().values())), F.lit(0))
    rows = cut(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low")).withColumnRenamed("digest", "digest2")
    rows = rows.join(firsts, (F.col("digest") == F.col("digest2")) & (F.col("id") == F.col("low")), "left")
    copy = F.when(F.col("id").isNotNull() & F.col("low").isNull(), 1 << len(failures())).otherwise(0)
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id2"))
    marks = of.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.select("id", "part", (F.col("mask") + copy).alias("mask")).join(marks, F.col("id") == F.col("id2"), "left")
    return rows.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """``(filter_order, bits)``: every permutation and the filters' bits in it."""
    found = ["".join(p) for p in itertools.permutations(letters)]
    return spark.createDataFrame([(p, [1 << letters.index(x) for x in p]) for p in found], "filter_order string, bits array<int>")


def replay(marked: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of masks."""
    n = len(letters)
    mask = F.col("mask")
    crossed = marked.crossJoin(F.broadcast(orders(marked.sparkSession, letters)))
    failing = [F.when(mask.bitwiseAND(F.get("bits", F.lit(i))) != 0, i + 1) for i in range(n)]
    crossed = crossed.withColumn("first", F.coalesce(*failing, F.lit(n + 1)))
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    step, fails = F.col("at") + 1, mask.bitwiseAND(F.col("bit")) != 0
    removed = F.col("first") == step
    cases = (F.col("first") > step, removed, fails & (F.col("first") < step), mask == F.col("bit"), removed & F.col("good"), removed & F.col("toxic"))
    counts = steps.groupBy("part", "filter_order", step.alias("step")).agg(*[F.count_if(c).alias(name) for c, name in zip(cases, COUNTS)])
    by_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(by_filter))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts of each part, filter order and step, zeros included.

    Null text is empty and equals empty text; a null part is the empty string. A document without an
    id is no copy of any and none is a copy of it; rows that repeat an id and its text are no copies
    of each other. A document has a label if any row of ``labels`` with its id has it; a null label
    is none. No documents give no rows. Other columns have no part in it.
    """
    return replay(masks(docs, labels, id_col, text_col, part_col))
