"""Evaluation analytics over prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import arrays as A
from corpuskit.functions import text as T

LETTERS = ("A", "B", "C", "D", "E")
# The order in which labels are looked for in an answer, and their signs.
NLI_LABELS = ("entailment", "contradiction", "neutral")
SENTIMENTS = (("positive", ("positive", "ポジティブ")), ("negative", ("negative", "ネガティブ")))
# Subject groups of the multiple-choice benchmark.
CATEGORIES = {
    "STEM": (
        "abstract_algebra",
        "anatomy",
        "astronomy",
        "college_biology",
        "college_chemistry",
        "college_computer_science",
        "college_mathematics",
        "college_physics",
        "computer_security",
        "conceptual_physics",
        "electrical_engineering",
        "elementary_mathematics",
        "high_school_biology",
        "high_school_chemistry",
        "high_school_computer_science",
        "high_school_mathematics",
        "high_school_physics",
        "high_school_statistics",
        "machine_learning",
    ),
    "Humanities": (
        "formal_logic",
        "high_school_european_history",
        "high_school_us_history",
        "high_school_world_history",
        "international_law",
        "jurisprudence",
        "logical_fallacies",
        "moral_disputes",
        "moral_scenarios",
        "philosophy",
        "prehistory",
        "professional_law",
        "world_religions",
    ),
    "Social Sciences": (
        "econometrics",
        "high_school_geography",
        "high_school_government_and_politics",
        "high_school_macroeconomics",
        "high_school_microeconomics",
        "high_school_psychology",
        "human_sexuality",
        "professional_psychology",
        "public_relations",
        "security_studies",
        "sociology",
        "us_foreign_policy",
    ),
    "Other": (
        "business_ethics",
        "clinical_knowledge",
        "college_medicine",
        "global_facts",
        "human_aging",
        "management",
        "marketing",
        "medical_genetics",
        "miscellaneous",
        "nutrition",
        "professional_accounting",
        "professional_medicine",
        "virology",
    ),
}


def _f1(overlap: Column, predicted: Column, wanted: Column) -> Column:
    precision, recall = overlap / predicted, overlap / wanted
    f1 = 2 * precision * recall / (precision + recall)
    return F.when((predicted == 0) & (wanted == 0), 1.0).when((predicted == 0) | (wanted == 0) | (overlap == 0), 0.0).otherwise(f1)


def _count(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def char_f1(prediction: Column, reference: Column) -> Column:
    """F1 over characters as multisets, of texts already in comparison form.

    The work grows with the length times the number of distinct characters.
    """

    def score(p: Column, r: Column) -> Column:
        shared = F.aggregate(F.array_distinct(A.characters(p)), F.lit(0), lambda n, c: n + F.least(_count(p, c), _count(r, c)))
        return A.let(shared, lambda k: _f1(k, F.length(p), F.length(r)))

    return A.let(prediction, lambda p: A.let(reference, lambda r: score(p, r)))


def char_f1_loose(prediction: Column, reference: Column) -> Column:
    """F1 that counts every predicted character which occurs in the reference; recall may pass 1."""

    def score(p: Column, r: Column) -> Column:
        shared = F.aggregate(F.array_distinct(A.characters(p)), F.lit(0), lambda n, c: n + F.when(F.contains(r, c), _count(p, c)).otherwise(0))
        return A.let(shared, lambda k: _f1(k, F.length(p), F.length(r)))

    return A.let(prediction, lambda p: A.let(reference, lambda r: score(p, r)))


def exact(prediction: Column, reference: Column) -> Column:
    return F.when(prediction == reference, 1.0).otherwise(0.0)


def best(score, prediction: Column, answers: Column) -> Column:
    """The highest score over an array of reference answers; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(answers, lambda a: score(prediction, a))), F.lit(0.0))


def nli_label(answer: Column) -> Column:
    """First known label that the lower-cased answer contains."""
    low = F.lower(answer)
    return reduce(lambda c, x: c.when(low.contains(x), x), NLI_LABELS[1:], F.when(low.contains(NLI_LABELS[0]), NLI_LABELS[0]))


def letter(answer: Column, n: int = 5) -> Column:
    """Letter with which the trimmed upper-cased answer starts, one of the first ``n``."""
    first = F.left(F.upper(T.strip(answer)), F.lit(1))
    return F.when(first.isin(*LETTERS[:n]), first)


def sentiment(answer: Column) -> Column:
    low, found = F.lower(answer), None
    for name, signs in SENTIMENTS:
        hit = reduce(lambda a, b: a | b, [low.contains(s) for s in signs])
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def accuracy(rows: DataFrame, by: list[str], right: str = "correct") -> DataFrame:
    """``n`` and ``accuracy`` per group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(right).cast("double")).alias("accuracy"))


def category_of(subject: Column) -> Column:
    pairs = [F.lit(x) for c, names in CATEGORIES.items() for s in names for x in (s, c)]
    return F.try_element_at(F.create_map(*pairs), subject)


def grouped_accuracy(rows: DataFrame, subject: str = "subject", category: str = "category", right: str = "correct") -> DataFrame:
    """``(level, name, n, accuracy)`` per subject, per category (rows with one) and overall."""
    sets = rows.groupingSets([[subject], [category], []], subject, category).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(right).cast("double")).alias("accuracy"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 1, "subject").when(F.col("g") == 2, "category").otherwise("overall")
    name = F.when(F.col("g") == 1, F.col(subject)).when(F.col("g") == 2, F.col(category))
    return sets.select(level.alias("level"), name.alias("name"), "n", "accuracy").where("level = 'overall' OR name IS NOT NULL")


def by_subject(rows: DataFrame) -> DataFrame:
    """Accuracies in the order of a report: subjects by name, then categories, then overall."""
    place = F.when(F.col("level") == "subject", 0).when(F.col("level") == "category", 1).otherwise(2)
    return rows.orderBy(place, "name")


def few_shot(rows: DataFrame, n: int, order: str, by: str | None = "subject") -> DataFrame:
    """The first ``n`` rows of each group in order, found by merging bounded lists; all columns kept."""
    if by is None:
        return rows.orderBy(order).limit(n)
    # Bounded lists of order keys merge before the shuffle, so no group is gathered whole.
    keys = rows.groupBy(by, F.pmod(F.xxhash64(order), F.lit(64)).alias("__salt")).agg(F.slice(F.sort_array(F.collect_list(order)), 1, n).alias("__k"))
    keys = keys.groupBy(by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("__k"))), 1, n).alias("__k")).select(F.col(by).alias("__by"), F.explode("__k").alias("__o"))
    return rows.join(keys, F.col(by).eqNullSafe(F.col("__by")) & (F.col(order) == F.col("__o")), "left_semi")


def best_choice(scores: DataFrame, item: str, label: str = "label", score: str = "score") -> DataFrame:
    """Highest-scored label of each item; the first label wins a tie."""
    order = Window.partitionBy(item).orderBy(F.desc(score), label)
    return scores.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")


def extract_fields(samples: DataFrame) -> DataFrame:
    """``x_question, x_choices, x_answer, x_subject`` of each row from whichever of the known fields it has a value in.

    Question: first non-empty of question, input, text. Choices: ``choices``, else A to D, else
    choice_a to choice_d, else option_a to option_d, the first of which that any field of the row has; four
    blanks unless there are exactly four values. Answer: answer, target or label, a letter or a number, 0 if
    neither. Subject: subject, category or ``unknown``. Null and absent fields are alike.
    """
    have = set(samples.columns)
    first = lambda names, last: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in have], F.lit(last))
    none = F.lit(None).cast("array<string>")
    groups = [F.col("choices")] if "choices" in have else []
    for names in ("ABCD", [f"choice_{x}" for x in "abcd"], [f"option_{x}" for x in "abcd"]):
        if own := [F.col(c).cast("string") for c in names if c in have]:
            values = F.filter(F.array(*own), lambda x: x.isNotNull())
            groups.append(F.when(F.size(values) > 0, values))
    choices = F.coalesce(*groups, none)
    choices = F.when(F.size(choices) == 4, choices).otherwise(F.array(*[F.lit("")] * 4))
    raw = F.upper(F.coalesce(*[F.col(c).cast("string") for c in ("answer", "target", "label") if c in have], F.lit("0")))
    place = F.array_position(F.array(*[F.lit(x) for x in LETTERS[:4]]), raw)
    answer = F.when(place > 0, place - 1).otherwise(F.coalesce(raw.try_cast("int"), F.lit(0))).cast("int")
    return samples.select("*", first(("question", "input", "text"), "").alias("x_question"), choices.alias("x_choices"), answer.alias("x_answer"), first(("subject", "category"), "unknown").alias("x_subject"))


# Prompt formats; fixed values.
def nli_prompt(premise: Column, hypothesis: Column, label: Column | None = None) -> Column:
    text = F.concat(F.lit("前提: "), premise, F.lit("\n仮説: "), hypothesis, F.lit("\n関係:"))
    return text if label is None else F.concat(text, F.lit(" "), label, F.lit("\n\n"))


def reading_prompt(context: Column, question: Column, answer: Column | None = None) -> Column:
    text = F.concat(F.lit("文脈: "), context, F.lit("\n質問: "), question, F.lit("\n回答:"))
    return text if answer is None else F.concat(text, F.lit(" "), answer, F.lit("\n\n"))


READING_HEADER = "以下の文脈に基づいて質問に答えてください。回答は文脈中の表現をそのまま使ってください。\n\n"


def lettered(choices: Column, separator: str) -> Column:
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("("), F.get(letters, i), F.lit(") "), c)), separator)


def commonsense_prompt(question: Column, choices: Column, answer: Column | None = None) -> Column:
    text = F.concat(F.lit("質問: "), question, F.lit("\n選択肢: "), lettered(choices, " "), F.lit("\n回答:"))
    return text if answer is None else F.concat(text, F.lit(" "), answer, F.lit("\n\n"))


def sentiment_prompt(text: Column, label: Column | None = None) -> Column:
    text = F.concat(F.lit("レビュー: "), text, F.lit("\n感情:"))
    return text if label is None else F.concat(text, F.lit(" "), label, F.lit("\n\n"))


def choice_question(question: Column, choices: Column, answer: Column | None = None) -> Column:
    text = F.concat(F.lit("質問: "), question, F.lit("\n"), lettered(choices, "\n"), F.lit("\n回答:"))
    return text if answer is None else F.concat(text, F.lit(" "), answer, F.lit("\n\n"))


def choice_header(subject: Column) -> Column:
    return F.concat(F.lit("以下は"), T.subject_title(subject), F.lit("に関する問題です。最も適切な回答をA、B、C、Dの中から選んでください。\n\n"))


def prompts(rows: DataFrame, shots: DataFrame, order: str, by: str, shot: Column, ask: Column, header: Column) -> DataFrame:
    """Adds ``prompt``: header, the group's example prompts in order (none for a group without) and the question.

    ``shots`` holds a bounded number of examples per group.
    """
    pool = shots.select(F.col(by).alias("__by"), F.struct(F.col(order).alias("at"), shot.alias("text")).alias("__shot"))
    pool = pool.groupBy("__by").agg(F.array_join(F.transform(F.sort_array(F.collect_list("__shot")), lambda s: s.text), "").alias("__shots"))
    joined = rows.join(pool, F.col(by) == F.col("__by"), "left")
    return joined.withColumn("prompt", F.concat(header, F.coalesce("__shots", F.lit("")), ask)).drop("__by", "__shots")


def macro_score(tasks: DataFrame) -> DataFrame:
    """Mean over tasks of accuracy, or of F1 where there is no accuracy."""
    return tasks.agg(F.avg(F.coalesce("accuracy", "f1")).alias("aggregate_score"))


def summary(results: DataFrame) -> DataFrame:
    """First score that each benchmark without an error reports."""
    score = F.coalesce("aggregate_score", "accuracy", "mean_perplexity", "overall_accuracy")
    return results.where("error IS NULL").select("benchmark", score.alias("score")).where("score IS NOT NULL")


def metric_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"))
