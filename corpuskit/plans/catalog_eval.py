"""Registered queries of mixing, scoring, perplexity, chat, sampling and training analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import chat, cursor, mixing, perplexity, sampling, scoring, tokenizer_metrics, tokens, training
from corpuskit.plans import durable, pipeline
from corpuskit.plans.catalog import JUDGED, LATIN_LIMITS, char_tokens, load, query, sql_clean, sql_ratio
from corpuskit.sources import readers
from corpuskit.streaming import clean as streaming

# Mixing -------------------------------------------------------------------------------------

DEFAULTS = {f"src{i}": float(i + 1) for i in range(5)}
CURRICULUM = [
    {"until_step": 300, "weights": {"src0": 1.0, "src1": 1.0}},
    {"until_step": 200, "weights": {"src4": 1.0}},
    {"until_step": 700, "weights": {"src1": 2.0, "src2": 1.0, "src3": 1.0}},
    {"until_step": 800, "weights": {"src4": 3.0, "src3": 1.0}},
]
_STAGES = """stage(stage, low, high, source, weight) AS (VALUES (0, 0, 300, 'src0', 1.0), (0, 0, 300, 'src1', 1.0), (2, 300, 700, 'src1', 2.0), (2, 300, 700, 'src2', 1.0), (2, 300, 700, 'src3', 1.0),
    (3, 700, NULL, 'src4', 3.0), (3, 700, NULL, 'src3', 1.0))"""
_UNIT = "CAST(('0x' || left(md5({}), 8)) AS BIGINT) / 4294967296.0"


def curriculum(spark: SparkSession) -> DataFrame:
    return mixing.stages(spark, CURRICULUM, DEFAULTS)


@query("m_weights", "SELECT source, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def m_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return mixing.normalised(sizes).withColumn("weight", F.round("weight", 6))


@query("m_curriculum", f"WITH {_STAGES} SELECT step, CAST(stage AS INTEGER) AS stage, source, CAST(round(weight / sum(weight) OVER (PARTITION BY step), 6) AS DOUBLE) AS weight FROM range(1000) s(step), stage WHERE step >= low AND (high IS NULL OR step < high)")
def m_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(1000).withColumnRenamed("id", "step")
    return mixing.weights_at(steps, curriculum(spark)).withColumn("weight", F.round("weight", 6))


_PLACED = f"""{_STAGES}, cum AS (SELECT stage, low, high, source, sum(weight) OVER o / sum(weight) OVER (PARTITION BY stage) AS to_u, (sum(weight) OVER o - weight) / sum(weight) OVER (PARTITION BY stage) AS from_u FROM stage WINDOW o AS (PARTITION BY stage ORDER BY source)),
u AS (SELECT i, {_UNIT.format("'42:s:' || i")} AS u FROM range(2000) r(i)),
draw AS (SELECT i, source, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS k FROM u JOIN cum ON i >= low AND (high IS NULL OR i < high) AND u >= from_u AND u < to_u),
sized AS (SELECT source, count(*) AS n FROM documents GROUP BY source), placed AS (SELECT i, source, k // n AS epoch, k % n AS pos FROM draw JOIN sized USING (source))"""
_DRAWS = f"""{_PLACED},
pool AS (SELECT p.source, p.epoch, doc_id, row_number() OVER (PARTITION BY p.source, p.epoch ORDER BY md5('42:' || p.epoch || ':' || doc_id), doc_id) - 1 AS pos FROM documents d JOIN (SELECT DISTINCT source, epoch FROM placed) p ON p.source = d.source),
sampled AS (SELECT i, i AS step, source, CAST(epoch AS BIGINT) AS epoch, doc_id FROM placed JOIN pool USING (source, epoch, pos))"""


@query("m_sample", f"WITH {_DRAWS} SELECT i, step, source, epoch, doc_id FROM sampled")
def m_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(load(spark, sf_dir, "documents"), 2000, curriculum(spark))


def _sql_network() -> str:
    """One pass of the Feistel network over ``walk(i, x, size, bits_a, bits_b, key)``, a subquery for each round."""
    sql = "SELECT *, CAST(x >> bits_b AS UBIGINT) AS a, CAST(x % (1::UBIGINT << bits_b) AS UBIGINT) AS b FROM walk WHERE NOT done"
    for r in range(cursor.ROUNDS):
        given, other, bits = ("a", "b", "bits_b") if r % 2 else ("b", "a", "bits_a")
        key = f"CAST((key + {r * cursor.GOLDEN}) % 4294967296 AS UBIGINT)"
        sql = f"SELECT * EXCLUDE (h), xor({given}, {key}) AS h FROM (SELECT *, 0 AS h FROM ({sql}))"
        for shift, factor in ((16, cursor.MIX1), (13, cursor.MIX2)):
            sql = f"SELECT * EXCLUDE (h), CAST(xor(h, h >> {shift})::UHUGEINT * {factor} % 4294967296 AS UBIGINT) AS h FROM ({sql})"
        sql = f"SELECT * EXCLUDE ({other}, h), CAST(xor({other}, xor(h, h >> 16) % (1::UBIGINT << {bits})) AS UBIGINT) AS {other} FROM ({sql})"
    return f"SELECT i, CAST((a << bits_b) + b AS UBIGINT), size, bits_a, bits_b, key, (a << bits_b) + b < size FROM ({sql})"


_CURSOR = f"""WITH RECURSIVE {_PLACED},
bits AS (SELECT source, n AS size, greatest(1, len(ltrim(bin(n - 1), '0'))) AS bits FROM sized),
walk(i, x, size, bits_a, bits_b, key, done) AS (SELECT i, CAST(pos AS UBIGINT), CAST(size AS UBIGINT), CAST(bits // 2 AS INTEGER), CAST(bits - bits // 2 AS INTEGER),
    CAST(('0x' || left(md5('42:' || source || ':' || epoch), 8)) AS UBIGINT), false FROM placed JOIN bits USING (source)
    UNION ALL {_sql_network()}),
ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents)
SELECT p.i, p.i AS step, p.source, CAST(p.epoch AS BIGINT) AS epoch, r.doc_id FROM placed p JOIN walk w ON w.i = p.i AND w.done JOIN ranked r ON r.source = p.source AND r.row = w.x"""


@query("m_cursor_sample", _CURSOR)
def m_cursor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by the keyed permutation of each epoch."""
    return cursor.sample(load(spark, sf_dir, "documents"), 2000, curriculum(spark))


@query("m_cursor_resume", f"{_CURSOR} WHERE p.i >= 750")
def m_cursor_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run, gone on at draw 750."""
    return cursor.sample(load(spark, sf_dir, "documents"), 2000, curriculum(spark), first=750)


@query("m_distribution", f"WITH {_DRAWS} SELECT source, count(*) AS n, round(count(*) / 2000, 6) AS share FROM draw GROUP BY source")
def m_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.distribution(mixing.draws(spark, 2000, curriculum(spark))).withColumn("share", F.round("share", 6))


@query("m_batches", f"WITH {_DRAWS} SELECT i // 8 AS step, i % 8 AS slot, s.source, CAST(512 AS BIGINT) AS n, CAST(least(length(text), 512) AS BIGINT) AS n_real FROM sampled s JOIN documents USING (doc_id)")
def m_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample(load(spark, sf_dir, "documents"), 2000, curriculum(spark))
    rows = mixing.batches(drawn, char_tokens(spark, sf_dir, 512), 8, 512)
    return rows.select("step", "slot", "source", F.size("input_ids").cast("long").alias("n"), F.col("n_real").cast("long").alias("n_real"))


@query("m_shuffled_batches", "SELECT doc_id, b AS batch FROM (SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // 16 AS b FROM documents) WHERE b < (SELECT count(*) // 16 FROM documents)")
def m_shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shuffled_batches(load(spark, sf_dir, "documents").select("doc_id"), 16)


@query("m_resume", "SELECT doc_id, b AS batch FROM (SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // 16 AS b FROM documents) WHERE b < (SELECT count(*) // 16 FROM documents) AND b >= 5")
def m_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.resumed(m_shuffled_batches(spark, sf_dir), 5)


@query("m_cycle", "SELECT step, item_id FROM range(500) r(step) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) b ON step % n = k")
def m_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.cycled(load(spark, sf_dir, "benchmark"), 500, "item_id")


# Scoring ------------------------------------------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a prediction, the next turn as the reference, in comparison form."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_form(F.col("text")).alias("p"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("r"))
    return turns.join(after, ["conv_id", "turn"])


_FORM = f"lower(regexp_replace(text, '[{T.PYWS}]+', '', 'g'))"
_ANSWERS = f"t AS (SELECT conv_id, turn, {_FORM} AS p FROM conversations), qa AS (SELECT a.conv_id, a.turn, a.p, b.p AS r FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _sql_f1(overlap: str) -> str:
    return f"CASE WHEN p = '' AND r = '' THEN 1.0 WHEN p = '' OR r = '' OR {overlap} = 0 THEN 0.0 ELSE 2.0 * {overlap} / (length(p) + length(r)) END"


_MULTI = "list_sum(list_transform(list_distinct(string_split(p, '')), lambda c: least(length(p) - length(replace(p, c, '')), length(r) - length(replace(r, c, '')))))"
_LOOSE = "len(list_filter(string_split(p, ''), lambda c: contains(r, c)))"


@query("e_char_f1_multi", f"WITH {_ANSWERS} SELECT conv_id, turn, CAST(round({_sql_f1(_MULTI)}, 6) AS DOUBLE) AS f1 FROM qa")
def e_char_f1_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", F.round(scoring.char_f1(F.col("p"), F.col("r")), 6).alias("f1"))


@query("e_char_f1_set", f"WITH {_ANSWERS} SELECT conv_id, turn, CAST(round({_sql_f1(_LOOSE)}, 6) AS DOUBLE) AS f1 FROM qa")
def e_char_f1_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", F.round(scoring.char_f1_loose(F.col("p"), F.col("r")), 6).alias("f1"))


@query("e_exact", f"WITH {_ANSWERS} SELECT count(*) AS n, count(*) FILTER (p = r) AS n_exact FROM qa")
def e_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(scoring.exact(F.col("p"), F.col("r"))).cast("long").alias("n_exact"))


@query("e_best_answer", f"WITH {_ANSWERS}, one AS (SELECT conv_id, {_sql_f1(_MULTI)} AS f FROM qa WHERE turn = 0), two AS (SELECT q.conv_id, 1.0 AS f FROM qa q WHERE turn = 0 AND length(p) % 2 = 0) SELECT CAST(round(avg(f), 6) AS DOUBLE) AS f1 FROM (SELECT conv_id, max(f) AS f FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY conv_id)")
def e_best_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two references for every other sample, one of them the prediction itself."""
    rows = answers(spark, sf_dir).where("turn = 0")
    refs = F.when(F.length("p") % 2 == 0, F.array("r", "p")).otherwise(F.array("r"))
    return rows.agg(F.round(F.avg(scoring.best(scoring.char_f1, F.col("p"), refs)), 6).alias("f1"))


_SUBJECTS = "list_extract(['anatomy', 'philosophy', 'sociology', 'virology', 'poetry'], CAST(d.doc_id % 5 + 1 AS BIGINT))"


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as graded answers: a subject by id, right if of good quality."""
    names = F.array(*[F.lit(x) for x in ("anatomy", "philosophy", "sociology", "virology", "poetry")])
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").withColumn("subject", F.get(names, (F.col("doc_id") % 5).cast("int")))
    return rows.withColumn("category", scoring.category_of(F.col("subject"))).withColumn("correct", F.col("quality") == 1)


_CATEGORY = "CASE subject WHEN 'anatomy' THEN 'STEM' WHEN 'philosophy' THEN 'Humanities' WHEN 'sociology' THEN 'Social Sciences' WHEN 'virology' THEN 'Other' END"
_GRADED = f"graded AS (SELECT *, {_CATEGORY} AS category FROM (SELECT d.doc_id, text, {_SUBJECTS} AS subject, lang, quality, CAST(quality = 1 AS INTEGER) AS correct FROM documents d JOIN labels l ON l.doc_id = d.doc_id))"


@query(
    "e_grouped_accuracy",
    f"""WITH {_GRADED} SELECT 'subject' AS level, subject AS name, count(*) AS n, round(avg(correct), 6) AS accuracy FROM graded GROUP BY subject
    UNION ALL SELECT 'category', category, count(*), round(avg(correct), 6) FROM graded WHERE category IS NOT NULL GROUP BY category UNION ALL SELECT 'overall', NULL, count(*), round(avg(correct), 6) FROM graded""",
)
def e_grouped_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.grouped_accuracy(graded(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("e_accuracy", f"WITH {_GRADED} SELECT lang, count(*) AS n, round(avg(correct), 6) AS accuracy FROM graded GROUP BY lang")
def e_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.accuracy(graded(spark, sf_dir), ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("e_fewshot_pool", f"WITH {_GRADED} SELECT subject, doc_id FROM (SELECT subject, doc_id, row_number() OVER (PARTITION BY subject ORDER BY doc_id) AS r FROM graded) WHERE r <= 5")
def e_fewshot_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.few_shot(graded(spark, sf_dir), 5, "doc_id").select("subject", "doc_id")


@query("e_fewshot_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5")
def e_fewshot_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.few_shot(load(spark, sf_dir, "documents"), 5, "doc_id", None).select("doc_id")


_Q = "'質問: ' || text || chr(10) || '(A) a' || chr(10) || '(B) b' || chr(10) || '(C) c' || chr(10) || '(D) d' || chr(10) || '回答:'"


@query(
    "e_prompts",
    f"""WITH {_GRADED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY doc_id) AS r FROM graded),
    shots AS (SELECT subject, string_agg({_Q} || ' ' || CASE quality WHEN 1 THEN 'A' ELSE 'B' END || chr(10) || chr(10), '' ORDER BY doc_id) AS s FROM ranked WHERE r <= 2 AND subject <> 'poetry' GROUP BY subject)
    SELECT doc_id, md5('以下は' || g.subject || 'に関する問題です。最も適切な回答をA、B、C、Dの中から選んでください。' || chr(10) || chr(10) || coalesce(s, '') || {_Q}) AS digest FROM graded g LEFT JOIN shots ON shots.subject = g.subject""",
)
def e_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded(spark, sf_dir)
    shots = scoring.few_shot(rows, 2, "doc_id").where("subject <> 'poetry'")
    choices, head = F.array(*[F.lit(x) for x in "abcd"]), F.col("text")
    answer = F.when(F.col("quality") == 1, "A").otherwise("B")
    out = scoring.prompts(rows, shots, "doc_id", "subject", scoring.choice_question(head, choices, answer), scoring.choice_question(head, choices), scoring.choice_header(F.col("subject")))
    return out.select("doc_id", F.md5("prompt").alias("digest"))


@query(
    "e_task_prompts",
    """SELECT item_id, md5('前提: ' || a || chr(10) || '仮説: ' || b || chr(10) || '関係: ' || 'neutral' || chr(10) || chr(10)) AS nli, md5('文脈: ' || a || chr(10) || '質問: ' || b || chr(10) || '回答:') AS reading,
    md5('質問: ' || a || chr(10) || '選択肢: (A) v (B) w (C) x (D) y (E) z' || chr(10) || '回答:') AS commonsense, md5('レビュー: ' || a || chr(10) || '感情:') AS sentiment FROM (SELECT item_id, text AS a, text || '?' AS b FROM benchmark)""",
)
def e_task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("text"), F.concat("text", F.lit("?"))
    five = F.array(*[F.lit(x) for x in "vwxyz"])
    return load(spark, sf_dir, "benchmark").select(
        "item_id", F.md5(scoring.nli_prompt(a, b, F.lit("neutral"))).alias("nli"), F.md5(scoring.reading_prompt(a, b)).alias("reading"),
        F.md5(scoring.commonsense_prompt(a, five)).alias("commonsense"), F.md5(scoring.sentiment_prompt(a)).alias("sentiment"),
    )


_ANSWER = "CASE item_id % 4 WHEN 0 THEN 'Contradiction or ENTAILMENT' WHEN 1 THEN ' b) ポジティブ' WHEN 2 THEN '(A) negative neutral' ELSE left(text, 20) END"


@query(
    "e_label_decode",
    f"""SELECT item_id, CASE WHEN contains(lower(a), 'entailment') THEN 'entailment' WHEN contains(lower(a), 'contradiction') THEN 'contradiction' WHEN contains(lower(a), 'neutral') THEN 'neutral' END AS nli,
    CASE WHEN upper(ltrim(a))[1] IN ('A', 'B', 'C', 'D', 'E') THEN upper(ltrim(a))[1] END AS letter,
    CASE WHEN contains(lower(a), 'positive') OR contains(a, 'ポジティブ') THEN 'positive' WHEN contains(lower(a), 'negative') OR contains(a, 'ネガティブ') THEN 'negative' END AS sentiment FROM (SELECT item_id, {_ANSWER} AS a FROM benchmark)""",
)
def e_label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr(_ANSWER)
    return load(spark, sf_dir, "benchmark").select("item_id", scoring.nli_label(a).alias("nli"), scoring.letter(a).alias("letter"), scoring.sentiment(a).alias("sentiment"))


@query(
    "e_best_choice",
    """SELECT vec_id, label FROM (SELECT vec_id, 'c' || lpad(CAST(i AS VARCHAR), 3, '0') AS label, row_number() OVER (PARTITION BY vec_id ORDER BY round(embedding[i], 1) DESC, i) AS r
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) WHERE r = 1""",
)
def e_best_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components as scores of choices, rounded to make ties; the first label wins them."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    rows = rows.select("vec_id", F.format_string("c%03d", F.col("i") + 1).alias("label"), F.round("x", 1).alias("score"))
    return scoring.best_choice(rows, "vec_id").select("vec_id", "label")


_FIELDS = """SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS question, CASE item_id % 3 WHEN 1 THEN text END AS input, text || '!' AS other,
    CASE WHEN item_id % 5 = 0 THEN ['k', 'l', 'm', 'n'] WHEN item_id % 5 = 1 THEN ['short'] END AS choices, CASE WHEN item_id % 5 = 2 THEN 'a' END AS A, CASE WHEN item_id % 5 < 3 THEN 'b' END AS B, CASE WHEN item_id % 5 < 3 THEN 'c' END AS C,
    CASE WHEN item_id % 5 < 3 THEN text END AS D, 'w' AS choice_a, 'x' AS choice_b, 'y' AS choice_c, CASE WHEN item_id % 5 = 3 THEN 'z' END AS choice_d,
    CASE item_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'q' WHEN 2 THEN '3' END AS answer, CASE WHEN item_id % 2 = 0 THEN 'D' END AS target, CASE WHEN item_id % 7 = 0 THEN 'anatomy' END AS category FROM benchmark"""


@query(
    "e_extract_fields",
    f"""SELECT item_id, coalesce(nullif(question, ''), nullif(input, ''), '') AS x_question,
    CASE item_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE CASE WHEN item_id % 2 = 0 THEN 3 ELSE 0 END END AS x_answer,
    CASE item_id % 5 WHEN 0 THEN 'k-l-m-n' WHEN 2 THEN 'a-b-c-' || D WHEN 3 THEN 'w-x-y-z' ELSE '---' END AS x_choices, coalesce(category, 'unknown') AS x_subject FROM ({_FIELDS})""",
)
def e_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that each row has under other names: the fallbacks are taken row by row."""
    sql = _FIELDS.replace("['k', 'l', 'm', 'n']", "array('k', 'l', 'm', 'n')").replace("['short']", "array('short')")
    load(spark, sf_dir, "benchmark").createOrReplaceTempView("corpuskit_benchmark")
    found = scoring.extract_fields(spark.sql(sql.replace("FROM benchmark", "FROM corpuskit_benchmark")).drop("other"))
    return found.select("item_id", "x_question", "x_answer", F.array_join("x_choices", "-").alias("x_choices"), "x_subject")


@query("e_macro_score", "SELECT CAST(round(avg(s), 6) AS DOUBLE) AS aggregate_score FROM (SELECT avg(quality) AS s FROM labels UNION ALL SELECT avg(toxic) FROM labels)")
def e_macro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    tasks = labels.agg(F.avg("quality").alias("accuracy"), F.lit(None).cast("double").alias("f1")).unionByName(labels.agg(F.lit(None).cast("double").alias("accuracy"), F.avg("toxic").alias("f1")))
    return scoring.macro_score(tasks).withColumn("aggregate_score", F.round("aggregate_score", 6))


@query(
    "e_summary",
    """SELECT benchmark, coalesce(a, b, c, d) AS score FROM (SELECT n_name AS benchmark, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey / 4 END AS a, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 8 END AS b,
    CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey / 2 END AS c, CASE WHEN n_nationkey % 7 = 0 THEN n_nationkey / 16 END AS d, n_nationkey % 11 = 4 AS failed FROM nation)
    WHERE NOT failed AND coalesce(a, b, c, d) IS NOT NULL""",
)
def e_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as benchmarks that report one of four scores, some of them none, some an error."""
    key = F.col("n_nationkey")
    rows = load(spark, sf_dir, "nation").select(
        F.col("n_name").alias("benchmark"), F.when(key % 2 == 0, F.col("n_regionkey") / 4).alias("aggregate_score"), F.when(key % 3 == 0, key / 8).alias("accuracy"),
        F.when(key % 5 == 0, key / 2).alias("mean_perplexity"), F.when(key % 7 == 0, key / 16).alias("overall_accuracy"), F.when(key % 11 == 4, "failed").alias("error"),
    )
    return scoring.summary(rows)


@query("e_metric_means", "SELECT event_type AS metric, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def e_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.metric_means(load(spark, sf_dir, "events").withColumnRenamed("event_type", "metric")).withColumn("mean", F.round("mean", 4))


# Perplexity and tokenizer metrics -----------------------------------------------------------


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters as tokens; the loss of one is its code point over 100."""
    rows = char_tokens(spark, sf_dir).select("doc_id", "lang", "tokens")
    return rows.select("doc_id", F.col("lang").alias("test_set"), F.transform("tokens", lambda x: x / 100.0).alias("losses"), F.size("tokens").cast("long").alias("n_tokens"), F.size("tokens").cast("long").alias("n_chars"))


_LOSSES = "l AS (SELECT doc_id, lang AS test_set, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS x, length(text) AS n FROM documents WHERE text <> '')"
_PPL = f"{_LOSSES}, s AS (SELECT *, list_sum(x[2:]) / 100.0 AS nll FROM l), p AS (SELECT doc_id, test_set, n, nll, CASE WHEN n > 1 AND nll / (n - 1) < 100 THEN exp(nll / (n - 1)) ELSE 'inf'::DOUBLE END AS t, CASE WHEN coalesce(nll, 0) / n < 100 THEN exp(coalesce(nll, 0) / n) ELSE 'inf'::DOUBLE END AS c FROM s)"


@query("e_ppl_windows", "SELECT doc_id, b AS begin, least(b + 1024, n) AS \"end\", CASE WHEN b = 0 THEN 1 ELSE b + 512 END AS first, least(b + 1024, n) - CASE WHEN b = 0 THEN 1 ELSE b + 512 END AS scored FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(0, CAST(ceil((length(text) - 1024) / 512) AS BIGINT)) * 512 + 1, 512)) AS b FROM documents WHERE length(text) > 1)")
def e_ppl_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_tokens"))
    return perplexity.windows(rows).select("doc_id", "begin", "end", F.col("first").cast("long").alias("first"), F.col("scored").cast("long").alias("scored"))


@query("e_perplexity", f"WITH {_PPL} SELECT doc_id, n - 1 AS n_scored, round(t, 4) AS token_perplexity, round(c, 4) AS char_perplexity FROM p")
def e_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.perplexities(losses(spark, sf_dir))
    return rows.select("doc_id", "n_scored", F.round("token_perplexity", 4).alias("token_perplexity"), F.round("char_perplexity", 4).alias("char_perplexity"))


@query(
    "e_perplexity_legacy",
    f"""WITH {_LOSSES}, k AS (SELECT *, range(1, greatest(0, CAST(ceil((n - 1024) / 512) AS BIGINT)) + 1) AS ks FROM l WHERE n > 1)
    SELECT doc_id, least(n, 1024) - 1 + coalesce(CAST(list_sum(list_transform(ks, lambda i: least(i * 512 + 1024, n) - i * 512)) AS BIGINT), 0) AS n_scored,
    round((list_sum(x[2:1024]) + coalesce(list_sum(list_transform(ks, lambda i: x[least(i * 512 + 1024, n)])), 0)) / 100.0, 4) AS total_nll FROM k""",
)
def e_perplexity_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.perplexities(losses(spark, sf_dir), legacy=True).where("n_tokens > 1")
    return rows.select("doc_id", "n_scored", F.round("total_nll", 4).alias("total_nll"))


@query("e_ppl_summary", f"WITH {_PPL} SELECT test_set, count(*) AS n, round(avg(t), 4) AS mean_token, round(stddev_pop(t), 4) AS std_token, round(avg(c), 4) AS mean_char, round(stddev_pop(c), 4) AS std_char, CAST(grouping(test_set) AS INTEGER) AS is_overall FROM p WHERE t < 'inf'::DOUBLE GROUP BY ROLLUP (test_set)")
def e_ppl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.summary(perplexity.perplexities(losses(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 4) for c in ("mean_token", "std_token", "mean_char", "std_char")})


def byte_metrics(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    rows = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.byte_encoder(), max_len=max_len)
    rows = rows.withColumn("decoded", F.decode(F.unhex(F.array_join(F.transform("tokens", lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8"))
    found = tokenizer_metrics.metrics(rows, "lang", decoded="decoded", unknown=32)
    return found.withColumns({c: F.round(c, 6) for c in ("fertility", "compression", "unk_rate", "round_trip")})


_BYTE = "SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_aggregate, CAST(sum(strlen(text)) AS BIGINT) AS n_tokens, CAST(sum(length(text)) AS BIGINT) AS n_chars, round(sum(strlen(text)) / sum(length(text)), 6) AS fertility, CAST(1 AS DOUBLE) AS compression, round(sum(length(text) - length(replace(text, ' ', ''))) / sum(strlen(text)), 6) AS unk_rate, CAST(1 AS DOUBLE) AS round_trip FROM documents WHERE text <> '' GROUP BY ROLLUP (lang)"


@query("e_tokenizer_metrics", _BYTE)
def e_tokenizer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_metrics(spark, sf_dir)


@query("e_tokenizer_compare", "SELECT lang, round(sum(strlen(text)) / sum(length(text)), 6) AS base_fertility, CAST(1 AS DOUBLE) AS merged_fertility, round(1 - sum(strlen(text)) / sum(length(text)), 6) AS fertility_delta, round(sum(strlen(text)) / sum(length(text)) - 1, 6) AS compression_delta FROM documents WHERE text <> '' GROUP BY lang")
def e_tokenizer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = tokenizer_metrics.metrics(char_tokens(spark, sf_dir), "lang")
    found = tokenizer_metrics.compare(byte_metrics(spark, sf_dir), merged, "lang")
    return found.select("lang", "base_fertility", "merged_fertility", F.round("fertility_delta", 6).alias("fertility_delta"), F.round("compression_delta", 6).alias("compression_delta"))


@query("e_tokenizer_verdicts", f"SELECT round(avg(fertility), 6) AS fertility, round(avg(unk_rate), 6) AS unk_rate, avg(round_trip) AS round_trip, 'PASS' AS fertility_verdict, 'FAIL' AS unk_verdict, 'PASS' AS round_trip_verdict FROM ({_BYTE}) WHERE is_aggregate = 0")
def e_tokenizer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_metrics.verdicts(byte_metrics(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("fertility", "unk_rate")})


# Chat ---------------------------------------------------------------------------------------

_BODY = "string_agg('<|' || role || '|>' || chr(10) || text, chr(10) ORDER BY turn)"
_TRANSCRIPT = f"SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN '' ELSE '<|system|>' || chr(10) || '{chat.DEFAULT_SYSTEM}' || chr(10) END || {_BODY} || chr(10) || '<|assistant|>' || chr(10) AS t FROM conversations GROUP BY conv_id"


@query("c_format", f"SELECT conv_id, md5(t) AS digest FROM ({_TRANSCRIPT})")
def c_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(load(spark, sf_dir, "conversations")).select("conv_id", F.md5("transcript").alias("digest"))


@query("c_parse", f"SELECT conv_id, \"at\", role, md5(content) AS digest FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS \"at\", role, regexp_replace(text, '^[{T.PYWS}]+|[{T.PYWS}]+$', '', 'g') AS content FROM conversations WHERE regexp_matches(text, '[^{T.PYWS}]'))")
def c_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations parsed again: the turns that are not blank, stripped."""
    rows = chat.format_conversations(load(spark, sf_dir, "conversations"), system="")
    rows = rows.select("conv_id", F.posexplode(chat.parse(F.col("transcript"))).alias("at", "m"))
    return rows.select("conv_id", F.col("at").cast("long").alias("at"), F.col("m.role").alias("role"), F.md5("m.content").alias("digest"))


@query("c_tokens", f"SELECT conv_id, CAST(strlen(t) AS BIGINT) AS n_tokens FROM ({_TRANSCRIPT})")
def c_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.tokenised(load(spark, sf_dir, "conversations"), tokens.byte_encoder())
    return found.select("conv_id", F.size("tokens").cast("long").alias("n_tokens"))


# Sampling filters ---------------------------------------------------------------------------

_LOGITS = "x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 20)) AS l, unnest(range(len(embedding))) AS i FROM embeddings)"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 20).alias("l"))


@query("g_topk", f"WITH {_LOGITS}, r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS k FROM x) SELECT vec_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS ids FROM r WHERE k <= 10 GROUP BY vec_id")
def g_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.transform(sampling.top_k(F.col("l"), 10), lambda v, i: F.when(v > sampling.NONE, i)), lambda i: i.isNotNull())
    return logits(spark, sf_dir).select("vec_id", F.size(kept).cast("long").alias("n"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, i: s + i).alias("ids"))


@query(
    "g_topp",
    f"WITH {_LOGITS}, e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS w FROM x), p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY l DESC, i ROWS UNBOUNDED PRECEDING) - p AS before FROM p) SELECT vec_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS ids FROM c WHERE before <= 0.9 GROUP BY vec_id",
)
def g_topp(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.transform(sampling.top_p(F.col("l"), 0.9), lambda v, i: F.when(v > sampling.NONE, i)), lambda i: i.isNotNull())
    return logits(spark, sf_dir).select("vec_id", F.size(kept).cast("long").alias("n"), F.aggregate(kept, F.lit(0).cast("long"), lambda s, i: s + i).alias("ids"))


@query("g_rep_penalty", f"WITH {_LOGITS} SELECT vec_id, round(sum(CASE WHEN i IN (0, 5, 9) THEN CASE WHEN l > 0 THEN l / 1.1 ELSE l * 1.1 END ELSE l END), 4) AS total FROM x GROUP BY vec_id")
def g_rep_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = sampling.repetition_penalty(F.col("l"), F.array(F.lit(0), F.lit(5), F.lit(5), F.lit(9)))
    return logits(spark, sf_dir).select("vec_id", F.round(F.aggregate(changed, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("g_greedy", f"WITH {_LOGITS} SELECT vec_id, CAST(i AS INTEGER) AS token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, i) AS r FROM x) WHERE r = 1")
def g_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", sampling.greedy(F.col("l")).alias("token"))


@query(
    "g_sample",
    f"""WITH {_LOGITS}, k AS (SELECT vec_id, l / 0.7 AS l, i, rank() OVER (PARTITION BY vec_id ORDER BY l DESC) AS r FROM x), e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS w FROM k WHERE r <= 20),
    p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY l DESC, i ROWS UNBOUNDED PRECEDING) - p AS before FROM p),
    n AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM c WHERE before <= 0.9), d AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM n)
    SELECT vec_id, CAST(min(i) AS INTEGER) AS token FROM d WHERE {_UNIT.format("'7:' || vec_id")} < upto GROUP BY vec_id""",
)
def g_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = mixing.unit(F.lit(7), F.col("vec_id"))
    return logits(spark, sf_dir).select("vec_id", sampling.sample(F.col("l"), u, 0.7, 20, 0.9).cast("int").alias("token"))


# Training analytics -------------------------------------------------------------------------


def _sql_lr(s: str, peak: float, low: float, warmup: int, steps: int) -> str:
    return f"CASE WHEN {s} < {warmup} THEN {peak:.10f}::DOUBLE * {s} / {warmup} ELSE {low:.10f}::DOUBLE + 0.5 * ({peak:.10f}::DOUBLE - {low:.10f}::DOUBLE) * (1 + cos(pi() * least(({s} - {warmup}) / {steps - warmup}, 1.0::DOUBLE))) END"


@query("x_lr_schedule", f"SELECT s AS step, round({_sql_lr('s', 1e-3, 1e-4, 500, 5000)}, 10) AS lr FROM range(6000) r(s)")
def x_lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(6000).select(F.col("id").alias("step"), F.round(training.warmup_cosine(F.col("id"), **training.STAGE1), 10).alias("lr"))


@query("x_lr_two_stage", f"SELECT s AS global_step, CAST(1 AS INTEGER) AS stage, s AS step, round({_sql_lr('s', 1e-3, 1e-4, 500, 5000)}, 10) AS lr FROM range(5000) r(s) UNION ALL SELECT s + 5000, 2, s, round({_sql_lr('s', 1e-5, 1e-6, 1000, 200000)}, 10) FROM range(3000) r(s)")
def x_lr_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.two_stages(spark, 5000, 3000).withColumn("lr", F.round("lr", 10))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as checkpoints at steps that do not follow their keys, one of them the best."""
    step = (F.col("n_nationkey") * 700) % 1100 + F.col("n_nationkey")
    return load(spark, sf_dir, "nation").select(step.cast("long").alias("step"), (F.col("n_name") == "CHINA").alias("is_best"))


_LISTING = "SELECT (n_nationkey * 700) % 1100 + n_nationkey AS step, n_name = 'CHINA' AS is_best FROM nation"


@query(
    "x_retention",
    f"""SELECT name, is_best, k <= (SELECT count(*) FROM nation) - 5 AND NOT is_best AS remove FROM (SELECT 'step_' || lpad(CAST(step AS VARCHAR), 8, '0') AS name, is_best,
    row_number() OVER (ORDER BY step) AS k FROM ({_LISTING}))""",
)
def x_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).select(F.format_string("step_%08d", "step").alias("name"), "is_best")
    return training.retention(rows)


@query("x_latest", f"SELECT 'step_' || step AS name, CAST(step AS BIGINT) AS step FROM ({_LISTING}) ORDER BY step DESC LIMIT 1")
def x_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).select(F.concat(F.lit("step_"), F.col("step").cast("string")).alias("name"))
    return training.latest(rows.unionByName(load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))))


@query("x_best_tag", f"SELECT 'step_' || step AS name, step = (SELECT max(step) FROM ({_LISTING}) WHERE step < 500) AS is_best FROM ({_LISTING})")
def x_best_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).select(F.concat(F.lit("step_"), F.col("step").cast("string")).alias("name"), "is_best")
    best = listing(spark, sf_dir).where("step < 500").agg(F.max("step").alias("step")).first().step
    return training.tag_best(rows, best)


@query(
    "x_shard_pack",
    """WITH RECURSIVE t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, length(text) AS n FROM documents),
    w(source, k, doc_id, used, shard) AS (SELECT DISTINCT source, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INTEGER) FROM t UNION ALL
        SELECT t.source, t.k, t.doc_id, CASE WHEN used + n > 50000 AND used > 0 THEN n ELSE used + n END, shard + CASE WHEN used + n > 50000 AND used > 0 THEN 1 ELSE 0 END FROM w JOIN t ON t.source = w.source AND t.k = w.k + 1)
    SELECT source, doc_id, shard FROM w WHERE k > 0""",
)
def x_shard_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source packed into shards of 50,000 characters in order of id."""
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return tokens.shard_numbers(rows, 50_000).select("source", "doc_id", "shard")


@query("x_mean_vector", "SELECT CAST(i AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i")
def x_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mean_vector(load(spark, sf_dir, "embeddings")).withColumn("mean", F.round("mean", 6))


@query("x_new_rows", "SELECT r AS row, CAST(64 AS BIGINT) AS n, round(s, 5) AS total FROM range(16) t(r), (SELECT sum(m) AS s FROM (SELECT avg(CAST(v AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i))")
def x_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.new_rows(load(spark, sf_dir, "embeddings"), 16)
    return rows.select("row", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_type", (F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))


@query("x_interval_loss", "SELECT event_id // 100 AS block, round(avg(value), 4) AS mean, max(event_id + 1) AS last_step FROM events GROUP BY 1")
def x_interval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.interval_means(loss_log(spark, sf_dir), 100).withColumn("mean", F.round("mean", 4))


@query("x_moving_loss", "SELECT event_id + 1 AS step, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING), 4) AS trailing_mean, min(value) OVER (PARTITION BY event_type ORDER BY event_id) AS best_so_far FROM events")
def x_moving_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.moving(loss_log(spark, sf_dir), "event_type").select("step", F.round("trailing_mean", 4).alias("trailing_mean"), "best_so_far")


_LOAD = f"{_LOGITS}, g AS (SELECT * FROM x), n AS (SELECT count(DISTINCT i) AS experts FROM x), e AS (SELECT *, exp(l - max(l) OVER w) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, i) AS r FROM g WINDOW w AS (PARTITION BY vec_id)), p AS (SELECT *, v / sum(v) OVER (PARTITION BY vec_id) AS p FROM e), load AS (SELECT i AS expert, count(*) FILTER (r <= 2) * (SELECT experts FROM n) / ((SELECT count(*) FROM embeddings) * 2) AS f, sum(p) / (SELECT count(*) FROM embeddings) AS p FROM p GROUP BY i)"


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select(F.col("vec_id").alias("token"), F.posexplode("l").alias("expert", "score"))


@query("x_expert_load", f"WITH {_LOAD} SELECT CAST(expert AS BIGINT) AS expert, round(f, 6) AS f, round(p, 6) AS p FROM load")
def x_expert_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.expert_load(gates(spark, sf_dir), 2).select(F.col("expert").cast("long").alias("expert"), F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


@query("x_routed", f"WITH {_LOAD.replace('load AS', 'routed AS (SELECT vec_id, i, v / sum(v) OVER (PARTITION BY vec_id) AS w FROM p WHERE r <= 2), load AS')} SELECT vec_id AS token, CAST(i AS BIGINT) AS expert, round(w, 6) AS weight FROM routed")
def x_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.routed(gates(spark, sf_dir), 2).select("token", F.col("expert").cast("long").alias("expert"), F.round("weight", 6).alias("weight"))


@query("x_balance_loss", f"WITH {_LOAD} SELECT round(sum(f * p), 6) AS balance FROM load")
def x_balance_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.balance_loss(training.expert_load(gates(spark, sf_dir), 2)).withColumn("balance", F.round("balance", 6))


@query("x_last_wins", "SELECT event_type AS name, max(event_id) AS shard, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def x_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("shard"), "value")
    return training.last_wins(rows)


# Drivers and streams ------------------------------------------------------------------------


@query("d_pipeline")
def d_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of a corpus build on a Latin class, tokenised into bytes."""
    settings = pipeline.Settings(min_ratio=0.3, script=T.LATIN, limits=LATIN_LIMITS)
    built = pipeline.build(load(spark, sf_dir, "documents"), tokens.byte_encoder(), settings)
    return built.select("doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"))


_CLEANED = f"cleaned AS (SELECT * FROM (SELECT doc_id, source, {sql_clean('text')} AS text FROM documents) WHERE text <> '' AND {sql_ratio('text', T.LATIN)} >= 0.3)"


@query("st_clean_stream", f"WITH {_CLEANED}, {JUDGED.replace('FROM documents', 'FROM cleaned')} SELECT source, reason, count(*) AS n FROM judged GROUP BY source, reason")
def st_clean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a JSONL stream, cleaned, judged and appended to Parquet."""
    base = f"{durable.shared_dir(spark)}/corpuskit-stream-{uuid.uuid4().hex}"
    readers.write_jsonl(load(spark, sf_dir, "documents").select("text", "source"), f"{base}/in")
    found = streaming.cleaned(streaming.read(spark, f"{base}/in"), 0.3, T.LATIN, LATIN_LIMITS)
    streaming.write(found, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
