"""Registered queries of the library's operators, each with DuckDB SQL that computes the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import arrays as A
from corpuskit.functions import text as T
from corpuskit.operators import neardup, quality, tokens
from corpuskit.plans import durable
from corpuskit.sources import packed, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The test tables have Latin text alone, so script tests run on a Latin class.
LATIN_LIMITS = quality.Limits(min_ratio=0.0)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its oracle."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in one small file, which may be one row group and so one task's, are dealt to all cores."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    small = name in ("documents", "pages") and rows.rdd.getNumPartitions() <= cores
    return rows.repartition(cores) if small and len(rows.inputFiles()) == 1 else rows


# Text functions -----------------------------------------------------------------------------


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.PYWS}]+|[{T.PYWS}]+$', '', 'g')"


def sql_clean(x: str) -> str:
    x = f"regexp_replace({x}, '{T.TAG}', '', 'g')"
    x = f"regexp_replace({x}, '{T.URL}', '', 'g')"
    x = f"regexp_replace({x}, '{T.CONTROL}', '', 'g')"
    x = f"translate({x}, '{T.ASCII_MARKS}', '{T.WIDE_MARKS}')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(x)


def sql_ratio(x: str, script: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE len(regexp_extract_all({x}, '[{script}]')) / length({x}) END"


#: Compatibility forms of the printable ASCII characters, which NFKC takes back.
_ASCII, _FULL = ("".join(map(chr, range(low, low + 94))) for low in (0x21, 0xFF01))


@query("t_nfkc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def t_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in full-width forms, normalised: those of the texts themselves."""
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.nfkc(F.translate("text", _ASCII, _FULL))).alias("digest"))


@query("t_clean_pages", f"SELECT page_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT page_id, {sql_clean('html')} AS c FROM pages)")
def t_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select("page_id", T.clean(F.col("html")).alias("c"))
    return rows.select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query(
    "t_clean_steps",
    f"""SELECT page_id, length(a) AS no_tags, length(regexp_replace(html, '{T.URL}', '', 'g')) AS no_urls, length(regexp_replace(html, '{T.CONTROL}', '', 'g')) AS no_controls,
    md5(translate(a, '{T.ASCII_MARKS}', '{T.WIDE_MARKS}')) AS wide, length({sql_strip('a')}) AS stripped
    FROM (SELECT page_id, html, regexp_replace(html, '{T.TAG}', '', 'g') AS a FROM pages)""",
)
def t_clean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    bare = T.remove_tags(html)
    size = lambda c: F.length(c).cast("long")
    return load(spark, sf_dir, "pages").select(
        "page_id", size(bare).alias("no_tags"), size(T.remove_urls(html)).alias("no_urls"), size(T.remove_controls(html)).alias("no_controls"),
        F.md5(T.widen_marks(bare)).alias("wide"), size(T.strip(bare)).alias("stripped"),
    )


@query("t_script_ratio", f"SELECT doc_id, round({sql_ratio('text', T.CJK)}, 6) AS cjk, round({sql_ratio('text', T.LATIN)}, 6) AS latin FROM (SELECT doc_id, translate(text, 'aeiou', 'アえ漢ー𠀀') AS text FROM documents)")
def t_script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of two scripts in texts with Han and kana for their vowels."""
    text = F.translate("text", "aeiou", "アえ漢ー𠀀")
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.script_ratio(text), 6).alias("cjk"), F.round(T.script_ratio(text, T.LATIN), 6).alias("latin"))


#: Kana and Han for the small letters, so that the script tests have something to find in Latin texts.
_SMALL, _KANA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこアイウエオカキクケコ日本語漢字東"
_JAPANESE = "[ぁ-ゟァ-ヿ一-龯]"


@query(
    "t_japanese_share_runs",
    f"""SELECT item_id, CASE WHEN length(replace(t, ' ', '')) = 0 THEN 0 ELSE round(len(regexp_extract_all(t, '{_JAPANESE}')) / length(replace(t, ' ', '')), 6) END AS share,
    len(list_filter(range(1, length(t) - 2), lambda i: substr(t, i, 3) = repeat(substr(t, i, 1), 3) AND substr(t, i, 1) <> chr(10))) > 0 AS has_run
    FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN translate(text, '{_SMALL}', '{_KANA}') ELSE replace(text, 'th', 'ttth') END AS t FROM benchmark)""",
)
def t_japanese_share_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text in kana and Han, the rest with runs."""
    text = F.when(F.col("item_id") % 2 == 0, F.translate("text", _SMALL, _KANA)).otherwise(F.replace("text", F.lit("th"), F.lit("ttth")))
    rows = load(spark, sf_dir, "benchmark").select("item_id", text.alias("t"))
    return rows.select("item_id", F.round(T.japanese_share(F.col("t")), 6).alias("share"), T.has_run(F.col("t"), 3).alias("has_run"))


_FORM = f"regexp_replace(text, '[{T.PYWS}]+', '', 'g')"


@query("t_answer_forms", f"""SELECT conv_id, turn, md5(lower({_FORM})) AS lower_form, md5({_FORM}) AS form, md5(regexp_replace(text, '{T.ANSWER_MARKS.replace("'", "''")}', '', 'g')) AS no_marks FROM conversations""")
def t_answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.answer_form(text)).alias("lower_form"), F.md5(T.answer_form(text, lower=False)).alias("form"), F.md5(T.remove_answer_marks(text)).alias("no_marks"))


@query("t_bytes_prefix", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(left(text, 5000)) AS head, coalesce(nullif(replace(source, '_', ' '), ''), '一般知識') AS title FROM documents")
def t_bytes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(T.prefix(text, 5000)).alias("head"), T.subject_title(F.col("source")).alias("title"))


# Filters ------------------------------------------------------------------------------------


@query("f_clean_filter", f"""SELECT page_id, length(c) AS n_chars FROM (SELECT page_id, {sql_clean('html')} AS c FROM pages) WHERE c <> '' AND {sql_ratio('c', T.LATIN)} >= 0.6""")
def f_clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.clean_filter(load(spark, sf_dir, "pages"), 0.6, T.LATIN, "html")
    return kept.select("page_id", F.length("html").cast("long").alias("n_chars"))


_LINE = f"""(SELECT doc_id, source, text, length(text) AS n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{T.PYWS}]')) AS ls FROM documents)"""
_MEAN = "CASE WHEN len(ls) = 0 THEN NULL ELSE list_sum(list_transform(ls, lambda x: length(x))) / len(ls) END"
_LEADS = " || ".join(["c", *(f"lead(c, {i}) OVER w" for i in range(1, 10))])
_GRAMS = f"""chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM documents WHERE length(text) >= 10),
grams AS (SELECT doc_id, {_LEADS} AS g FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
counted AS (SELECT doc_id, g, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY ALL), rep AS (SELECT doc_id, max(n) / sum(n) AS r FROM counted GROUP BY doc_id)"""
JUDGED = f"""{_GRAMS}, judged AS (SELECT d.doc_id, source, CASE WHEN n < 50 OR n > 500000 THEN 'length' WHEN coalesce(r, 0) > 0.2 THEN 'repetition'
    WHEN coalesce(({_MEAN}) BETWEEN 10 AND 10000, false) THEN NULL ELSE 'mean_line_length' END AS reason FROM {_LINE} d LEFT JOIN rep ON rep.doc_id = d.doc_id)"""


@query("f_reason", f"WITH {JUDGED} SELECT doc_id, reason FROM judged")
def f_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_reason(load(spark, sf_dir, "documents"), LATIN_LIMITS).select("doc_id", "reason")


@query("f_reason_stats", f"WITH {JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1")
def f_reason_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_counts(quality.with_reason(load(spark, sf_dir, "documents"), LATIN_LIMITS))


_KANA_DOCS = f"kana AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN translate(text, '{_SMALL}', '{_KANA}') ELSE text END AS text FROM documents)"
_DEFAULT = JUDGED.replace("FROM documents", "FROM kana").replace("WHEN coalesce(r, 0)", f"WHEN {sql_ratio('text', T.CJK)} < 0.3 THEN 'cjk_ratio' WHEN coalesce(r, 0)")


@query("f_default_reasons", f"WITH {_KANA_DOCS}, {_DEFAULT} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1")
def f_default_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default limits on documents of which every other one is in kana and Han."""
    text = F.when(F.col("doc_id") % 2 == 0, F.translate("text", _SMALL, _KANA)).otherwise(F.col("text"))
    return quality.reason_counts(quality.with_reason(load(spark, sf_dir, "documents").withColumn("text", text)))


@query(
    "f_stats_rollup",
    f"""WITH {JUDGED} SELECT source, count(*) AS total, count(*) FILTER (reason IS NULL) AS kept, CAST(grouping(source) AS INTEGER) AS is_summary, count(*) FILTER (reason IS NOT NULL) AS filtered,
    round(count(*) FILTER (reason IS NOT NULL) / count(*), 6) AS filter_rate FROM judged GROUP BY ROLLUP (source)""",
)
def f_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_stats(quality.with_reason(load(spark, sf_dir, "documents"), LATIN_LIMITS)).withColumn("filter_rate", F.round("filter_rate", 6))


@query("f_repetition_ratio", f"WITH {_GRAMS} SELECT d.doc_id, round(coalesce(r, 0), 6) AS ratio FROM documents d LEFT JOIN rep ON rep.doc_id = d.doc_id")
def f_repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(quality.repetition(F.col("text")), 6).alias("ratio"))


@query("f_mean_line_len", f"SELECT doc_id, round({_MEAN}, 6) AS mean FROM {_LINE}")
def f_mean_line_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(quality.mean_line(F.col("text")), 6).alias("mean"))


@query("f_first_long", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 200 ORDER BY doc_id LIMIT 100")
def f_first_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_long(load(spark, sf_dir, "documents"), 200, 100).select("doc_id", F.length("text").cast("long").alias("n"))


@query("f_limit_then_subject", "SELECT doc_id, source FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300) WHERE source IN ('src1', 'src2')")
def f_limit_then_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return load(spark, sf_dir, "documents").orderBy("doc_id").limit(300).join(wanted, "source", "left_semi").select("doc_id", "source")


@query("f_clean_stats", "SELECT source, total, kept, total - kept AS filtered, round((total - kept) / total, 6) AS filter_rate FROM (SELECT source, count(*) AS total, count(*) FILTER (length(text) > 500) AS kept FROM documents GROUP BY source)")
def f_clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.clean_stats(docs, docs.where(F.length("text") > 500)).withColumn("filter_rate", F.round("filter_rate", 6))


# Sources and sinks --------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{durable.shared_dir(spark)}/corpuskit-{uuid.uuid4().hex}"


@query("s_jsonl_roundtrip", "SELECT text, source FROM documents")
def s_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and malformed lines written as JSONL and read again: the malformed ones go."""
    folder = _folder(spark)
    docs = load(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text", "source")).alias("value"))
    bad = spark.createDataFrame([("not json",), ("",), ("   ",), ("[1]",), ('{"text": "open',)], "value string")
    docs.unionByName(bad).write.text(folder)
    return readers.read_jsonl(spark, folder)


@query("s_raw_lines", "SELECT count(*) + 3 AS lines, count(*) AS valid FROM documents")
def s_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    docs = load(spark, sf_dir, "documents").select(F.to_json(F.struct("text", "source")).alias("value"))
    docs.unionByName(spark.createDataFrame([("not json",), ("",), ("[2]",)], "value string")).write.text(folder)
    lines = readers.raw_lines(spark, folder).agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(readers.read_jsonl(spark, folder).agg(F.count(F.lit(1)).alias("valid")))


@query("s_source_append", "SELECT 'own' AS source, CAST(count(DISTINCT text) AS BIGINT) AS documents FROM (SELECT " + sql_strip("text") + " AS text FROM documents) WHERE text <> ''")
def s_source_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered corpus written twice: the second run adds nothing."""
    root, out = sf_dir, _folder(spark)
    registry = {"own": readers.SourceSpec("documents.parquet")}
    docs = readers.load_source(spark, "own", root, registry=registry).dropDuplicates(["text"])
    readers.write_jsonl(docs.where(F.length("text") < 2000), f"{out}/own")
    done = readers.read_jsonl(spark, f"{out}/own").select(F.md5("text").alias("key"))
    readers.write_jsonl(docs.withColumn("key", F.md5("text")).join(done, "key", "left_anti").drop("key"), f"{out}/own", "append")
    return readers.read_jsonl(spark, f"{out}/own").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


_PARTS = "SELECT doc_id, unnest(string_split(text || chr(10) || chr(10) || text, chr(10) || chr(10))) AS p, unnest(range(2)) AS pos FROM documents"


@query("s_text_to_docs", f"SELECT 'wiki_' || (row_number() OVER (ORDER BY doc_id, pos) - 1) AS id, doc_id, length(p) AS n_chars FROM ({_PARTS}) WHERE length(p) > 50")
def s_text_to_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text twice, a blank line between: paragraphs of over 50 characters, numbered over the table."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n\n"), "text").alias("text"))
    # Paragraphs are found once, and only what is asked of them is cut, sorted and numbered.
    sizes = durable.cut(readers.paragraphs(docs).select("doc_id", "pos", F.length("paragraph").cast("long").alias("n_chars")))
    found = durable.numbered(sizes, ["doc_id", "pos"], "n")
    return found.select(F.concat(F.lit("wiki_"), F.col("n").cast("string")).alias("id"), "doc_id", "n_chars")


@query("s_packed_roundtrip", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, CAST(length(text) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS id_sum FROM documents WHERE text <> ''")
def s_packed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.char_encoder(), max_len=None)
    manifest = packed.write_packed(rows, _folder(spark))
    back = packed.concatenated(spark, manifest)
    return back.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@query("s_packed_manifest", "SELECT count(*) AS num_documents, CAST(sum(strlen(text)) AS BIGINT) AS total_tokens, 'uint16' AS dtype FROM documents WHERE text <> ''")
def s_packed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.byte_encoder(), max_len=None)
    manifest = packed.write_packed(rows, _folder(spark), source="source")
    return manifest.groupBy("dtype").agg(F.sum("num_documents").alias("num_documents"), F.sum("total_tokens").alias("total_tokens"))


# Near-duplicates ----------------------------------------------------------------------------

_P, _B = neardup.PRIME, neardup.BASE
_CODES = "codes AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))) AS c0, unnest(range(length(text))) AS pos FROM documents WHERE text <> '')"
_SHINGLES = f"""{_CODES}, led AS (SELECT doc_id, pos, c0, lead(c0, 1) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3, lead(c0, 4) OVER w AS c4 FROM codes WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hashed AS (SELECT DISTINCT doc_id, (((((c0 * {_B} + c1) % {_P}) * {_B} + c2) % {_P} * {_B} + c3) % {_P} * {_B} + c4) % {_P} AS h FROM led WHERE c4 IS NOT NULL
    UNION SELECT doc_id, list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * {_B} + c) % {_P}) FROM documents WHERE length(text) BETWEEN 1 AND 4)"""
_MULT, _OFFS = neardup.permutation_constants()
_MINS = ", ".join(f"min(({a} * h + {b}) % {_P})" for a, b in zip(_MULT, _OFFS))
_SIGNED = f"{_SHINGLES}, signed AS (SELECT doc_id, [{_MINS}] AS signature FROM hashed GROUP BY doc_id)"
_BANDS, _ROWS = neardup.bands_for()


def _sql_pairs(scope: str) -> str:
    s, eq = ("source, ", "a.source = b.source AND ") if scope else ("", "")
    return f"""{_SIGNED}, node AS (SELECT {s}signature, min(doc_id) AS doc_id FROM signed JOIN documents USING (doc_id) GROUP BY {s}signature),
banded AS (SELECT {s}doc_id, b AS band, signature[b * {_ROWS} + 1:b * {_ROWS} + {_ROWS}] AS key FROM node, range({_BANDS}) r(b)),
pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM banded a JOIN banded b ON {eq}a.band = b.band AND a.key = b.key AND a.doc_id < b.doc_id)"""


def _sql_greedy(scope: str) -> str:
    return f"""WITH RECURSIVE {_sql_pairs(scope)}, touched AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT a AS n FROM pair UNION SELECT b FROM pair)),
before AS (SELECT b, list(a) AS smaller FROM pair GROUP BY b),
walk(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
    SELECT t.i, CASE WHEN coalesce(list_has_any(walk.kept, before.smaller), false) THEN walk.kept ELSE list_append(walk.kept, t.n) END FROM walk JOIN touched t ON t.i = walk.i + 1 LEFT JOIN before ON before.b = t.n),
final AS (SELECT coalesce((SELECT kept FROM walk ORDER BY i DESC LIMIT 1), []) AS kept)
SELECT doc_id FROM node WHERE doc_id NOT IN (SELECT n FROM touched) UNION SELECT unnest(kept) FROM final"""


@query("p_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def p_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.exact_duplicates(load(spark, sf_dir, "documents"))


@query("p_shingles", "SELECT item_id, CAST(count(DISTINCT s) AS BIGINT) AS n FROM (SELECT item_id, unnest(list_transform(range(1, greatest(length(text) - 4, 1) + 1), lambda i: substr(text, i, 5))) AS s FROM benchmark) GROUP BY item_id")
def p_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(neardup.shingles(F.col("text"))).cast("long").alias("n"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.signatures(load(spark, sf_dir, "documents"), ["doc_id", "source"])


@query("p_signature", f"WITH {_SIGNED} SELECT doc_id, signature FROM signed")
def p_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select("doc_id", "signature")


@query("p_candidates", f"WITH {_sql_pairs('')} SELECT a, b FROM pair")
def p_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.collisions(_signed(spark, sf_dir).drop("source"))


@query("p_jaccard_pairs", f"WITH {_sql_pairs('')}, sized AS (SELECT doc_id, count(*) AS n FROM hashed GROUP BY doc_id), met AS (SELECT a, b, count(*) AS k FROM pair JOIN hashed x ON x.doc_id = a JOIN hashed y ON y.doc_id = b AND x.h = y.h GROUP BY a, b) SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b")
def p_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact similarity of the candidate pairs, found where their texts meet in a bucket."""
    docs = load(spark, sf_dir, "documents")
    members = neardup.memberships(neardup.signatures(docs, ["doc_id"]))[1]
    return neardup.similarities(docs, members).withColumn("jaccard", F.round("jaccard", 6))


@query("p_greedy", _sql_greedy("source"))
def p_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    signed = durable.cut(neardup.signatures(docs, ["doc_id", "source"]))
    return neardup.first_wins(*neardup.memberships(signed, scope=["source"]))


@query("p_greedy_global", _sql_greedy(""))
def p_greedy_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = durable.cut(neardup.signatures(load(spark, sf_dir, "documents"), ["doc_id"]))
    return neardup.first_wins(*neardup.memberships(signed))


@query(
    "p_dedup_stats",
    f"""WITH kept AS ({_sql_greedy("source")}) SELECT source, count(*) AS total, count(*) FILTER (text <> '') - count(k.doc_id) AS duplicates, count(k.doc_id) AS remaining,
    round((count(*) FILTER (text <> '') - count(k.doc_id)) / count(*), 6) AS dedup_rate FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY source""",
)
def p_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return neardup.dedup_stats(docs, neardup.near_duplicates(docs, "doc_id", "source")).withColumn("dedup_rate", F.round("dedup_rate", 6))


# Tokens -------------------------------------------------------------------------------------


def char_tokens(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    return tokens.tokenise(load(spark, sf_dir, "documents"), tokens.char_encoder(), max_len=max_len)


@query("k_tokens_bytes", "SELECT doc_id, least(strlen(text), 4096) AS n_tokens, left(hex(encode(text)), 16) AS head FROM documents WHERE text <> ''")
def k_tokens_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.byte_encoder())
    head = F.array_join(F.transform(F.slice("tokens", 1, 8), lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), head.alias("head"))


@query("k_sentencepiece")
def k_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the public SentencePiece model; a library call without an SQL form."""
    import public_tokenizers

    rows = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.sentencepiece_encoder(public_tokenizers.path("piece_bpe_32k.model")))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


_OFFSETS = "SELECT doc_id, source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS e, length(text) AS n, text FROM documents WHERE text <> ''"


@query("k_offsets", f"SELECT doc_id, source, CAST(e - n AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM ({_OFFSETS})")
def k_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.counted(load(spark, sf_dir, "documents"), tokens.char_encoder(), max_len=None)
    return tokens.offsets(sizes.select("doc_id", "source", "n_tokens")).select("doc_id", "source", "start", "end")


@query(
    "k_chunks",
    """WITH joined AS (SELECT source, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY source)
    SELECT source, k AS sample_id, md5(substr(t, k * 512 + 1, 512)) AS digest FROM joined, range((SELECT max(length(t)) // 512 FROM joined)) r(k) WHERE (k + 1) * 512 <= length(t)""",
)
def k_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.text_chunks(load(spark, sf_dir, "documents"), tokens.char_encoder(), 512)
    text = F.array_join(F.transform("tokens", lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")), "")
    return rows.select("source", "sample_id", F.md5(text).alias("digest"))


@query(
    "k_pack_eos",
    """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, least(length(text), 4096) AS n FROM conversations WHERE text <> ''),
    w(conv_id, k, used, docs) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM t UNION ALL
        SELECT t.conv_id, t.k, CASE WHEN used + n + 1 <= 512 THEN used + n + 1 ELSE used END, CASE WHEN used + n + 1 <= 512 THEN docs + 1 ELSE docs END FROM w JOIN t ON t.conv_id = w.conv_id AND t.k = w.k + 1)
    SELECT conv_id, max(used) AS n_tokens, max(docs) AS n_docs FROM w GROUP BY conv_id""",
)
def k_pack_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation packed into one sequence: what does not fit is passed over."""
    rows = tokens.tokenise(load(spark, sf_dir, "conversations"), tokens.char_encoder())
    rows = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "tokens"))), lambda x: x.tokens).alias("docs"))
    packed_ids = tokens.greedy_pack(F.col("docs"), 512, 3)
    return rows.select("conv_id", F.size(packed_ids).cast("long").alias("n_tokens"), A.share_of(packed_ids, 3).cast("long").alias("n_docs"))


@query("k_pad", "SELECT item_id, CAST(256 AS BIGINT) AS n, CAST(least(length(text), 256) AS BIGINT) AS n_real FROM benchmark")
def k_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.pad(tokens.tokenise(load(spark, sf_dir, "benchmark"), tokens.char_encoder()), 256)
    return rows.select("item_id", F.size("tokens").cast("long").alias("n"), F.size(F.filter("tokens", lambda x: x != 0)).cast("long").alias("n_real"))


@query("k_token_stats", "SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(grouping(source) AS INTEGER) AS is_summary, CAST(sum(length(text)) * 2 AS BIGINT) AS bytes FROM documents WHERE text <> '' GROUP BY ROLLUP (source)")
def k_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_stats(char_tokens(spark, sf_dir))


def _vocabulary(rows: DataFrame) -> DataFrame:
    chars = rows.select(F.explode(A.characters(F.col("text"))).alias("piece")).distinct()
    return durable.numbered(chars, ["piece"], "id").select("piece", F.col("id").cast("int").alias("id"))


_CHARS = "SELECT c AS piece, row_number() OVER (ORDER BY encode(c)) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM {})"


@query(
    "k_vocab_merge",
    f"""WITH base AS ({_CHARS.format("(SELECT text FROM benchmark)")}), fresh AS ({_CHARS.format("(SELECT text FROM documents)")}), size AS (SELECT count(*) AS s FROM base),
    new AS (SELECT piece, row_number() OVER (ORDER BY id) - 1 AS r FROM fresh WHERE piece NOT IN (SELECT piece FROM base) ORDER BY id LIMIT 10), total AS (SELECT s + (SELECT count(*) FROM new) AS t FROM size)
    SELECT piece, CAST(id AS BIGINT) AS id, 'base' AS origin FROM base UNION ALL SELECT piece, CAST(r + s AS BIGINT), 'new' FROM new, size
    UNION ALL SELECT '<|pad_' || i || '|>', CAST(i + t AS BIGINT), 'pad' FROM total, range(128) p(i) WHERE i < (128 - t % 128) % 128""",
)
def k_vocab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.merge_vocabulary(_vocabulary(load(spark, sf_dir, "benchmark")), _vocabulary(load(spark, sf_dir, "documents")), 10)


@query("k_vocab_overlap", f"WITH base AS ({_CHARS.format('(SELECT text FROM benchmark)')}), fresh AS ({_CHARS.format('(SELECT text FROM documents)')}) SELECT count(*) FILTER (piece IN (SELECT piece FROM base)) AS overlap, count(*) FILTER (piece NOT IN (SELECT piece FROM base)) AS candidates FROM fresh")
def k_vocab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary_overlap(_vocabulary(load(spark, sf_dir, "benchmark")), _vocabulary(load(spark, sf_dir, "documents")))
