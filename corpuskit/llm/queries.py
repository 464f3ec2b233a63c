"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import audit, bpe, embdup, html, langid, licenses, linededup, merkle, mixing, packing, simhash, sstable, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.expr("transform(copies, c -> c.shard)").alias("shards"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encode_to_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_shared", "n_removed", "all_shared", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified against tampered rows where 7 divides the crc32 of the id."""
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_text": op3_html_text,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_token_shards": op5_token_shards,
    "op6_language_id": op6_language_id,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_filter_audit": op11_filter_audit,
    "op12_retrieval_packing": op12_retrieval_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: White space of the line contract, for DuckDB's trim.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9 = f"""
WITH doc AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT source, text, trim(unnest(parts), {_BLANKS}) AS line FROM doc),
bad AS (SELECT line FROM line WHERE line <> '' GROUP BY line
    HAVING count(DISTINCT coalesce(source, '')) >= {linededup.MIN_SITES} AND count(DISTINCT text) >= {linededup.MIN_SITES}),
bads AS (SELECT coalesce(list(line), []) AS bads FROM bad),
marked AS (SELECT doc_id, text, parts, list_filter(parts, lambda p: list_contains(bads, trim(p, {_BLANKS}))) AS shared,
    list_filter(parts, lambda p: NOT list_contains(bads, trim(p, {_BLANKS}))) AS rest FROM doc, bads),
decided AS (SELECT *, len(shared) > 0 AND len(list_filter(rest, lambda p: trim(p, {_BLANKS}) <> '')) = 0 AS all_shared FROM marked),
done AS (SELECT *, CASE WHEN all_shared THEN text ELSE array_to_string(rest, chr(10)) END AS left_text FROM decided)
SELECT doc_id, CAST(coalesce(len(list_filter(parts, lambda p: trim(p, {_BLANKS}) <> '')), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(shared), 0) AS BIGINT) AS n_shared,
    CAST(CASE WHEN all_shared THEN 0 ELSE coalesce(len(shared), 0) END AS BIGINT) AS n_removed, coalesce(all_shared, false) AS all_shared,
    CAST(length(left_text) AS BIGINT) AS n_chars, sha256(left_text) AS text_sha256
FROM done
"""

OP10 = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7 = """
WITH RECURSIVE unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_reached AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id, least(e.vec_id, coalesce(l.low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least_reached l ON l.a = e.vec_id
"""

OP11 = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM doc),
flag AS (SELECT part, doc_id, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > low, false)] AS fails FROM counted),
label AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
marked AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM flag LEFT JOIN label USING (doc_id)),
n AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM n a, n b, n c, n d, n e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
run AS (SELECT part, o, s.i AS step, fails[o[s.i]] AS fails_here, len(list_filter(fails, lambda f: f)) AS n_fails, good, toxic,
    len(list_filter(range(1, s.i), lambda k: fails[o[k]])) > 0 AS gone FROM marked, orders, n s),
counts AS (SELECT part, o, step, count_if(NOT gone AND NOT fails_here) AS kept, count_if(fails_here AND NOT gone) AS removed, count_if(fails_here AND gone) AS redundant,
    count_if(fails_here AND n_fails = 1) AS unique_fails, count_if(fails_here AND NOT gone AND good) AS good_lost, count_if(fails_here AND NOT gone AND toxic) AS toxic_lost
    FROM run GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
    CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM counts
"""



def _leaf(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return f"sha256({' || '.join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields)})"


#: Fixed value: the reversed polynomial of crc32. A byte is xored in and shifted out in eight steps.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP13 = f"""
WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree(lang, k, i, h, n) AS (SELECT lang, 0, i, leaf, n FROM placed
    UNION ALL SELECT lang, any_value(k) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, i // 2),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(k, i, h, n) AS (SELECT 0, i, h, n FROM subroots
    UNION ALL SELECT any_value(k) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY i // 2),
nodes AS (SELECT lang, 0 AS tier, k, i, h, n FROM tree UNION ALL SELECT NULL, 1, k, i, h, n FROM top),
levels AS (SELECT DISTINCT lang, tier, k FROM nodes WHERE n > 1),
at_level AS (SELECT p.r, l.tier, l.k, p.lang, p.i >> l.k AS i FROM placed p JOIN levels l ON l.tier = 0 AND l.lang IS NOT DISTINCT FROM p.lang
    UNION ALL SELECT p.r, 1, l.k, NULL, s.i >> l.k FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN levels l ON l.tier = 1),
steps AS (SELECT a.r, a.i % 2 AS side, s.h, row_number() OVER (PARTITION BY a.r ORDER BY a.tier, a.k) AS o
    FROM at_level a LEFT JOIN nodes s ON s.tier = a.tier AND s.lang IS NOT DISTINCT FROM a.lang AND s.k = a.k AND s.i = xor(a.i, 1)),
folding(r, o, h) AS (SELECT r, 0::BIGINT, coalesce(tampered, leaf) FROM placed
    UNION ALL SELECT f.r, s.o, sha256(CASE WHEN s.side = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END) FROM folding f JOIN steps s ON s.r = f.r AND s.o = f.o + 1),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY o), '')) AS proof FROM steps GROUP BY r),
folded AS (SELECT r, arg_max(h, o) AS h FROM folding GROUP BY r),
root AS (SELECT h FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN folded f USING (r) LEFT JOIN proofs q USING (r), root
"""

ORACLES: dict[str, str] = {"op11_filter_audit": OP11, "op13_merkle_manifest": OP13, "op7_embedding_dedup": OP7, "op9_line_dedup": OP9, "op10_exact_topk": OP10}
