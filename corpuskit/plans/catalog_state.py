"""Registered queries of stored indexes, streams with state, file stages and the packed source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators import mixing, quality, ranking, tokens
from corpuskit.operators.lshindex import LshIndex
from corpuskit.plans import files, pipeline
from corpuskit.plans.catalog import JUDGED, LATIN_LIMITS, _folder, _sql_greedy, load, query, sql_strip
from corpuskit.plans.catalog_eval import _DRAWS, curriculum
from corpuskit.sources import packed, packed_source, readers
from corpuskit.streaming import clean, ingest
from corpuskit.streaming import neardup as streaming

BATCHES = 3


def in_batches(docs: DataFrame, order: str = "doc_id") -> list[DataFrame]:
    """All documents in ``BATCHES`` ranges of ascending order."""
    top = docs.agg(F.max(order)).first()[0] or 0
    edges = [-(-i * (top + 1) // BATCHES) for i in range(1, BATCHES)]
    ranges = [F.col(order) < edges[0], *[(F.col(order) >= low) & (F.col(order) < high) for low, high in zip(edges, edges[1:])], F.col(order) >= edges[-1]]
    # A range of a table in order lies in few of its partitions, so its rows are dealt out again.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // BATCHES))
    return [docs.where(x).repartition(parts) for x in ranges]


@query("p_incremental", _sql_greedy(""))
def p_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three batches against a stored index: what stays is what one batch over all keeps."""
    index, found = LshIndex(spark, _folder(spark)), None
    for number, docs in enumerate(in_batches(load(spark, sf_dir, "documents"))):
        kept = index.add(number, docs)
        found = kept if found is None else found.unionByName(kept)
    return found


@query("p_index_bands", f"SELECT CAST(count(*) AS BIGINT) AS documents, CAST(9 * count(*) AS BIGINT) AS bands FROM ({_sql_greedy('')})")
def p_index_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index has all bands of every document that stays, and of no other."""
    index = LshIndex(spark, _folder(spark))
    for number, docs in enumerate(in_batches(load(spark, sf_dir, "documents"))):
        index.add(number, docs)
    return index.bands(spark).agg(F.count_distinct("n").alias("documents"), F.count(F.lit(1)).alias("bands"))


@query("st_near_dedup_stream", _sql_greedy(""))
def st_near_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that is started again from its checkpoint as each batch of files arrives."""
    base = _folder(spark)
    for docs in in_batches(load(spark, sf_dir, "documents").select("doc_id", "text")):
        docs.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{base}/in")
        streaming.near_dedup(stream, LshIndex(spark, f"{base}/index"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id")


@query("st_first_of_text", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def st_first_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of each text, by state that outlives a restart of the stream."""
    base, setting = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for docs in in_batches(load(spark, sf_dir, "documents").select("doc_id", "text")):
            docs.write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema("doc_id long, text string").parquet(f"{base}/in")
            clean.write(streaming.first_of_text(stream), f"{base}/out", f"{base}/state").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{base}/out")


_PACKED = """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc, CAST(length(text) AS BIGINT) AS n_tokens,
    CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c) + {shift})) AS BIGINT) AS id_sum FROM documents WHERE text <> ''"""


def _packed(spark: SparkSession, sf_dir: str, shift: int, dtype: str) -> DataFrame:
    rows = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.char_encoder(), max_len=None)
    folder = _folder(spark)
    packed_source.save(rows.withColumn("tokens", F.transform("tokens", lambda x: x.cast("long") + shift)), folder, dtype=dtype)
    ids = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    return packed_source.load(spark, folder).select("doc", F.size("tokens").cast("long").alias("n_tokens"), ids.alias("id_sum"))


@query("s_packed_source", _PACKED.format(shift=0))
def s_packed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packed 2-byte ids, written and read as a Spark source."""
    return _packed(spark, sf_dir, 0, "uint16")


@query("s_packed_source_wide", _PACKED.format(shift=1 << 16))
def s_packed_source_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ids that all take 4 bytes."""
    return _packed(spark, sf_dir, 1 << 16, "uint32")


def _filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Documents as JSONL files, filtered file by file: the statistics and where the outputs are."""
    base = _folder(spark)
    readers.write_jsonl(load(spark, sf_dir, "documents").select("text", "source"), f"{base}/in")
    return files.filter_files(spark, f"{base}/in", f"{base}/out", LATIN_LIMITS, schema="text STRING, source STRING"), f"{base}/out"


@query("d_files_outputs", f"WITH {JUDGED} SELECT source, count(*) AS kept FROM judged WHERE reason IS NULL GROUP BY source")
def d_files_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all files' outputs."""
    _, out = _filtered(spark, sf_dir)
    return files.output(spark, out, "text STRING, source STRING").groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


_REASONS = ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in files.REASONS)


@query(
    "d_files_stats",
    f"WITH {JUDGED} SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS filtered, {_REASONS} FROM judged",
)
def d_files_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' statistics, which the pass that wrote the outputs counted, added up."""
    stats, _ = _filtered(spark, sf_dir)
    reasons = [F.coalesce(F.sum(F.try_element_at("reasons", F.lit(r))), F.lit(0)).alias(r) for r in files.REASONS]
    return stats.agg(*[F.sum(c).alias(c) for c in ("total", "kept", "filtered")], *reasons)


@query("s_ingest", f"SELECT DISTINCT md5(t) AS key FROM (SELECT {sql_strip('text')} AS t FROM documents) WHERE t <> ''")
def s_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches, then all again under numbers old and new: each text is taken once."""
    docs, store = load(spark, sf_dir, "documents"), ingest.Ingest(_folder(spark))
    for number, part in enumerate([*in_batches(docs), docs]):
        store.add(number, part)
    store.add(0, docs)
    return store.documents(spark).select(F.md5("text").alias("key"))


@query(
    "l_most_common",
    "SELECT user_id AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank FROM events GROUP BY user_id",
)
def l_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their events, equally busy ones as first seen."""
    return ranking.most_common(load(spark, sf_dir, "events"), "user_id", ["event_id"])


@query(
    "f_reasons_first_seen",
    f"WITH {JUDGED} SELECT reason AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS rank FROM judged WHERE reason IS NOT NULL GROUP BY reason",
)
def f_reasons_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of rejection in a counter's order."""
    return ranking.reason_counts(quality.with_reason(load(spark, sf_dir, "documents"), LATIN_LIMITS), ["doc_id"])


@query("s_download", f"SELECT 'own' AS source, count(*) AS documents FROM documents WHERE {sql_strip('text')} <> ''")
def s_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered corpus written in full, and once more, which adds nothing."""
    registry, out = {"own": readers.SourceSpec("documents.parquet")}, _folder(spark)
    readers.download(spark, "own", sf_dir, out, registry=registry)
    return readers.download(spark, "all", sf_dir, out, registry=registry)


#: The documents drawn, in the order of the draws, as the mixed set numbers them.
_MIXED = f"""WITH {_DRAWS}, found AS (SELECT i, s.source, text FROM sampled s JOIN documents d USING (doc_id) WHERE text <> '')"""


@query(
    "d_mixed_set",
    f"{_MIXED} SELECT row_number() OVER (ORDER BY i) - 1 AS doc, CAST(least(length(text), 4096) AS BIGINT) AS n_tokens, CAST(unicode(text) AS BIGINT) AS first_id FROM found",
)
def d_mixed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curriculum's mix packed into files and read back."""
    manifest = pipeline.mixed(load(spark, sf_dir, "documents"), tokens.char_encoder(), curriculum(spark), out=_folder(spark), n=2000)
    return packed.concatenated(spark, manifest).select(F.col("doc_id").alias("doc"), F.size("tokens").cast("long").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first_id"))


@query("d_mixed_sources", f"{_MIXED} SELECT source, count(*) AS documents FROM found GROUP BY source")
def d_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source that the mix's indexes count."""
    manifest = pipeline.mixed(load(spark, sf_dir, "documents"), tokens.char_encoder(), curriculum(spark), out=_folder(spark), n=2000)
    return packed.distribution(spark, manifest)


@query("d_mixed_batches", f"{_MIXED} SELECT i // 8 AS step, i % 8 AS slot, source, CAST(least(length(text), 64) AS INTEGER) AS n_real FROM found WHERE i < 2000")
def d_mixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mix as padded batches of eight, a draw a step of the curriculum."""
    drawn = tokens.tokenise(load(spark, sf_dir, "documents"), tokens.char_encoder(), max_len=64)
    return mixing.batches(mixing.sample(load(spark, sf_dir, "documents"), 2000, curriculum(spark)), drawn, 8, 64).select("step", "slot", "source", "n_real")
