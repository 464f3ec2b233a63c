"""Tokenising, offsets, fixed-length samples, greedy packing and vocabulary operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import arrays as A
from corpuskit.functions.lots import arrow_lots
from corpuskit.plans.durable import cut, numbered, running

Encoder = Callable[[list[str]], list[Sequence[int]]]
#: Rows of document places, 24 bytes each, that are broadcast at most.
PLACES = 1_000_000


def byte_encoder() -> Encoder:
    """One id per UTF-8 byte, the byte's value."""
    return lambda texts: [np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8) for x in texts]


def char_encoder() -> Encoder:
    """One id per code point, its number."""
    return lambda texts: [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<i4") for x in texts]


def sentencepiece_encoder(path: str) -> Encoder:
    """Ids of a SentencePiece model; the model is loaded once per worker."""
    return lambda texts: _sentencepiece(path).encode(texts, num_threads=1)


@lru_cache(2)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def tokenise(docs: DataFrame, encoder: Encoder, text_col: str = "text", max_len: int | None = 4096, drop_empty: bool = True) -> DataFrame:
    """Adds ``tokens``, cut after ``max_len`` ids; rows without text or ids go."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrow_lots(batches):
            yield _lists([np.asarray(x[:max_len], np.int32) for x in encoder(texts)])

    docs = docs.where(F.length(text_col) > 0) if drop_empty else docs
    # Else a filter on the result would be moved below the projection and compute it a second time.
    docs = docs.withColumn("tokens", encode.asNondeterministic()(text_col))
    return docs.where(F.size("tokens") > 0) if drop_empty else docs


def counted(docs: DataFrame, encoder: Encoder, text_col: str = "text", max_len: int | None = 4096) -> DataFrame:
    """As ``tokenise``, but adds only ``n_tokens``, the number of ids, in place of the ids."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrow_lots(batches):
            yield pa.array([len(x[:max_len]) for x in encoder(texts)], pa.int64())

    docs = docs.where(F.length(text_col) > 0).withColumn("n_tokens", count.asNondeterministic()(text_col))
    return docs.where("n_tokens > 0")


def offsets(tokens: DataFrame, order: str = "doc_id", by: str | None = "source", tokens_col: str = "tokens") -> DataFrame:
    """Adds ``start`` and ``end``: places of each document in the concatenated stream of its file, in order.

    A column ``n_tokens`` stands for the ids, which then need not be there; columns that are not
    wanted are best left out, for all are shuffled and written once.
    """
    if "n_tokens" not in tokens.columns:
        tokens = tokens.withColumn("n_tokens", F.size(tokens_col).cast("long"))
    rows = running(tokens, [order], {"end": "n_tokens"}, [by] if by else [])
    return rows.withColumn("start", F.col("end") - F.col("n_tokens"))


def text_chunks(docs: DataFrame, encoder: Encoder, length: int, order: str = "doc_id", by: str | None = "source", text_col: str = "text") -> DataFrame:
    """Samples of ``length`` ids of the texts of each file, as ``chunks``.

    Places follow from the numbers of ids alone, which are narrow; texts are then encoded again where they
    are, so that only the pieces of the samples are shuffled. ``order`` is distinct.
    """
    keys = [order] + ([by] if by else [])
    located = cut(offsets(counted(docs, encoder, text_col, None).select(*keys, "n_tokens"), order, by).select(F.col(order).alias("__at"), "start", "end"))
    rows = docs.join(F.broadcast(located) if located.count() <= PLACES else located, F.col(order) == F.col("__at"))
    return chunks(tokenise(rows, encoder, text_col, None), length, by)


def chunks(located: DataFrame, length: int, by: str | None = "source", tokens_col: str = "tokens") -> DataFrame:
    """``(by, sample_id, tokens)``: samples of exactly ``length`` ids across document borders; the tail of a file goes.

    A document is cut at the sample borders it crosses, so pieces, not single ids, are shuffled.
    """
    keys = [by] if by else []
    first, last = F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length)
    parts = located.where("end > start").select(*keys, "start", "end", tokens_col, F.explode(F.sequence(first, last)).alias("sample_id"))
    low = F.greatest("start", F.col("sample_id") * length)
    high = F.least("end", (F.col("sample_id") + 1) * length)
    piece = F.slice(tokens_col, (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    parts = parts.select(*keys, "sample_id", F.struct(low.alias("at"), piece.alias("ids")).alias("piece"))
    joined = parts.groupBy(*keys, "sample_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    joined = joined.select(*keys, "sample_id", F.flatten(F.transform("pieces", lambda p: p.ids)).alias("tokens"))
    return joined.where(F.size("tokens") == length)


def greedy_pack(docs: Column, max_len: int, eos: int) -> Column:
    """One sequence from an array of token arrays: each document that still fits comes with ``eos``, others are passed over."""
    start = F.array().cast("array<int>")
    end = F.array(F.lit(eos))
    return F.aggregate(docs, start, lambda packed, doc: F.when(F.size(packed) + F.size(doc) + 1 <= max_len, F.concat(packed, doc, end)).otherwise(packed))


def _shard_ends(sizes: np.ndarray, max_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a shard that starts at each item: where the next one starts, and the shards begun and the size used at the end."""
    n, ends = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    # The first item with a size always fits; the next shard starts at the first item after it that passes the limit.
    some = np.minimum.accumulate(np.where(sizes > 0, np.arange(n), n)[::-1])[::-1]
    after = np.maximum(np.searchsorted(ends, ends[:-1] + max_size, side="right") - 1, np.minimum(some + 1, n))
    shards, used = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        shards[i], used[i] = (1, ends[n] - ends[i]) if j >= n else (shards[j] + 1, used[j])
    return after, shards, used


#: Rows of a run that a task numbers at once, about.
RUN_ROWS = 1_000_000


def shard_numbers(sizes: DataFrame, max_size: int, order: str = "doc_id", by: str = "source", size: str = "size") -> DataFrame:
    """``sizes`` with ``shard``, the 0-based shard of each row of its ``by`` group in ``order``.

    A new shard starts when the size would pass ``max_size`` and the shard holds something. Rows are
    dealt to range partitions. Each one tells, for every row at which its first new shard may start, how
    many shards it begins and what its last one holds; only rows with a size within the first
    ``max_size`` can be such a row. These tables are read group by group, in the order of the
    partitions and a batch at a time, to find what each partition begins with, and a second pass numbers
    the rows. Sizes are not negative; ``order`` is distinct.
    """
    sizes = cut(sizes)
    parts = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // RUN_ROWS))
    rows = sizes.repartitionByRange(parts, by, order).sortWithinPartitions(by, order).withColumn("__part", F.spark_partition_id())
    rows = cut(rows.select(*sizes.columns, "__part"))
    group = F.xxhash64(by)
    narrow = rows.select("__part", group.alias("__g"), F.struct(F.col(order).alias("at"), F.col(size).cast("long").alias("size")).alias("row"))
    runs = narrow.groupBy("__part", "__g").agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: r.size).alias("sizes"))

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                values = np.asarray(r.sizes, np.int64)
                _, shards, used = _shard_ends(values, max_size)
                before = np.cumsum(values) - values
                starts = np.arange(min(len(values), np.searchsorted(before, max_size, side="right") + 1))
                starts = starts[(values[starts] > 0) | (starts == 0)]
                yield pd.DataFrame({"part": r.part, "g": r.g, "before": before[starts], "size": values[starts], "shards": shards[starts], "used": used[starts], "total": int(values.sum())})

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of a run the first row that passes the limit counts; a run may go on in the next batch.
        last, used, shard, after = None, 0, 0, (0, 0)
        for batch in batches:
            out = []
            for (g, part), lot in batch.groupby(["g", "part"], sort=False):
                if (g, part) != last:
                    used, shard = after if last is not None and last[0] == g else (0, 0)
                    last, after = (g, part), (used + int(lot["total"].iloc[0]), shard)
                    out.append((part, g, used, shard))
                    open_ = True
                if open_:
                    held = used + lot["before"].to_numpy()
                    over = np.nonzero((held + lot["size"].to_numpy() > max_size) & (held > 0))[0]
                    if len(over):
                        after, open_ = (int(lot["used"].iloc[over[0]]), shard + int(lot["shards"].iloc[over[0]])), False
            yield pd.DataFrame(out, columns=["__part2", "__g2", "__used", "__shard"])

    found = runs.withColumnsRenamed({"__part": "part", "__g": "g"}).select("part", "g", "sizes").mapInPandas(chains, "part int, g long, before long, size long, shards long, used long, total long")
    entry = cut(found.repartition("g").sortWithinPartitions("g", "part", "before").mapInPandas(begins, "__part2 int, __g2 long, __used long, __shard long"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                values = np.asarray(r.sizes, np.int64)
                before, out = np.cumsum(values) - values, np.full(len(values), r.shard, np.int64)
                over = np.nonzero((r.used + before + values > max_size) & (r.used + before > 0))[0]
                if len(over):
                    after, at, shard = _shard_ends(values, max_size)[0], over[0], r.shard
                    while at < len(values):
                        shard += 1
                        out[at : after[at]] = shard
                        at = after[at]
                yield pd.DataFrame({"__k": r.keys, "__g3": r.g, "shard": out})

    keyed = narrow.groupBy("__part", "__g").agg(F.sort_array(F.collect_list("row")).alias("rows")).join(entry, (F.col("__part") == F.col("__part2")) & (F.col("__g") == F.col("__g2")))
    keyed = keyed.select(F.transform("rows", lambda r: r.at).alias("keys"), F.transform("rows", lambda r: r.size).alias("sizes"), F.col("__used").alias("used"), F.col("__shard").alias("shard"), F.col("__g").alias("g"))
    kind = sizes.schema[order].dataType.simpleString()
    numbers = keyed.mapInPandas(number, f"__k {kind}, __g3 long, shard long").withColumn("shard", F.col("shard").cast("int"))
    return rows.join(numbers, (group == F.col("__g3")) & (F.col(order) == F.col("__k"))).drop("__k", "__g3", "__part")


def token_stats(tokens: DataFrame, by: str = "source", bytes_per_id: int = 2, tokens_col: str = "tokens") -> DataFrame:
    """Documents, ids and bytes per file and, with a null key, in all."""
    return tokens.rollup(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(tokens_col).cast("long")).alias("tokens"), F.grouping(by).cast("int").alias("is_summary")).withColumn("bytes", F.col("tokens") * bytes_per_id)


def pad(tokens: DataFrame, length: int, tokens_col: str = "tokens") -> DataFrame:
    return tokens.withColumn(tokens_col, A.padded(F.col(tokens_col), length))


# Pieces that a vocabulary difference passes over.
SPECIAL_PIECES = ("<pad>", "<eos>", "<bos>", "<unk>", "<s>", "</s>")


def vocabulary_overlap(base: DataFrame, new: DataFrame) -> DataFrame:
    """``(overlap, candidates)``: how many of the new pieces the base has and lacks, special pieces aside."""
    new = new.where(~F.col("piece").isin(*SPECIAL_PIECES))
    known = base.select("piece", F.lit(True).alias("known")).distinct()
    return new.join(known, "piece", "left").agg(F.count_if("known").alias("overlap"), F.count_if(F.col("known").isNull()).alias("candidates"))


def merge_vocabulary(base: DataFrame, new: DataFrame, max_new: int = 16_128, align: int = 128) -> DataFrame:
    """``(piece, id, origin)``: the base, then the first ``max_new`` new pieces in order of id, then padding to a multiple of ``align``."""
    added = new.where(~F.col("piece").isin(*SPECIAL_PIECES)).join(base.select("piece"), "piece", "left_anti").orderBy("id").limit(max_new)
    size = base.count()
    added = numbered(added.select("piece", "id"), ["id"], "rank").select("piece", (F.col("rank") + size).alias("id"), F.lit("new").alias("origin"))
    total = size + added.count()
    filler = base.sparkSession.range(-total % align).select(F.format_string("<|pad_%d|>", "id").alias("piece"), (F.col("id") + total).alias("id"), F.lit("pad").alias("origin"))
    return base.select("piece", F.col("id").cast("long").alias("id"), F.lit("base").alias("origin")).unionByName(added).unionByName(filler)


def train_bpe(lines: DataFrame, prefix: str, text_col: str = "text", vocab: int = 32_000, coverage: float = 0.9995, max_lines: int = 1_000_000) -> str:
    """Trains a SentencePiece BPE model on at most ``max_lines`` lines; returns the model's path.

    A library call on the driver: NFKC, byte fallback, split digits, ids 0 to 3 for pad, unk, bos, eos.
    """
    import sentencepiece

    rows = (r[0] for r in lines.where(F.length(text_col) > 0).select(text_col).limit(max_lines).toLocalIterator())
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=rows, model_prefix=prefix, vocab_size=vocab, model_type="bpe", character_coverage=coverage, normalization_rule_name="nfkc",
        byte_fallback=True, split_digits=True, pad_id=0, unk_id=1, bos_id=2, eos_id=3,
    )
    return f"{prefix}.model"
