"""Stage drivers: clean, remove near-duplicates, filter, tokenise and pack, with their statistics."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import mixing, neardup, quality, tokens
from corpuskit.plans.durable import cut
from corpuskit.sources import packed, readers

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """Parameters of a corpus build."""

    min_ratio: float = 0.3
    script: str = T.CJK
    scope: str | None = "source"
    threshold: float = 0.8
    permutations: int = neardup.PERMUTATIONS
    shingle: int = neardup.SHINGLE
    limits: quality.Limits = field(default_factory=quality.Limits)
    max_len: int = 4096


def clean_stage(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return quality.clean_filter(docs, s.min_ratio, s.script)


def dedup_stage(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return neardup.near_duplicates(docs, "doc_id", s.scope, threshold=s.threshold, permutations=s.permutations, n=s.shingle)


def filter_stage(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return quality.keep(docs, s.limits)


def token_stage(docs: DataFrame, encoder: tokens.Encoder, s: Settings = Settings()) -> DataFrame:
    return tokens.tokenise(docs, encoder, max_len=s.max_len)


def build(docs: DataFrame, encoder: tokens.Encoder, s: Settings = Settings()) -> DataFrame:
    """All stages as one plan; only near-duplicate removal cuts it."""
    return token_stage(filter_stage(dedup_stage(cut(clean_stage(docs, s)), s), s), encoder, s)


def run_files(spark: SparkSession, inputs: str, out: str, encoder: tokens.Encoder, s: Settings = Settings()) -> dict[str, DataFrame]:
    """JSONL files in, a packed token set out; statistics of each stage by name.

    Each file is a source of its own; total counts every raw line in cleaning and valid rows after it.
    """
    raw = readers.raw_lines(spark, inputs)
    docs = readers.read_jsonl(spark, inputs, "text STRING", with_file=True).withColumnRenamed("file", "source")
    docs = cut(docs.withColumn("doc_id", F.monotonically_increasing_id()))
    cleaned = cut(clean_stage(docs, s))
    unique = cut(dedup_stage(cleaned, s))
    judged = cut(quality.with_reason(unique, s.limits))
    packed_tokens = cut(token_stage(judged.where("reason IS NULL").drop("reason"), encoder, s))
    return {
        "clean": quality.clean_stats(raw.withColumnRenamed("file", "source"), cleaned),
        "dedup": neardup.dedup_stats(cleaned, unique),
        "filter": quality.filter_stats(judged),
        "reasons": quality.reason_counts(judged),
        "prepare": tokens.token_stats(packed_tokens),
        "manifest": packed.write_packed(packed_tokens, out, source="source"),
    }


def mixed(docs: DataFrame, encoder: tokens.Encoder, stage_weights: DataFrame, mode: str = "dataset", out: str | None = None, n: int = 100_000, batch: int = 8, steps: int = 10, length: int = 4096, seed: int = mixing.SEED) -> DataFrame:
    """A curriculum's mix of the sources of ``docs``.

    Mode ``dataset`` packs ``n`` drawn documents, step after step, into files under ``out`` and returns
    their manifest, whose indexes hold the documents of each source. Mode ``dataloader`` returns the
    padded batches of the first ``steps`` steps. Any other mode is an error.
    """
    if mode == "dataset":
        if not out:
            raise ValueError("mode dataset needs a folder")
        drawn = mixing.sample(docs, n, stage_weights, seed)
        rows = tokens.tokenise(docs.select("doc_id", "text"), encoder, max_len=length)
        return packed.write_packed(drawn.join(rows.select("doc_id", "tokens"), "doc_id"), out, order="i", source="source")
    if mode == "dataloader":
        drawn = mixing.sample(docs, steps * batch, stage_weights, seed, per_step=batch)
        return mixing.batches(drawn, tokens.tokenise(docs.select("doc_id", "text"), encoder, max_len=length), batch, length)
    raise ValueError(f"unknown mode {mode}: dataset or dataloader")


def benchmarks(names: str, runners: dict[str, Callable[[], DataFrame]], strict: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Runs evaluations by name; a failing one is noted and the others go on.

    An unknown name is an error, or, for the tasks of a suite (``strict`` false), a warning.
    """
    wanted = list(runners) if names == "all" else [x.strip() for x in names.split(",") if x.strip()]
    unknown = [x for x in wanted if x not in runners]
    if unknown and strict:
        raise ValueError(f"unknown benchmarks: {unknown}")
    for name in unknown:
        log.warning("unknown task %s passed over", name)
    wanted = [x for x in wanted if x in runners]
    done, errors = {}, {}
    for name in wanted:
        try:
            done[name] = cut(runners[name]())
        except Exception as e:
            log.exception("benchmark %s failed", name)
            errors[name] = str(e)
    return done, errors
