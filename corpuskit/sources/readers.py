"""Sources: a registry of corpora, JSONL, plain text, paragraphs, and tokenizer inputs."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as T

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SourceSpec:
    """Where a corpus is and which field holds its text."""

    path: str
    name: str = "ja"
    split: str = "train"
    text_field: str = "text"
    format: str = "parquet"
    options: dict = field(default_factory=dict)


# Corpora known by name, their configuration, split and text field.
REGISTRY = {
    "wikipedia": SourceSpec("wikipedia", "20220301.ja"),
    "oscar": SourceSpec("oscar-corpus/OSCAR-2301"),
    "mc4": SourceSpec("mc4"),
    "cc100-ja": SourceSpec("cc100"),
}


def load_source(spark: SparkSession, name: str, root: str, max_docs: int | None = None, registry: dict[str, SourceSpec] = REGISTRY) -> DataFrame:
    """``(text, source)`` of a corpus under ``root``: stripped, rows without text dropped; a limit of 0 means 1."""
    spec = registry[name]
    rows = spark.read.format(spec.format).options(**spec.options).load(f"{root}/{spec.path}")
    rows = rows.select(T.strip(F.col(spec.text_field)).alias("text"), F.lit(name).alias("source")).where("text <> ''")
    return rows if max_docs is None else rows.limit(max(1, max_docs))


def download(spark: SparkSession, dataset: str, root: str, out: str, max_docs: int | None = None, registry: dict[str, SourceSpec] = REGISTRY) -> DataFrame:
    """Appends corpora as JSONL, one folder each; ``all`` takes every one, a failing one is logged and passed over.

    A text that its folder has already is not written again, so a second run resumes the first.
    Returns ``(source, documents)``.
    """
    for name in list(registry) if dataset == "all" else [dataset]:
        try:
            rows, folder = load_source(spark, name, root, max_docs, registry), f"{out}/{name}"
            try:
                done = read_jsonl(spark, folder, "text STRING, source STRING").select(F.md5("text").alias("key")).distinct()
                rows = rows.withColumn("key", F.md5("text")).join(done, "key", "left_anti").drop("key")
            except Exception as e:  # nothing was written yet
                log.debug("no earlier output in %s: %s", folder, e)
            write_jsonl(rows, folder, "append")
        except Exception:
            if dataset != "all":
                raise
            log.exception("source %s failed", name)
    return read_jsonl(spark, f"{out}/*", "text STRING, source STRING").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def read_jsonl(spark: SparkSession, path: str, schema: str = "text STRING, source STRING", with_file: bool = False) -> DataFrame:
    """Rows of JSONL files; blank and malformed lines are passed over."""
    rows = spark.read.text(path)
    if with_file:
        rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return parse_jsonl(rows, schema).select("row.*", *(["file"] if with_file else []))


def parse_jsonl(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """Adds ``row``, the fields of each line; blank and malformed lines go. Runs on streams as well."""
    bare = lines.where(T.strip(F.col(line)).startswith("{"))
    kind = f"{schema}, _corrupt_record STRING"
    parsed = bare.withColumn("row", F.from_json(line, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("row IS NOT NULL AND row._corrupt_record IS NULL").withColumn("row", F.col("row").dropFields("_corrupt_record"))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, file)`` of every raw line, for statistics that count blank and malformed ones."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines; null fields are written as null."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_text(rows: DataFrame, path: str, text_col: str = "text", max_docs: int = 50_000, order: str = "doc_id") -> None:
    """Texts of the first rows in order, each with a line feed."""
    rows.orderBy(order).limit(max_docs).select(text_col).write.mode("overwrite").text(path)


def paragraphs(texts: DataFrame, text_col: str = "text", min_len: int = 50) -> DataFrame:
    """Explodes texts at blank lines: ``pos`` and ``paragraph`` of those longer than ``min_len``.

    Blank lines hold nothing but white space; the lines of a paragraph stay joined by line feeds.
    """
    parts = F.split(F.col(text_col), rf"\n(?:[{T.PYWS}&&[^\n]]*\n)+")
    out = texts.select("*", F.posexplode(parts).alias("pos", "paragraph"))
    edge = rf"^(?:[{T.PYWS}&&[^\n]]*\n)+|(?:\n[{T.PYWS}&&[^\n]]*)+$"
    fine = lambda p: (F.length(p) > min_len) & p.rlike(f"[^{T.PYWS}]")
    # As in ``quality.clean_filter``: the edges are taken off once, not for each test.
    return out.withColumn("paragraph", F.explode(F.filter(F.array(F.regexp_replace("paragraph", edge, "")), fine)))


def read_paragraphs(spark: SparkSession, path: str, min_len: int = 50) -> DataFrame:
    """Paragraphs of text files; the reader splits at empty lines, so a file is never one record."""
    return paragraphs(spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "text"), "text", min_len).select("paragraph")


def tokenizer_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """``(text, file)`` lines of all .txt, .tsv and .csv files below a folder; an error if there is none."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,tsv,csv}").text(folder)
    if not rows.inputFiles():
        raise FileNotFoundError(f"no input files in {folder}")
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def load_config(path: str) -> dict:
    """A JSON or YAML configuration file (YAML where the library is installed)."""
    body = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(body)
    import yaml

    return yaml.safe_load(body)


def first_of(spark: SparkSession, candidates: list[tuple[str, str]]) -> DataFrame:
    """The first ``(format, path)`` of which a row can be read, or that is empty; an error naming all if none can."""
    for kind, path in candidates:
        try:
            rows = spark.read.format(kind).load(path)
            rows.limit(1).collect()
            return rows
        except Exception as e:
            log.warning("%s: %s", path, e)
    raise FileNotFoundError(f"none of {[p for _, p in candidates]} can be read")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def synthetic(spark: SparkSession, lines: list[str], duplicates: int = 0) -> DataFrame:
    """``(id, text)``: rows ``doc_0``, ... of the lines, then ``dup_0``, ... of the first of them again."""
    rows = [(f"doc_{i}", x) for i, x in enumerate(lines)] + [(f"dup_{i}", x) for i, x in enumerate(lines[:duplicates])]
    return spark.createDataFrame(rows, "id string, text string")


def total_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``(files, bytes)`` of the files at a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
