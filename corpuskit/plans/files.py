"""Row-wise stages over folders of JSONL files: an output for each input, statistics from the same pass.

Raw lines and kept rows are counted while the output is written, by two observed aggregates: a
histogram with as many bins as there are files (and reasons) is an exact count of each. The sink is
partitioned by file name and overwrites the files at hand alone, so a changed input rewrites its own
output and no other.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from urllib.parse import unquote

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import quality
from corpuskit.sources import readers

#: Files of one job; beyond them files are handled in groups, one after another.
FILES = 1000
#: Reasons in the order in which a text is tested.
REASONS = ("length", "cjk_ratio", "repetition", "mean_line_length")
STATS = "file string, total long, kept long, filtered long, filter_rate double, reasons map<string,long>"


def _number(names: list[str]) -> Column:
    """A row's file as a number."""
    pairs = [F.lit(x) for i, name in enumerate(names) for x in (name, i)]
    return F.try_element_at(F.create_map(*pairs), F.col("file"))


def _counts(number: Column, n: int) -> Column:
    """Counts of whole numbers from 0 to below ``n``, exact because each has a bin of its own."""
    return F.histogram_numeric(number.cast("double"), F.lit(max(2, n)))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    # Spark gives names with percent codes, in which a plus is itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(paths).select("value", name.alias("file"))


def _named(spark: SparkSession, inputs: str, only: Iterable[str] | None) -> dict[str, str]:
    """Paths of the input files by name, those of ``only`` if given; an error for an unknown one or for two of one name."""
    found: dict[str, str] = {}
    for path in sorted(map(unquote, spark.read.text(inputs).inputFiles())):
        name = os.path.basename(path)
        if name in found:
            raise ValueError(f"two inputs are named {name}")
        found[name] = path
    asked = set(found) if only is None else set(only)
    if asked - set(found):
        raise FileNotFoundError(f"no inputs named {', '.join(sorted(asked - set(found)))}")
    return {name: path for name, path in found.items() if name in asked}


def run(spark: SparkSession, inputs: str, out: str, stage: Callable[[DataFrame], DataFrame], only: Iterable[str] | None = None, schema: str = "text STRING") -> DataFrame:
    """``(file, total, kept, filtered, filter_rate, reasons)``, a row for each input, whose kept rows are in ``out/file=<name>``.

    ``stage`` gets the parsed rows of the files and returns them with a column ``reason``, null for those to
    keep; rows that it drops count as filtered without a reason. ``total`` counts every raw line,
    blank and malformed ones too. ``only`` names the inputs to handle again; the outputs of others stay
    as they are. An input of which nothing is kept has no output, also where it had one.
    """
    paths, rows = _named(spark, inputs, only), []
    names = sorted(paths)
    for at in range(0, len(names), FILES):
        rows += _job(spark, {x: paths[x] for x in names[at : at + FILES]}, out, stage, schema)
    return spark.createDataFrame(rows, STATS)


def _job(spark: SparkSession, paths: dict[str, str], out: str, stage: Callable[[DataFrame], DataFrame], schema: str) -> list[tuple]:
    names, seen, judged = list(paths), Observation("seen"), Observation("judged")
    file, n = _number(names), len(paths)
    lines = _read(spark, list(paths.values())).observe(seen, _counts(file, n).alias("total"))
    parsed = readers.parse_jsonl(lines, schema).select("file", "row.*")
    by_reason = F.try_element_at(F.create_map(*[F.lit(x) for i, r in enumerate(REASONS) for x in (r, i)]), F.col("reason"))
    done = stage(parsed).observe(
        judged,
        _counts(F.when(F.col("reason").isNull(), file), n).alias("kept"),
        _counts(file * len(REASONS) + by_reason, n * len(REASONS)).alias("reasons"),
    )
    kept = done.where("reason IS NULL").drop("reason")
    kept.write.partitionBy("file").option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(out)
    counts = {k: {int(x["x"]): int(x["y"]) for x in (found or [])} for k, found in (seen.get | judged.get).items()}
    rows = []
    for i, name in enumerate(names):
        total, left = counts["total"].get(i, 0), counts["kept"].get(i, 0)
        reasons = {r: c for k, r in enumerate(REASONS) if (c := counts["reasons"].get(i * len(REASONS) + k, 0))}
        rows.append((name, total, left, total - left, (total - left) / total if total else 0.0, reasons))
    _drop_outputs(out, [r[0] for r in rows if not r[2]])
    return rows


def _drop_outputs(out: str, names: list[str]) -> None:
    """Removes what an earlier run left of inputs that have no rows now; an overwrite by partition does not see them."""
    fs, base = pyarrow.fs.FileSystem.from_uri(out)
    for name in names:
        for at in {f"{base}/file={name}", f"{base}/file={_escaped(name)}"}:
            if fs.get_file_info(at).type == pyarrow.fs.FileType.Directory:
                fs.delete_dir(at)


def _escaped(name: str) -> str:
    """A partition's folder name, in which Spark writes some characters as percent codes."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 32 or ord(c) == 127 else c for c in name)


def output(spark: SparkSession, out: str, schema: str = "text STRING") -> DataFrame:
    """``file`` and the fields of all outputs."""
    return spark.read.schema(f"{schema}, file STRING").json(out)


def clean_files(spark: SparkSession, inputs: str, out: str, min_ratio: float = 0.3, script: str = T.CJK, only: Iterable[str] | None = None, schema: str = "text STRING") -> DataFrame:
    """Cleans each file's texts; those empty, or with too little of the script, go without a reason."""
    return run(spark, inputs, out, lambda rows: quality.clean_filter(rows, min_ratio, script).withColumn("reason", F.lit(None).cast("string")), only, schema)


def filter_files(spark: SparkSession, inputs: str, out: str, limits: quality.Limits = quality.Limits(), only: Iterable[str] | None = None, schema: str = "text STRING") -> DataFrame:
    """Filters each file's rows by quality, with the reasons of the rejected ones."""
    return run(spark, inputs, out, lambda rows: quality.with_reason(rows, limits), only, schema)


def summary(stats: DataFrame) -> DataFrame:
    """One row over all files: ``files, total, kept, filtered, filter_rate``."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "kept", "filtered")]
    return stats.agg(F.count(F.lit(1)).alias("files"), *sums).withColumn("filter_rate", F.coalesce(F.try_divide("filtered", "total"), F.lit(0.0)))
