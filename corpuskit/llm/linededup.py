"""Removal of lines that many sites share, by DataFrame operations alone.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites and in as many distinct
texts: copies of one text on many sites do not make its lines boilerplate. HyperLogLog sketches of
the sites and of the texts of each line hash are merged by partial aggregation. Lines whose
estimates are far from the threshold are decided by them; those near it are counted exactly.
Boilerplate leaves every text but those that hold nothing else: of them nothing would be left, and
copies among them are the business of near-duplicate removal.

Texts are split and hashed once, into distinct (line, text, site); all that follows works on these
hashes. A line that stands in most texts is never dealt to one task by its hash: its rows are
aggregated before they are shuffled, and tables of lines are broadcast up to ``BROADCAST`` rows, else
joined with a salt from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import plain_names, spread_join
from corpuskit.plans.durable import cut

MIN_SITES = 10
LOG_BUCKETS = 10
#: Share of the threshold by which an estimate must miss it to decide; at 2**10 buckets ten standard errors.
MARGIN = 0.35
#: Lines, eight bytes each, that are broadcast at most; beyond them a join is dealt by line and salt.
BROADCAST = 1_000_000
SALTS = 32
#: Distinct boilerplate lines of a text up to which its lines are compared with each of them; beyond, marks are joined by place.
FEW_LINES = 256
BLANK = r"^[\x20\x09-\x0D]*$"


def _line_key(line: Column) -> Column:
    """Hash of a line without white space at its ends; null for a blank line."""
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col).cast("string"), "\n")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__ld_key``, a hash of the text; empty texts, which have no line, are spread by their other columns."""
    text, rest = F.col(text_col).cast("string"), [c for c in docs.columns if c != text_col]
    return docs.withColumn("__ld_key", F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.xxhash64(text)).otherwise(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in rest])))


def _occurrences(keyed: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """Distinct ``(line, text, site)`` as hashes. A null site counts as the empty one."""
    lines = F.array_distinct(F.transform(_lines(text_col), _line_key))
    rows = keyed.select(F.explode(lines).alias("line"), F.col("__ld_key").alias("text"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit(""))).alias("site"))
    return cut(rows.where("line IS NOT NULL").distinct())


def _of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows(line, text, ...)`` of the lines in ``lines(line)``, a cut table."""
    if lines.count() <= BROADCAST:
        return rows.join(F.broadcast(lines), "line", "left_semi")
    salted = lines.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return rows.withColumn("__salt", F.expr(f"int(pmod(text, {SALTS}))")).join(salted, ["line", "__salt"], "left_semi").drop("__salt")


def _distinct(rows: DataFrame, column: str) -> DataFrame:
    """``(line, n_<column>)``: exact numbers of distinct values per line."""
    return rows.groupBy("line", column).agg(F.lit(1).alias("one")).groupBy("line").agg(F.sum("one").alias(f"n_{column}"))


def _spread(found: DataFrame, min_sites: int) -> DataFrame:
    """``(line)``: the lines of ``found(line, text, site)`` on ``min_sites`` distinct sites or more, in as many distinct texts."""
    often = cut(found.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line"))
    found = _of(found, often)
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LOG_BUCKETS)))
    counted = cut(found.groupBy("line").agg(sketch("site").alias("sites"), sketch("text").alias("texts")))
    least = F.least("sites", "texts")
    near = cut(counted.where(least.between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("line"))
    rows = _of(found, near)
    exact = _distinct(rows, "site").join(_distinct(rows, "text"), "line").where((F.col("n_site") >= min_sites) & (F.col("n_text") >= min_sites))
    return cut(counted.where(least > min_sites * (1 + MARGIN)).select("line").unionByName(exact.select("line")))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``(line)``: hashes of the boilerplate lines. A null site counts as one site, the same as an empty one."""
    return _spread(_occurrences(_keyed(docs, text_col), text_col, site_col), min_sites)


def _marks(keyed: DataFrame, text_col: str, pairs: DataFrame) -> DataFrame:
    """``(__ld_hit, __ld_bad, __ld_marks)``: whether each line of the texts in ``pairs(__ld_hit, line)`` is in there, in order.

    One copy of a text gives the hashes of its lines, which meet its boilerplate by text and line, so
    the work grows with the number of lines, and a text's lines are dealt over tasks.
    """
    texts = pairs.select(F.col("__ld_hit").alias("text")).distinct()
    texts = F.broadcast(texts) if texts.count() <= BROADCAST else texts
    keys = keyed.select(F.col("__ld_key").alias("text"), F.transform(_lines(text_col), _line_key).alias("keys")).join(texts, "text", "left_semi")
    each = keys.groupBy("text").agg(F.first("keys").alias("keys")).select("text", F.posexplode("keys").alias("pos", "key"))
    each = each.join(pairs, (F.col("text") == F.col("__ld_hit")) & (F.col("key") == F.col("line")), "left")
    places = F.array_sort(F.collect_list(F.struct("pos", F.col("line").isNotNull().alias("bad"))))
    none = F.lit(None).cast("array<bigint>").alias("__ld_bad")
    return each.groupBy(F.col("text").alias("__ld_hit")).agg(none, F.transform(places, lambda x: x.bad).alias("__ld_marks"))


def _marked(docs: DataFrame, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """``docs`` with ``__ld_lines``, an array of (line, bad) for texts with boilerplate, and ``__ld_cut``, whether it leaves them."""
    keyed = _keyed(docs, text_col)
    found = _occurrences(keyed, text_col, site_col)
    # Keys are hashes of whole texts, so copies meet in one row, of which the size is bounded by the text's.
    hits = _of(found, _spread(found, min_sites)).groupBy(F.col("text").alias("__ld_hit")).agg(F.collect_set("line").alias("__ld_bad"))
    hits = cut(hits.withColumn("__ld_marks", F.lit(None).cast("array<boolean>")))
    many = hits.where(F.size("__ld_bad") > FEW_LINES)
    if not many.isEmpty():
        marks = _marks(keyed, text_col, many.select("__ld_hit", F.explode("__ld_bad").alias("line")))
        hits = hits.where(F.size("__ld_bad") <= FEW_LINES).unionByName(marks)
    docs = spread_join(keyed, hits, "__ld_key", "__ld_hit", [c for c in docs.columns if c != text_col])
    bad = lambda x, i: F.coalesce(F.get("__ld_marks", i), F.array_contains("__ld_bad", _line_key(x)), F.lit(False))
    parts = F.transform(_lines(text_col), lambda x, i: F.struct(x.alias("line"), bad(x, i).alias("bad")))
    docs = docs.withColumn("__ld_lines", F.when(F.col("__ld_hit").isNotNull(), parts))
    return docs.withColumn("__ld_cut", F.coalesce(F.exists("__ld_lines", lambda x: ~x.bad & ~x.line.rlike(BLANK)), F.lit(False)))


def _left(text_col: str) -> Column:
    """The text without its boilerplate lines."""
    rest = F.array_join(F.transform(F.filter("__ld_lines", lambda x: ~x.bad), lambda x: x.line), "\n")
    return F.when(F.col("__ld_cut"), rest).otherwise(F.col(text_col))


def remove_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``; other rows and columns as they are.

    ``n_chars``, where there is such a column, follows. Null and empty texts stay, and so do texts of
    boilerplate alone. Lines are compared without white space at their ends; blank lines are never
    boilerplate. A null site counts as one site. Repeated rows, and copies of a text, count once each. An
    empty input gives no rows.
    """
    docs, named_back = plain_names(docs, [text_col, site_col, "n_chars"])
    marked = _marked(docs, text_col, site_col, min_sites).withColumn(text_col, _left(text_col))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.when(F.col("__ld_cut"), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return named_back(marked)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per input row ``doc_id, n_lines, n_shared, n_removed, all_shared`` and the text that is left, ``text``.

    ``n_lines`` counts the lines that are not blank, ``n_shared`` the boilerplate among them,
    ``n_removed`` those removed (none if ``all_shared``: the text is boilerplate alone). Null text
    has no lines. Otherwise as ``remove_lines``.
    """
    marked = _marked(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, site_col))]), text_col, site_col, min_sites)
    text = F.col(text_col).cast("string")
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(BLANK))))
    shared = F.when(F.col("__ld_lines").isNull(), 0).otherwise(F.size(F.filter("__ld_lines", lambda x: x.bad)))
    return marked.select(
        F.col(id_col).cast("long").alias("doc_id"), lines.cast("long").alias("n_lines"), shared.cast("long").alias("n_shared"),
        F.when(F.col("__ld_cut"), shared).otherwise(0).cast("long").alias("n_removed"),
        (F.col("__ld_lines").isNotNull() & ~F.col("__ld_cut")).alias("all_shared"), _left(text_col).alias("text"),
    )
