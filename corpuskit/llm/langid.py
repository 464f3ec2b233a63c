"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent character 1- to 3-grams of a language in order of
frequency; words are lower-cased runs of letters between boundary marks. A document is compared
with each profile by the out-of-place distance: the sum, over the document's own most frequent
n-grams, of how far each stands from its place in the profile, n-grams that the profile lacks
counting as the profile's length. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import plain_names
from corpuskit.plans.durable import cut

PROFILE = 400
#: Bound on the labelled documents per language that profiles are fitted on.
FIT_DOCS = 2000
FOLDS, HELD = 4, 2
UNKNOWN = "und"
SPAN = 1_000_000
#: Languages, a row each, that are broadcast at most.
BROADCAST_LANGS = 100_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of a text as integers, ascending, with their counts.

    A long text is read in spans; the last two marks of one stand before the next, so that counts are those
    of the whole text.
    """
    text = text.lower()
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.ones(1, np.int64)
    for i in range(0, max(1, len(text)), SPAN):
        codes = np.frombuffer(text[i : i + SPAN].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        codes = np.where(_letters()[codes], codes + 2, 1)
        if i + SPAN >= len(text):
            codes = np.append(codes, 1)
        codes = np.concatenate((before, codes))
        mark = codes == 1
        codes = codes[~(mark & np.concatenate(([False], mark[:-1])))]  # one mark between words
        n = min(len(before), len(codes))
        one, two = codes[n:], codes[n - 1 : -1] << 21 | codes[n:]
        three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[max(0, n - 2) :]
        three = three[(codes[1:-1] != 1)[max(0, n - 2) :]]  # no 3-gram across two words
        before = codes[-2:]
        k, c = np.unique(np.concatenate((one[one != 1], two, three)), return_counts=True)
        if len(keys):
            both = np.concatenate((keys, k))
            keys, inverse = np.unique(both, return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, c)), len(keys)).astype(np.int64)
        else:
            keys, counts = k, c
    return keys, counts


def _top(keys: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    return keys[np.argsort(-counts, kind="stable")[:n]]


def training_fold(id_col: Column) -> Column:
    """Whether a document may be learnt from: crc32 of its id as text, modulo 4, is not 2."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS != HELD


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = FIT_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of all languages of the training fold.

    At most about ``per_lang`` documents a language are read, chosen by a hash of id and text; their
    n-grams are counted on the executors and only ``size`` of each language reach the driver.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"), training_fold(F.col(id_col)).alias("train"))
    rows = rows.where("train AND lang IS NOT NULL AND text IS NOT NULL").drop("train")
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count(F.lit(1)))
    shares = cut(rows.groupBy("lang").agg(share.alias("share")))
    rows = rows.join(F.broadcast(shares) if shares.count() <= BROADCAST_LANGS else shares, "lang")
    rows = rows.where(F.expr("pmod(key, 1000000L) < share * 1000000")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                k, c = _grams(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], ["lang", "gram", "n"])

    found = cut(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def _table(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all n-grams of their profiles ascending, and the place of each in each profile."""
    langs = sorted(profiles)
    every = np.unique(np.array([g for x in langs for g in profiles[x]], np.int64))
    rank = np.full((len(every), len(langs)), PROFILE, np.int64)
    for j, x in enumerate(langs):
        rank[np.searchsorted(every, np.array(profiles[x], np.int64)), j] = np.arange(len(profiles[x]))
    return langs, every, rank


def predict(text: str | None, langs: list[str], every: np.ndarray, rank: np.ndarray) -> tuple[str, float]:
    """Language and score of one whole text."""
    top = _top(*_grams(text or ""))
    if not len(top) or not langs:
        return UNKNOWN, 0.0
    at = np.minimum(np.searchsorted(every, top), len(every) - 1)
    known = (every[at] == top)[:, None] & (rank[at] < PROFILE)
    far = np.where(known, np.abs(rank[at] - np.arange(len(top))[:, None]), PROFILE).sum(axis=0)
    best = int(np.argmin(far))
    return langs[best], 1.0 - float(far[best]) / (PROFILE * len(top))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per input row, without a shuffle.

    Null text, text without a letter and an empty set of profiles give ``und`` and score 0. Equal
    distances go to the first language by code point. The score is 1 less the distance as a share of
    the largest possible.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_table(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(x.as_py(), *shared.value) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits profiles on the training fold and identifies every row: ``(doc_id, held_out, lang_pred, score)``.

    A row without an id is in neither fold: it is not learnt from, and ``held_out`` is false.
    """
    found = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the predicted language in ``lang_col``, without the rows of which no language can be told.

    Those are null texts and texts without a letter. Where no profile could be learnt no language is
    told: texts with a letter stay, as they are. An empty input gives no rows.
    """
    docs, named_back = plain_names(docs, [id_col, text_col, lang_col])
    profiles = fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(_table(profiles))

    @F.pandas_udf("string")
    def named(texts: pd.Series) -> pd.Series:
        return pd.Series([predict(x, *shared.value)[0] for x in texts], dtype=object)

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([len(_grams(x or "")[0]) > 0 for x in texts], dtype=bool)

    text = F.col(text_col).cast("string")
    if not profiles:
        return named_back(docs.where(lettered(text)))
    # Else the filter would be moved below the projection and compute it a second time.
    found = docs.withColumn("__li_lang", named.asNondeterministic()(text)).where(F.col("__li_lang") != UNKNOWN)
    kind = docs.schema[lang_col].dataType
    return named_back(found.withColumn(lang_col, F.col("__li_lang").cast(kind)))
