"""Chat transcripts: formatting, parsing and tokenising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import arrays as A
from corpuskit.functions import text as T
from corpuskit.operators.tokens import Encoder, tokenise

# Tags of the transcript format.
TAGS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
DEFAULT_SYSTEM = "あなたは日本語で答えるアシスタントです。"


def message(role: Column, content: Column) -> Column:
    """Tag, line feed, content; an unknown role is an error."""
    tag = reduce(lambda c, r: c.when(role == r, F.lit(TAGS[r])), list(TAGS)[1:], F.when(role == "system", F.lit(TAGS["system"])))
    tag = tag.otherwise(F.raise_error(F.concat(F.lit("Unknown role: "), F.coalesce(role, F.lit("null")))).cast("string"))
    return F.concat(tag, F.lit("\n"), content)


def transcript(messages: Column, generation_prompt: bool = True, system: str | None = None) -> Column:
    """Text of an ordered array of ``struct<role, content>``.

    Without a system message one is put first (``system``, or a default; the empty string leaves it
    out); an assistant tag may ask for the answer; the text ends with a line feed.
    """
    system = DEFAULT_SYSTEM if system is None else system
    body = F.transform(messages, lambda m: message(m.role, m.content))
    if system:
        has = F.exists(messages, lambda m: m.role == "system")
        body = F.when(has, body).otherwise(F.concat(F.array(F.lit(f"{TAGS['system']}\n{system}")), body))
    if generation_prompt:
        body = F.concat(body, F.array(F.lit(TAGS["assistant"])))
    return F.concat(F.array_join(body, "\n"), F.lit("\n"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", **options) -> DataFrame:
    """``(conv_id, transcript)``: turns of each conversation in order."""
    rows = turns.select(conv, F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")).alias("m"))
    rows = rows.groupBy(conv).agg(F.sort_array(F.collect_list("m")).alias("m"))
    return rows.select(conv, transcript(F.col("m"), **options).alias("transcript"))


def _role_of(line: Column) -> Column:
    """The role that a line's tag names, null for a line of content."""
    bare = T.strip(line)
    first, *rest = TAGS
    return reduce(lambda c, r: c.when(bare == TAGS[r], r), rest, F.when(bare == TAGS[first], F.lit(first)))


def parse(text: Column) -> Column:
    """Array of ``struct<role, content>`` of a transcript.

    A line that is a tag but for white space starts a message; contents are stripped; empty messages
    and text before the first tag are dropped. Tags are marked first and lines cut between their
    places, so the work grows with the number of lines.
    """

    def between(lines: Column, roles: Column, at: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            n = F.coalesce(F.get(at, k + 1), F.size(lines)) - i - 1
            return F.struct(F.get(roles, i).alias("role"), T.strip(F.array_join(F.slice(lines, i + 2, n), "\n")).alias("content"))

        return F.transform(at, one)

    def messages(lines: Column) -> Column:
        def placed(roles: Column) -> Column:
            tags = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(roles, i).isNotNull())
            return A.let(tags, lambda at: between(lines, roles, at))

        return A.let(F.transform(lines, _role_of), placed)

    return F.filter(A.let(F.split(text, "\n"), messages), lambda m: m.content != "")


def tokenised(turns: DataFrame, encoder: Encoder, **options) -> DataFrame:
    """Transcripts with their token ids."""
    return tokenise(format_conversations(turns, **options), encoder, "transcript", None)
