"""Chat: bounded history, numeric tokens and the check of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import fixed_values as fixed
from ticketlens.functions.text import mentions_any, number_tokens, starts_with_any, strip
from ticketlens.sources.schemas import CHAT_ANSWER


def bounded_history(turns: DataFrame, max_messages: int = fixed.DEFAULT_HISTORY) -> DataFrame:
    """The last ``max_messages`` turns of each conversation.

    The rank filter is pushed below the exchange as a window group limit: each
    partition sends at most ``max_messages`` rows per conversation.
    """
    if max_messages < 1:
        raise ValueError("max_messages must be at least 1")
    if max_messages > fixed.LARGEST_HISTORY:
        raise ValueError(f"max_messages must be at most {fixed.LARGEST_HISTORY}")
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        turns.withColumn("_age", F.row_number().over(latest))
        .filter(F.col("_age") <= max_messages)
        .drop("_age")
    )


def history_lists(bounded: DataFrame) -> DataFrame:
    """One row per conversation with its bounded turns as an ordered array.

    ``answer_details`` of a turn is kept where the turns carry it, else null.
    """
    if "answer_details" not in bounded.columns:
        bounded = bounded.withColumn("answer_details", F.lit(None).cast(CHAT_ANSWER))
    turn = F.struct("turn", "role", "content", "answer_details")
    by_turn = F.array_sort(F.collect_list(turn))
    return bounded.groupBy("conv_id").agg(
        F.transform(by_turn, lambda t: t.dropFields("turn")).alias("recent_turns")
    )


def numeric_tokens(texts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Numeric tokens of a text in order: ``(*keys, token_no, token)``."""
    return texts.select(
        *keys, F.posexplode(number_tokens(F.col(column))).alias("token_no", "token")
    )


def cited_lines(answers: DataFrame) -> DataFrame:
    """Distinct lines cited per batch: ``(batch_id, line)``.

    A line cited by very many answers shrinks before the shuffle.
    """
    return answers.select("batch_id", F.explode("evidence_used").alias("line")).distinct()


def foreign_lines(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Cited lines that aren't in the catalog of their own batch: ``(batch_id, line)``.

    Only catalogs of batches with citations are laid out; both sides hold a line of a batch once.
    """
    cited = cited_lines(answers)
    asked = cited.select("batch_id").distinct()
    lines = contexts.join(asked, "batch_id", "left_semi").select("batch_id", F.explode("evidence_catalog").alias("line"))
    return cited.join(lines, ["batch_id", "line"], "left_anti")


def verify_chat_answers(answers: DataFrame, foreign: DataFrame) -> DataFrame:
    """Add ``verdict`` and ``issue`` to answers keyed by (batch_id, turn).

    ``answers`` carries question, answer, evidence_used, assumptions and missing_information;
    ``foreign`` is what ``foreign_lines`` finds. Only keys of answers that cite such a line come back to the texts.
    """
    cited = answers.select("batch_id", "turn", F.explode("evidence_used").alias("line"))
    outside = (
        cited.join(foreign, ["batch_id", "line"], "left_semi")
        .select("batch_id", "turn", F.lit(True).alias("_outside"))
        .distinct()
    )
    answer = F.col("answer")
    # Wrapped in an array so that the joined text is built once, not per token.
    cited_text = F.array(F.array_join("evidence_used", " "))
    uncited = F.exists(
        cited_text, lambda c: F.exists(number_tokens(answer), lambda t: ~F.contains(c, t))
    )
    # In the order of the checks; the citation check comes second.
    own = (
        F.when((F.size("evidence_used") == 0) & (F.size("missing_information") == 0), "neither")
        .when(
            F.exists("assumptions", lambda a: ~starts_with_any(a, fixed.ASSUMPTION_LABELS)),
            "unlabelled",
        )
        .when(uncited, "number")
        .when(mentions_any(answer, (fixed.FORBIDDEN_CLAIM,)), "guarantee")
        .otherwise("accepted")
    )
    verdict = (
        F.when(F.col("_blank"), "blank question")
        .when(F.col("_outside"), "outside")
        .otherwise(F.col("_own"))
    )
    wording = {
        "blank question": fixed.ISSUE_BLANK_QUESTION,
        "outside": fixed.ISSUE_OUTSIDE,
        "neither": fixed.ISSUE_NEITHER,
        "unlabelled": fixed.ISSUE_UNLABELLED,
        "number": fixed.ISSUE_NUMBER,
        "guarantee": fixed.ISSUE_CHAT_GUARANTEE,
    }
    issue = F.lit(None).cast("string")
    for name, text in wording.items():
        issue = F.when(F.col("verdict") == name, F.lit(text)).otherwise(issue)
    return (
        answers.withColumn("_blank", F.length(strip(F.col("question"))) == 0)
        .withColumn("_own", own)
        .join(outside, ["batch_id", "turn"], "left")
        .withColumn("verdict", verdict)
        .drop("_outside", "_blank", "_own")
        .withColumn("issue", issue)
    )
