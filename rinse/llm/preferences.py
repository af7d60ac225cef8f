"""Preference pairs: what two conversations share becomes the prompt, what differs is completed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.llm.merkle import next_ids
from rinse.session import stored

IDS_PER_PART = 4_000


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def _said(turns: DataFrame) -> DataFrame:
    """conv_id, turn, and what was said, once for each turn."""
    turns = turns.select("conv_id", "turn", "role", "text").dropna(subset=["conv_id", "turn"])
    return turns.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))


def preference_turns(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Turns of chosen and rejected conversations, with the shared beginning once as prompt.

    ``turns`` has conv_id, turn, role, text; ``pairs`` has pair_id, chosen, rejected (conv_ids; a
    null or unknown one has no turns). The prompt is the longest beginning in which both have the
    same turn numbers, roles and texts (null equals null). Returns a row per turn: pair_id, part
    (prompt, chosen or rejected), turn, rendered, and trained, the mask: true for the turns of the
    assistant outside the prompt. Rows without conv_id or turn are left out; of repeated rows for
    one turn the smallest by role and text counts. Other columns are not read.

    Turns are compared row by row, so a conversation of any length is never gathered.
    """
    turns = _said(turns)
    sides = pairs.dropna(subset=["pair_id"]).dropDuplicates(["pair_id"]).select(
        "pair_id", F.explode(F.array(*(
            F.struct(F.lit(side).alias("part"), F.col(side).alias("conv_id")) for side in ("chosen", "rejected")
        ))).alias("side")
    ).select("pair_id", "side.part", "side.conv_id")
    said = sides.join(turns, "conv_id").select("pair_id", "part", "turn", "said")

    def of(part: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col("said")))

    both = said.groupBy("pair_id", "turn").agg(of("chosen").alias("chosen"), of("rejected").alias("rejected"))
    return _parts(both)


def answer_turns(turns: DataFrame, per_part: int = IDS_PER_PART) -> DataFrame:
    """Every conversation, chosen over itself with another last answer; rows as of ``preference_turns``.

    ``pair_id`` is the conv_id. In the rejected one the text of the last turn of the assistant is
    that of the next lower conversation which has such a turn, the highest after the lowest. Turns
    after it stay in both. Conversations without such a turn, or with an equal one, are all prompt.
    """
    said = _said(turns)
    answers = said.where(F.col("said.role") == "assistant").groupBy("conv_id").agg(
        F.max(F.struct("turn", "said.text")).alias("answer")
    )
    answers = stored(answers.select(F.col("conv_id").cast("long").alias("conv_id"), "answer.*"), "answers")
    following = next_ids(answers.select(F.lit(True).alias("known"), F.col("conv_id").alias("id")), per_part)
    others = answers.select(F.col("conv_id").alias("other"), F.struct(F.col("text").alias("said")).alias("instead"))
    last = following.select(F.col("id").alias("conv_id"), F.col("next.id").alias("other")).join(others, "other")
    last = last.join(answers.select("conv_id", "turn"), "conv_id").select("conv_id", "turn", "instead")
    rejected = F.when(
        F.col("instead").isNotNull(), F.struct(F.col("said.role").alias("role"), F.col("instead.said").alias("text"))
    ).otherwise(F.col("said"))
    both = said.join(last, ["conv_id", "turn"], "left")
    return _parts(both.select(F.col("conv_id").alias("pair_id"), "turn", F.col("said").alias("chosen"), rejected.alias("rejected")))


def _parts(both: DataFrame) -> DataFrame:
    """The rows of ``preference_turns`` from pair_id, turn, and what either side says in it."""
    differ = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    ends = both.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("end"))
    shared = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    parts = both.join(ends, "pair_id").select(
        "pair_id", "turn", F.explode(
            F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said"))))
            .otherwise(F.array(*(
                F.struct(F.lit(side).alias("part"), F.col(side).alias("said")) for side in ("chosen", "rejected")
            )))
        ).alias("row")
    ).where("row.said is not null")
    trained = F.coalesce((F.col("row.part") != "prompt") & (F.col("row.said.role") == "assistant"), F.lit(False))
    return parts.select(
        "pair_id", F.col("row.part").alias("part"), "turn",
        _rendered(F.col("row.said.role"), F.col("row.said.text")).alias("rendered"), trained.alias("trained"),
    )


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``preference_turns`` as one row per pair, see ``paired``."""
    return paired(preference_turns(turns, pairs))


def paired(parts: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected as texts, and the spans that are trained.

    ``chosen_spans`` and ``rejected_spans`` are the completions' (start, end) ranges of characters
    that count for the loss; the rest is masked. A part without turns is empty.
    """
    gathered = parts.groupBy("pair_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "rendered", "trained"))).alias("turns")
    )

    def of(part: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col("turns"))),
                          F.array().cast("array<struct<turn:bigint,rendered:string,trained:boolean>>"))

    def text(turns: Column) -> Column:
        return F.array_join(turns["rendered"], "")

    def spans(turns: Column) -> Column:
        ends = F.aggregate(
            turns,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
            lambda done, one: F.struct(
                (done["at"] + F.length(one["rendered"])).alias("at"),
                F.when(one["trained"], F.concat(done["spans"], F.array(F.struct(
                    done["at"].alias("start"), (done["at"] + F.length(one["rendered"])).alias("end")
                )))).otherwise(done["spans"]).alias("spans"),
            ),
        )
        return ends["spans"]

    whole = gathered.groupBy("pair_id").agg(*(of(part).alias(part) for part in ("prompt", "chosen", "rejected")))
    return whole.select(
        "pair_id", text(F.col("prompt")).alias("prompt"), text(F.col("chosen")).alias("chosen"),
        spans(F.col("chosen")).alias("chosen_spans"), text(F.col("rejected")).alias("rejected"),
        spans(F.col("rejected")).alias("rejected_spans"),
    )
