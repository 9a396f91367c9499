"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns (role and text equal) of the chosen and the rejected conversation
is rendered once as the prompt; what is left of each is its completion.  A turn is rendered as

    <|role|>\\n text <|end|>\\n

and marks inside texts are broken up ("<|" becomes "< |"), so that texts cannot forge turns.  A
completion's mask lists the spans (start, stop), in characters of the completion, that training
should learn: the texts of turns of the assistant with their end mark.

All with native functions and no shuffle but the one that gathers conversations.  Null roles and
texts count as empty; turns sort by turn, role and text, null first, and repeated turns stay.
Identical conversations give empty completions, null or empty conversations empty
prompts.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.shared import own

END = "<|end|>"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(role), F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t.role), _safe(t.text), F.lit(END + "\n"))), "")


def learned_spans(turns: Column, learner: str) -> Column:
    """array<struct<start, stop>> within the rendered turns."""

    def step(a: Column, t: Column) -> Column:
        start = a.at + F.length(_head(t.role))
        stop = start + F.length(_safe(t.text)) + len(END)
        spans = F.when(t.role == learner, F.array_append(a.spans, F.struct(start.alias("start"), stop.alias("stop")))).otherwise(a.spans)
        return F.struct((stop + 1).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda a: a.spans)


def _clean(turns: Column) -> Column:
    filled = lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text"))
    return F.coalesce(F.transform(turns, filled), F.array().cast("array<struct<role:string,text:string>>"))


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected", learner: str = "assistant") -> DataFrame:
    """pairs (id, chosen, rejected: array<struct<role, text>>) -> (id_col, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)."""
    rows = own(pairs, pair_id=id_col, c=_clean(F.col(chosen_col)), r=_clean(F.col(rejected_col)))
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    rows = rows.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n")))
    rows = rows.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return rows.select(
        F.col("pair_id").alias(id_col), F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        learned_spans(F.col("c"), learner).alias("chosen_mask"), learned_spans(F.col("r"), learner).alias("rejected_mask"),
    )


def conversations_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    rows = own(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def reply_pairs(conversations: DataFrame, learner: str = "assistant") -> DataFrame:
    """Pairs made of each conversation with a reply of the learner: chosen is the conversation up to its last reply,
    rejected the same with a stale reply there (the reply before or, if there is none, an echo of the first user turn)."""
    turns = _clean(F.col("turns"))
    rows = conversations.select("conv_id", turns.alias("t"))
    last = F.array_max(F.transform("t", lambda t, i: F.when(t.role == learner, i + 1)))
    rows = rows.withColumn("last", last).where("last is not null").select("conv_id", F.slice("t", F.lit(1), F.col("last") - 1).alias("before"), F.get("t", F.col("last") - 1).alias("reply"))
    of = lambda role: F.filter("before", lambda t: t.role == role)
    stale = F.coalesce(F.try_element_at(of(learner), F.lit(-1)).text, F.try_element_at(of("user"), F.lit(1)).text, F.lit(""))
    other = F.struct(F.lit(learner).alias("role"), stale.alias("text"))
    return rows.select("conv_id", F.array_append("before", F.col("reply")).alias("chosen"), F.array_append("before", other).alias("rejected"))
