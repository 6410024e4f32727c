"""Preference formatting: shared prompt, paired masked completions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

START, END = "<|im_start|>", "<|im_end|>"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def with_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, each rendered, with the end of each in the whole rendering."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = turns.withColumn("line", render(F.col("role"), F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("ends", F.sum(F.length("line")).over(order)).withColumn("at", F.row_number().over(order))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "role", "text", "line", "ends"))).alias("turns"))


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected); null stands for one that is missing."""
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    return ids.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(~even, F.col("conv_id"))).alias("rejected_id"))


def format_preferences(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """For each pair: the longest common turn prefix as prompt, and both remainders with loss masks.

    pairs: pair_id, chosen_id, rejected_id (adjacent_pairs() by default). Turns are
    equal if role and text are (null counts as empty); turns with one number are
    ordered by role, then text, and all kept, repeated ones too. A mask has from and to of each
    assistant turn in a completion, in characters: its text and the end mark after it, which a model must learn to give; what lies
    outside gets no loss. Where one of a pair is missing or has no turns, the prompt is empty and that
    completion null. Rows without conv_id are left out, other columns, whatever their names, too; an empty table gives no rows.
    A conversation, however long its texts, is one row."""
    pairs = adjacent_pairs(conversations) if pairs is None else pairs
    convs = with_turns(conversations)
    side = lambda name: convs.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    shared = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.expr("filter(sequence(0, least(size(chosen), size(rejected)) - 1), i -> chosen[i].role != rejected[i].role or chosen[i].text != rejected[i].text)")
    both = both.withColumn("n_shared", F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), 0).otherwise(F.coalesce(F.array_min(differs), shared)))
    out = [F.col("pair_id").cast("long").alias("pair_id"), "chosen_id", "rejected_id", F.col("n_shared").cast("long").alias("n_prompt_turns")]
    prompt = "array_join(transform(slice(chosen, 1, n_shared), t -> t.line), '')"
    out.append(F.coalesce(F.expr(prompt), F.lit("")).alias("prompt"))
    for name in ("chosen", "rejected"):
        rest = f"slice({name}, n_shared + 1, size({name}))"
        base = f"if(n_shared > 0, {name}[n_shared - 1].ends, 0)"
        tail = len(END) + 1
        span = f"named_struct('from', t.ends - {base} - {tail} - length(t.text), 'to', t.ends - {base} - 1)"
        out.append(F.expr(f"array_join(transform({rest}, t -> t.line), '')").alias(f"{name}_completion"))
        out.append(F.expr(f"transform(filter({rest}, t -> t.role = 'assistant'), t -> {span})").alias(f"{name}_mask"))
    return both.select(*out)
