"""Operator 3, chat formatting, by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once more: that speaker's turns as the assistant's,
all others as users with their names, and a loss mask over the speaker's own words. The result has a row for each
perspective and turn, with its place in the rendered dialogue, so a conversation of any length is never one value.

Places are prefix sums in two steps: over the turns of a block, and over the blocks of a dialogue, so that a
conversation with a third of all turns is spread over its blocks.

Defined results: a null text is empty; a null role is the participant "unknown"; null conversation ids are one
conversation; turns with equal numbers stand in the order of role and text, null numbers come first; repeated rows
are turns of their own; extra columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Turns to a block.
BLOCK = 64


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, role, rendered, start, mask_start, mask_end: places in code points of the whole dialogue; the mask is null where nothing is learned."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.groupBy("conv_id", "name").agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("_conv"), F.col("name").alias("speaker"))
    told = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("name") == F.col("speaker")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("name"), F.lit("|>\n")))
    told = told.withColumns({"role": F.when(own, "assistant").otherwise("user"), "_head": F.length(head), "rendered": F.concat(head, F.col("text"), F.lit("\n")), "_block": F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)})
    told = told.withColumn("_long", F.length("rendered").cast("long"))
    dialogue = ["conv_id", "speaker"]
    blocks = told.groupBy(*dialogue, "_block").agg(F.sum("_long").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*dialogue).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_long").over(Window.partitionBy(*dialogue, "_block").orderBy("turn", "name", "text").rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("_within", F.coalesce(within, F.lit(0)))
    told = told.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("speaker") == F.col("_speaker")) & (F.col("_block") == F.col("_b")))
    start = F.col("_before") + F.col("_within")
    mask = start + F.col("_head")
    return told.select("conv_id", "speaker", "turn", "role", "rendered", start.alias("start"), F.when(own, mask).alias("mask_start"), F.when(own, mask + F.length("text")).alias("mask_end"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, dialogue, masks as start:end lists, for conversations that fit in a value."""
    rows = F.sort_array(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_end")))
    out = rotate(conversations).groupBy("conv_id", "speaker").agg(rows.alias("r"))
    own = F.filter("r", lambda x: x["mask_start"].isNotNull())
    return out.select("conv_id", "speaker", F.array_join(F.transform("r", lambda x: x["rendered"]), "").alias("dialogue"), F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["mask_start"], x["mask_end"])), ",").alias("masks"))


def op3_chat_formatting(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


SQL_OP3 = """
with turns as (select conv_id, turn::bigint as turn, coalesce(role, 'unknown') as name, coalesce(text, '') as text from conversations),
speakers as (select distinct conv_id, name as speaker from turns),
told as (
  select t.conv_id, s.speaker, t.turn, t.name, t.text, case when t.name = s.speaker then 'assistant' else 'user' end as role,
    case when t.name = s.speaker then '<|assistant|>' || chr(10) else '<|user name=' || t.name || '|>' || chr(10) end as head
  from turns t join speakers s on t.conv_id is not distinct from s.conv_id),
placed as (
  select *, coalesce(sum(length(head) + length(text) + 1) over (partition by conv_id, speaker order by turn nulls first, name, text rows between unbounded preceding and 1 preceding), 0)::bigint as start from told)
select conv_id, speaker, turn, role, head || text || chr(10) as rendered, start,
  case when role = 'assistant' then (start + length(head))::bigint end as mask_start,
  case when role = 'assistant' then (start + length(head) + length(text))::bigint end as mask_end
from placed
"""
