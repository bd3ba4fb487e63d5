"""Chat formatting: collapse of cumulative snapshots, then rendering.

A logged conversation that is a prefix of a longer one is a snapshot of it and
is dropped; of equal conversations the one with the smallest conv_id stays.

A turn's hash covers its place, role and text, and a prefix's hash is the
exclusive or of its turns' hashes, so it rolls along by one turn at a time.
Conversations are worked on in strips of STRIP turns: strips' counts and hashes
are summed first and carried to the next strips, so a conversation with very
many turns is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut, read

STRIP = 512


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns `(conv_id, strip, place, role, text)`, places counting from 1; rows without conv_id or turn are left out."""
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / STRIP).alias("strip")).distinct()
    sizes = rows.groupBy("conv_id", "strip").count()
    before = sizes.select("conv_id", "strip", F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("strip").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("conv_id", "strip").orderBy("turn", "role", "text"))
    return rows.withColumn("n", within).join(before, ["conv_id", "strip"]).select("conv_id", "strip", (F.col("before") + F.col("n")).alias("place"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """`(conv_id, place, h1, h2, last)`: the hash of each prefix in two words, and whether it is the whole conversation."""
    hashed = turns.select("conv_id", "strip", "place", F.xxhash64("place", "role", "text").alias("a"), F.xxhash64("text", "role", "place", F.lit(1)).alias("b"))
    strips = hashed.groupBy("conv_id", "strip").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = W.partitionBy("conv_id").orderBy("strip").rowsBetween(W.unboundedPreceding, -1)
    final = F.lead("strip").over(W.partitionBy("conv_id").orderBy("strip")).isNull()
    carried = strips.select("conv_id", "strip", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ab"), final.alias("final"))
    rolling = W.partitionBy("conv_id", "strip").orderBy("place")
    here = hashed.select("conv_id", "strip", "place", F.bit_xor("a").over(rolling).alias("a"), F.bit_xor("b").over(rolling).alias("b"), F.lead("place").over(rolling).isNull().alias("ends"))
    both = here.join(carried, ["conv_id", "strip"])
    return both.select("conv_id", "place", F.col("a").bitwiseXOR(F.col("a0")).alias("h1"), F.col("b").bitwiseXOR(F.col("b0")).alias("h2"), (F.col("ends") & F.col("final")).alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """`(conv_id, n_turns)` of the conversations that stay."""
    found = cut(prefixes(turns))
    name = ["place", "h1", "h2"]
    whole = found.where("last").groupBy(*name).agg(F.min("conv_id").alias("conv_id"))
    longer = found.where("NOT last").select(*name).distinct()
    return whole.join(longer, name, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """`(conv_id, part, n_turns, text)`: each kept conversation in the chat template, a row for each strip of turns."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = turns.join(kept, "conv_id").withColumn("line", F.struct("place", line.alias("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "")
    return rows.groupBy("conv_id", F.col("strip").alias("part")).agg(F.first("n_turns").alias("n_turns"), text.alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    turns = cut(numbered_turns(conversations))
    return render(turns, maximal_conversations(turns))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered.

    A null role or text is rendered as an empty one; repeated rows count once;
    turns with the same number are ordered by role, then text; rows without
    conv_id or turn are left out; an empty table gives no rows; further columns
    are not read.  A part covers turns numbered from 512 * part.
    """
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return format_chats(turns)


OP3_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns FROM t GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns
), m AS (
  SELECT conv_id, len(turns) AS n_turns FROM u
  WHERE NOT EXISTS (SELECT 1 FROM u AS d WHERE len(d.turns) > len(u.turns) AND d.turns[1:len(u.turns)] = u.turns)
)
SELECT t.conv_id, (t.turn // 512)::BIGINT AS part, any_value(m.n_turns)::BIGINT AS n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS text
FROM t JOIN m USING (conv_id) GROUP BY ALL
"""
