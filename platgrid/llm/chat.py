"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context.

An example's text is the rendered context followed by the rendered reply; only the characters
[train_start, train_end) of it, the reply and the mark that ends it, are trainable.

Defined results: turns are ordered by (turn, role, text), so that ties and repeated rows have one order, and
repeated rows stay.  Rows of null conv_id or null turn are left out; a null role counts as 'user' and a
null text as empty.  An assistant turn that comes first has an empty context.  Conversations without an
assistant turn give nothing, and so does an empty table.  Columns beyond the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, example, context_turns, prompt, reply, train_start, train_end); one shuffle, by conversation."""
    t = turns.where("conv_id is not null and turn is not null").select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    rendered = F.transform("ts", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END)))
    one = grouped.select("conv_id", "ts", rendered.alias("shown")).select("conv_id", "shown", F.posexplode("ts").alias("k", "t")).where("t.role = 'assistant'")
    one = one.select(
        "conv_id",
        F.col("t.turn").alias("turn"),
        F.col("k").cast("bigint").alias("context_turns"),
        F.concat(F.array_join(F.slice("shown", F.lit(1), F.col("k")), ""), F.lit(f"{START}assistant\n")).alias("prompt"),
        F.concat(F.col("t.text"), F.lit(END)).alias("reply"),
    )
    return one.withColumns({"train_start": F.length("prompt").cast("bigint"), "train_end": (F.length("prompt") + F.length("reply")).cast("bigint")})


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT *, coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k)
    OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '<|im_start|>assistant' || chr(10) AS prompt
  FROM t)
SELECT conv_id, turn, k AS context_turns, prompt, text || '<|im_end|>' || chr(10) AS reply,
  length(prompt) AS train_start, length(prompt) + length(text) + 11 AS train_end
FROM p WHERE role = 'assistant'
"""
