"""Chat formatting.

Method: prefix-target expansion. Every assistant turn becomes an example of its own: all turns before it are its
context, and only its reply is trainable. Turns after the last reply, or of a conversation without a
reply, go into one closing example without a trainable part, so that no turn is lost.

Template of a turn: `<s>[INST]` role `[/INST]` text `</s>`. In roles and texts, backslash, `<` and `[` are
written as `\\b`, `\\l` and `\\k`, so no control string can occur inside them; this is reversible. The loss
mask is a span of code points: the reply's text, without its `</s>`.

Only DataFrame functions are used; all turns of a conversation meet in one row, as its examples are
strings that hold them all. Defined results: a null text is the empty text and a null role the role '';
turns are in the order of turn, then role, then text, null turns first; a null conversation id is a conversation;
repeated rows are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BEGIN, SPLIT, END = "<s>[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def examples(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, closing): examples of each conversation, numbered from 0.

    loss_start and loss_end count code points of `formatted` from 0, end exclusive; both are null if closing.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text").alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(BEGIN), escaped(t["role"]), F.lit(SPLIT), escaped(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: t["role"] == assistant).alias("replies"),
        F.transform("turns", lambda t: F.char_length(escaped(t["text"]))).alias("sizes"),
    )
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.col("replies")[i - 1] | (i == n))
    each = convs.select("conv_id", "parts", "replies", "sizes", F.posexplode_outer(ends).alias("example", "upto"))
    each = each.select(
        "conv_id", "example", F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "").alias("formatted"),
        F.col("sizes")[F.col("upto") - 1].alias("size"), (~F.col("replies")[F.col("upto") - 1]).alias("closing"),
    )
    end = F.char_length("formatted") - len(END)
    return each.select(
        "conv_id", "example", "formatted", F.when(~F.col("closing"), end - F.col("size")).alias("loss_start"), F.when(~F.col("closing"), end).alias("loss_end"), "closing",
    )


def loss_text(example: DataFrame) -> Column:
    """The trainable text of an example, unescaped; '' if it has none."""
    return F.coalesce(unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))), F.lit(""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role,text>>."""
    parts = F.split(formatted, r"<s>\[INST\]")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)  # what stands before the first turn is empty
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.split_part(p, F.lit(SPLIT), F.lit(1))).alias("role"),
            unescaped(F.replace(F.split_part(p, F.lit(SPLIT), F.lit(2)), F.lit(END), F.lit(""))).alias("text"),
        ),
    )


def digests(found: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples."""
    told = found.select("conv_id", "example", "formatted", loss_text(found).alias("loss"))
    told = told.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    told = told.select("conv_id", read_turns(F.col("longest.formatted")).alias("turns"), "loss", "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, CAST(pos AS BIGINT) AS turn, role, '{said}' AS text FROM (SELECT posexplode(array('user', 'assistant')) AS (pos, role))")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionAll(extra)
    return digests(examples(turns))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(role) + length(text) + 20
    + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', ''))) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM turns
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
