"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example is the conversation's formatted turns up to that assistant turn as context, and the reply as the only trainable
part. The template marks each turn as ``### Role: text</turn>`` and a line feed; control strings inside roles and texts are
escaped with a backslash, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "### ", "</turn>\n"
#: fixed values: what stands in a text, and how it is written
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))


def escape(c: Column, header: bool = False) -> Column:
    for plain, written in ESCAPES if header else ESCAPES[:3]:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, header: bool = False) -> Column:
    """A written backslash pair is a backslash; the pieces between such pairs hold the other escapes."""

    def plain(piece: Column) -> Column:
        for text, written in ESCAPES[1:4] if header else ESCAPES[1:3]:
            piece = F.replace(piece, F.lit(written), F.lit(text))
        return piece

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Examples: conv_id, example (from 0), context, reply, closing.

    ``context + reply`` is the formatted example and ``reply`` (escaped, without its header and end mark) its only trainable
    text; the end mark is not trained. What follows the last reply has no target; it comes as one closing example with an
    empty reply, so that nothing of a conversation is lost.

    Edge cases: null texts and roles count as empty; rows with equal or null turns are ordered by turn (nulls first), then role,
    then text; rows with a null conversation id form one conversation; repeated rows are turns of their own; a conversation
    without assistant turns has only a closing example. Other columns are not read.

    Scale: one shuffle by conversation. A conversation is one row (as a long text is); its examples are made one after another.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), header=True), F.lit(": "))
    turn = F.struct("turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).withColumn("n", F.size("t"))
    replies = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("t", i + 1)["role"] == "assistant")
    last = F.element_at(F.col("t"), -1)["role"] == "assistant"
    ends = talks.select("conv_id", "t", "n", F.posexplode(F.when(last, replies).otherwise(F.concat(replies, F.array("n")))).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("t", 1, F.col("at")), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    closing = F.col("at") == F.col("n")
    target = F.element_at("t", F.col("at") + 1)
    return ends.select(
        "conv_id", "example",
        F.when(closing, before).otherwise(F.concat(before, target["head"])).alias("context"),
        F.when(closing, F.lit("")).otherwise(target["body"]).alias("reply"), closing.alias("closing"),
    )


def read_back(example: Column) -> Column:
    """The turns of a formatted example: array of (role, text), unescaped. A part cut off before its end mark is kept as it is."""
    parts = F.filter(F.split(example, f"(?<=</turn>\n)", -1), lambda p: p != "")

    def turn(part: Column) -> Column:
        inner = F.regexp_replace(F.substring(part, len(OPEN) + 1, 2**31 - 1), "</turn>\n$", "")
        at = F.locate(": ", inner)
        return F.struct(unescape(F.substring(inner, F.lit(1), at - 1), header=True).alias("role"), unescape(F.substring(inner, at + 2, F.length(inner))).alias("text"))

    return F.transform(parts, turn)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talk.schema)
    return digests(chat_format(talk.unionByName(probe)))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its examples; see op7_chat_format."""
    whole = F.when(F.col("closing"), F.col("context")).otherwise(F.concat("context", "reply", F.lit(CLOSE)))
    rows = examples.select("conv_id", "example", F.length(whole).cast("long").alias("chars"), whole.alias("whole"), unescape(F.col("reply")).alias("reply"), (~F.col("closing")).alias("trained"))
    got = rows.groupBy("conv_id").agg(
        F.max_by("whole", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct("example", "reply")))), lambda x: x["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = read_back(F.col("whole"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c') || ': '
            || replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') || '</turn>' || chr(10) AS piece,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM c
), g AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""
