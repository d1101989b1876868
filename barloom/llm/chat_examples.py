"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context.

Only column expressions are used. The template writes a turn as

    <|role|>text<|end|>

and inside texts (and roles) `&`, `<` and `|` are written `&amp;`, `&lt;` and `&bar;`, so that no text, whatever control
strings it holds, can be taken for a mark, and reading undoes the writing exactly.

The prefixes of one conversation are nested: example k is a prefix of example k + 1. They are therefore kept as
positions in the one formatted conversation (`example_end`, and the trainable span `loss_start`..`loss_end`): n turns
take n rows and no text is stored twice, where written-out prefixes would take n * n / 2 turns. `example_text` writes
out examples that are asked for.

Positions are running sums in two steps, over blocks of turns and then inside a block, so that a conversation holding
a third of all turns is not one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import load, query, stage

#: Template marks and the writing of reserved characters: fixed values of the format.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&bar;"))
#: Turns in a block of the running sums.
BLOCK = 1024


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, seq, role, segment, start, loss_start, loss_end, example_end.

    `segment` is the turn as the template writes it; the formatted conversation is its segments in order of `seq`.
    `start` is the segment's place in it, in code points. For an assistant turn, `loss_start`..`loss_end` is the span
    of its text and `example_end` the end of its example (the prefix that ends with this turn); null for other roles.

    * Turns are ordered by turn, then role, then text; nulls come first. Repeated rows are repeated turns.
    * Null text and null role count as empty. A null conv_id is a conversation of its own.
    * Conversations without an assistant turn have no example. Other columns are not read. Empty in, empty out.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.floor(F.col("turn") / BLOCK).alias("block"),
        F.concat(head, body, F.lit(END)).alias("segment"),
        F.char_length(head).cast("bigint").alias("head_chars"),
        F.char_length(body).cast("bigint").alias("body_chars"),
    ).withColumn("chars", F.col("head_chars") + F.col("body_chars") + len(END))
    before_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.count(F.lit(1)).alias("turns"), F.sum("chars").alias("chars"))
        .select(
            F.col("conv_id").alias("b_conv"),
            F.col("block").alias("b_block"),
            F.coalesce(F.sum("turns").over(before_block), F.lit(0)).alias("seq_before"),
            F.coalesce(F.sum("chars").over(before_block), F.lit(0)).alias("chars_before"),
        )
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    local = rows.withColumns(
        {
            "in_block": F.row_number().over(inside),
            "up_to": F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    placed = local.join(blocks, same).withColumn("start", F.col("chars_before") + F.col("up_to") - F.col("chars"))
    speaks = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "turn",
        (F.col("seq_before") + F.col("in_block")).alias("seq"),
        "role",
        "segment",
        "start",
        F.when(speaks, F.col("start") + F.col("head_chars")).alias("loss_start"),
        F.when(speaks, F.col("start") + F.col("head_chars") + F.col("body_chars")).alias("loss_end"),
        F.when(speaks, F.col("start") + F.col("chars")).alias("example_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, target (its seq), example_end, loss_start, loss_end."""
    return turns.filter(F.col("example_end").isNotNull()).select(
        "conv_id", F.col("seq").alias("target"), "example_end", "loss_start", "loss_end"
    )


def conversation_text(turns: DataFrame) -> DataFrame:
    """The formatted text of every conversation, whole."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "segment")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("formatted"))


def example_text(wanted: DataFrame, turns: DataFrame) -> DataFrame:
    """Examples written out: prefix and reply as one text, the reply's span beside it."""
    texts = conversation_text(turns).withColumnRenamed("conv_id", "t_conv")
    joined = wanted.join(texts, F.col("conv_id").eqNullSafe(F.col("t_conv")))
    return joined.select("conv_id", "target", F.substring("formatted", F.lit(1), F.col("example_end").cast("int")).alias("text"), "loss_start", "loss_end")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text): the template read back."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, CLOSE)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(piece, cut + len(CLOSE), F.char_length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def replies(wanted: DataFrame, turns: DataFrame) -> DataFrame:
    """The trainable text of every example, as the template writes it: conv_id, target, reply.

    A span lies inside the segment of its target; cutting there spares counting code points from the front. The join
    is by conversation and place, so a conversation with very many turns is not one task.
    """
    segments = turns.select(F.col("conv_id").alias("t_conv"), "seq", "segment", "start")
    joined = wanted.join(segments, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("target") == F.col("seq")))
    first, size = F.col("loss_start") - F.col("start") + 1, F.col("loss_end") - F.col("loss_start")
    return joined.select("conv_id", "target", F.substring("segment", first.cast("int"), size.cast("int")).alias("reply"))


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and the examples' loss spans: counts and digests of what was written.

    The loss columns are the replies of the conversation's examples, in order; without examples they are empty.
    """
    turns = stage(turns, "turns")
    told = conversation_text(turns).select("conv_id", read_turns(F.col("formatted")).alias("said"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    parts = F.sort_array(F.collect_list(F.struct("target", "reply")))
    trained = replies(examples(turns), turns).groupBy(F.col("conv_id").alias("r_conv"))
    trained = trained.agg(F.array_join(F.transform(parts, lambda p: unescape(p["reply"])), "").alias("loss"))
    told = told.join(trained, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left").withColumn("loss", F.coalesce("loss", F.lit("")))
    lines = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("said").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Text of conversation -1.
PROBE = "</s>[INST] ok [/INST]"


@query(
    "op4_chat_examples",
    f"""
    WITH c AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
    ), t AS (
      SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '|', '&bar;') AS body FROM c
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           cast(sum(length(role) + length(body) + 11) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def _op4(spark, sf_dir):
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return read_back(format_turns(given.unionByName(probe)))
