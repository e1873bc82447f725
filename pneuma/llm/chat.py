"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import pick, table

OPEN, HEAD_END, NEXT, CLOSE = "<|", "|>\n", "<|+|>", "<|/|>\n"
#: Each control character, and what stands for it inside texts.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))


def escape(text: Column) -> Column:
    """Reversible: no `<`, `[` or `|` is left, so no control string can arise inside a text."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive).

    Turns are sorted by (turn, role, text); adjacent turns of one role share a
    header and are parted by a continuation mark, so the turns can be read
    back. Null texts and roles count as empty; a null turn number sorts first;
    a null conv_id is a conversation of its own. Repeated rows stay.
    """
    rows = pick(turns, conv_id="bigint", turn="bigint", role="string", text="string")
    rows = rows.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def neighbour(i: Column, by: int) -> Column:
        return F.get("ts", i + by)["role"]

    def piece(t: Column, i: Column) -> Column:
        first = (i == 0) | (neighbour(i, -1) != t["role"])
        last = (i == F.size("ts") - 1) | (neighbour(i, 1) != t["role"])
        lead = F.when(first, F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD_END))).otherwise(F.lit(NEXT))
        return F.struct(
            lead.alias("lead"),
            escape(t["text"]).alias("body"),
            F.when(last, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == loss_role).alias("loss"),
        )

    chats = chats.select("conv_id", F.transform("ts", piece).alias("ps"))
    spans = F.aggregate(
        "ps",
        F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.char_length(p["lead"]) + F.char_length(p["body"]) + F.char_length(p["tail"])).alias("pos"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["pos"] + F.char_length(p["lead"])).alias("start"),
                            (acc["pos"] + F.char_length(p["lead"]) + F.char_length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["lead"], p["body"], p["tail"])), "")
    return chats.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text structs) and loss_text, from the formatted text and its spans."""
    mark = F.lit(CLOSE.replace("|", "\\|"))
    blocks = F.split(F.col("formatted"), mark, F.lit(-1))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, HEAD_END, 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.char_length(head) + len(HEAD_END) + 1)
        texts = F.split(body, F.lit(NEXT.replace("|", "\\|").replace("+", "\\+")), F.lit(-1))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    loss = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def chat_digests(turns: DataFrame) -> DataFrame:
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read_chats(format_chats(turns)).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus number -7, whose texts hold control strings of common templates."""
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = pick(table(spark, sf_dir, "conversations"), conv_id="bigint", turn="bigint", role="string", text="string")
    return chat_digests(turns.unionByName(probe))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b'), '|', '\p') AS body,
    replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), '|', '\p') AS head,
    lag(role) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE length(head) + 5 + 6 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
