"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are
context, only that reply is trainable.  A conversation that does not end with
an assistant turn gets one further example without a trainable part, so that
the output holds every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Opening character, backslashes added so far, rest of a control string.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    """Put one more backslash inside each control string; no marker can occur in the result."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def prefix_examples(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One formatted example per assistant turn.

    Returns ``conv``, ``example`` (number of turns in it), ``formatted``,
    ``loss_start`` and ``loss_length`` (code points of ``formatted`` that are
    trainable; length 0 in an example without a reply) and ``is_last``.

    Rows of a conversation are ordered by turn, then role, then text, nulls
    first; repeated rows stay.  A null role or text is empty, rows with a null
    ``conv`` form one conversation, an empty table gives no rows.  Other
    columns are ignored.  One conversation is one row while it is expanded;
    its examples are made one after the other.
    """
    turns = conversations.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("entry"),
    )
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    segments = grouped.select(
        "conv",
        F.transform(
            "entries",
            lambda e: F.struct(
                (e["role"] == "assistant").alias("reply"),
                F.concat(F.lit(TURN), escape(e["role"]), F.lit(TEXT)).alias("head"),
                escape(e["text"]).alias("body"),
            ),
        ).alias("segments"),
    )
    numbered = segments.select(
        "conv",
        F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit(END))).alias("pieces"),
        F.size("segments").alias("turns"),
        F.explode(
            F.filter(
                F.transform("segments", lambda s, i: F.struct((i + 1).alias("example"), s.alias("segment"))),
                lambda x: x["segment"]["reply"] | (x["example"] == F.size("segments")),
            )
        ).alias("target"),
    )
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("target.example") - 1), "")
    made = numbered.select(
        "conv",
        F.col("target.example").alias("example"),
        context.alias("context"),
        F.col("target.segment").alias("own"),
        (F.col("target.example") == F.col("turns")).alias("is_last"),
    )
    return made.select(
        F.col("conv").alias(conv),
        F.col("example").cast("long").alias("example"),
        F.concat("context", "own.head", "own.body", F.lit(END)).alias("formatted"),
        (F.length("context") + F.length("own.head")).cast("long").alias("loss_start"),
        F.when(F.col("own.reply"), F.length("own.body")).otherwise(0).cast("long").alias("loss_length"),
        "is_last",
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digest of each conversation, parsed from its formatted examples alone."""
    formatted = F.col("formatted")
    plain = F.replace(F.replace(formatted, F.lit(TURN), F.lit("")), F.lit(TEXT), F.lit("\n"))
    turns = unescape(F.replace(plain, F.lit(END), F.lit("\n")))
    n_turns = (F.length("formatted") - F.length(F.replace(formatted, F.lit(END), F.lit("")))) / len(END)
    loss = unescape(F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    parsed = examples.select(
        conv,
        F.length("formatted").cast("long").alias("chars"),
        F.struct("example", loss.alias("loss")).alias("target"),
        F.when(F.col("is_last"), n_turns.cast("long")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(turns, 256)).alias("turns_sha256"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("target")), lambda x: x["loss"]), "")
    digest = parsed.groupBy(conv).agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        joined.alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return digest.select(
        conv,
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    23 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g'))
       + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\2\\\3', 'g')) AS chars
  FROM given
), run AS (
  SELECT *, sum(chars) OVER w AS prefix, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(prefix) FILTER (role = 'assistant' OR pos = turns))::BIGINT AS formatted_chars
FROM run GROUP BY conv_id
"""
