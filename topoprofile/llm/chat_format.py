"""Chat formatting by prefix-target expansion, in built-in SQL functions only.

Template. Every turn is an opening marker, its escaped text and a closing marker::

    system    [SYS]text[/SYS]
    user      [INST]text[/INST]
    assistant [OUT]text</s>
    others    [ROLE]name[/ROLE][INST]text[/INST]

Escaping. A backslash is doubled, then a backslash is put after the first
character of every control string (``[SYS]`` becomes ``[\\SYS]``), so no raw
control string of the template survives inside a text. ``unescape`` inverts it.

Defined cases. Null text, null role: empty. Turns sort by turn number, nulls
first; equal turn numbers sort by role, then text. Repeated rows are repeated
turns. A conversation without any row does not exist; one without an assistant
turn, or with turns after its last assistant turn, gets one closing example
without a trainable part, so that no turn is lost. Null conversation ids form
one conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template, as one pattern with the first character apart.
CONTROL = r"([<\[])(/?(?:SYS|INST|OUT|ROLE)\]|/?s>)"
#: One turn of a formatted text: role header, opening marker, body.
TURN = r"(?s)(?:\[ROLE\](.*?)\[/ROLE\])?\[(SYS|INST|OUT)\](.*?)(?:\[/SYS\]|\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _format_turn(role: Column, text: Column) -> Column:
    body = escape(text)
    return (
        F.when(role == "system", F.concat(F.lit("[SYS]"), body, F.lit("[/SYS]")))
        .when(role == "assistant", F.concat(F.lit("[OUT]"), body, F.lit("</s>")))
        .when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE][INST]"), body, F.lit("[/INST]")))
    )


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: all turns before it as context, only its reply trainable.

    In: ``conv_id, turn, role, text``. Out: ``conv_id, example`` (from 1),
    ``is_last``, ``formatted`` (context, then target), ``loss_start`` and
    ``loss_length`` in code points (the reply's body; length 0 in a closing
    example).

    Turns are formatted before the one shuffle (by conversation). A conversation
    is the unit that training reads, so its turns meet in one row; its examples
    are cut from that row one at a time while they stream out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", _format_turn(F.col("role"), F.col("text")).alias("piece")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.count("*").alias("n_rows"))
    # one fold over the turns: where each example ends, and its reply's body
    cuts = F.expr("""aggregate(ts, named_struct('at', 0L, 'i', 0L, 'cuts', cast(array() AS array<struct<end:bigint,target:boolean,start:bigint,length:bigint>>)),
        (a, t) -> named_struct('at', a.at + length(t.piece), 'i', a.i + 1, 'cuts',
            CASE WHEN t.role = 'assistant' OR a.i = n_rows - 1
                 THEN array_append(a.cuts, named_struct('end', a.at + length(t.piece), 'target', t.role = 'assistant',
                                                        'start', a.at + 5, 'length', cast(length(t.piece) - 9 AS bigint)))
                 ELSE a.cuts END)).cuts""")
    whole = grouped.select("conv_id", F.expr("array_join(transform(ts, t -> t.piece), '')").alias("whole"), cuts.alias("cuts"))
    # posexplode keeps the order of the turns
    examples = whole.select("conv_id", "whole", F.size("cuts").alias("n"), F.posexplode("cuts").alias("p", "c"))
    return examples.select(
        "conv_id",
        (F.col("p") + 1).cast("long").alias("example"),
        (F.col("p") == F.col("n") - 1).alias("is_last"),
        F.expr("substring(whole, 1, int(c.end))").alias("formatted"),
        F.when(F.col("c.target"), F.col("c.start")).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        F.when(F.col("c.target"), F.col("c.length")).otherwise(F.lit(0)).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Parse formatted examples again: a digest row per conversation.

    The turns come from each conversation's last example (all its turns are the
    context and target there), the trainable text from every example's own loss
    span. A wrong span or escape therefore shows in the digests.
    """
    loss = F.expr("substring(formatted, int(loss_start) + 1, int(loss_length))")
    slim = examples.select(
        "conv_id",
        "example",
        unescape(loss).alias("reply"),
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.col("formatted")).alias("last"),
    )
    by_conv = slim.groupBy("conv_id").agg(
        F.max("last").alias("last"),
        F.array_join(F.expr("transform(sort_array(collect_list(struct(example, reply))), x -> x.reply)"), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    # each turn is cut out once, then parsed by itself
    turn = lambda k: f"regexp_extract(p, r'{TURN}', {k})"
    role = F.expr(f"""transform(regexp_extract_all(last, r'{TURN}', 0), p -> concat(
        CASE WHEN startswith(p, '[ROLE]') THEN regexp_replace({turn(1)}, r'\\\\(\\\\?)', '$1')
             WHEN startswith(p, '[SYS]') THEN 'system' WHEN startswith(p, '[OUT]') THEN 'assistant' ELSE 'user' END,
        '\n', regexp_replace({turn(3)}, r'\\\\(\\\\?)', '$1'), '\n'))""")
    by_conv = by_conv.select("*", role.alias("parsed"))
    by_conv = by_conv.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.array_join("parsed", "").alias("turns"), "loss", "formatted_chars", "n_examples")
    return by_conv.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the planted conversation -1, formatted and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(prefix_target_examples(table.unionByName(planted)))


_E = "regexp_replace(replace({0}, '\\', '\\\\'), '([<\\[])(/?(?:SYS|INST|OUT|ROLE)\\]|/?s>)', '\\1\\\\\\2', 'g')"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, length({_E.format('text')}) + CASE WHEN role = 'assistant' THEN 9 WHEN role = 'system' THEN 11
            WHEN role = 'user' THEN 13 ELSE 26 + length({_E.format('role')}) END AS len,
         row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM s
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS n_examples
FROM c GROUP BY conv_id
"""
