"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, BETWEEN = "<|im_start|>", "<|im_end|>\n", "\n"


def format_conversations(turns: DataFrame, open: str = OPEN, close: str = CLOSE, between: str = BETWEEN) -> DataFrame:
    """(conv_id, n_turns, n_messages, roles, formatted), one row per conversation.

    Turns are sorted by (turn, role, text); neighbours of one role become one message, their texts
    joined by ``between``; a message reads ``open`` role newline text ``close``. Needs conv_id,
    turn, role and text; other columns are ignored whatever their names. A null role reads
    "unknown", a null text is empty, a null turn comes first. Repeated rows and turns with one
    number are all kept. Rows without conv_id belong to no conversation and are left out. An empty
    table gives no rows. Work per conversation grows in proportion to its turns.
    """
    lit = F.lit
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), lit("unknown")).alias("role"),
            F.coalesce(F.col("text").cast("string"), lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    starts = F.filter(
        F.sequence(lit(1), n),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, lit(1)))["role"]),
    )
    marked = grouped.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", 2, n), F.array(n + 1)))
    messages = F.zip_with(
        "starts",
        "ends",
        lambda s, e: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.array_join(F.transform(F.slice("turns", s, e - s), lambda t: t["text"]), between).alias("text"),
        ),
    )
    made = marked.select("conv_id", n.cast("long").alias("n_turns"), messages.alias("messages"))
    spoken = F.transform("messages", lambda m: F.concat(lit(open), m["role"], lit("\n"), m["text"], lit(close)))
    return made.select(
        "conv_id",
        "n_turns",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), " ").alias("roles"),
        F.array_join(spoken, "").alias("formatted"),
    )


FORMAT_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY conv_id, role ORDER BY rn) AS island FROM t),
m AS (
  SELECT conv_id, role, island, min(rn) AS first_rn, count(*) AS n, string_agg(text, chr(10) ORDER BY rn) AS text
  FROM g GROUP BY conv_id, role, island)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages,
       string_agg(role, ' ' ORDER BY first_rn) AS roles,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY first_rn) AS formatted
FROM m GROUP BY conv_id
"""
