"""Query of operator 8: all conversations formatted, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerprep.llm.chat import format_chats, read_back
from ledgerprep.session import Scratch


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return read_back(*format_chats(given.unionByName(added), Scratch(spark)))


# Control strings and backslashes get one character more; the marks of a turn are 20 characters.
_ESCAPES = r"len(regexp_extract_all({0}, '\\|</?turn>|### '))"
_OP8 = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length(text) + {_ESCAPES.format('text')} + 20)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {"op8_chat_format": op8_chat_format}
ORACLES = {"op8_chat_format": _OP8}
