"""Preference formatting: paired completions after the longest common prefix of turns, with loss masks.

The turns of a conversation are ordered by (turn, role, text). Two conversations have turns in common as long as role
and text are equal; the common turns are rendered once as the prompt, what follows in each is its completion. A completion's
mask has the spans [start, end) of its characters that are trained on: assistant texts with their end marks, not headers and not
the turns of others. Rendered turn: `<|role|>` newline text `<|end|>` newline.

A null role or text is an empty one; a null turn comes first; rows with a null id are one conversation; repeated rows are repeated turns. A pair whose
conversations are equal has empty completions; a pair with a conversation that is not there is left out. A conversation is one
row of the result, so its turns meet in one task; conversations are spread by id. Empty tables give no row, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import table

END = "<|end|>\n"


def conversations(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): the turns of each conversation in order, as structs of role and text."""
    each = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(each)).alias("turns"))
    return rows.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    both = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.slice(a, 1, F.greatest(both, F.lit(0))), lambda t, i: t == F.get(b, i)), False)
    return F.when(differs > 0, differs - 1).otherwise(both).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Trained spans of rendered turns, as `start-end` joined by commas."""
    size = lambda t: F.char_length(_head(t)) + F.char_length(t["text"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.char_length(_head(t))
        span = F.concat(begin.cast("string"), F.lit("-"), (s["at"] + size(t)).cast("string"))
        return F.struct((s["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["spans"], ","))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Formats rows with `chosen_turns` and `rejected_turns`: their other columns, and n_common, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    n = pairs.withColumn("n_common", common_turns(F.col("chosen_turns"), F.col("rejected_turns")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    n = n.withColumns({"prompt": _render(F.slice("chosen_turns", 1, F.col("n_common")))})
    for side in ("chosen", "rejected"):
        n = n.withColumns({side: _render(rest(F.col(f"{side}_turns"))), f"{side}_mask": _spans(rest(F.col(f"{side}_turns")))})
    return n.drop("chosen_turns", "rejected_turns")


def pair_up(turns: DataFrame, ids: DataFrame, **columns: str) -> DataFrame:
    """Pairs for `format_preferences` from rows (chosen_id, rejected_id). A null id means the turns without one."""
    found = conversations(turns, **columns)
    side = lambda s: found.select(F.col("id").alias(f"{s}_id"), F.col("turns").alias(f"{s}_turns"))
    for s in ("chosen", "rejected"):
        other = side(s).withColumnRenamed(f"{s}_id", "side_id")
        ids = ids.join(other, ids[f"{s}_id"].eqNullSafe(other["side_id"])).drop("side_id")
    return ids


def spoiled_pairs(turns: DataFrame, **columns: str) -> DataFrame:
    """Pairs where only one side of each conversation is known: (id, chosen_turns, rejected_turns).

    Chosen is the conversation up to its last assistant turn. Rejected is the same with one assistant text cut to the first half of its
    characters: the last one, or for odd ids the first. Conversations without an assistant turn make no pair.
    """
    found = conversations(turns, **columns)
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    found = found.withColumn("replies", replies).where(F.size("replies") > 0)
    odd = F.coalesce(F.col("id").cast("long") % 2 != 0, F.lit(False))
    found = found.select("id", F.slice("turns", 1, F.element_at("replies", -1) + 1).alias("chosen_turns"), F.when(odd, F.col("replies")[0]).otherwise(F.element_at("replies", -1)).alias("at"))
    half = lambda t: F.substring(t["text"], F.lit(1), F.floor(F.char_length(t["text"]) / 2).cast("int"))
    rejected = F.transform("chosen_turns", lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), half(t).alias("text"))).otherwise(t))
    return found.select("id", "chosen_turns", rejected.alias("rejected_turns"))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply as a pair: conv_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    return format_preferences(spoiled_pairs(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations),
k AS (
  SELECT conv_id, max(i) AS last, CASE WHEN conv_id % 2 <> 0 THEN min(i) ELSE max(i) END AS cut
  FROM t WHERE role = 'assistant' GROUP BY conv_id),
two AS (
  SELECT t.conv_id, i, role, cut, text AS c, CASE WHEN i = cut THEN substr(text, 1, length(text) // 2) ELSE text END AS r
  FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id WHERE i <= last),
n AS (SELECT conv_id, CASE WHEN max(CASE WHEN c <> r THEN 1 ELSE 0 END) = 1 THEN max(cut) - 1 ELSE max(i) END AS n_common FROM two GROUP BY conv_id),
turns AS (
  SELECT two.conv_id, i, role, n_common, '<|' || role || '|>' || chr(10) AS head, c || '<|end|>' || chr(10) AS c, r || '<|end|>' || chr(10) AS r
  FROM two JOIN n ON two.conv_id IS NOT DISTINCT FROM n.conv_id),
placed AS (
  SELECT *, sum(CASE WHEN i > n_common THEN length(head || c) ELSE 0 END) OVER w AS c_end,
            sum(CASE WHEN i > n_common THEN length(head || r) ELSE 0 END) OVER w AS r_end
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, CAST(max(n_common) AS INTEGER) AS n_common,
       coalesce(string_agg(head || c, '' ORDER BY i) FILTER (i <= n_common), '') AS prompt,
       coalesce(string_agg(head || c, '' ORDER BY i) FILTER (i > n_common), '') AS chosen,
       coalesce(string_agg(CAST(c_end - length(c) AS VARCHAR) || '-' || CAST(c_end AS VARCHAR), ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(head || r, '' ORDER BY i) FILTER (i > n_common), '') AS rejected,
       coalesce(string_agg(CAST(r_end - length(r) AS VARCHAR) || '-' || CAST(r_end AS VARCHAR), ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
