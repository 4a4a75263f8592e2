"""Preference formatting of pairs of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the
prompt. What follows in each is its completion, with a mask: the spans of characters that a model is to
learn, which are the assistant's words and the mark that ends its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation (id, turns): its turns in order, as (turn, role, text). Null roles and texts are empty; a row that repeats counts once; rows without a turn come first, without an id go."""
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_set(row)).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """The spans (start, end) of the completion's characters that count."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN + MIDDLE)
        body = F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct((a["at"] + head).alias("start"), (a["at"] + head + body).alias("end")))
        return F.struct((a["at"] + head + body).alias("at"), F.when(t["role"] == "assistant", F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda a: a["out"])


def preference_format(pairs: DataFrame) -> DataFrame:
    """Per pair (pair_id, chosen, rejected: arrays of (turn, role, text)) the pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Turns are the same if role and text are; their numbers don't matter. A null role or text is an empty
    one, and a null turn one without both. Null arrays are conversations without turns, whose completion
    and mask are empty. If one conversation is the start of the other, its completion is empty. Pairs may
    repeat; an empty table gives no rows. A pair is one row, so a conversation is as long as a row may be.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    known = lambda c: F.coalesce(F.transform(c, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), none)
    rows = pairs.select("pair_id", known("chosen").alias("c"), known("rejected").alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differs = lambda i: (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])
    apart = F.when(shorter > 0, F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(shorter, F.lit(1)) - 1), differs)))
    rows = rows.withColumn("n_prefix", F.coalesce(apart, shorter))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.size(c))
    rows = rows.select("pair_id", "n_prefix", F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), F.when(F.size("c") > F.col("n_prefix"), rest("c")).otherwise(none).alias("c"), F.when(F.size("r") > F.col("n_prefix"), rest("r")).otherwise(none).alias("r"))
    return rows.select("pair_id", "n_prefix", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against one that starts as it does and goes on as its neighbour, whose id differs in the lowest bit.

    They part at a turn that goes by half the id, so that prefixes of all lengths occur; without a
    neighbour the other one ends there. Returned are lengths, digests and the masks as start-end,...
    """
    whole = conversations(table(spark, sf_dir, "conversations"))
    other = whole.select(F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), F.col("turns").alias("other"))
    joined = whole.join(other, "id", "left").withColumn("part", F.expr("cast(pmod(id div 2, size(turns)) as int)"))
    goes_on = F.when(F.size("other") > F.col("part"), F.slice("other", F.col("part") + 1, F.size("other"))).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    made = preference_format(joined.select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("part")), goes_on).alias("rejected")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    sha = lambda c: F.sha2(c, 256)
    return made.select("pair_id", "n_prefix", F.length("prompt").alias("prompt_chars"), sha(F.col("prompt")).alias("prompt_sha256"), sha(F.col("chosen")).alias("chosen_sha256"), sha(F.col("rejected")).alias("rejected_sha256"), shown("chosen_mask").alias("chosen_mask"), shown("rejected_mask").alias("rejected_mask"))


def _completion(name: str) -> str:
    """SQL for a completion's rows with the places of each in it, then its digest and mask."""
    at = "sum(length(shown)) OVER (PARTITION BY conv_id ORDER BY i) - length(shown)"
    return f"""{name}_rows AS (SELECT conv_id, i, shown, role, {at} + length(role) + {len(OPEN + MIDDLE)} AS first, {at} + length(shown) AS last FROM {name} JOIN p USING (conv_id) WHERE i > prefix),
{name}_made AS (SELECT conv_id, string_agg(shown, '' ORDER BY i) AS shown, string_agg(first || '-' || last, ',' ORDER BY i) FILTER (role = 'assistant') AS mask FROM {name}_rows GROUP BY 1)"""


SQL = {
    "op3_preference_format": f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
chosen AS (SELECT *, '{OPEN}' || role || chr(10) || text || '{CLOSE.strip()}' || chr(10) AS shown,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM t),
b AS (SELECT conv_id, any_value(n) AS n, (conv_id // 2) % any_value(n) AS part FROM chosen GROUP BY 1),
rejected AS (SELECT conv_id, i, role, text, shown FROM chosen JOIN b USING (conv_id) WHERE i <= part
             UNION ALL SELECT b.conv_id, i, role, text, shown FROM b JOIN chosen o ON o.conv_id = xor(b.conv_id, 1) WHERE i > part),
p AS (SELECT c.conv_id, coalesce(min(c.i) FILTER (r.i IS NULL OR r.role <> c.role OR r.text <> c.text) - 1, any_value(c.n))::INT AS prefix
      FROM chosen c LEFT JOIN rejected r ON r.conv_id = c.conv_id AND r.i = c.i GROUP BY 1),
h AS (SELECT conv_id, string_agg(shown, '' ORDER BY i) AS head FROM chosen JOIN p USING (conv_id) WHERE i <= prefix GROUP BY 1),
{_completion("chosen")},
{_completion("rejected")}
SELECT p.conv_id AS pair_id, prefix AS n_prefix, length(coalesce(head, ''))::INT AS prompt_chars, sha256(coalesce(head, '')) AS prompt_sha256,
       sha256(coalesce(c.shown, '')) AS chosen_sha256, sha256(coalesce(r.shown, '')) AS rejected_sha256,
       coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM p LEFT JOIN h USING (conv_id) LEFT JOIN chosen_made c USING (conv_id) LEFT JOIN rejected_made r USING (conv_id)
"""
}
