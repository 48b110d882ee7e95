"""Chat formatting of preference pairs.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (same role and text) is rendered once, as
the prompt; what follows in each is a completion, with the code point spans that the loss counts: what assistant turns say,
including the end mark. Everything is one grouped pass and array expressions.

Defined results: null role or text counts as empty; turns are ordered by number, then role and text, and repeated rows are
repeated turns; turns without a conversation or a number take no part; a conversation without a partner is formatted against
none: everything is its completion and the other side is empty. Marks that a text itself holds lose their bars, so that no text can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import let, running

START, END = "<|im_start|>", "<|im_end|>"
_MASK = "array<struct<start:int,end:int>>"


def _safe(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns both begin with; null and empty are alike, as in what is rendered."""
    n = F.least(F.size(a), F.size(b))
    said = lambda turns, i, c: F.coalesce(F.element_at(turns, i)[c], F.lit(""))
    same = lambda i: (said(a, i, "role") == said(b, i, "role")) & (said(a, i, "text") == said(b, i, "text"))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: ~same(i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, n)).cast("int")


def loss_mask(turns: Column) -> Column:
    """The spans of render(turns) that assistant turns say."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body"), t["role"].eqNullSafe("assistant").alias("counts")))

    def span(x: Column) -> Column:
        at = lambda s, i: F.get(x["starts"], i) + s["head"]
        all_ = F.transform(x["sizes"], lambda s, i: F.struct(at(s, i).alias("start"), (at(s, i) + s["body"]).alias("end"), s["counts"].alias("counts")))
        return F.transform(F.filter(all_, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    starts = lambda s: running(F.transform(s, lambda t: t["head"] + t["body"]), F.lit(0), lambda a, b: a + b)
    return let(sizes, lambda s: let(F.struct(s.alias("sizes"), starts(s).alias("starts")), span)).cast(_MASK)


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`pairs`, whose two columns hold arrays of struct(role, text), with n_prefix, prompt, and for either side its completion and mask."""
    df = pairs.withColumn("n_prefix", common_prefix(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c), F.lit(1)))
    df = df.withColumn("prompt", render(F.slice(chosen, F.lit(1), F.col("n_prefix"))))
    for side, c in (("chosen", chosen), ("rejected", rejected)):
        df = df.withColumn(f"{side}_completion", render(rest(F.col(c)))).withColumn(f"{side}_mask", loss_mask(rest(F.col(c))))
    return df


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    rows = conversations.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    rows = rows.select(pair.alias("pair_id"), F.struct((F.col("conv_id") % 2 != 0).alias("second"), "turn", "role", "text").alias("t"))
    both = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    side = lambda second: F.transform(F.filter("turns", lambda t: t["second"] == second), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return both.select("pair_id", side(False).alias("chosen"), side(True).alias("rejected"))


def digest(conversations: DataFrame) -> DataFrame:
    df = format_pairs(adjacent_pairs(conversations))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return df.select("pair_id", "n_prefix", "prompt", "chosen_completion", mask("chosen_mask"), "rejected_completion", mask("rejected_mask"))


def _sql_side(side: str, second: str) -> str:
    return f"""(SELECT pair_id, coalesce(string_agg(head || body, '' ORDER BY k), '') AS {side}_completion,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN (e - length(body))::VARCHAR || ':' || e END, ',' ORDER BY k), '') AS {side}_mask FROM (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id ORDER BY k)::BIGINT AS e FROM t JOIN p USING (pair_id) WHERE second = {second} AND k > n_prefix) GROUP BY pair_id)"""


SQL = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, second ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k,
  '{START}' || replace(replace(coalesce(role, ''), '{START}', '<im_start>'), '{END}', '<im_end>') || chr(10) AS head,
  replace(replace(coalesce(text, ''), '{START}', '<im_start>'), '{END}', '<im_end>') || '{END}' || chr(10) AS body
  FROM (SELECT floor(conv_id / 2.0)::BIGINT AS pair_id, conv_id % 2 <> 0 AS second, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
sizes AS (SELECT pair_id, least(count(*) FILTER (NOT second), count(*) FILTER (second)) AS m FROM t GROUP BY pair_id),
diff AS (SELECT a.pair_id, min(a.k) AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND NOT a.second AND b.second
  WHERE coalesce(a.role, '') <> coalesce(b.role, '') OR coalesce(a.text, '') <> coalesce(b.text, '') GROUP BY a.pair_id),
p AS (SELECT pair_id, coalesce(k - 1, m)::INT AS n_prefix FROM sizes LEFT JOIN diff USING (pair_id)),
prompts AS (SELECT pair_id, string_agg(head || body, '' ORDER BY k) AS prompt FROM t JOIN p USING (pair_id) WHERE NOT second AND k <= n_prefix GROUP BY pair_id)
SELECT pair_id, n_prefix, coalesce(prompt, '') AS prompt, coalesce(chosen_completion, '') AS chosen_completion, coalesce(chosen_mask, '') AS chosen_mask,
  coalesce(rejected_completion, '') AS rejected_completion, coalesce(rejected_mask, '') AS rejected_mask
FROM p LEFT JOIN prompts USING (pair_id) LEFT JOIN {_sql_side("chosen", "false")} USING (pair_id) LEFT JOIN {_sql_side("rejected", "true")} USING (pair_id)
"""
