"""Preference formatting: one shared prompt, two masked completions.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import order_key, ranked

#: How a turn is rendered: before the role, between role and text, after the text.
HEAD, MID, TAIL = "<|", "|>\n", "<|end|>\n"


def told() -> Column:
    """A turn: number, role and text; null texts as empty, null roles as user."""
    return F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def gathered(turns: DataFrame) -> DataFrame:
    """A row for each conversation that has an id: conv_id and its turns in order.

    Turns of the same number are ordered by role and text; repeated rows stay.
    """
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(told())).alias("turns"))


def opening_pairs(turns: DataFrame, seed: str = "prefer") -> DataFrame:
    """Pairs of conversations with the same first turn: chosen_id, rejected_id, each conversation in one row.

    The conversations of an opening are ranked by a hash of their id and paired in that order, so a common
    opening is never gathered: ranks come from buckets, and a pair is a group of two.  The last of an odd
    number, and every conversation with an opening of its own, has a null rejected_id.  Pairs are not
    preferences of people: which is chosen follows from the hash.  Turns without a conv_id are in no pair.
    """
    opening = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.min(told()).alias("f")).select("conv_id", F.md5(F.concat_ws("|", "f.role", "f.text")).alias("opening"))
    placed = ranked(opening.withColumn("key", order_key("conv_id", seed=seed)), ["opening"], "key", ["conv_id"], "rank")
    side = F.col("rank") % 2
    pair = placed.groupBy("opening", F.floor(F.col("rank") / 2).alias("n")).agg(
        F.max(F.when(side == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(side == 1, F.col("conv_id"))).alias("rejected_id"), F.count(F.lit(1)).alias("rows"),
    )
    return pair.select("chosen_id", "rejected_id", (F.col("rows") == 2).alias("paired"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MID), t["text"], F.lit(TAIL))), "")


def loss_spans(turns: Column) -> Column:
    """Character spans, ``start-end`` comma-joined, of the assistant's texts and their end marks within ``rendered(turns)``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, t):
        begin = acc["at"] + F.lit(len(HEAD) + len(MID)) + F.length(t["role"])
        end = begin + F.length(t["text"]) + F.lit(len(TAIL))
        here = F.when(t["role"] == "assistant", F.concat(F.when(acc["out"] == "", "").otherwise(","), begin.cast("string"), F.lit("-"), end.cast("string"))).otherwise("")
        return F.struct(end.alias("at"), F.concat(acc["out"], here).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Render each pair: chosen_id, rejected_id, n_common, status, prompt, chosen, rejected and the loss spans of both.

    ``turns``: conv_id, turn, role, text.  ``pairs``: chosen_id, rejected_id, paired (whether there is a second).
    The prompt is the longest common prefix of turns, equal in role and text, rendered once; the completions
    are the rest of each, and their loss spans hold what the assistant says.  Status: ``pair``;
    ``identical`` if nothing differs (empty completions); ``prefix`` if one continues the other;
    ``single`` for a conversation without a partner: its prompt ends before its last assistant turn (none: it
    is all prompt) and the rejected columns are null.  Turns without a conv_id are not gathered, as
    they may be a large part of all: each is a ``single`` conversation of one turn with a null chosen_id.
    Other conversations that no pair names don't appear; ids that name no turns, null too, count as empty conversations.
    Other columns of ``turns`` and ``pairs`` are not looked at.
    """
    convs = gathered(turns)
    a = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    b = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.alias("p").join(a.alias("a"), F.col("p.chosen_id") == F.col("a.chosen_id"), "left")
    both = both.join(b.alias("b"), F.col("paired") & (F.col("p.rejected_id") == F.col("b.rejected_id")), "left")
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    t = both.select("p.chosen_id", "p.rejected_id", "paired", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    nobody = turns.where("conv_id IS NULL").select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.lit(False).alias("paired"), F.array(told()).alias("a"), none.alias("b"))
    t = t.unionByName(nobody)
    same = F.transform(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1), lambda i: (F.get("a", i)["role"] == F.get("b", i)["role"]) & (F.get("a", i)["text"] == F.get("b", i)["text"]))
    shortest = F.least(F.size("a"), F.size("b"))
    miss = F.array_position(F.when(shortest > 0, same), False)
    answers = F.transform("a", lambda x: F.when(x["role"] == "assistant", "1").otherwise("0"))
    last = F.size("a") - F.instr(F.reverse(F.array_join(answers, "")), "1")
    alone = F.when(F.array_contains(answers, "1"), last).otherwise(F.size("a"))
    common = F.when(~F.col("paired"), alone).when(shortest == 0, 0).when(miss > 0, miss - 1).otherwise(shortest)
    t = t.withColumn("n_common", common.cast("int"))
    tail = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    t = t.withColumns({"prompt": rendered(F.slice("a", F.lit(1), F.col("n_common"))), "ra": tail("a"), "rb": tail("b")})
    status = F.when(~F.col("paired"), "single").when((F.size("ra") == 0) & (F.size("rb") == 0), "identical").when((F.size("ra") == 0) | (F.size("rb") == 0), "prefix").otherwise("pair")
    return t.select(
        "chosen_id", "rejected_id", "n_common", status.alias("status"), "prompt", rendered(F.col("ra")).alias("chosen"), loss_spans(F.col("ra")).alias("chosen_loss"),
        F.when(F.col("paired"), rendered(F.col("rb"))).alias("rejected"), F.when(F.col("paired"), loss_spans(F.col("rb"))).alias("rejected_loss"),
    )


def op9_preference_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_preferences(turns, opening_pairs(turns))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS len FROM c),
o AS (SELECT conv_id, len, md5(concat_ws('|', role, text)) AS opening, md5('prefer|' || coalesce(conv_id::VARCHAR, chr(0))) AS k FROM n WHERE i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY opening ORDER BY k, conv_id) - 1 AS rank FROM o),
p AS (SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.len AS la, b.len AS lb FROM r a LEFT JOIN r b ON a.opening = b.opening AND b.rank = a.rank + 1 WHERE a.rank % 2 = 0),
m AS (SELECT p.chosen_id, min(x.i) AS miss FROM p JOIN n x ON x.conv_id = p.chosen_id JOIN n y ON y.conv_id = p.rejected_id AND y.i = x.i WHERE x.role <> y.role OR x.text <> y.text GROUP BY 1),
s AS (SELECT conv_id, max(i) AS last FROM n WHERE role = 'assistant' GROUP BY 1),
q AS (SELECT p.*, CASE WHEN rejected_id IS NULL THEN coalesce(last - 1, la) ELSE coalesce(miss - 1, least(la, lb)) END AS k FROM p LEFT JOIN m USING (chosen_id) LEFT JOIN s ON s.conv_id = p.chosen_id),
f AS (SELECT n.*, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, 5 + length(role) AS head FROM n),
v AS (SELECT q.chosen_id AS pid, f.*, f.i <= q.k AS shared, 'a' AS side FROM q JOIN f ON f.conv_id = q.chosen_id UNION ALL SELECT q.chosen_id, f.*, f.i <= q.k, 'b' FROM q JOIN f ON f.conv_id = q.rejected_id),
z AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pid, side, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM v),
g AS (SELECT pid, string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND shared) AS prompt, string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND NOT shared) AS chosen, string_agg(shown, '' ORDER BY i) FILTER (side = 'b' AND NOT shared) AS rejected,
      string_agg((pos + head) || '-' || (pos + length(shown)), ',' ORDER BY i) FILTER (side = 'a' AND NOT shared AND role = 'assistant') AS chosen_loss, string_agg((pos + head) || '-' || (pos + length(shown)), ',' ORDER BY i) FILTER (side = 'b' AND NOT shared AND role = 'assistant') AS rejected_loss FROM z GROUP BY pid)
SELECT q.chosen_id, q.rejected_id, k::INTEGER AS n_common, CASE WHEN rejected_id IS NULL THEN 'single' WHEN k = la AND k = lb THEN 'identical' WHEN k = la OR k = lb THEN 'prefix' ELSE 'pair' END AS status,
  coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(chosen_loss, '') AS chosen_loss, CASE WHEN rejected_id IS NOT NULL THEN coalesce(rejected, '') END AS rejected, CASE WHEN rejected_id IS NOT NULL THEN coalesce(rejected_loss, '') END AS rejected_loss
FROM q JOIN g ON g.pid = q.chosen_id
"""
