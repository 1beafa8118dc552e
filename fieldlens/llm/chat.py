"""Chat formatting (4): reply trees, their branches ranked, each chosen path one conversation. DataFrame functions only.

1. Messages (tree, node, parent, role, text, score) form reply trees; a plain conversation is a tree without branches.
2. Root-to-leaf paths come from iterative self-joins that double their reach: round i joins every path member with its
   2^i-th ancestor, so a path of n messages takes log2(n) rounds and the rows never exceed the paths themselves.
3. A branch's score is the mean score of its messages; the ``top`` best of a tree are kept (all without ``top``).
4. A path is written turn by turn as ``<|im_start|>role\\ntext<|im_end|>\\n``; the loss mask is the list of code point
   spans that hold the texts of ``loss_role``.

Control strings inside texts and roles (this template's and the common ``<s>``, ``[INST]``, ``<<SYS>>`` forms) get a
backslash after their first character, one more for each there already, so reading back is exact (``read_back``).

Defined results: null texts, roles and scores are empty, empty and 0; rows that repeat a turn are turns of their own, in
the order of role and text; rows without tree id are one tree; a parent that isn't there makes its message a root;
messages whose parents form a circle are on no path; no rows give no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import read_table, stage, unstage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
TURNS_PER_BUCKET = 64
_TAILS = r"\||/?s>|/?INST\]|</?SYS>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(" + _TAILS + ")", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(" + _TAILS + ")", "$1$2$3")


def _head(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role(head: Column) -> Column:
    return F.replace(F.replace(unescaped(head), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn answers the one before it.

    Turns are numbered in buckets of neighbouring turns, so a long conversation is many groups."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(1 << 60))))
    sizes = rows.groupBy("tree", "bucket").count()
    before = sizes.select("tree", "bucket", F.coalesce(F.sum("count").over(
        Window.partitionBy("tree").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("tree", "bucket").orderBy("turn", "role", "text"))
    return (rows.withColumn("own", own).join(before, ["tree", "bucket"])
            .select("tree", (F.col("before") + F.col("own") - 1).alias("node"), "role", "text")
            .select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score")))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the members of every root-to-leaf path, ``up`` steps above its leaf."""
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    jump = stage(nodes.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
                 .select("tree", "node", F.col("p").alias("to")), "jump")
    roots = jump.where("to is null").select(F.col("tree").alias("t"), F.col("node").alias("r"))
    parents = jump.where("to is not null").select(F.col("tree").alias("t"), F.col("to").alias("p")).distinct()
    leaves = nodes.join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    reach = stage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    first, step, limit = jump, 1, 2 * max(1, nodes.count())
    while step < limit and not jump.where("to is not null").limit(1).isEmpty():
        hop = jump.where("to is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        further = (reach.join(hop, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
                   .select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up")))
        grown = stage(reach.unionByName(further), "paths")
        twice = hop.select("t", F.col("n").alias("m"), F.col("to").alias("end"))
        nxt = stage(jump.where("to is not null")
                    .join(twice, (F.col("tree") == F.col("t")) & (F.col("to") == F.col("m")), "left")
                    .select("tree", "node", F.col("end").alias("to")), "jump")
        unstage(reach)
        if jump is not first:
            unstage(jump)
        reach, jump, step = grown, nxt, 2 * step
    if step < limit:
        return reach
    sound = reach.join(roots, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("r"))).select("tree", "leaf").distinct()
    return reach.join(sound, ["tree", "leaf"], "left_semi")


def format_trees(messages: DataFrame, top: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_spans) of every chosen path; spans are code points [from, to)."""
    messages = stage(messages, "messages")
    members = paths(messages).join(messages, ["tree", "node"])
    ranked = (members.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("path_score"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    body = escaped(F.coalesce("text", F.lit("")))
    lead = F.concat(F.lit(OPEN), _head(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = members.select("tree", "leaf", "up", "role", lead.alias("lead"), body.alias("body"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    size = F.length("lead") + F.length("body") + len(CLOSE)
    turns = turns.withColumn("start", F.coalesce(
        F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("lead"))
    span = F.when(F.col("role") == loss_role, F.struct(F.col("start").alias("from"),
                                                       (F.col("start") + F.length("body")).alias("to")))
    written = turns.groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("start", F.concat("lead", "body", F.lit(CLOSE)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return (written.join(ranked, ["tree", "leaf"])
            .select("tree", "leaf", "rank", F.col("path_score").alias("score"),
                    F.array_join(F.col("turns")["turn"], "").alias("formatted"), "loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    inner = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p):
        at = F.locate("\n", p) if isinstance(p, str) else F.position(F.lit("\n"), p)
        return F.struct(_role(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
                        unescaped(F.substring(p, at + 1, F.length(p))).alias("text"))
    return F.transform(inner, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")


def op4(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_trees(reply_chain(rows))
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.select("tree", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"),
                     masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return out.select(F.when(F.col("tree") != "none", F.col("tree")).cast("long").alias("conv_id"),
                      F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      "formatted_chars")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
done AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
         + length(role) + 24 AS size FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM done GROUP BY conv_id
"""
