"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parents. Binary lifting by self-joins (each round joins the table
of 2^k-th ancestors with itself, and adds up the scores between) gives ancestors in log2(depth) rounds. Leaves climb to
their roots by those tables and so get the sum of their paths' scores without a row for each message on it. The best
`top` leaves of a tree are chosen by that sum, and only their root-to-leaf paths are then expanded, by the
same tables; each becomes one conversation in a template:

    <|im_start|>role\\ntext<|im_end|>\\n

Escapes make the template reversible: in a text, `\\` becomes `\\\\` and then `<|` becomes
`<\\|`; in a role also a line end becomes `<\\n`. So `<|` in the output is always a mark. The loss
mask lists (start, length) in characters of the escaped assistant texts.

Defined results: a null text or role is empty; a null tree id is a tree of its own; a null score is 0; a parent
that isn't there makes its child a root; messages above which lies a circle of parents are left
out, as they have no root; of rows with the same tree and node the least by parent, score, role and text stays; rows at
the same turn are ordered by role, then text; equal
paths' scores rank by the smaller leaf (sums are in double precision); very long texts and paths stay whole; other columns,
whatever their names, aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def turns_to_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as chains: each message's parent is the row before it."""
    rows = conversations.select(
        F.col("conv_id").alias("tree"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    node = F.row_number().over(w).cast("long")
    return rows.select("tree", node.alias("node"), "role", "text").withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1)
    ).withColumn("score", F.lit(1.0))


def _keyed(messages: DataFrame, unique: bool) -> DataFrame:
    """(k, tree, node, parent, score, role, text): one row for each node."""
    key = F.coalesce(F.col("tree").cast("string"), F.lit("\0null"))
    rows = messages.select(key.alias("k"), "tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text")
    if unique:
        return rows
    least = rows.groupBy("k", "tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m"))
    return least.select("k", "tree", "node", "m.parent", "m.score", "m.role", "m.text")


def best_paths(spark: SparkSession, messages: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, rank, node, dist) of the best root-to-leaf paths; dist counts from the leaf.

    messages: tree, node, parent (null: a root), role, text, score; unique: no node is twice in a tree.
    """
    return _chosen(spark, _keyed(messages, unique), top).select("tree", "leaf", "rank", "node", "dist")


def _chosen(spark: SparkSession, keyed: DataFrame, top: int) -> DataFrame:
    scratch = Scratch(spark, "reply-trees")
    nodes = scratch.cut(keyed.select("k", "tree", "node", "parent", "score"), "nodes")
    there = nodes.select("k", F.col("node").alias("parent"))
    up = scratch.cut(nodes.where("parent is not null").join(there, ["k", "parent"]).select("k", "node", "parent", F.col("score").alias("total")), "up")
    levels = [up]
    n = up.count()
    for _ in range(math.ceil(math.log2(n + 2)) + 1 if n else 0):
        last = levels[-1]
        nxt = last.alias("a").join(last.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.parent") == F.col("b.node")))
        nxt = scratch.cut(nxt.select("a.k", "a.node", "b.parent", (F.col("a.total") + F.col("b.total")).alias("total")), "up")
        levels.append(nxt)
        if nxt.isEmpty():
            break
    # rows left at the last level never reach a root: a circle lies above them
    lost = levels[-1].select("k", "node")
    leaves = nodes.join(up.select("k", F.col("parent").alias("node")), ["k", "node"], "left_anti").join(lost, ["k", "node"], "left_anti")
    leaves = scratch.cut(leaves.select("k", "tree", F.col("node").alias("leaf")), "leaves")
    per_tree = scratch.cut(leaves.groupBy("k", "tree").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf")), "trees")
    best = per_tree.where("n = 1").select("k", "tree", "leaf", F.lit(1).alias("rank"))
    several = per_tree.where("n > 1").select("k")
    if not several.isEmpty():
        climbed = _climb(leaves.join(several, "k", "left_semi"), nodes, levels[:-1] if n else [], scratch)
        ranked = climbed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("total"), "leaf"))).where(F.col("rank") <= top)
        best = best.unionByName(ranked.select("k", "tree", "leaf", "rank"))
    paths = best.withColumns({"node": F.col("leaf"), "dist": F.lit(0).cast("long")})
    for i, level in enumerate(levels[:-1] if n else []):
        paths = scratch.cut(paths, "paths")
        more = paths.join(level, ["k", "node"]).select("k", "tree", "leaf", "rank", F.col("parent").alias("node"), (F.col("dist") + (1 << i)).alias("dist"))
        paths = paths.unionByName(more)
    paths = scratch.cut(paths, "paths")
    scratch.keep(paths)
    return paths


def _climb(leaves: DataFrame, nodes: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """leaves with total: the sum of the scores from each leaf to its root, by jumps of falling length."""
    at = leaves.withColumns({"at": F.col("leaf"), "total": F.lit(0.0)})
    for i in range(len(levels) - 1, -1, -1):
        jump = levels[i].select("k", F.col("node").alias("at"), "parent", F.col("total").alias("more"))
        at = at.join(jump, ["k", "at"], "left").select("k", "tree", "leaf", F.coalesce("parent", "at").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))
        if i % 3 == 0:
            at = scratch.cut(at, "climbing")
    root = nodes.select("k", F.col("node").alias("at"), F.col("score").alias("more"))
    return scratch.cut(at.join(root, ["k", "at"]).select("k", "tree", "leaf", (F.col("total") + F.col("more")).alias("total")), "climbed")


def format_trees(spark: SparkSession, messages: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """tree, rank, formatted, loss_mask (start and length in characters, from 0) of each chosen path; unique as in best_paths()."""
    keyed = _keyed(messages, unique)
    turns = _chosen(spark, keyed, top).join(keyed.select("k", "node", "role", "text"), ["k", "node"])
    role = escape_role(F.coalesce(F.col("role"), F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    part = F.struct(
        (-F.col("dist")).alias("at"),
        F.concat(head, body, F.lit(END)).alias("out"),
        F.length(head).cast("long").alias("before"),
        F.length(body).cast("long").alias("size"),
        (F.col("role") == "assistant").alias("loss"),
    )
    whole = turns.groupBy("k", "tree", "leaf", "rank").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    # one left fold: where each part begins, and the spans of assistant texts
    fold = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + p["before"] + p["size"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + p["before"]).alias("start"), p["size"].alias("size"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    return whole.select(
        "tree",
        "rank",
        F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("formatted"),
        fold["mask"].alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["size"].cast("int")))), "")
