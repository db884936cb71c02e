"""Chat formatting of reply trees, with DataFrame operations only.

Messages form trees: each names its parent.  Iterative self-joins by pointer doubling give
every message its ancestors at distance 1, 2, 4, .., and the score of its path to the root, in
as many joins as the depth has binary digits.  The leaves of a tree are ranked by the mean
score of their path, the best paths are chosen, and the same ancestor tables, taken from the
largest jump to the smallest, list the messages of each chosen path.

A path becomes one string.  Marks are ``<|im_start|>``, ``<|im_sep|>`` and ``<|im_end|>``; in
roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``, so that no mark can occur
in them, and ``unescape`` gives back exactly what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MASKED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def tree_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of ``nodes(tree_id, node_id, parent_id, score)``.

    Returns ``tree_id, leaf_id, rank, node_id, depth``: the ``branches`` best paths of a tree
    by mean score (then the longer one, then the lesser leaf), with the messages of each.  A
    null score counts as zero; a parent that doesn't exist makes its child a root; rows with
    a null tree or node id are left out; of repeated ids the row with the least parent counts;
    messages in a cycle have no root and no leaf, and are left out.
    """
    key = ["tree_id", "node_id"]
    one = nodes.where("tree_id is not null and node_id is not null").groupBy(*key).agg(
        F.min(F.struct("parent_id", "score")).alias("x")
    )
    one = stash(one.select(*key, F.col("x.parent_id").alias("parent"), F.coalesce("x.score", F.lit(0.0)).alias("score")), "tree")
    ids = one.select("tree_id", F.col("node_id").alias("parent"), F.lit(True).alias("has"))
    jump = stash(
        one.join(ids, ["tree_id", "parent"], "left").select(
            *key, F.when(F.col("has"), F.col("parent")).alias("up"), F.col("score").cast("double").alias("sum"), F.lit(1).cast("long").alias("n")
        ),
        "jump",
    )
    inner = one.select("tree_id", F.col("parent").alias("node_id")).where("node_id is not null").distinct()
    total = jump.count()
    jumps, done = [], []
    while True:  # messages whose path has reached its root take no part in further joins
        done.append(jump.where("up is null"))
        alive = jump.where("up is not null")
        if alive.isEmpty() or 2 ** len(jumps) > 2 * total:
            break
        jumps.append(alive)
        above = alive
        for x in done:
            above = above.unionByName(x)
        above = above.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("s2"), F.col("n").alias("n2"))
        jump = stash(
            alive.join(above, ["tree_id", "up"]).select(
                *key, F.col("up2").alias("up"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n")
            ),
            "jump",
        )
    reached = done[0]
    for x in done[1:]:
        reached = reached.unionByName(x)
    leaves = reached.join(inner, key, "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc(F.col("sum") / F.col("n")), F.desc("n"), "node_id")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    path = stash(
        best.select("tree_id", F.col("node_id").alias("leaf_id"), "rank", "node_id", F.col("n").alias("depth")), "path"
    )
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].select(*key, "up")
        more = path.join(up, key).select("tree_id", "leaf_id", "rank", F.col("up").alias("node_id"), (F.col("depth") - 2**k).alias("depth"))
        path = stash(path.unionByName(more), "path")
    return path


def format_paths(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, leaf_id, depth, role, text)`` as one row per path: ``conv_id,
    leaf_id, formatted string, loss array<struct<start int, end int>>``.

    ``loss`` has the code points of the formatted string that assistants said (escaped).  A
    path is one output row, so its messages meet in one task.
    """
    path = Window.partitionBy("conv_id", "leaf_id").orderBy("depth")
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit(SEP))
    turn = messages.select("conv_id", "leaf_id", "depth", head.alias("head"), text.alias("text"), (F.col("role") == MASKED_ROLE).alias("masked"))
    size = F.length("head") + F.length("text") + len(END)
    turn = turn.withColumn("size", size).withColumn("at", F.sum("size").over(path) - F.col("size") + F.length("head"))
    span = F.when(F.col("masked"), F.struct(F.col("at").cast("int").alias("start"), (F.col("at") + F.length("text")).cast("int").alias("end")))
    turns = turn.groupBy("conv_id", "leaf_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "text", F.lit(END)).alias("s"), span.alias("span")))).alias("t")
    )
    return turns.select(
        "conv_id",
        "leaf_id",
        F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """``formatted`` rows with ``turns array<struct<role, text>>`` and ``loss_text`` read back."""
    parts = F.split("formatted", "<\\|im_end\\|>", -1)
    heads = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), "<\\|im_sep\\|>", -1),
    )
    turns = F.transform(heads, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    said = F.transform(
        "loss", lambda x: unescape(F.substr("formatted", x["start"] + 1, x["end"] - x["start"]))
    )
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(said, ""))


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as trees: each turn replies to the one before it (by
    turn, then role, then text, nulls first).  Rows without a conv_id are left out."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("tree_id"),
        F.row_number().over(order).cast("long").alias("node_id"),
        "role",
        "text",
    )
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return numbered.withColumn("parent_id", parent).withColumn("score", F.lit(0.0))


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The chosen paths of ``nodes(tree_id, node_id, parent_id, score, role, text)``, formatted
    (see ``format_paths``); ``conv_id`` is the tree."""
    nodes = stash(nodes, "nodes")
    paths = tree_paths(nodes, branches)
    said = nodes.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "score", "role", "text")).alias("x"))
    messages = paths.join(said, ["tree_id", "node_id"]).select(
        F.col("tree_id").alias("conv_id"), "leaf_id", "depth", "x.role", "x.text"
    )
    return format_paths(messages)


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, all read back from the formatted output: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Null roles and texts are empty; an empty table gives an empty result.
    """
    made = stash(format_trees(conversation_nodes(conversations.select("conv_id", "turn", "role", "text"))), "formatted")
    read = parse(made)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
