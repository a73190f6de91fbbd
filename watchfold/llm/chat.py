"""Reply trees as training conversations.

Messages point to the message they answer.  Root-to-leaf paths are found with iterative
self-joins that double their reach: after k rounds every message knows its 2**k-th
ancestor, and a leaf then collects its path in as many joins, so the number of joins
grows with the logarithm of the depth.  Branches are ranked by score, and each chosen
path is written as one conversation under a template whose control strings cannot
occur in texts.  DataFrame operations only; paths carry ids, and texts join last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from watchfold.llm.common import written

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """Backslash, ``#``, ``<`` and ``:`` as two characters each; so no control string is left in a text."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A linear conversation as a tree: ``node`` numbers its rows by turn, each answers the one before.

    Rows that repeat a turn follow each other, ordered by all their columns; a null turn comes first.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col, *[c for c in turns.columns if c not in (conv_col, turn_col)])
    node = F.row_number().over(order).cast("bigint")
    return turns.withColumn("node", node).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(spark: SparkSession, tree: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, leaf, node, up): the messages on each leaf's way to its root, ``up`` steps above the leaf.

    ``tree`` has conv, node, parent.  A parent that is missing, or the message itself, makes its
    child a root.  Messages on a cycle, or below one, have no root and are on no path.
    """
    nodes = tree.select(F.col(conv_col).alias("conv"), "node", "parent")
    known = nodes.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    same = nodes["conv"].eqNullSafe(known["c"]) & (nodes["parent"] == known["p"]) & (nodes["parent"] != nodes["node"])
    jump = written(nodes.join(known, same, "left").select("conv", "node", F.col("p").alias("up")), spark, "jump")
    inner = jump.where("up is not null").select(F.col("conv").alias("c"), F.col("up").alias("u")).distinct()
    same = jump["conv"].eqNullSafe(inner["c"]) & (jump["node"] == inner["u"])
    leaves = jump.join(inner, same, "left_anti").select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    total = jump.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    steps = []
    while not (far := jump.where("up is not null")).isEmpty():
        if len(steps) == total.bit_length():  # beyond the largest conversation only what stands on or below a cycle points upwards
            stuck = far.select(F.col("conv").alias("c"), F.col("node").alias("n"))
            leaves = leaves.join(stuck, leaves["conv"].eqNullSafe(stuck["c"]) & (leaves["node"] == stuck["n"]), "left_anti")
            break
        steps.append(far)
        nxt = jump.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("far"))
        jump = written(far.join(nxt, far["conv"].eqNullSafe(nxt["c"]) & (far["up"] == nxt["n"])).select("conv", "node", F.col("far").alias("up")), spark, "jump")
    found = leaves
    for k in reversed(range(len(steps))):
        step = steps[k].select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("far"))
        higher = found.join(step, found["conv"].eqNullSafe(step["c"]) & (found["node"] == step["n"])).select("conv", "leaf", F.col("far").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = found.union(higher)
        if len(steps) > 4 and k % 4 == 0:
            found = written(found, spark, "paths")
    return found


def best_paths(found: DataFrame, scores: DataFrame, keep: int | None = 1) -> DataFrame:
    """The ``keep`` best leaves of each conversation (None: all), with all rows of their paths.

    ``scores`` has conv, node, score; a path's score is the sum of its messages' scores (null: 0);
    ties go to the longer path, then to the least leaf.
    """
    marks = scores.select(F.col("conv").alias("c"), F.col("node").alias("n"), "score")
    rated = found.join(marks, found["conv"].eqNullSafe(marks["c"]) & (found["node"] == marks["n"]), "left")
    leaves = rated.groupBy("conv", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("up").alias("depth"))
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("depth"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("branch") <= keep)
    ranked = ranked.select(F.col("conv").alias("c"), F.col("leaf").alias("l"), "branch")
    return found.join(ranked, found["conv"].eqNullSafe(ranked["c"]) & (found["leaf"] == ranked["l"])).select("conv", "leaf", "node", "up", "branch")


def format_paths(chosen: DataFrame, tree: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, branch, formatted): each chosen path from root to leaf as one string."""
    said = tree.select(F.col(conv_col).alias("c"), F.col("node").alias("n"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turn = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(CLOSE))
    rows = chosen.join(said, chosen["conv"].eqNullSafe(said["c"]) & (chosen["node"] == said["n"])).select("conv", "branch", "up", turn.alias("turn"))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn")))
    return rows.groupBy("conv", "branch").agg(F.concat_ws("", F.transform(turns, lambda t: t["turn"])).alias("formatted"))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: t != "")
    body = lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.length(t))
    cut = lambda t: F.instr(t, MID)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring(body(t), F.lit(1), cut(body(t)) - 1)).alias("role"),
        unescape(F.substring(body(t), cut(body(t)) + len(MID), F.length(t))).alias("text"),
    ))


def conversations(spark: SparkSession, tree: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text", score_col: str | None = None, keep: int | None = 1) -> DataFrame:
    """(conv, branch, formatted) of each chosen path of each reply tree.

    ``tree`` has conv, node (unique in its conversation), parent, role, text and maybe a score.  Null roles and texts
    count as empty; a null conversation id is a conversation; an empty table gives no rows; a
    conversation that is all cycles gives none.  Other columns are ignored.
    """
    need = [conv_col, "node", "parent", role_col, text_col, *([score_col] if score_col else [])]
    tree = written(tree.select(*need), spark, "tree")
    score = F.col(score_col).cast("double") if score_col else F.lit(0.0)
    found = paths(spark, tree, conv_col)
    chosen = best_paths(found, tree.select(F.col(conv_col).alias("conv"), "node", score.alias("score")), keep)
    return format_paths(chosen, tree, conv_col, role_col, text_col)


def digest(formatted: DataFrame, conv_col: str = "conv_id", answers: str = "assistant") -> DataFrame:
    """What a reader gets back: turns, and the text under the loss mask (``answers`` speaking)."""
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    plain = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["role"] == answers), lambda t: t["text"]))
    return read.select(
        F.col("conv").alias(conv_col), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
