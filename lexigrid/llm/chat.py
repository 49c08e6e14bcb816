"""Reply trees formatted as conversations, with column expressions and joins only.

Messages name their parent. Pointer jumping (self-joins that double the length
of every jump) lists the messages between each leaf and its root in a number of
rounds that is logarithmic in the depth. Branches are ranked by the sum of their
messages' scores, and each chosen path becomes one conversation.

    <|im_start|>role \\n text <|im_end|> \\n        for each turn, without the blanks

Inside roles and texts `\\` is written `\\\\` and `<|` is written `<\\|`, so no text
can hold a control string; in roles a line break is written `\\/` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import col, settle

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\/")) if role else out


def unescape(text: Column) -> Column:
    """Undoes escape(). Doubled backslashes are taken off from the left, so what is left between them holds single escapes only."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\/"), F.lit("\n"))), "\\")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, id, hops long: for each leaf the messages up to its root, hops 0 at the leaf.

    nodes: tree, id (unique and not null in its tree), parent. A parent that is
    null or not in the tree makes a root. Messages on a cycle of parents have no
    root, and no leaf leads to one: whatever hangs below a cycle gives no path.
    """
    known = settle(nodes.select("tree", "id", "parent"))
    up = known.join(known.select(F.col("tree").alias("t"), F.col("id").alias("above")), (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("above"))).select("tree", "id", "above")
    up = settle(up)
    inner = up.select(F.col("tree").alias("t"), F.col("above").alias("i")).distinct()
    leaves = known.join(inner, (F.col("tree") == F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    paths = settle(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("hops")))
    deepest = known.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jump, length = up, 1
    while length < deepest and not jump.isEmpty():
        step = jump.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("above").alias("to"))
        on = (F.col("tree") == F.col("t")) & (F.col("id") == F.col("i"))
        paths = settle(paths.unionByName(paths.join(step, on).select("tree", "leaf", F.col("to").alias("id"), (F.col("hops") + length).alias("hops"))))
        jump = settle(jump.join(step, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("i"))).select("tree", "id", F.col("to").alias("above")))
        length *= 2
    rooted = paths.join(up.select(F.col("tree").alias("t"), F.col("id").alias("i")), (F.col("tree") == F.col("t")) & (F.col("id") == F.col("i")), "left_anti").select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return paths.join(rooted, (F.col("tree") == F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def best_branches(paths: DataFrame, nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, score double, rank int of the best branches of each tree: highest sum of scores first, then smallest leaf."""
    scores = nodes.select("tree", "id", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    total = paths.join(scores, ["tree", "id"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return total.withColumn("rank", rank).where(F.col("rank") <= branches)


def format_paths(turns: DataFrame, keys: list[str], loss_role: str = "assistant") -> DataFrame:
    """One row for each value of keys: formatted string, loss_spans array of struct(start, end) in code points of it.

    turns: keys, pos (order), role, text. Null roles and texts count as empty.
    """
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    parts = turns.select(*keys, "pos", "role", head.alias("head"), body.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = F.sum(F.length("piece")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    placed = parts.select(*keys, F.struct("pos", "piece", start.alias("start"), (start + F.length("body")).alias("end"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss")).alias("turn"))
    joined = placed.groupBy(*keys).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return joined.select(*keys, F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss_spans"))


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """tree, leaf, rank, score, formatted, loss_spans of the best branches of each reply tree.

    messages: tree, id, parent, role, text, score; other columns are not read. A
    null tree is a tree like any other. Ids are unique in a tree; rows with a null
    id give no path, nor do messages on or below a cycle of parents (threads()
    makes neither). Ties between branches go to the smallest leaf. An empty table
    gives no rows.
    """
    # structs are equal where both hold null, so that a null tree joins with itself
    nodes = messages.where("id is not null").select(F.struct("tree").alias("tree"), "id", "parent", "role", "text", "score")
    paths = settle(leaf_paths(nodes))
    best = best_branches(paths, nodes, branches)
    chosen = paths.join(best.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turns = chosen.join(nodes.select("tree", "id", "role", "text"), ["tree", "id"]).select("tree", "leaf", (-F.col("hops")).alias("pos"), "role", "text")
    return best.join(format_paths(turns, ["tree", "leaf"], loss_role), ["tree", "leaf"]).select("tree.tree", "leaf", "rank", "score", "formatted", "loss_spans")


def threads(rows: DataFrame, tree_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations without branches: each answers the one before it.

    Order is by order_col (nulls first), then role and text, so ties and repeated
    rows have a place each. Rows whose tree_col is null are one conversation.
    """
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("o").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())).cast("long")
    named = rows.select(col(tree_col).cast("long").alias("tree"), col(order_col).alias("o"), col(role_col).cast("string").alias("role"), col(text_col).cast("string").alias("text"))
    return named.withColumn("id", place).select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text) read back from a formatted conversation."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(b: Column) -> Column:
        cut = F.locate("\n", b)
        return F.struct(unescape(F.substring(b, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(b, cut + 1, F.length(b) - cut - len(END))).alias("text"))

    return F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
