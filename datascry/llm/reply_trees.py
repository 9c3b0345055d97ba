"""Reply trees to chat texts: root-to-leaf paths by iterative self-joins, branches ranked by score, one conversation per chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import written
from datascry.operators.ordered import Sequence

#: The template: "### role:", a line break, the text, a line break, "</turn>" and a line break. A backslash marks what is no control sign.
OPEN, NAMED, CLOSE = "### ", ":\n", "\n</turn>\n"


def escaped_text(c: Column) -> Column:
    """The text with a backslash before every backslash, # and <: no control string of the template is left in it."""
    return F.regexp_replace(c, r"([\\#<])", r"\\$1")


def escaped_role(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\#<:\n])", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\s\S])", "$1")


def turn_text(role: Column, text: Column) -> Column:
    """One formatted turn."""
    return F.concat(F.lit(OPEN), escaped_role(role), F.lit(NAMED), escaped_text(text), F.lit(CLOSE))


def path_states(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For (rid, up, worth): (rid, depth, total) of every node below a root, and the tables of jumps, 1, 2, 4, ... steps up.

    Each round joins the jumps with themselves, so their number follows the logarithm of the longest path. A row is some numbers whatever
    the path. Nodes on or below a cycle never end; they are those left when a path would be longer than the table, and are left out.
    """
    state = written(nodes.select("rid", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("worth").alias("total")), "reply-paths")
    jumps, longest = [], state.count()
    while True:
        open_ = state.where("up is not null")
        if open_.isEmpty() or 1 << len(jumps) > 2 * longest:
            return state.where("up is null").select("rid", "depth", "total"), jumps
        jumps.append(open_.select("rid", "up"))
        above = state.select(F.col("rid").alias("a"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"), F.col("total").alias("a_total"))
        stepped = open_.join(above, F.col("up") == F.col("a")).select("rid", F.col("a_up").alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth"), (F.col("total") + F.col("a_total")).alias("total"))
        state = written(stepped.unionByName(state.where("up is null")), "reply-paths")


def chosen_paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, rid, depth): every node on the path of each leaf, by the jumps that the bits of its distance name.

    `leaves` has (rid, depth). In the step of 2 ** k every row far enough from its root keeps itself and adds the node 2 ** k above, so each
    distance comes once and no more rows exist than the paths have nodes. Rows too near the root join with a number of their own.
    """
    rows = leaves.select(F.col("rid").alias("leaf"), "rid", "depth")
    for k in reversed(range(len(jumps))):
        far = F.col("depth") >= (1 << k)
        jump = jumps[k].select(F.col("rid").alias("j"), F.col("up").alias("j_up"))
        rows = rows.withColumn("ask", F.when(far, F.col("rid")).otherwise(-1 - F.col("leaf"))).join(jump, F.col("ask") == F.col("j"), "left")
        here, there = F.struct("rid", "depth"), F.struct(F.col("j_up").alias("rid"), (F.col("depth") - (1 << k)).alias("depth"))
        rows = rows.select("leaf", F.inline(F.when(F.col("j_up").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return rows


def format_trees(messages: DataFrame, tree_col: str = "conv_id", node_col: str = "node", parent_col: str = "parent", role_col: str = "role", text_col: str = "text",
                 score_col: str | None = None, branches: int | None = None, learned_role: str = "assistant") -> DataFrame:
    """(tree, branch, score, formatted, loss): one row per chosen root-to-leaf path of each reply tree, with all its turns in order.

    Branches of a tree are ranked by the sum of their scores, higher first, then by node; the first `branches` are taken, all where it is
    None. `loss` has one entry per turn of `learned_role`: the number of the turn, and where its escaped text starts and ends in that
    turn, in code points. `parse_turns` and `loss_text` read them back.

    Null texts and roles are empty, null scores zero. A parent that is null or not in its tree makes a root. Where a node's key is repeated in a
    tree, one row stays, that with the least (parent, role, digest of the text, score). Messages on or below a cycle of parents are on no path from a root
    and left out. A null tree is a tree. Texts of any length are handled whole; one conversation is one string, as long as Spark's
    strings may be. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (tree_col, node_col)}
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    rows = messages.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).cast(kinds[node_col]).alias("parent"),
                           F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), score.alias("worth"))
    texts = written(rows.withColumn("rid", F.monotonically_increasing_id()), "messages")  # from here on numbers travel, texts only at the end
    least = F.min(F.struct("parent", "role", F.sha2("text", 256).alias("digest"), "worth", "rid")).alias("m")
    rows = written(texts.groupBy("tree", "node").agg(least).select("tree", "node", "m.parent", "m.worth", "m.rid"), "message-keys")
    above = rows.where("node is not null").select(F.col("tree").alias("a_tree"), F.col("node").alias("a_node"), F.col("rid").alias("a_rid"))
    asking = rows.where("parent is not null").select("rid", "tree", "parent")
    found = asking.join(above, F.col("tree").eqNullSafe(F.col("a_tree")) & (F.col("parent") == F.col("a_node"))).select("rid", F.col("a_rid").alias("up"))
    nodes = written(rows.select("rid", "worth").join(found, "rid", "left"), "reply-nodes")
    ended, jumps = path_states(nodes)
    inner = nodes.where("up is not null").select(F.col("up").alias("rid")).distinct()
    leaves = ended.join(inner, "rid", "leftanti").join(rows.select("rid", "tree", "node"), "rid")
    ranked = Sequence(leaves.withColumn("less", -F.col("total")), ["tree"], ["less", "rid"]).numbered("branch")
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    ranked = written(ranked.select(F.col("rid").alias("leaf"), "tree", "depth", "branch", F.col("total").alias("score")), "branches")
    placed = chosen_paths(ranked.select(F.col("leaf").alias("rid"), "depth"), jumps)
    role_size = F.length(escaped_role(F.col("role"))) + len(OPEN) + len(NAMED)
    turns = placed.join(texts.select("rid", turn_text(F.col("role"), F.col("text")).alias("turn"), (F.col("role") == learned_role).alias("learned"), role_size.alias("start")), "rid")
    whole = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "learned", "start"))).alias("turns"))
    mask = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), (F.length(t["turn"]) - len(CLOSE)).alias("end"), t["learned"].alias("learned"))),
                    lambda m: m["learned"])
    whole = whole.select("leaf", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.transform(mask, lambda m: m.dropFields("learned")).alias("loss"))
    return ranked.join(whole, "leaf").select(F.col("tree").alias(tree_col), "branch", "score", "formatted", "loss")


def split_turns(formatted: Column) -> Column:
    """The formatted turns of a conversation, without their ends."""
    parts = F.split(formatted, CLOSE)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) as they were before formatting."""
    head = r"^### ((?:[^\\:\n]++|\\[\s\S])*+):\n"
    role = lambda p: F.regexp_extract(p, head, 1)
    return F.transform(split_turns(formatted), lambda p: F.struct(
        unescaped(role(p)).alias("role"), unescaped(F.substr(p, F.length(role(p)) + len(OPEN) + len(NAMED) + 1)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    parts = split_turns(formatted)
    return F.array_join(F.transform(loss, lambda m: unescaped(F.substr(F.get(parts, m["turn"]), m["start"] + 1, m["end"] - m["start"]))), "")


def linear_trees(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, node, parent, role, text): plain conversations as reply trees, each row answering the one before it by turn (equal turns by content)."""
    rows = turns.select(tree_col, F.col(turn_col).alias("at"), F.xxhash64(role_col, text_col).alias("content"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    numbered = Sequence(rows, [tree_col], ["at", "content"]).numbered("node")
    return numbered.select(tree_col, "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")
