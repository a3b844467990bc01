"""Chat formatting of reply trees (DataFrame functions only).

Messages know their parent. Iterated self-joins double the stretch each message can jump up its tree, which gives depth
and path score in log2(depth) joins; the leaves of each tree are ranked by path score, and the same jumps, taken from
the longest to the shortest, enumerate the messages of each chosen path. Each path becomes one conversation:

    <|im_start|>role
    text<|im_end|>

Inside roles and texts "<|" never occurs: one backslash is put between "<", any backslashes that follow it, and "|",
which is reversed by taking one out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posemill.llm.common import written

#: The template's marks, and the roles whose texts a model learns.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role is one line: percent signs and line ends are written as in URLs."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of jumps (tree, node, up) of 1, 2, 4, ... steps, for the nodes that have so many above them, and
    (tree, node, depth, total) of every node that hangs from a root: total is the score from the root to the node."""
    known = nodes.select(F.col("tree").alias("known_tree"), F.col("node").alias("known_node"))
    has_parent = F.col("tree").eqNullSafe(F.col("known_tree")) & (F.col("parent") == F.col("known_node"))
    state = written(nodes.join(known, has_parent, "left").select(
        "tree", "node", F.col("known_node").alias("up"), F.when(F.col("known_node").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("score").alias("total")), "jumps")
    tables, arrived, most = [], [], nodes.count()
    named = ["tree", "node", "depth", "total"]
    while True:
        climbing = state.filter(F.col("up").isNotNull())
        if not climbing.limit(1).count() or 1 << len(tables) > most:  # what climbs on after so many steps goes round a cycle
            arrived.append(state.filter(F.col("up").isNull()).select(*named))
            break
        tables.append(climbing.select("tree", "node", "up"))
        # A tree whose nodes have all arrived at its root takes no part in later joins.
        open_trees = climbing.select(F.col("tree").alias("open_tree")).distinct()
        is_open = F.col("tree").eqNullSafe(F.col("open_tree"))
        arrived.append(state.join(open_trees, is_open, "left_anti").select(*named))
        rest = state.join(open_trees, is_open, "left_semi")
        above = rest.select(*[F.col(c).alias(f"above_{c}") for c in state.columns])
        reached = climbing.join(above, F.col("tree").eqNullSafe(F.col("above_tree")) & (F.col("up") == F.col("above_node"))).select(
            "tree", "node", F.col("above_up").alias("up"), (F.col("depth") + F.col("above_depth")).alias("depth"), (F.col("total") + F.col("above_total")).alias("total"))
        state = written(reached.unionByName(rest.filter(F.col("up").isNull())), "jumps")
    depths = arrived[0]
    for part in arrived[1:]:
        depths = depths.unionByName(part)
    return tables, depths


def tree_paths(nodes: DataFrame, top_k: int | None = None) -> DataFrame:
    """tree, leaf, total, rank, turn (0 at the root), node: the messages of each tree's root-to-leaf paths, the top_k
    by total score if given (ties: the smaller leaf); rank counts from 1, and is null if all paths are wanted."""
    tables, depths = _jumps(nodes)
    parents = nodes.select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_node"))
    is_parent = F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("node") == F.col("p_node"))
    leaves = depths.join(parents, is_parent, "left_anti").withColumnRenamed("node", "leaf")
    if top_k is None:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:  # with this filter each task keeps top_k rows of a tree before they are dealt out
        leaves = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).filter(F.col("rank") <= top_k)
    path = leaves.withColumn("node", F.col("leaf")).withColumn("turn", F.col("depth")).drop("depth")
    for power in reversed(range(len(tables))):
        jump = tables[power].toDF("j_tree", "j_node", "up")
        on = F.col("tree").eqNullSafe(F.col("j_tree")) & (F.col("node") == F.col("j_node"))
        steps = F.filter(F.array(F.struct("node", "turn"), F.struct(F.col("up").alias("node"), (F.col("turn") - (1 << power)).alias("turn"))), lambda s: s["node"].isNotNull())
        path = path.join(jump, on, "left").select("tree", "leaf", "total", "rank", F.inline(steps))
    return path


def format_trees(messages: DataFrame, top_k: int | None = None, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row for each chosen path: tree, leaf, total double, rank int, n_turns long, formatted string, loss_turns
    array<boolean> (whether a turn's text is learned) and loss_spans array<struct<start,end>> (code points of formatted,
    end exclusive: the escaped texts of those turns).

    messages has tree, node, parent, role, text, score; other columns are not used. Null role or text is empty, a null
    score is 0, and null is a tree of its own. A parent that is null or missing makes a root. Rows with a null node, and
    messages on or below a cycle, belong to no path. Rows that repeat a node of a tree count once: the smallest by
    parent, role, text and score. An empty table gives an empty table. A path of any length is one value of a row.
    """
    named = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).filter(F.col("node").isNotNull())
    nodes = written(named.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*"), "messages")
    paths = tree_paths(nodes.select("tree", "node", "parent", "score"), top_k)
    said = nodes.select(F.col("tree").alias("m_tree"), F.col("node").alias("m_node"), "role", "text")
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("node") == F.col("m_node")))
    turns = turns.select("tree", "leaf", "total", "rank", "turn", F.col("role").isin(*trained).alias("loss"),
                         F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(END) + 1
    so_far = W.partitionBy("tree", "leaf").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(so_far), F.lit(0)) + F.char_length("head"))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("total").alias("total"), F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct("turn", "loss", "start", (F.col("start") + F.char_length("body")).alias("end"),
                                             F.concat("head", "body", F.lit(END + "\n")).alias("shown")))).alias("turns"))
    return whole.select(
        "tree", "leaf", "total", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.shown", "").alias("formatted"),
        F.col("turns.loss").alias("loss_turns"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(unescaped_role(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescaped(F.substr(part, F.char_length(head) + 2)).alias("text"))
    return F.transform(parts, turn)


def chains(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: every turn answers the one before it. Turns are
    ordered by turn (nulls first), then role and text; repeated rows are turns of their own."""
    node = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return turns.withColumn("node", node).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
