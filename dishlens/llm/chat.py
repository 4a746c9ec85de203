"""Conversations from reply trees, formatted with a mask of the text to learn.

Messages form trees. For every message the distance to its root and the sum of the scores on its path are found by
iterative self-joins that double the reach: a message knows its ancestor 2 ** k steps up, and the next round joins each
message with what that ancestor knows. A tree of depth d takes log2(d) rounds. Leaves are then ranked in their tree by mean
score of their path (the longer path first, then the least node), and for the branches chosen the same ancestors mark
all messages of the path, again in log2(d) joins. Each chosen path is formatted as one conversation.

Template, per turn: ``### Role: text</turn>`` and a line feed. In roles and texts a backslash is doubled, ``###`` becomes
``\\h``, ``</turn>`` becomes ``\\t`` and, in roles, a colon becomes ``\\c``, so that a text can hold any control string and is
read back as it was. The mask is a list of code point ranges of the formatted text: the texts of the assistant.

Results: null text or role counts as empty; a message whose parent is missing is a root; messages in a circle of replies
have no root and are left out; a null tree is a tree of its own; an empty table gives an empty result. One conversation is
one row, so it has to fit into memory; nothing else is gathered, and a row is made in time that goes with its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dishlens.sources.sinks import materialize

OPEN, END = "### ", "</turn>"
#: (control string, escape), fixed values of the template; the backslash itself is handled apart.
ESCAPES = [("###", "\\h"), ("</turn>", "\\t")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
LEARNED = "assistant"
#: A conversation that the query adds to the table: texts that are control strings themselves.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control, code in pairs:
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column, pairs: list[tuple[str, str]] = ROLE_ESCAPES) -> Column:
    """Doubled backslashes part the text; between them every code is one that ``escape`` wrote."""
    def one(piece: Column) -> Column:
        for control, code in pairs:
            piece = F.replace(piece, F.lit(code), F.lit(control))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def replies(turns: DataFrame) -> DataFrame:
    """A table of turns as trees without branches: tree, node, parent, role, text, score.

    Turns follow by number; turns with the same number follow by role and text.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = turns.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _reach(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ancestors 2 ** k steps up, and for every message that has a root its depth and the score of its path."""
    nodes = messages.select("tree_key", "node")
    parents = nodes.select("tree_key", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = messages.select("tree_key", "node", "parent", "score").join(parents, ["tree_key", "parent"], "left")
    state = materialize(
        state.select("tree_key", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")),
        "replies",
    )
    n, jumps, ended = nodes.count(), [], []
    while True:
        # messages that have met their root are done; only the others are joined further
        ended.append(state.where("up IS NULL").select("tree_key", "node", F.col("steps").alias("depth"), "total"))
        open_ones = state.where("up IS NOT NULL")
        if open_ones.isEmpty() or 1 << len(jumps) > n:
            return jumps, reduce(DataFrame.unionByName, ended)
        jumps.append(open_ones.select("tree_key", "node", "up"))
        far = state.select("tree_key", F.col("node").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("total").alias("above"))
        done = reduce(DataFrame.unionByName, ended[:-1], state.limit(0).select("tree_key", "node", F.col("steps").alias("depth"), "total"))
        met = done.select("tree_key", F.col("node").alias("up"), F.lit(None).cast("long").alias("further"), F.col("depth").alias("more"), F.col("total").alias("above"))
        state = materialize(
            open_ones.join(far.unionByName(met), ["tree_key", "up"]).select(
                "tree_key", "node", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("above")).alias("total")
            ),
            "replies",
        )


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The messages of the ``top`` branches of each tree: tree, branch, position, role, text.

    ``messages``: tree, node (unique in its tree), parent (null for a root), role, text, score (null counts as 0).
    """
    messages = messages.select(
        F.to_json(F.struct("tree")).alias("tree_key"),
        "tree",
        "node",
        "parent",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    messages = materialize(messages, "messages")
    jumps, paths = _reach(messages)
    inner = messages.where("parent IS NOT NULL").select("tree_key", F.col("parent").alias("node")).distinct()
    leaves = paths.join(inner, ["tree_key", "node"], "left_anti")
    order = Window.partitionBy("tree_key").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), F.col("node"))
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= top)
    marked = chosen.select("tree_key", "branch", "node")
    for jump in reversed(jumps):
        further = marked.join(jump, ["tree_key", "node"]).select("tree_key", "branch", F.col("up").alias("node"))
        marked = materialize(marked.unionByName(further), "branches")
    depth = paths.select("tree_key", "node", F.col("depth").alias("position"))
    return marked.join(depth, ["tree_key", "node"]).join(messages, ["tree_key", "node"]).select("tree", "tree_key", "branch", "position", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """One row for each branch: tree, branch, formatted, and learned, the [start, end) ranges of the assistant's texts.

    Where a turn begins is a running sum over the rows of its branch, made before they are gathered.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    rows = paths.select("tree_key", "branch", "tree", "position", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    size = (F.length("head") + F.length("body") + len(END) + 1).cast("long")
    before = Window.partitionBy("tree_key", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turns = F.array_sort(F.collect_list(F.struct("position", F.concat("head", "body", F.lit(END + "\n")).alias("turn"))))
    spans = F.array_sort(F.collect_list(F.when(F.col("learned"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))))
    gathered = rows.groupBy("tree_key", "branch").agg(F.first("tree").alias("tree"), turns.alias("turns"), spans.alias("learned"))
    return gathered.select("tree", "branch", F.array_join(F.col("turns.turn"), "").alias("formatted"), "learned")


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and learned text, read from the formatted text and its mask alone: tree, turns (role, text), learned_text."""
    lines = F.filter(F.split("formatted", f"{END}\n", -1), lambda x: F.length(x) > 0)
    at = lambda x: F.instr(x, ": ")
    turns = F.transform(
        lines,
        lambda x: F.struct(
            unescape(F.substr(x, F.lit(len(OPEN) + 1), at(x) - 1 - len(OPEN))).alias("role"),
            unescape(F.substr(x, at(x) + 2)).alias("text"),
        ),
    )
    masked = F.transform("learned", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return conversations.withColumns({"turns": turns, "learned_text": F.array_join(masked, "")})


def probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The table with the conversation of control strings."""
    extra = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return turns.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in extra.schema)).unionByName(extra)


def digest(conversations: DataFrame) -> DataFrame:
    """What is read back from the output, as counts and hashes."""
    rows = read_back(conversations)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
