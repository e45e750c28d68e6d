"""Reply trees to chat transcripts, in DataFrame operations alone.

A message names the message it replies to. Iterated self-joins double a pointer
from each message towards its root (2, 4, 8 ... replies up), summing depth and
score on the way; so a branch's score is known for each leaf after as many joins
as the depth has binary digits. Branches are ranked in their tree by score, and
of the chosen ones the same pointers, taken from the longest down, enumerate all
messages of the path. Each path becomes one transcript.

A transcript is, for every turn, `### ` role, a line break, the text and
`</turn>` with a line break. Inside roles and texts a backslash becomes `\\b`, a
number sign `\\h` and a less-than sign `\\l` (in roles a line break `\\n`), so no
marker can be spelt there, and every backslash begins an escape, so it can be
undone. The loss mask is a list of (start, length) in code points: the text of
every assistant turn as it stands in the transcript.

Null roles and texts count as empty. Messages without a tree form one tree with
an empty id. Trees of equal score take the smaller leaf. A message whose parent is
missing is a root. Messages above which parents form a circle have no root and are in
no path. Of several messages with one tree and node the smallest (by parent, score,
role, text) counts; rows that a table of conversations repeats are turns of their own.
A conversation of n turns takes log2(n) joins each way and its transcript is one row.
An empty table gives no transcript; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

MARK = "### "
END = "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column, line: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, coded in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *([("\n", "\\n")] if line else [])):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column, line: bool = False) -> Column:
    out = text
    for plain, coded in (*([("\n", "\\n")] if line else []), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def pointers(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From tree, node, parent, score: (tree, node, up) for 1, 2, 4 ... replies up, and
    (tree, node, depth, score) summed from the root."""
    known = messages.select("tree", F.col("node").alias("parent")).distinct()
    step = messages.join(known.withColumn("known", F.lit(True)), ["tree", "parent"], "left")
    step = step.select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).alias("depth"), "score"
    )
    step, levels = common.cut(step, "replies"), []
    # As many replies up as there are messages are only in a circle.
    while (1 << len(levels)) <= step.count() and not step.filter("up is not null").isEmpty():
        levels.append(step.filter("up is not null").select("tree", "node", "up"))
        above = step.select(
            "tree",
            F.col("node").alias("up"),
            F.col("up").alias("next"),
            F.col("depth").alias("more"),
            F.col("score").alias("add"),
        )
        # Only messages still below their root take part; short trees drop out early.
        moved = step.filter("up is not null").join(above, ["tree", "up"]).select(
            "tree",
            "node",
            F.col("next").alias("up"),
            (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("score") + F.col("add")).alias("score"),
        )
        step = common.cut(step.filter("up is null").unionByName(moved), "replies")
    return levels, step.filter("up is null").select("tree", "node", "depth", "score")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, node, depth: messages of the best branches of each tree."""
    levels, sums = pointers(messages)
    parents = messages.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = sums.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    found = leaves.select("tree", F.col("node").alias("leaf"), "rank", "node", "depth")
    for k in range(len(levels) - 1, -1, -1):
        higher = found.join(levels[k], ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")
        )
        found = common.cut(found.unionByName(higher), "paths")
    return found


def single(messages: DataFrame) -> DataFrame:
    """One message for each tree and node, without a null tree."""
    row = F.struct("parent", "score", "role", "text")
    found = messages.withColumn("tree", F.coalesce("tree", F.lit(""))).groupBy("tree", "node").agg(F.min(row).alias("row"))
    return found.select("tree", "node", "row.*")


def transcripts(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """From tree, node, parent, score, role, text: tree, leaf, rank, transcript, loss_spans.

    unique: whether no two messages have one tree and node, and none a null tree.
    """
    messages = messages if unique else common.cut(single(messages), "messages")
    chosen = paths(messages.select("tree", "node", "parent", "score"), branches)
    turns = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree",
        "leaf",
        "rank",
        "depth",
        (F.col("role") == LOSS_ROLE).alias("loss"),
        escape(F.col("role"), line=True).alias("role"),
        escape(F.col("text")).alias("body"),
    )
    piece = F.concat(F.lit(MARK), "role", F.lit("\n"), "body", F.lit(END))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("piece", piece).withColumn(
        "start", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0).cast("long"))
    )
    body_at = F.col("start") + F.lit(len(MARK) + 1).cast("long") + F.char_length("role")
    turn = F.struct(
        "depth", "piece", body_at.alias("start"), F.char_length("body").cast("long").alias("length"), "loss"
    )
    rows = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "tree",
        "leaf",
        "rank",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("transcript"),
        F.transform(
            F.filter("turns", lambda t: F.coalesce(t["loss"], F.lit(False))),
            lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
        ).alias("loss_spans"),
    )


def conversations(rows: DataFrame) -> DataFrame:
    """The messages of conv_id, turn, role, text rows: each replies to the one before
    it by turn (ties by role and text), and counts one point of score."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(1.0).alias("score"),
        "role",
        "text",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What transcripts say: conv_id, counts and digests of their turns and loss text."""
    pieces = F.split("transcript", END, -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    head = lambda piece: F.substring_index(piece, "\n", 1)
    role = lambda piece: unescape(F.substr(head(piece), F.lit(len(MARK) + 1)), line=True)
    body = lambda piece: unescape(F.substr(piece, F.char_length(head(piece)) + 2))
    whole = F.transform(turns, lambda p: F.concat(role(p), F.lit("\n"), body(p), F.lit("\n")))
    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr(F.col("transcript"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    read = formatted.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(whole, "").cast("binary"), 256).alias("turns_sha256"),
        F.array_join(loss, "").alias("loss_text"),
        F.char_length("transcript").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
