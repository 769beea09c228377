"""Chat formatting of reply trees: iterative self-joins list root-to-leaf paths, the best branches become conversations.

Messages are (tree, node, parent, role, text, score). Ancestors are found by doubling: in round k a path is extended
by the ancestors at distances 2**k and more, so a path of n messages takes log2(n) self-joins. A branch's score is the
sum over its messages; ``branches`` of each tree are formatted, best first, ties by leaf. DataFrame functions only.

The template is ``<|turn|>role<|text|>text<|end|>\\n`` for each turn. In roles and texts a backslash is doubled and
each control string gets a backslash after its first character, so no text can hold a marker and unescaping (drop a
backslash, keep what follows) restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialise, small

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Messages of a tree beyond which its texts are first reduced to those of the chosen branches.
LARGE_TREE = 10_000
#: Control strings of this and of other templates; "<|" covers all of this one's markers.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, pos, branch, branch_score): the messages of the chosen branches, pos 0 at the root.

    ``messages``: tree, node, parent, score; a node occurs once in its tree. A parent that isn't in its tree makes its
    reply a root. Messages on a cycle reach no root and belong to no path; so do those of a null tree or node.
    An empty table has no paths.
    """
    nodes = materialise(messages.select("tree", "node", "parent", "score"), "chat-nodes")
    jump = nodes.where("parent IS NOT NULL AND parent <> node").select("tree", "node", F.col("parent").alias("up")).join(nodes.select("tree", F.col("node").alias("up")), ["tree", "up"]).select("tree", "node", "up")
    jump = materialise(jump, "chat-jump")
    written = [nodes, jump]
    roots = nodes.join(jump, ["tree", "node"], "left_anti").select("tree", "node")
    has_reply = jump.select("tree", F.col("up").alias("node")).distinct()
    reach = nodes.join(has_reply, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_by"))
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < largest and not jump.isEmpty():
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("up_by") + step).alias("up_by"))
        reach = materialise(reach.unionAll(further), "chat-reach")
        jump = materialise(jump.alias("x").join(jump.alias("y"), (F.col("x.tree") == F.col("y.tree")) & (F.col("x.up") == F.col("y.node"))).select("x.tree", "x.node", "y.up"), "chat-jump")
        written += [reach, jump]
        step *= 2
    ended = reach.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf", F.col("up_by").alias("depth"))
    scored = reach.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    best = Window.partitionBy("tree").orderBy(F.desc_nulls_last("branch_score"), "leaf")
    chosen = ended.join(scored, ["tree", "leaf"]).withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    out = reach.join(chosen, ["tree", "leaf"]).where("up_by <= depth").select("tree", "leaf", "node", (F.col("depth") - F.col("up_by")).alias("pos"), "branch", "branch_score")
    out = materialise(out, "chat-paths")
    discard(*written)
    return out


def _formatted(links: DataFrame, texts: DataFrame, branches: int, loss_role: str) -> DataFrame:
    """``links``: key, node, parent, score, ref; ``texts``: key, ref, role, text. Texts are shuffled once, by key.

    The texts and the places of the chosen branches meet as one union, so that windows by ref and by leaf and the
    grouping all find their rows where the one shuffle has put them.
    """
    placed = paths(links.withColumnRenamed("key", "tree"), branches).withColumnRenamed("tree", "key").join(links.select("key", "node", "ref"), ["key", "node"])
    placed = materialise(placed, "chat-placed")
    big = links.groupBy("key").count().where(F.col("count") > LARGE_TREE).select("key")
    big = materialise(big, "chat-large")
    if big.count():  # of a large tree only the texts of the chosen branches go where these are put together
        in_big = texts.join(small(big), "key", "left_semi").join(placed.select("key", "ref").distinct(), ["key", "ref"], "left_semi")
        texts = texts.join(small(big), "key", "left_anti").unionByName(in_big)
    either = texts.select("key", "ref", "role", "text").unionByName(placed.select("key", "ref", "leaf", "branch", "branch_score", "pos"), allowMissingColumns=True).repartition("key")
    same = Window.partitionBy("key", "ref")
    turn = either.withColumn("said", F.first(F.when(F.col("text").isNotNull(), F.struct("role", "text")), ignorenulls=True).over(same)).where("pos IS NOT NULL")
    head, body = F.concat(F.lit(TURN), escape(F.col("said.role")), F.lit(TEXT)), escape(F.col("said.text"))
    pieces = turn.select("key", "leaf", "branch", "branch_score", "pos", (F.col("said.role") == loss_role).alias("loss"), F.length(head).alias("h"), F.length(body).alias("b"), F.concat(head, body, F.lit(END)).alias("piece"))
    before = Window.partitionBy("key", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = pieces.withColumn("start", F.sum(F.length("piece").cast("long")).over(before) - F.length("piece") + F.col("h")).withColumn("end", F.col("start") + F.col("b"))
    turns = F.array_sort(F.collect_list(F.struct("pos", "piece", "start", "end", "loss")))
    grouped = spans.groupBy("key", "leaf", "branch", "branch_score").agg(turns.alias("turns"))
    return grouped.select(F.col("key.tree").alias("tree"), "leaf", "branch", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"))


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, leaf, branch, branch_score, n_turns, formatted, loss_spans.

    ``messages``: tree, node, parent (null at a root), role, text, score; other columns aren't read, whatever their
    names. Null roles and texts count as empty, null scores as nothing; messages of a null tree are one tree. Rows
    with a null node are left out. Of rows that repeat a node of a tree the least by parent, score and text hash
    counts. Equal branch scores rank by leaf. loss_spans: (start, end) in code points of ``formatted``, the texts of
    ``loss_role`` in order. Texts of any length are whole; one conversation is one row and must fit in a task. An
    empty table gives an empty result.
    """
    said = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = messages.where("node IS NOT NULL").select(F.struct("tree").alias("key"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"), F.struct("node", said.alias("h")).alias("ref"))
    links = rows.groupBy("key", "node").agg(F.min(F.struct("parent", "score", "ref")).alias("m")).select("key", "node", "m.parent", "m.score", "m.ref")
    return _formatted(materialise(links, "chat-links"), rows.select("key", "ref", "role", "text"), branches, loss_role)


def format_turns(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``format_trees(from_turns(rows))`` for linear conversations; only what orders the turns is shuffled with them.

    ``rows``: conv_id, turn, role, text. Null ids are one conversation, null turns come first, null roles and texts
    are empty; other columns aren't read. Rows of one turn and role are in the order of their texts, and repeated rows
    each are a turn. An empty table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = rows.select(F.struct(F.col("conv_id").alias("tree")).alias("key"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(text).alias("h"))
    place = F.struct("key", "turn", "role")
    narrow = materialise(said.select("key", "turn", "role", "h", F.length("text").cast("double").alias("score")), "chat-order")
    tied = narrow.groupBy(place.alias("place")).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("place")
    tied = materialise(tied, "chat-tied")
    ordered = narrow.withColumn("rank", F.lit(0))
    if tied.count():
        texts = said.select(place.alias("place"), "h", "text").join(small(tied), "place", "left_semi").distinct()
        ranks = texts.select("place", "h", F.row_number().over(Window.partitionBy("place").orderBy("text")).alias("r"))
        ordered = narrow.withColumn("place", place).join(ranks, ["place", "h"], "left").select(*narrow.columns, F.coalesce("r", F.lit(0)).alias("rank"))
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "rank")).cast("long")
    links = ordered.select("key", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "score", F.struct("turn", "role", "h").alias("ref"))
    return _formatted(materialise(links, "chat-links"), said.select("key", F.struct("turn", "role", "h").alias("ref"), "role", "text"), 1, loss_role)


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    text = lambda p: F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p) - F.instr(p, TEXT) - len(TEXT) + 1 - len(END))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(text(p)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, one after the other."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each replies to the one before.

    Turns are ordered by turn, then role and text, so ties and repeated rows have a place of their own. An empty table
    has no messages.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    n = F.row_number().over(order).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).alias("score"))
