"""Format reply trees as conversations, with DataFrame functions only.

A tree is a set of turns, each with the turn it answers.  Its branches run from
a root to a leaf.  Self-joins find them by doubling: round k joins every turn
with the turn 2^k answers above it, so a chain of a million turns needs twenty
rounds.  Branches are ranked by the sum of their scores; the best ones of each
tree are written out, one conversation per branch.

The text form of a conversation is ``<s>`` followed by ``[INST]role[/INST]text</s>``
per turn.  These four marks never stand inside a role or a text: a backslash goes
between the first and the second character of a mark, or of a mark that is
already escaped so; taking one backslash away again gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import stored

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_MARK = r"([<\[])(\\*(?:/?s>|/?INST\]))"
_ESCAPED = r"([<\[])\\(\\*(?:/?s>|/?INST\]))"
TURN = r"(?s)\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def chains(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of plain conversations as trees: every row answers the one before it.

    Gives ``tree, node, parent, role, text, score``; nulls in role and text become
    empty, rows of one turn stand in the order of role and text, a null turn comes
    first.  The rows of one conversation meet in one task, as they meet in one
    formatted text anyway.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (
        rows.select(
            F.col(conv).alias("tree"),
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
        .withColumn("node", F.row_number().over(order).cast("long"))
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .select("tree", "node", "parent", "role", "text", F.lit(0.0).alias("score"))
    )


def branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """The ``best`` branches of each tree: ``tree, leaf, rank, node, depth`` (depth 1 is the root).

    ``nodes`` has ``tree, node, parent, score``; ``(tree, node)`` is unique and ``tree``
    may be null.  A turn whose parent is missing is a root.  A null score counts 0.
    Branches rank by score, then by smaller leaf; ``None`` keeps all.  Turns on a cycle
    hang on no root and belong to no branch.
    """
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = links.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    here = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    first = stored(
        links.join(known, here, "left").select(
            "tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), "score"
        ),
        "links",
    )
    jumps, longest = [first], first.groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    open_turns, done = first.where(F.col("up").isNotNull()), first.where(F.col("up").isNull())
    while open_turns.take(1):
        if 1 << (len(jumps) - 1) > longest:
            break  # whatever still has a turn above it lies on a cycle or answers one
        # From here on up, depth and score cover twice as many turns; up is null once the root is covered.
        above = open_turns.unionByName(done).select(
            F.col("tree").alias("t"),
            F.col("node").alias("n"),
            F.col("up").alias("next"),
            F.col("depth").alias("more"),
            F.col("score").alias("extra"),
        )
        joined = open_turns.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        longer = stored(
            joined.select(
                "tree",
                "node",
                F.col("next").alias("up"),
                (F.col("depth") + F.col("more")).alias("depth"),
                (F.col("score") + F.col("extra")).alias("score"),
            ),
            "links",
        )
        jumps.append(longer)
        open_turns = longer.where(F.col("up").isNotNull())
        done = done.unionByName(longer.where(F.col("up").isNull()))
    rooted = done
    parents = first.where(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = rooted.join(
        parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti"
    ).select("tree", F.col("node").alias("leaf"), "depth", F.col("score").alias("total"))
    ranked = leaves.withColumn(
        "rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    )
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    path = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), "depth")
    for jump in reversed(jumps):
        # Every turn found so far also names the one 2^k above it: all sums of powers, each once.
        step = jump.where(F.col("up").isNotNull()).select(
            F.col("tree").alias("t"), F.col("node").alias("n"), "up", F.col("depth").alias("span")
        )
        found = path.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        path = path.unionByName(
            found.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - F.col("span")).alias("depth"))
        )
        path = stored(path, "paths")
    return path


def format_branches(nodes: DataFrame, best: int | None = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen branch: ``tree, leaf, rank, formatted, loss_spans``.

    ``loss_spans`` marks the texts of the ``trained`` roles as pairs ``start, length``
    in code points of ``formatted``, in order.  Empty texts have a span of length 0.
    No turns give no rows.
    """
    turns = nodes.select(
        F.col("tree").alias("t"),
        F.col("node").alias("n"),
        "role",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    whole = branches(nodes, best).join(
        turns, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    )
    head, body = F.char_length("head"), F.char_length("body")
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.select(
        "tree",
        "leaf",
        "rank",
        "depth",
        F.concat("head", "body", F.lit(END)).alias("turn"),
        F.col("role").isin(list(trained)).alias("trained"),
        (
            F.coalesce(F.sum(head + body + len(END)).over(before), F.lit(0)) + len(BEGIN) + head
        ).cast("long").alias("start"),
        body.cast("long").alias("length"),
    )
    grouped = placed.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "turn", "trained", "start", "length"))).alias("turns")
    )
    spans = F.transform(
        F.filter("turns", lambda t: t["trained"]),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
    )
    return grouped.select(
        "tree",
        "leaf",
        "rank",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["turn"]), "")).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts read back from a formatted conversation, as an array of ``role, text``."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(
        roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text"))
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(
        spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
