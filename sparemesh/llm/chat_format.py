"""Chat formatting: the best branch of each reply tree as one training conversation, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    """Reversible: afterwards no ``#`` and no ``<`` is left, so a control string cannot occur inside a text."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Each backslash belongs to one letter, so undoing the letters in turn, the backslash itself last, is exact."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(":")))


def chain(turns: DataFrame, tree: str, *order: str) -> DataFrame:
    """A linear conversation as a tree: ``node`` (1, 2, ... in the given order), ``parent`` (null for the first)."""
    from pyspark.sql import Window

    rows = turns.withColumn("node", F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def best_paths(nodes: DataFrame, tree: str, score: str | None) -> DataFrame:
    """(tree, leaf, node, depth) of the nodes on each tree's best branch.

    Self-joins by doubling: after round k each node knows its ancestor 2^k steps up and the score and number of
    turns in between, so a chain of n turns takes log2(n) rounds. Leaves are ranked by the mean score of their
    branch, then by its length, then by the smaller leaf id. The chosen leaf's ancestors are read back by the
    same jumps, largest first.
    """
    n = nodes.select(F.col(tree).alias("tree"), "node", "parent", (F.coalesce(F.col(score), F.lit(0.0)) if score else F.lit(0.0)).cast("double").alias("score"))
    n = n.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = n.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    # a parent that is not there makes a root
    n = n.join(known, n["tree"].eqNullSafe(known["t2"]) & (n["parent"] == known["n2"]), "left")
    jump = stored(n.select("tree", "node", F.col("n2").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")), "jump-0")
    parents = jump.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = jump.select("tree", "node").join(parents, jump["tree"].eqNullSafe(parents["tree"]) & (jump["node"] == parents["node"]), "left_anti")
    # a node that has reached its root is not joined or written again
    jumps, complete = [jump], [jump.where("up IS NULL")]
    # no chain has more turns than there are nodes; only a loop of parents would go on
    n_nodes = jump.count()
    while (1 << len(jumps) - 1) <= n_nodes and jump.where("up IS NOT NULL").limit(1).count():
        still = jump.where("up IS NOT NULL")
        above = reduce(DataFrame.union, complete, still).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("length").alias("length2"))
        joined = still.join(above, still["tree"].eqNullSafe(above["t2"]) & (still["up"] == above["n2"]), "left")
        jump = stored(
            joined.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("length2", F.lit(0))).alias("length")),
            f"jump-{len(jumps)}",
        )
        jumps.append(jump)
        complete.append(jump.where("up IS NULL"))
    complete = reduce(DataFrame.union, complete)
    ranked = complete.join(leaves.select(F.col("tree").alias("t2"), F.col("node").alias("n2")), complete["tree"].eqNullSafe(F.col("t2")) & (complete["node"] == F.col("n2")), "left_semi")
    rank = F.struct((F.col("total") / F.col("length")).alias("mean"), "length", (-F.col("node")).alias("first"))
    best = ranked.groupBy("tree").agg(F.max_by(F.struct("node", "length"), rank).alias("best"))
    path = best.select("tree", F.col("best.node").alias("node"), F.col("best.length").alias("depth"))
    for k in range(len(jumps) - 2, -1, -1):
        step = jumps[k].where("up IS NOT NULL").select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        both = path.join(step, path["tree"].eqNullSafe(step["t2"]) & (path["node"] == step["n2"]), "left")
        here, above = F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        both = both.select("tree", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))).alias("at"))
        path = both.select("tree", "at.node", "at.depth")
    return path


def format_trees(nodes: DataFrame, tree: str, role: str = "role", text: str = "text", score: str | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per tree: ``tree``, ``formatted`` and ``loss`` (spans of code points from 0, [start, end), under the loss mask).

    ``nodes`` has one row per message: ``tree``, ``node`` and ``parent`` (long), role, text and perhaps a score. A turn is
    written as ``### role: text</turn>`` and a line end; ``#``, ``<``, ``:`` (in roles) and backslashes are escaped by
    letters, so ``read_turns`` gives back exactly the roles and texts. Null role or text: empty. Null tree: a tree
    of its own. A missing parent makes a root; a row repeated with the same node id counts once (smallest role and
    text); of several roots or branches the best one is kept. Messages on a loop of parents belong to no tree.
    """
    path = best_paths(nodes, tree, score)
    said = nodes.groupBy(F.col(tree).alias("t2"), F.col("node").alias("n2")).agg(
        F.min(F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))).alias("said")
    )
    turns = path.join(said, path["tree"].eqNullSafe(said["t2"]) & (path["node"] == said["n2"]))
    head = F.concat(F.lit(OPEN), escaped_role(F.col("said.role")), F.lit(": "))
    turns = turns.select("tree", F.struct("depth", head.alias("head"), escaped(F.col("said.text")).alias("body"), (F.col("said.role") == trained_role).alias("trained")).alias("turn"))
    whole = turns.groupBy("tree").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    end = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(
                t["trained"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).cast("long").alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).cast("long").alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return whole.select(F.col("tree").alias(tree), formatted.alias("formatted"), end["spans"].alias("loss"))


def read_turns(formatted: Column | str) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.substring(F.substring_index(p, ":", 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescaped(p.substr(F.length(F.substring_index(p, ":", 1)) + 3, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column | str, loss: Column | str) -> Column:
    """All text under the loss mask, unescaped, in order."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    parts = F.transform(loss, lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")
