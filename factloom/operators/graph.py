"""Bounded walks over typed edges, as rounds of joins; depth-first order where a query needs it."""

from __future__ import annotations

import uuid
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.model import EDGE_KINDS
from factloom.session import shared_folder

MAX_DEPTH = 20
MAX_VISITS = 10_000


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder by columns and read again: for what is read often, and of few columns each time."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides by their keys.

    What is made from a table is larger than the table, and Spark's guess of its size, which goes by the table, would send
    such a side whole through the driver.
    """
    return df.hint("merge")


def masked(edges: DataFrame, mask: int) -> DataFrame:
    """Edges (src, dst, kind, ord) whose kind bit is in the mask."""
    return edges.where(F.col("kind").bitwiseAND(mask) != 0)


def inverted(edges: DataFrame) -> DataFrame:
    """Inherits edges with the inverse kind beside them."""
    back = edges.where(F.col("kind") == EDGE_KINDS["inherits"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(EDGE_KINDS["inherits_inv"]).alias("kind"), "ord")
    return edges.unionByName(back)


def neighbours(inherits: DataFrame) -> DataFrame:
    """name, direction (supertype, subtype), type: what is one step above and below each class."""
    up = inherits.select(F.col("src").alias("name"), F.lit("supertype").alias("direction"), F.col("dst").alias("type"))
    return up.unionByName(inherits.select(F.col("dst").alias("name"), F.lit("subtype").alias("direction"), F.col("src").alias("type"))).distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, include_self: bool = False) -> DataFrame:
    """origin, node, depth (fewest steps), truncated: everything within max_depth steps of each seed (origin).

    A node at max_depth is returned and not expanded; truncated tells that it had somewhere to go. Each round joins only
    the newest nodes, and only nodes not reached before go on.
    """
    steps = edges.select("src", "dst").distinct()
    reached = cut(seeds.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = reached
    for depth in range(1, max_depth + 1):
        new = frontier.join(dealt(steps), frontier["node"] == steps["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(dealt(reached), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    goes_on = steps.select(F.col("src").alias("node")).distinct().withColumn("more", F.lit(True))
    out = reached.join(dealt(goes_on), "node", "left").select("origin", "node", "depth", (F.coalesce("more", F.lit(False)) & (F.col("depth") == max_depth)).alias("truncated"))
    return out if include_self else out.where("depth > 0")


def depth_first(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, max_visits: int = MAX_VISITS, prune: tuple[str, ...] = ()) -> DataFrame:
    """origin, node, rank: visiting order of a left-to-right depth-first walk from each seed.

    The children of a visited node are marked when they are put on the stack, so a node is visited from the first parent
    that was visited. The edges each origin can reach come from the closure; a walk holds max_visits nodes at most.
    Nodes in prune are visited and not expanded.
    """
    near = closure(edges, seeds, max_depth, include_self=True).select("origin", "node")
    own = near.join(edges.select("src", "dst", "ord"), F.col("node") == F.col("src")).select("origin", "src", "dst", "ord")
    own = seeds.select("origin").distinct().join(own, "origin")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        origin = group["origin"].iloc[0]
        children: dict = {}
        for s, t, _ in sorted(group[["src", "dst", "ord"]].dropna().itertuples(index=False, name=None), key=lambda e: (str(e[0]), e[2])):
            children.setdefault(s, []).append(t)
        seen, stack, order = {origin}, [(origin, 0)], []
        while stack and len(order) <= max_visits:
            node, depth = stack.pop()
            if depth:
                order.append(node)
            if depth < max_depth and node not in prune:
                fresh = [c for c in dict.fromkeys(children.get(node, [])) if c not in seen]
                seen.update(fresh)
                stack += [(c, depth + 1) for c in reversed(fresh)]
        order = order[:max_visits]
        return pd.DataFrame({"origin": [origin] * len(order), "node": order, "rank": range(1, len(order) + 1)}, dtype=object)

    kind = dict(edges.dtypes)["src"]
    return own.groupBy("origin").applyInPandas(walk, f"origin {kind}, node {kind}, rank int")


def resolve_chains(links: DataFrame, rounds: int = 8) -> DataFrame:
    """links (src, dst), one per src, to (src, terminal, hops): pointer jumping doubles the reach of each round.

    Chains that end in a cycle, or are longer than 2**rounds, have no terminal.
    """
    at = cut(links.select("src", F.col("dst").alias("to"), F.lit(1).alias("hops")))
    for _ in range(rounds):
        nxt = at.select(F.col("src").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"))
        moved = at.join(nxt, "to", "left")
        at = cut(moved.select("src", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    open_ = at.join(links.select(F.col("src").alias("to")), "to", "left_semi").select("src").withColumn("open", F.lit(True))
    return at.join(open_, "src", "left").select("src", F.when(F.col("open").isNull(), F.col("to")).alias("terminal"), "hops")


def methods_in_order(order: DataFrame, methods: DataFrame) -> DataFrame:
    """origin, method, owner: for each method name the first class of the order (origin, node, rank) that has it (node, method)."""
    return order.join(methods, "node").groupBy("origin", "method").agg(F.min_by("node", "rank").alias("owner"))


def override_family(inherits: DataFrame, methods: DataFrame, targets: DataFrame) -> DataFrame:
    """origin, member: classes above and below each target (origin, method) that define its method, itself included."""
    seeds = targets.select("origin").distinct()
    up, down = closure(inherits, seeds, include_self=True), closure(inherits.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)
    line = up.select("origin", "node").unionByName(down.select("origin", "node")).distinct()
    return line.join(targets, "origin").join(methods, ["node", "method"], "left_semi").select("origin", F.col("node").alias("member"))


def dispatch_participants(inherits: DataFrame, seeds: DataFrame) -> DataFrame:
    """origin, node: descendants of each seed and all their ancestors."""
    down = closure(inherits.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, include_self=True)
    up = closure(inherits, down.select(F.col("node").alias("origin")).distinct(), include_self=True).select(F.col("origin").alias("via"), F.col("node").alias("above"))
    return down.join(up, F.col("node") == F.col("via")).select("origin", F.col("above").alias("node")).distinct()


def implementations(inherits: DataFrame, methods: DataFrame, targets: DataFrame) -> DataFrame:
    """origin, member: participants that define the target's method, without the target's own line of ancestors."""
    seeds = targets.select("origin").distinct()
    contract = closure(inherits, seeds, include_self=True).select("origin", "node")
    found = dispatch_participants(inherits, seeds).join(contract, ["origin", "node"], "left_anti")
    return found.join(targets, "origin").join(methods, ["node", "method"], "left_semi").select("origin", F.col("node").alias("member")).distinct()


def dirty_closure(provides: DataFrame, consumes: DataFrame, changed: DataFrame) -> DataFrame:
    """file: every consumer, however far, of names that the changed files (file) provide: (file, name) in both relations."""
    steps = provides.join(consumes.select(F.col("file").alias("dst"), "name"), "name").where("file <> dst").select(F.col("file").alias("src"), "dst").distinct()
    # one walk for the whole set: all changed files start together; each round finds new files or is the last
    reached = cut(changed.select("file").distinct())
    frontier = reached
    for depth in count(1):
        new = frontier.join(steps, F.col("file") == F.col("src")).select(F.col("dst").alias("file")).distinct()
        frontier = cut(new.join(reached, "file", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % MAX_DEPTH == 0:  # keeps the plan of a long walk short
            reached = cut(reached)
    return reached.join(changed, "file", "left_anti")


def unresolved(inherits: DataFrame, seeds: DataFrame, known: DataFrame) -> DataFrame:
    """origin, closed, truncated: whether every ancestor of a seed is a known class (node), and whether the walk was cut."""
    up = closure(inherits, seeds).join(known.select("node").withColumn("ok", F.lit(True)), "node", "left")
    found = up.groupBy("origin").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("closed"), F.bool_or("truncated").alias("truncated"))
    return seeds.select("origin").distinct().join(found, "origin", "left").select("origin", F.coalesce("closed", F.lit(True)).alias("closed"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
