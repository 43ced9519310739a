"""Certificates that the ancestry of a class was seen in full, kept as rows and struck out when a provider moves.

A certificate lists every name of an ancestry with the seal of that name's provider set: how many providers there are, and
the sum of their hashes, which needs no order, no list and no single task for a name that many files provide. It is checked
against what has changed since: names that no change touches aren't read again, and a provider that arrives, leaves or moves
breaks the seal of its name and with it each certificate that lists it. Where anything can't be vouched for there is no
certificate, with the reason.

providers: name, path, fingerprint (null: not vouched for); repeated rows count once. A name without providers has the seal of
the empty set, so that a first provider breaks it. Null names and classes are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.graph import MAX_DEPTH, closure, cut

#: More names than this are declined, as checking them would cost more than it saves.
MOST_NAMES = 64


def seals(providers: DataFrame) -> DataFrame:
    """name, n, seal, vouched: the provider set of each name."""
    one = providers.where("name is not null").select("name", "path", "fingerprint").distinct()
    return one.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "fingerprint").cast("decimal(38,0)")).alias("seal"), F.bool_and(F.col("fingerprint").isNotNull()).alias("vouched"))


def mint(classes: DataFrame, inherits: DataFrame, providers: DataFrame, bridged: DataFrame, most: int = MOST_NAMES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Certificates (origin, name, n, seal) of classes (origin), and those declined (origin, reason).

    bridged (name): classes to which a plugin adds members that no file declares.
    """
    near = cut(closure(inherits, classes.where("origin is not null"), max_depth, include_self=True).select("origin", F.col("node").alias("name"), "truncated"))
    wanted = near.select("name").distinct()
    sealed = seals(providers.join(wanted, "name", "left_semi")).join(wanted, "name", "right")
    marks = sealed.join(bridged.select("name").distinct().withColumn("bridged", F.lit(True)), "name", "left")
    marks = marks.select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seal", F.lit(0).cast("decimal(38,0)")).alias("seal"), F.coalesce("vouched", F.lit(True)).alias("vouched"), F.coalesce("bridged", F.lit(False)).alias("bridged"))
    rows = near.join(marks, "name")
    reason = F.when(F.count("*") > most, "wide").when(F.bool_or("truncated"), "deep").when(F.bool_or("bridged"), "bridged").when(~F.bool_and("vouched"), "unvouched")
    judged = cut(rows.groupBy("origin").agg(reason.alias("reason")))
    certificates = rows.select("origin", "name", "n", "seal").join(judged.where("reason is null"), "origin", "left_semi")
    return cut(certificates), judged.where("reason is not null")


def broken(certificates: DataFrame, touched: DataFrame, providers: DataFrame, bridged: DataFrame) -> DataFrame:
    """origin: the certificates that list a touched name (name) whose provider set is not what was sealed."""
    listed = cut(certificates.select("name", "n", "seal").distinct().join(touched.select("name").distinct(), "name", "left_semi"))
    now = seals(providers.join(listed.select("name").distinct(), "name", "left_semi")).where("vouched").select("name", F.col("n").alias("n_now"), F.col("seal").alias("seal_now"))
    both = listed.join(now, "name", "left").join(bridged.select("name").distinct().withColumn("bridged", F.lit(True)), "name", "left")
    empty = F.lit(0).cast("decimal(38,0)")
    same = (F.col("n") == F.coalesce("n_now", F.lit(0))) & (F.col("seal") == F.coalesce("seal_now", empty)) & F.col("bridged").isNull()
    return certificates.join(both.where(~same).select("name", "n", "seal"), ["name", "n", "seal"], "left_semi").select("origin").distinct()


def consult(classes: DataFrame, certificates: DataFrame, touched: DataFrame, inherits: DataFrame, providers: DataFrame, bridged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, state) of classes (origin): kept, minted (anew) or the reason why there is no certificate; and all certificates that hold now.

    Only classes without a certificate that holds are walked.
    """
    fallen = cut(broken(certificates, touched, providers, bridged))
    kept = certificates.join(fallen, "origin", "left_anti")
    holds = kept.select("origin").distinct()
    asked = classes.where("origin is not null").select("origin").distinct()
    fresh, declined = mint(asked.join(holds, "origin", "left_anti"), inherits, providers, bridged)
    state = asked.join(holds, "origin", "left_semi").select("origin", F.lit("kept").alias("state"))
    state = state.unionByName(fresh.select("origin").distinct().select("origin", F.lit("minted").alias("state"))).unionByName(declined.select("origin", F.col("reason").alias("state")))
    return state, kept.unionByName(fresh)
