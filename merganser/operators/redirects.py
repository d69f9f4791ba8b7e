"""Resolving redirects: chains end at their last survivor; forks and cycles are reported, not guessed at.

A redirect has rows (dup_id, primary_id). If a survivor is itself merged away, what pointed to it follows. This is done by pointer
jumping: in each round every pointer moves to where its target points, so a chain of n takes about log2(n) rounds, each
one join on ids. A pointer is finished when it names something that goes nowhere; when a round finishes none, the rest never
will: they are in cycles, or lead into one.

Outcomes: ``ok``; ``fork``: the duplicate has several survivors, of which the least id counts; ``cycle``: no survivor (null). Rows with a null id,
and those that name themselves, are no redirects and are left out. Repeated rows count once. A fork leads where its least
survivor leads, and ``cycle`` goes before ``fork``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.operators.lineage import cut


def resolve(redirect: DataFrame) -> tuple[DataFrame, int]:
    """((dup_id, primary_id, hops, outcome), rounds): hops is the length of the way, null for cycles."""
    links = redirect.filter("dup_id is not null and primary_id is not null and dup_id <> primary_id").select("dup_id", "primary_id").distinct()
    first = links.groupBy("dup_id").agg(F.min("primary_id").alias("at"), (F.count("*") > 1).alias("fork"))
    ends = first.select(F.col("dup_id").alias("goes"), F.lit(True).alias("on"))
    now = first.join(ends, F.col("at") == F.col("goes"), "left").select("dup_id", "at", F.lit(1).cast("long").alias("hops"), "fork", F.col("on").isNull().alias("done"))
    now, rounds = cut(now), 0
    waiting = now.filter("not done").count()
    while waiting:
        to = now.select(F.col("dup_id").alias("via"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("done").alias("ended"))
        moved = now.filter("not done").join(to, F.col("at") == F.col("via")).select("dup_id", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), "fork", F.col("ended").alias("done"))
        now, rounds = cut(now.filter("done").unionByName(moved)), rounds + 1
        left = now.filter("not done").count()
        if left == waiting:
            break
        waiting = left
    outcome = F.when(~F.col("done"), "cycle").when(F.col("fork"), "fork").otherwise("ok")
    return now.select("dup_id", F.when(F.col("done"), F.col("at")).alias("primary_id"), F.when(F.col("done"), F.col("hops")).alias("hops"), outcome.alias("outcome")), rounds


def usable(redirect: DataFrame) -> DataFrame:
    """(dup_id, primary_id): the redirect that merges can take, each duplicate once and straight to its last survivor."""
    return resolve(redirect)[0].filter("outcome <> 'cycle'").select("dup_id", "primary_id")
