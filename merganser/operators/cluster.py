"""Groups of duplicates: the earliest entity that is not yet taken leads a group and takes every later match of its own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.operators import match
from merganser.operators.components import components
from merganser.operators.lineage import cut


def _round(edges: DataFrame, state: DataFrame) -> DataFrame:
    """The state after one round: who waits for nobody earlier leads, or joins the earliest leader that it matches."""
    labelled = edges.join(state.select(F.col("ord").alias("ord_a"), F.col("leader").alias("of")), "ord_a")
    seen = labelled.groupBy("ord_b").agg(
        F.min(F.when(F.col("of") == F.col("ord_a"), F.col("ord_a"))).alias("joins"),
        F.min(F.when(F.col("of").isNull(), F.col("ord_a"))).alias("waits"),
    )
    now = state.join(seen.withColumnRenamed("ord_b", "ord"), "ord", "left")
    # a leader that may still turn up earlier than the one found has to be waited for
    settled = F.when(F.col("waits").isNotNull() & (F.col("joins").isNull() | (F.col("waits") < F.col("joins"))), None).otherwise(F.coalesce("joins", "ord"))
    return now.select("ord", F.coalesce("leader", settled).alias("leader"))


def _remaining(edges: DataFrame, state: DataFrame) -> DataFrame:
    """What is decided asks no more, and what was taken answers no more."""
    open_ = state.filter("leader is null").select(F.col("ord").alias("ord_b"))
    taken = state.filter("leader <> ord").select(F.col("ord").alias("ord_a"))
    return edges.join(open_, "ord_b", "left_semi").join(taken, "ord_a", "left_anti")


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule within one component. rows: ord, ord_a (an earlier match), leads (whether that is known to lead)."""
    rows = rows.sort_values("ord", kind="stable")
    found: dict[int, int] = {}
    for own, earlier, leads in zip(rows["ord"].tolist(), rows["ord_a"].tolist(), rows["leads"].tolist(), strict=True):
        best = found.get(own, own)  # itself, as long as nobody earlier leads it
        found[own] = min(best, earlier) if leads or found.get(earlier) == earlier else best
    return pd.DataFrame({"ord": list(found), "leader": list(found.values())}, dtype="int64")


def _in_components(edges: DataFrame, state: DataFrame, bound: int) -> DataFrame:
    """The state with everything decided that is in a component, of those who wait for each other, of at most ``bound`` edges."""
    known = edges.join(state.select(F.col("ord").alias("ord_a"), F.col("leader").isNotNull().alias("leads")), "ord_a")
    known = cut(known.select("ord_a", "ord_b", "leads"))
    roots = components(known.filter("not leads").select(F.col("ord_b").alias("a"), F.col("ord_a").alias("b")))
    waiting = state.filter("leader is null").join(roots, F.col("ord") == F.col("node"), "left").select("ord", F.coalesce("root", "ord").alias("root"))
    rows = waiting.join(known, F.col("ord") == F.col("ord_b"), "left").select("root", "ord", F.coalesce("ord_a", "ord").alias("ord_a"), F.coalesce("leads", F.lit(False)).alias("leads"))
    rows = cut(rows.withColumns({c: F.col(c).cast("long") for c in ("root", "ord", "ord_a")}))
    small = rows.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") <= bound)
    decided = rows.join(small, "root", "left_semi").select("root", "ord", "ord_a", "leads").groupBy("root").applyInPandas(lambda g: _in_order(g), "ord long, leader long")
    return state.join(decided.withColumnRenamed("leader", "found"), "ord", "left").select("ord", F.coalesce("leader", "found").alias("leader"))


def leaders(pairs: DataFrame, rounds: int = 8, bound: int = 1_000_000) -> DataFrame:
    """(ord, leader): every entity that has a pair, with the one that leads its group; leaders lead themselves.

    An entity without an earlier undecided match leads, unless an earlier leader matches it; it then joins the earliest such
    leader. That is decided in ``rounds`` of joins, after which only long chains of entities that wait for each other are
    left. These go by connected components: one of at most ``bound`` edges is gone through in order by one task, a larger one goes on
    in rounds. The result equals that of going through all entities one by one.
    """
    edges = cut(pairs.select("ord_a", "ord_b").distinct())
    nodes = edges.select(F.col("ord_a").alias("ord")).unionByName(edges.select(F.col("ord_b").alias("ord"))).distinct()
    state, done = cut(nodes.withColumn("leader", F.lit(None).cast("long"))), 0
    while state.filter("leader is null").limit(1).count():
        state = cut(_in_components(edges, state, bound) if done == rounds else _round(edges, state))
        edges, done = cut(_remaining(edges, state)), done + 1
    return state


def group_entities(entities: DataFrame, entity_id: str = "entity_id", ord_col: str = "ord", title: str = "title", aliases: dict[str, str] | None = None) -> DataFrame:
    """What group_duplicates gives for all pairs of these entities, without making pairs of entities.

    Entities of one parsed name match each other and have the same neighbours, so whoever takes the earliest of them takes
    all: names are grouped, each with its least ``ord`` (no two entities share one), and entities join them once.
    """
    who, pairs = match.name_matches(entities, entity_id, ord_col, title, aliases)
    who = cut(who)
    heads = cut(who.groupBy("name").agg(F.min("ord").alias("head")))
    ha, hb = (heads.select(F.col("name").alias(x), F.col("head").alias(f"ord_{x}")) for x in "ab")
    near = cut(pairs.filter("a <> b").join(ha, "a").join(hb, "b").filter("ord_a < ord_b").select("ord_a", "ord_b", "certainty", "scenario"))
    led = leaders(near).withColumnRenamed("ord", "head")
    named = heads.join(led, "head", "left").select("name", "head", F.coalesce("leader", "head").alias("group_ord"))
    members = who.join(named, "name").select("group_ord", F.col("id").alias("entity_id"), "ord", "head")
    # pairs of the leader: with the first of each name that it took, and with the next of its own name
    taken = near.join(led.select(F.col("head").alias("ord_b"), "leader"), "ord_b").filter(F.col("leader") == F.col("ord_a")).select(F.col("ord_a").alias("group_ord"), "ord_b", "certainty", "scenario")
    same = members.filter("head = group_ord and ord > group_ord").groupBy("group_ord").agg(F.min("ord").alias("ord_b")).select("group_ord", "ord_b", F.lit(100).alias("certainty"), F.lit("exact").alias("scenario"))
    best = taken.unionByName(same).groupBy("group_ord").agg(F.max("certainty").alias("certainty"), F.max_by("scenario", F.struct("certainty", (-F.col("ord_b")).alias("o"))).alias("scenario"))
    return members.join(best, "group_ord").select("group_ord", "entity_id", "ord", "certainty", "scenario")


def group_titles(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_ord, name): a group is called as its first entity is."""
    seeds = groups.filter("ord = group_ord").select("group_ord", "entity_id")
    return seeds.join(entities.select("entity_id", F.col("title").alias("name")), "entity_id").select("group_ord", "name")


def group_duplicates(pairs: DataFrame) -> DataFrame:
    """(group_ord, entity_id, ord, certainty, scenario): members of groups of two and more, with the group's best pair.

    The group's certainty is the highest of its leader's pairs, its scenario that of the first of these.
    """
    pairs = cut(pairs)
    led = leaders(pairs)
    members = pairs.join(led.withColumnRenamed("ord", "ord_b"), "ord_b").filter(F.col("leader") == F.col("ord_a"))
    best = members.groupBy(F.col("ord_a").alias("group_ord")).agg(F.max("certainty").alias("certainty"), F.max_by("scenario", F.struct("certainty", (-F.col("ord_b")).alias("o"))).alias("scenario"))
    first = members.select(F.col("ord_a").alias("group_ord"), F.col("id_a").alias("entity_id"), F.col("ord_a").alias("ord")).distinct()
    rest = members.select(F.col("ord_a").alias("group_ord"), F.col("id_b").alias("entity_id"), F.col("ord_b").alias("ord"))
    return first.unionByName(rest).join(best, "group_ord")
