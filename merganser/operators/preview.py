"""What a merge would change, before it is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merganser.operators.enrich import valid
from merganser.operators.merge import number


def shown(items: Column) -> Column:
    """Up to three items whole, else two and how many more."""
    return F.when(F.size(items) <= 3, F.array_join(items, ", ")).otherwise(F.concat(F.array_join(F.slice(items, 1, 2), ", "), F.lit(" +"), (F.size(items) - 2).cast("string"), F.lit(" more")))


def preview_counts(participation: DataFrame, redirect: DataFrame) -> DataFrame:
    """(primary_id, current, incoming, result): rows of the primary and of its duplicates; a shared event counts twice."""
    r = redirect.select("dup_id", "primary_id")
    counts = participation.groupBy("entity_id").agg(F.count("*").alias("n"))
    incoming = r.join(counts, F.col("dup_id") == F.col("entity_id"), "left").groupBy("primary_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("incoming"))
    out = incoming.join(counts, F.col("primary_id") == F.col("entity_id"), "left").select("primary_id", F.coalesce("n", F.lit(0)).alias("current"), "incoming")
    return out.withColumn("result", F.col("current") + F.col("incoming"))


def shared_events(participation: DataFrame, redirect: DataFrame) -> DataFrame:
    """(primary_id, shared): rows of the primary in events of each duplicate, added up over the duplicates."""
    r = redirect.select("dup_id", "primary_id")
    own = participation.join(r.select(F.col("primary_id").alias("entity_id")).distinct(), "entity_id", "left_semi").groupBy("entity_id", "event_id").agg(F.count("*").alias("n"))
    theirs = participation.join(r, participation["entity_id"] == r["dup_id"]).select("primary_id", "dup_id", "event_id").distinct()
    both = theirs.join(own, (theirs["primary_id"] == own["entity_id"]) & (theirs["event_id"] == own["event_id"]))
    return both.groupBy("primary_id").agg(F.sum("n").alias("shared"))


def value_rows(values: DataFrame, redirect: DataFrame, data_type: str) -> DataFrame:
    """(primary_id, data_type, current, incoming, result) of named values: entity_id, name, pos (order)."""
    r = redirect.select("dup_id", "primary_id")
    ids = r.select("primary_id").distinct()
    ordered = lambda c: F.array_distinct(F.array_sort(F.collect_list(F.when(c, F.struct("dup_id", "pos", "name"))))["name"])
    own = values.join(ids, values["entity_id"] == ids["primary_id"]).select("primary_id", F.lit(None).cast("long").alias("dup_id"), "name", "pos")
    theirs = values.join(r, values["entity_id"] == r["dup_id"]).select("primary_id", "dup_id", "name", "pos")
    grouped = own.unionByName(theirs).groupBy("primary_id").agg(ordered(F.col("dup_id").isNull()).alias("c"), ordered(F.col("dup_id").isNotNull()).alias("i"))
    return grouped.select("primary_id", F.lit(data_type).alias("data_type"), shown(F.col("c")).alias("current"), shown(F.col("i")).alias("incoming"), shown(F.array_union("c", "i")).alias("result"))


def valid_names(attrs: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(entity_id, name, pos) of a key's values that are numbers and name an entity (entity_id, title)."""
    rows = attrs.filter((F.col("key") == key) & valid(F.col("value"))).withColumn("n", number(F.col("value"))).filter("n is not null")
    n = names.select(F.col("entity_id").alias("of"), "title")
    return rows.join(n, F.col("n").cast("long") == F.col("of")).select("entity_id", F.col("title").alias("name"), F.col("attr_id").alias("pos"))


def cell(items: Column, whole: bool = False) -> Column:
    """The items of a cell of the preview, all of them if ``whole``; None if there are none."""
    return F.when(F.size(items) == 0, "None").otherwise(F.array_join(items, ", ") if whole else shown(items))


def frame(attrs: DataFrame, terms: DataFrame, references: DataFrame, teams: DataFrame, redirect: DataFrame, current_key: str = "sp_current_team", past_key: str = "sp_past_team") -> DataFrame:
    """(primary_id, data_type, current, incoming, result): a row of each kind for each primary, empty ones too.

    Kinds: the current team (the last value that is a number and names a team), past teams, each taxonomy, and the number
    of rows that name the player in events. A primary that shares events with its duplicates has one row more, a warning.
    """
    mains = redirect.select("primary_id").distinct()
    last = valid_names(attrs, current_key, teams).groupBy("entity_id").agg(F.max_by("name", "pos").alias("name")).withColumn("pos", F.lit(0).cast("long"))
    past = valid_names(attrs, past_key, teams).select("entity_id", "name", "pos")
    kinds = terms.select("taxonomy").distinct()
    named = terms.select("entity_id", "taxonomy", "name", F.lit(0).cast("long").alias("pos"))
    values = last.select("entity_id", F.lit("Current Team").alias("data_type"), "name", "pos").unionByName(past.withColumn("data_type", F.lit("Past Team(s)"))).unionByName(named.withColumnRenamed("taxonomy", "data_type"))
    r = redirect.select("dup_id", "primary_id")
    own = values.join(mains, values["entity_id"] == mains["primary_id"]).withColumn("dup_id", F.lit(None).cast("long"))
    theirs = values.join(r, values["entity_id"] == r["dup_id"])
    ordered = lambda c: F.array_distinct(F.array_sort(F.collect_list(F.when(c, F.struct("dup_id", "pos", "name"))))["name"])
    columns = ["primary_id", "data_type", "dup_id", "pos", "name"]
    lists = own.select(*columns).unionByName(theirs.select(*columns)).groupBy("primary_id", "data_type").agg(ordered(F.col("dup_id").isNull()).alias("c"), ordered(F.col("dup_id").isNotNull()).alias("i"))
    # the taxonomies are one row
    every = mains.withColumn("data_type", F.explode(F.array(F.lit("Current Team"), F.lit("Past Team(s)")))).unionByName(mains.withColumn("__one", F.lit(1)).join(F.broadcast(kinds.agg(F.collect_set("taxonomy").alias("k"), F.lit(1).alias("__one"))), "__one").select("primary_id", F.explode("k").alias("data_type")))
    full = every.join(lists, ["primary_id", "data_type"], "left").select("primary_id", "data_type", *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in "ci"])
    team = F.col("data_type") == "Current Team"
    both = F.array_union("c", "i")
    cells = [F.when(team, cell(x, whole=True)).otherwise(cell(x)).alias(n) for x, n in ((F.col("c"), "current"), (F.col("i"), "incoming"), (both, "result"))]
    players = references.filter("key = 'sp_player'").select(F.col("value").try_cast("long").alias("entity_id"), F.col("entity_id").alias("event_id"))
    counts = preview_counts(players, redirect)
    number_cell = lambda c: F.when(F.col(c) == 0, "None").otherwise(F.col(c).cast("string")).alias(c)
    events = counts.select("primary_id", F.lit("Events").alias("data_type"), number_cell("current"), number_cell("incoming"), F.col("result").cast("string").alias("result"))
    none = F.lit(None).cast("string")
    text = F.concat(F.col("shared").cast("string"), F.lit(" event(s) hold both the primary and a duplicate"))
    warning = shared_events(players, redirect).select("primary_id", F.lit("Warning").alias("data_type"), none.alias("current"), none.alias("incoming"), text.alias("result"))
    return full.select("primary_id", "data_type", *cells).unionByName(events).unionByName(warning)


def titled(ids: DataFrame, entities: DataFrame, kind: str | None = None) -> DataFrame:
    """ids (id) with their titles, or a placeholder; entities of another ``kind`` have that, too."""
    entities = entities if kind is None else entities.filter(F.col("kind") == kind)
    return ids.join(entities.select(F.col("entity_id").alias("id"), "title"), "id", "left").select("id", F.coalesce("title", F.lit("Unknown Player")).alias("title"))
