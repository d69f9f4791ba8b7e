"""Scored duplicate pairs: lossless blocking by equi joins, then an ordered cascade of rules.

Names are compared once for each pair of different parsed names. Two surnames are related if they are the same, one or
two typing errors apart, or one is a part of the other; that is found among distinct surnames. Two names are compared
only if their surnames are related and their first names share a key (an alias, a typing error, an initial, a
joined middle name), or if one is the other reversed, or if both are single words. Every rule implies one of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.functions.names import alias_table, apart, canonical, deletions, in_bytes, initial, norm_surname, parse_names, typo, variants
from merganser.operators.lineage import cut

NAME = ("first", "middle", "last")


def with_names(entities: DataFrame, title: str = "title") -> DataFrame:
    """entities with first, last, middle, and ``norm_last``."""
    return apart(parse_names(entities, title), "norm_last", norm_surname(F.col("last")))


def with_variants(names: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """names with ``variants``: the forms of the first name, each with the name that it is read as; and ``norm_first``."""
    named = apart(names, "__v", variants(F.col("first")))
    named = apart(named, "variants", F.transform("__v", lambda v: F.struct(v.alias("v"), canonical(v, aliases).alias("c")))).drop("__v")
    return apart(named, "norm_first", norm_surname(F.col("first")))


def compare(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with certainty and scenario, null if no rule applies.

    a, b: structs of first, middle, last, norm_last, norm_first, variants; a is the earlier entity's.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    (fa, fb), (la, lb), (na, nb), (ma, mb) = ([c(s, n) for s in (a, b)] for n in ("first", "last", "norm_last", "middle"))
    parts = lambda x: F.split(x, r"[-\s]")
    inside = lambda whole, part: (F.size(parts(whole)) > 1) & F.array_contains(parts(whole), part)
    ia, ib = initial(fa), initial(fb)
    # the first pair of variants, in order, that are the same name
    crossed = F.flatten(F.transform(c(a, "variants"), lambda x: F.transform(c(b, "variants"), lambda y: F.struct((x["v"] == y["v"]).alias("equal"), ((x["v"] == y["v"]) | (x["c"] == y["c"])).alias("alias")))))
    p = apart(pairs, "__typo", typo(na, nb))
    p = apart(p, "__part", inside(na, nb) | inside(nb, na))
    p = apart(p, "__hit", F.get(F.filter(crossed, lambda v: v["alias"]), 0))
    p = apart(p, "__first", typo(fa, fb))
    p = apart(p, "__initials", ((ia != "") & fb.startswith(ia)) | ((ib != "") & fa.startswith(ib)))
    p = p.withColumn("__same", na == nb).withColumn("__exact", fa == fb)
    reverse = ((fa == lb) & (la == fb)) | ((c(a, "norm_first") == nb) & (na == c(b, "norm_first")))
    joined = ((ma != "") & (F.concat(fa, ma) == fb)) | ((mb != "") & (F.concat(fb, mb) == fa))
    same, hit = F.col("__same"), F.col("__hit")
    near = ~same & F.col("__typo")
    compound = ~same & ~F.col("__typo") & F.col("__part")
    result = lambda certainty, scenario: F.struct(F.lit(certainty).alias("certainty"), F.lit(scenario).alias("scenario"))
    nothing = F.lit(None).cast("struct<certainty int, scenario string>")
    verdict = (
        F.when((la == "") | (lb == ""), F.when(F.col("__exact") & (la == "") & (lb == ""), result(100, "exact")).otherwise(nothing))
        .when(F.col("__exact") & (la == lb), result(100, "exact"))
        .when(F.col("__exact") & same, result(95, "normalization"))
        .when(~same & ~F.col("__typo") & ~F.col("__part"), F.when(reverse, result(50, "reversal")).otherwise(nothing))
        .when(hit.isNotNull() & same & hit["equal"], result(90, "french_compound"))
        .when(hit.isNotNull() & same, result(70, "nickname"))
        .when(hit.isNotNull() & near, result(60, "nickname+typo"))
        .when(hit.isNotNull() & compound, result(60, "nickname+compound"))
        .when(same & F.col("__first"), result(65, "typo"))
        .when(compound & F.col("__first"), result(50, "typo"))
        .when(F.col("__initials"), result(50, "initial"))
        .when(same & joined, result(55, "middle_name"))
        .otherwise(nothing)
    )
    p = apart(p, "__verdict", verdict)
    return p.select(*[F.col(f"`{x}`") for x in pairs.columns], "__verdict.certainty", "__verdict.scenario")


def related_surnames(names: DataFrame) -> DataFrame:
    """(sa, sb) of normalised surnames that are the same, a typing error apart, or part of one another; both directions."""
    surnames = names.filter("last <> ''").select(F.col("norm_last").alias("s")).distinct()
    holed = apart(surnames, "bytes", in_bytes(F.col("s"))).select("s", F.explode(deletions(F.col("bytes"))).alias("k"))
    near = holed.alias("x").join(holed.alias("y"), "k").select(F.col("x.s").alias("sa"), F.col("y.s").alias("sb")).distinct()
    near = near.filter((F.col("sa") == F.col("sb")) | typo(F.col("sa"), F.col("sb")))
    parts = surnames.select(F.col("s").alias("sa"), F.explode(F.filter(F.split("s", "-"), lambda p: F.size(F.split(F.col("s"), "-")) > 1)).alias("sb"))
    parts = parts.join(surnames.select(F.col("s").alias("sb")), "sb").select("sa", "sb")
    return near.unionByName(parts).unionByName(parts.select(F.col("sb").alias("sa"), F.col("sa").alias("sb"))).distinct()


def first_keys(names: DataFrame) -> DataFrame:
    """(name, norm_last, key, asks): first names that a rule can match share a key, and one of them asks."""
    some = lambda tag, c: F.transform(c, lambda x: F.struct(F.concat(F.lit(tag), x).alias("key"), F.lit(True).alias("asks")))
    first = F.col("first")
    one = lambda tag, c, asks: F.array(F.struct(F.concat(F.lit(tag), c).alias("key"), asks.alias("asks")))
    is_initial = initial(first) != ""
    keys = F.concat(
        some("a", F.array_distinct(F.transform("variants", lambda v: v["c"]))),
        some("a", F.array_distinct(F.transform("variants", lambda v: v["v"]))),
        some("d", F.col("deleted")),
        one("i", F.substr(first, F.lit(1), F.lit(1)), is_initial),
        one("m", first, F.lit(False)),
        F.when(F.col("middle") != "", one("m", F.concat("first", "middle"), F.lit(True))).otherwise(F.array().cast("array<struct<key string, asks boolean>>")),
    )
    named = apart(names.filter("last <> ''"), "bytes", in_bytes(first))
    return apart(named, "deleted", deletions(F.col("bytes"))).select("name", "norm_last", F.explode(F.array_distinct(keys)).alias("k")).select("name", "norm_last", "k.key", "k.asks")


def name_pairs(names: DataFrame) -> DataFrame:
    """(a, b, certainty, scenario) of all ordered pairs of different or equal parsed names that match."""
    slim = names.select("name", "first", "last", "norm_last", "norm_first")
    keys = first_keys(names)
    related = related_surnames(names)
    x, y = keys.alias("x"), keys.alias("y")
    close = x.join(related, F.col("x.norm_last") == F.col("sa")).join(y, (F.col("y.norm_last") == F.col("sb")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.asks") | F.col("y.asks")))
    x, y = slim.filter("last <> ''").alias("x"), slim.filter("last <> ''").alias("y")
    raw = x.join(y, (F.col("x.first") == F.col("y.last")) & (F.col("x.last") == F.col("y.first")))
    normal = x.join(y, (F.col("x.norm_first") == F.col("y.norm_last")) & (F.col("x.norm_last") == F.col("y.norm_first")))
    equal = slim.select(F.col("name").alias("a"), F.col("name").alias("b"))
    single = slim.filter("last = ''")
    alone = single.alias("x").join(single.alias("y"), F.col("x.first") == F.col("y.first"))
    both = [F.col("x.name").alias("a"), F.col("y.name").alias("b")]
    candidates = close.select(*both).unionByName(raw.select(*both)).unionByName(normal.select(*both)).unionByName(alone.select(*both)).unionByName(equal).distinct()
    info = names.select("name", F.struct("first", "middle", "last", "norm_last", "norm_first", "variants").alias("n"))
    full = candidates.join(info.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(info.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    return compare(full, "na", "nb").filter("certainty is not null").select("a", "b", "certainty", "scenario")


def name_matches(entities: DataFrame, entity_id: str = "entity_id", ord_col: str = "ord", title: str = "title", aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, ord, name) of all entities; and (a, b, certainty, scenario) of all ordered pairs of their names that match."""
    every = entities.select(F.col(f"`{entity_id}`").alias("id"), F.col(f"`{ord_col}`").alias("ord"), F.col(f"`{title}`").alias("title"))
    # titles are parsed once each, and names are read by many joins
    parsed = cut(with_names(every.select("title").distinct()).select("title", F.concat_ws("\x01", *NAME).alias("name"), *NAME, "norm_last"))
    names = cut(with_variants(parsed.drop("title").distinct(), aliases or alias_table()))
    who = every.join(parsed.select(F.col("title").alias("__title"), "name"), F.col("title").eqNullSafe(F.col("__title")))
    return who.select("id", "ord", "name"), name_pairs(names)


def find_pairs(entities: DataFrame, entity_id: str = "entity_id", ord_col: str = "ord", title: str = "title", aliases: dict[str, str] | None = None) -> DataFrame:
    """(id_a, id_b, ord_a, ord_b, certainty, scenario) of all matching pairs, the earlier one first."""
    who, pairs = name_matches(entities, entity_id, ord_col, title, aliases)
    a = pairs.join(who.select(F.col("id").alias("id_a"), F.col("ord").alias("ord_a"), F.col("name").alias("a")), "a")
    both = a.join(who.select(F.col("id").alias("id_b"), F.col("ord").alias("ord_b"), F.col("name").alias("b")), "b")
    return both.filter("ord_a < ord_b").select("id_a", "id_b", "ord_a", "ord_b", "certainty", "scenario")


def class_pairs(entities: DataFrame, entity_id: str = "entity_id", ord_col: str = "ord", title: str = "title", aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity_id, ord, class_id) of all entities, a class being those of one parsed name, called as its earliest is; and (id_a, id_b,
    certainty, scenario) of classes.

    These are the pairs of ``find_pairs``, whose number grows with the square of a class: any entity of class ``id_a`` matches any later one
    of class ``id_b``. A class of two and more is a pair with itself; classes have no row if none of ``id_a`` is before one of ``id_b``.
    """
    who, pairs = name_matches(entities, entity_id, ord_col, title, aliases)
    heads = cut(who.groupBy("name").agg(F.min_by("id", "ord").alias("class_id"), F.min("ord").alias("first"), F.max("ord").alias("last")))
    a, b = (heads.select(F.col("name").alias(x), F.col("class_id").alias(f"id_{x}"), F.col(end)) for x, end in (("a", "first"), ("b", "last")))
    links = pairs.join(a, "a").join(b, "b").filter(F.col("first") < F.col("last")).select("id_a", "id_b", "certainty", "scenario")
    return who.join(heads.select("name", "class_id"), "name").select(F.col("id").alias("entity_id"), "ord", "class_id"), links
