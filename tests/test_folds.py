"""Several duplicates of one primary, chains of redirects, and numbers, against plain versions."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from merganser.operators import merge, redirects, whole

ATTRS = "attr_id long, entity_id long, key string, value string"
LINKS = "dup_id long, primary_id long"


def folded(rows, redirect, several=("sp_team",)):
    """(entity, key) -> counts of values, by the rule as it is told: one duplicate after the other."""
    of = defaultdict(list)
    for _, entity, key, value in rows:
        of[entity, key].append(value or "")
    primaries, dups = {p for _, p in redirect}, {d for d, _ in redirect}
    out = {}
    for entity in {e for e, _ in of} | primaries:
        if entity in dups:
            continue
        for key in {k for _, k in of}:
            now = list(of[entity, key])
            for dup in sorted(d for d, p in redirect if p == entity):
                if key.startswith("sp_"):
                    now += [v for v in of[dup, key] if v not in set(now)]
                if key in several and len(set(now)) < len(now):
                    now = [v for v in dict.fromkeys(now) if v not in ("", "0")]
            if now:
                out[entity, key] = Counter(now)
    return out


def values_of(df):
    out = defaultdict(Counter)
    for r in df.collect():
        out[r.entity_id, r.key][r.value or ""] += 1
    return dict(out)


def test_the_first_duplicate_clears_a_later_one_brings_back(spark):
    rows = [(i, 1, "sp_team", v) for i, v in enumerate(["5", "5", "0"])] + [(9, 3, "sp_team", "0"), (10, 2, "sp_other", "x")]
    out = whole.merge_attributes(spark.createDataFrame(rows, ATTRS), spark.createDataFrame([(2, 1), (3, 1)], LINKS))
    assert values_of(out) == {(1, "sp_team"): Counter(["5", "0"]), (1, "sp_other"): Counter(["x"])}


def test_attributes_against_the_fold(spark):
    for seed in range(3):
        rng = random.Random(seed)
        redirect = [(d, rng.choice([1, 2, 3])) for d in range(10, 30)] + [(d, 4) for d in range(5000, 30_000, 7000)]
        rows = [(i, rng.choice([1, 2, 3, 4, 5, *[d for d, _ in redirect]]), rng.choice(["sp_team", "sp_team", "sp_x", "mail"]), rng.choice(["", "0", "0", "5", "6", "7"])) for i in range(220)]
        df, r = spark.createDataFrame(rows, ATTRS).withColumn("more", F.lit(1)), spark.createDataFrame(redirect, LINKS)
        want = folded(rows, redirect)
        assert values_of(whole.merge_attributes(df, r)) == want
        own = {k: v for k, v in want.items() if k[1] == "sp_team" and k[0] in {1, 2, 3, 4}}
        for steps in (1, 3):  # blocks of few steps are put together
            got = merge.fold_distinct(df, r, steps=steps)
            assert got.columns == df.columns and values_of(got) == own


def resolved(links):
    to = {}
    for d, p in links:
        if d is not None and p is not None and d != p:
            to.setdefault(d, set()).add(p)
    out = {}
    for d in to:
        at, hops, seen = d, 0, set()
        while at in to and at not in seen:
            seen.add(at)
            at, hops = min(to[at]), hops + 1
        out[d] = (None, None, "cycle") if at in to else (at, hops, "fork" if len(to[d]) > 1 else "ok")
    return out


def test_redirects_against_walking(spark):
    rng = random.Random(7)
    for links in ([(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(50)], [(None, 1), (2, None), (3, 3), (5, 4), (5, 4), (4, 3)], []):
        got, _ = redirects.resolve(spark.createDataFrame(links, LINKS))
        assert {r.dup_id: (r.primary_id, r.hops, r.outcome) for r in got.collect()} == resolved(links)
    links = [(1, 2), (2, 3), (7, 8), (8, 7), (9, 7)]
    assert sorted(map(tuple, redirects.usable(spark.createDataFrame(links, LINKS)).collect())) == [(1, 3), (2, 3)]


def test_a_long_chain_takes_few_rounds(spark):
    links = spark.range(1, 1025).select(F.col("id").alias("dup_id"), (F.col("id") - 1).alias("primary_id"))
    got, rounds = redirects.resolve(links)
    assert rounds == 10 and got.filter("primary_id <> 0 or hops <> dup_id or outcome <> 'ok'").count() == 0 and got.count() == 1024


def test_what_is_a_number(spark):
    texts = ["5", " 5", "5 ", "-1.5", "+.5", "5.", "1e3", "5d", "5f", "NaN", "Infinity", "0x1A", "", " ", "1 2", "١", "1e", "e1", ".", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", merge.number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect() if r.n is not None} == {"5": 5, " 5": 5, "5 ": 5, "-1.5": -1.5, "+.5": 0.5, "5.": 5, "1e3": 1000}
    shown = {0.1 + 0.2: "0.3", 12345678.5: "12345678.5", 1e14: "1.0E+14", 1.5e-5: "1.5E-5", 3.0: "3", -2.25: "-2.25", 1e30: "1.0E+30", 0.0: "0", 100.0: "100", 99999999999999.0: "99999999999999", 1234567890123456.0: "1.2345678901235E+15", 0.0001: "0.0001", 1e-25: "1.0E-25"}
    df = spark.createDataFrame([(x,) for x in shown], "x double").select("x", merge.as_text(F.col("x")).alias("t"))
    assert {r.x: r.t for r in df.collect()} == shown


def test_box_scores_of_what_is_no_number(spark):
    schema = "event_id long, team string, player_id long, stat string, value string, pos long"
    rows = [(1, "t", p, s, v, p) for s, vs in {"a": ("5", "5d"), "b": ("5", "NaN"), "c": ("5d", "5"), "d": ("0.1", "0.2"), "e": ("1e30", "1"), "f": ("", "3")}.items() for p, v in enumerate(vs, 1)]
    out = merge.merge_boxscore(spark.createDataFrame(rows, schema), spark.createDataFrame([(2, 1)], LINKS))
    assert {r.stat: r.value for r in out.collect()} == {"a": "5", "b": "5", "c": "5d", "d": "0.3", "e": "1.0E+30", "f": "3"}
