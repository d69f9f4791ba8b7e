"""Grouping against the sequential rule; adjustments and ranks."""

import random

from pyspark.sql import functions as F

from merganser.operators import cluster, components, enrich, match


def sequential(n, pairs):
    taken, out = set(), {}
    for i in range(n):
        if i not in taken:
            mine = [j for j in range(i + 1, n) if j not in taken and (i, j) in pairs]
            taken.update(mine)
            if mine:
                out[i] = mine
    return out


def frame(spark, pairs):
    rows = [(a, b, a, b, 50 + (a * 7 + b) % 3, f"s{b % 4}") for a, b in pairs]
    return spark.createDataFrame(rows, "id_a long, id_b long, ord_a long, ord_b long, certainty int, scenario string")


def test_groups_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.06}
    got = {}
    for r in cluster.group_duplicates(frame(spark, pairs)).collect():
        got.setdefault(r.group_ord, set()).add(r.ord)
    assert got == {k: {k, *v} for k, v in sequential(60, pairs).items()}


def test_best_pair_of_a_group(spark):
    rows = [(0, 1, 0, 1, 50, "initial"), (0, 2, 0, 2, 70, "nickname"), (0, 3, 0, 3, 70, "other")]
    found = cluster.group_duplicates(spark.createDataFrame(rows, "id_a long, id_b long, ord_a long, ord_b long, certainty int, scenario string"))
    assert {(r.certainty, r.scenario) for r in found.collect()} == {(70, "nickname")}


def test_order_decides(spark):
    def groups(titles):
        entities = spark.createDataFrame(list(enumerate(titles)), "entity_id long, title string").withColumn("ord", F.col("entity_id"))
        out = {}
        for r in cluster.group_duplicates(match.find_pairs(entities)).collect():
            out.setdefault(r.group_ord, set()).add(titles[r.entity_id])
        return out

    assert groups(["J. Smith", "John Smith", "Jane Smith"]) == {0: {"J. Smith", "John Smith", "Jane Smith"}}
    assert groups(["John Smith", "J. Smith", "Jane Smith"]) == {0: {"John Smith", "J. Smith"}}


def test_adjustments(spark):
    # base, e-mails, teams, positions, result
    cases = [(70, "aa", "tt", "xy", 75), (100, "aa", "tt", "xy", 80), (50, "ab", "tu", "xy", 50), (60, "ab", "tu", "xy", 50), (95, "ab", "tt", "xx", 100), (70, "a-", "tu", "xx", 70), (70, "ab", "t-", "xx", 70)]
    groups, details = [], []
    for g, (base, emails, teams, positions, _) in enumerate(cases):
        for k in range(2):
            groups.append((g, 2 * g + k, 2 * g + k, base, "s"))
            details.append((2 * g + k, *[("" if x[k] == "-" else x[k]) for x in (emails, teams, positions)]))
    out = enrich.adjust(spark.createDataFrame(groups, "group_ord long, entity_id long, ord long, certainty int, scenario string"), spark.createDataFrame(details, "entity_id long, email string, team string, position string"))
    assert {r.group_ord: r.adjusted for r in out.collect()} == {g: c[-1] for g, c in enumerate(cases)}


def test_tiers(spark):
    rows = spark.createDataFrame([(90,), (89,), (70,), (69,)], "c int").select("c", enrich.tier(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in rows} == {90: "High", 89: "Medium", 70: "Medium", 69: "Low"}


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "id_a long, id_b long, ord_a long, ord_b long, certainty int, scenario string")
    assert cluster.group_duplicates(empty).count() == 0


def test_grouping_over_names_equals_grouping_over_pairs(spark):
    rng = random.Random(5)
    firsts, lasts = ["John", "J.", "Jon", "Jean Pierre", "Jeanpierre", "Mike", "Michael", "Smith"], ["Smith", "Smyth", "Smith-Jones", "Jones", "John", ""]
    for seed in range(2):
        titles = [f"{rng.choice(firsts)} {rng.choice(lasts)}".strip() for _ in range(120)] + ["", ""]
        entities = spark.createDataFrame([(1000 - i, i * 3 + seed, t) for i, t in enumerate(titles)], "entity_id long, ord long, title string")
        over_names = sorted(map(tuple, cluster.group_entities(entities).select("group_ord", "entity_id", "ord", "certainty", "scenario").collect()))
        over_pairs = sorted(map(tuple, cluster.group_duplicates(match.find_pairs(entities)).select("group_ord", "entity_id", "ord", "certainty", "scenario").collect()))
        assert over_names == over_pairs and over_names
    assert cluster.group_entities(entities.limit(0)).count() == 0


def test_ranks_of_a_large_group(spark):
    rng = random.Random(6)
    rows = [(g, k * 10 + g, k * 10 + g) for g, n in ((0, 3000), (1, 2), (2, 40)) for k in range(n)]
    groups = spark.createDataFrame(rows, "group_ord long, entity_id long, ord long")
    counts = {r[1]: rng.randint(1, 5) for r in rows if rng.random() < 0.8}
    adjusted = spark.createDataFrame([(0, 95), (1, 70), (2, 50)], "group_ord long, adjusted int")
    got = {r.entity_id: (r["rank"], r.events, r.group_events, r.tier, r.survivor) for r in enrich.ranked_members(groups, spark.createDataFrame(list(counts.items()), "entity_id long, events long"), adjusted).collect()}
    for g, tier in ((0, "High"), (1, "Medium"), (2, "Low")):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-counts.get(r[1], 0), r[2]))
        total = sum(counts.get(r[1], 0) for r in own)
        for k, r in enumerate(own):
            assert got[r[1]] == (k + 1, counts.get(r[1], 0), total, tier, k == 0)


def test_a_group_is_called_as_its_first_entity(spark):
    entities = spark.createDataFrame([(7, 1, "Mike Scott"), (8, 2, "Michael Scott"), (9, 0, "Other One")], "entity_id long, ord long, title string")
    assert [tuple(r) for r in cluster.group_titles(cluster.group_entities(entities), entities).collect()] == [(1, "Mike Scott")]


def led(n, pairs):
    return {m: k for k, mine in sequential(n, pairs).items() for m in (k, *mine)}


def test_leaders_by_components_equal_the_sequential_rule(spark):
    rng = random.Random(8)
    for rounds, bound in ((0, 1000), (1, 1000), (1, 12), (0, 0), (2, 40)):
        pairs = {(a, b) for a in range(90) for b in range(a + 1, min(90, a + 12)) if a // 30 == b // 30 and rng.random() < 0.13}
        found = cluster.leaders(frame(spark, sorted(pairs)), rounds, bound).collect()
        assert {r.ord: r.leader for r in found if r.leader != r.ord} == {m: k for m, k in led(90, pairs).items() if m != k}, (rounds, bound)
        assert {r.ord for r in found} == {x for p in pairs for x in p}


def test_a_long_chain_takes_few_rounds(spark):
    n, jobs = 3000, spark.sparkContext.statusTracker()
    rows = [(k, k + 1, k, k + 1) for k in range(n - 1)]
    pairs = spark.createDataFrame(rows, "id_a long, id_b long, ord_a long, ord_b long")
    spark.sparkContext.setJobGroup("chain", "a long chain")
    got = {r.ord: r.leader for r in cluster.leaders(pairs, rounds=2).collect()}
    done = len(jobs.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: k - k % 2 for k in range(n)}
    assert done < 400  # in rounds alone it would be some thousands


def test_components_against_a_plain_search(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 400)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items() if x != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
