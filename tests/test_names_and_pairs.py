"""Golden vectors of the cascade, and blocking against the cross product."""

import random

from pyspark.sql import functions as F

from merganser.functions import names
from merganser.operators import match

GOLDEN = [
    ("Mike Scott", "mike scott", 100, "exact"),
    ("Mike Scott (G)", "Mike Scott", 100, "exact"),
    ("José Núñez", "Jose Nunez", 100, "exact"),
    ("José Nuñez", "José Núñez", 100, "exact"),
    ("James Porter Sr.", "James Porter", 100, "exact"),
    ("Peter (Jr) Austin", "Peter Austin", 100, "exact"),
    ("Smith, John", "John Smith", 100, "exact"),
    ("John Michael Smith", "John Smith", 100, "exact"),
    ("Pele", "pele", 100, "exact"),
    ("Sean O’Connor", "Sean OConnor", 95, "normalization"),
    ("Ian MacBeth", "Ian McBeth", 95, "normalization"),
    ("Jan van der Berg", "Jan Vanderberg", 95, "normalization"),
    ("John Alden", "John Elder", 95, "normalization"),
    ("Jean-Pierre Tremblay", "Jean Pierre Tremblay", 90, "french_compound"),
    ("Jean-Pierre Tremblay", "Jean-Paul Tremblay", 90, "french_compound"),
    ("Mike Scott", "Michael Scott", 70, "nickname"),
    ("Marc Roy", "Mark Roy", 70, "nickname"),
    ("Nathan Hill", "Jonathan Hill", 70, "nickname"),
    ("Michel Roy", "Michael Roy", 65, "typo"),
    ("Mathew Hill", "Matthew Hill", 65, "typo"),
    ("Mark Roy", "Mary Roy", 65, "typo"),
    ("Ann Cooper", "Ann Coopper", 60, "nickname+typo"),
    ("Jon Smith", "John Smyth", 60, "nickname+typo"),
    ("Anna Smith-Jones", "Anna Jones", 60, "nickname+compound"),
    ("Jean Pierre Roy", "Jeanpierre Roy", 55, "middle_name"),
    ("James Porter, Jr.", "James Porter", 55, "middle_name"),
    ("Mathew Smith-Jones", "Matthew Jones", 50, "typo"),
    ("J. Smith", "John Smith", 50, "initial"),
    ("J Smith", "J. Smith", 50, "initial"),
    ("John Smith", "Smith John", 50, "reversal"),
    ("Jean Roy", "John Roy", None, None),
    ("Nathan Hill", "Nathaniel Hill", None, None),
    ("Jhon Smith", "John Smyth", None, None),
    ("Rob Lee", "Ron Lee", None, None),
    ("Pele", "Pele Silva", None, None),
    ("Anna Smith-Macdonald", "Anna MacDonald", None, None),
    ("Smith Jr., John", "John Smith", None, None),
]


def compared(spark, pairs):
    """Every pair through the cascade, without blocking."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    side = lambda c: match.with_variants(match.with_names(rows.select("i", F.col(c).alias("title")))).select("i", F.struct("first", "middle", "last", "norm_last", "norm_first", "variants").alias(c))
    found = match.compare(side("a").join(side("b"), "i"), "a", "b")
    return [(r.certainty, r.scenario) for r in found.orderBy("i").collect()]


def test_golden_pairs(spark):
    assert compared(spark, [g[:2] for g in GOLDEN]) == [g[2:] for g in GOLDEN]


def test_match_is_symmetric(spark):
    forth, back = compared(spark, [g[:2] for g in GOLDEN]), compared(spark, [(b, a) for a, b, *_ in GOLDEN])
    assert [f[0] is None for f in forth] == [b[0] is None for b in back]


def test_blocking_loses_no_pair(spark):
    rng = random.Random(5)
    titles = [t for g in GOLDEN for t in g[:2]]
    for _ in range(60):  # typing errors
        t = list(rng.choice(titles))
        k = rng.randrange(len(t))
        t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", " ", "-"])
        titles.append("".join(t))
    titles += ["", "x", None, "   ", "A B C D", "d' ", "Mac X", "X Mac"]
    entities = spark.createDataFrame(list(enumerate(titles)), "entity_id long, title string").withColumn("ord", F.col("entity_id"))
    found = {(r.id_a, r.id_b): (r.certainty, r.scenario) for r in match.find_pairs(entities).collect()}
    pairs = [(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles))]
    want = {p: m for p, m in zip(pairs, compared(spark, [(titles[i], titles[j]) for i, j in pairs]), strict=True) if m[0] is not None}
    assert found == want
    assert {m[0] for m in want.values()} <= {100, 95, 90, 70, 65, 60, 55, 50}


def test_surnames(spark):
    vectors = {"o'connor": "oconnor", "macbeth": "mcbeth", "mac": "mac", "macs": "macs", "vanderberg": "berg", "delacruz": "cruz", "alden": "", "elder": "", "delaney": "ney", "alderson": "son", "dellarocca": "rocca"}
    rows = spark.createDataFrame([(k,) for k in vectors], "s string").select("s", names.norm_surname(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == vectors


def test_aliases_first_row_wins():
    table = names.alias_table()
    assert (table["jon"], table["nathan"], table["pat"], table["alex"], table["chris"], table["ben"]) == ("john", "jonathan", "patrick", "alexander", "christopher", "benjamin")
    assert table["michael"] == "michael" and table["jack"] == "john" and len(table) == 257


def test_empty_table(spark):
    assert match.find_pairs(spark.createDataFrame([], "entity_id long, ord long, title string")).count() == 0


def test_pairs_of_classes_are_all_pairs_and_few(spark):
    rng = random.Random(5)
    titles = [rng.choice(["Mike", "Michael", "M.", "Marc", "Mark"]) + " " + rng.choice(["Scott", "Scot", "Mark", "MacBeth", "McBeth"]) for _ in range(300)] + ["Pele", "pele", None, None]
    entities = spark.createDataFrame([(1000 - 3 * i, i, t) for i, t in enumerate(titles)], "entity_id long, ord long, title string")
    members, links = match.class_pairs(entities)
    of, links = {r.entity_id: (r.ord, r.class_id) for r in members.collect()}, links.collect()
    assert len(of) == len(titles) and len(links) < 700
    held = {}
    for i, (_, c) in of.items():
        held.setdefault(c, []).append(i)
    assert all(min(held[c], key=lambda i: of[i][0]) == c for c in held)
    every = sorted((a, b, r.certainty, r.scenario) for r in links for a in held[r.id_a] for b in held[r.id_b] if of[a][0] < of[b][0])
    want = sorted((r.id_a, r.id_b, r.certainty, r.scenario) for r in match.find_pairs(entities).collect())
    assert every == want and len(want) > 10_000
    assert all(any(of[a][0] < of[b][0] for a in held[r.id_a] for b in held[r.id_b]) for r in links)
