"""Documents with lists, maps and texts that meet, against the recursive rule told with lists of pairs."""

import json
import random

from merganser.operators import documents

DOCS = "entity_id long, key string, doc string"
LINKS = "dup_id long, primary_id long"


def pairs(x):
    """An array as ordered pairs, everything else as it is."""
    if isinstance(x, list):
        return [(str(i), pairs(v)) for i, v in enumerate(x)]
    return [(k, pairs(v)) for k, v in x.items()] if isinstance(x, dict) else x


def is_list(x):
    return [k for k, _ in x] == [str(i) for i in range(len(x))]


def plain(x):
    if not isinstance(x, list):
        return x
    return [plain(v) for _, v in x] if is_list(x) else {k: plain(v) for k, v in x}


def both(a, b):
    """The rule for two arrays of pairs, whose values may be arrays too."""
    for key, value in b:
        at = [i for i, (k, _) in enumerate(a) if k == key]
        if not at:
            a = [*a, (key, value)]
            continue
        mine = a[at[0]][1]
        if mine is None:
            a[at[0]] = (key, value)
        elif isinstance(mine, list) and isinstance(value, list):
            if is_list(mine) and is_list(value):
                seen, kept = set(), []
                for _, v in mine + value:
                    text = "Array" if isinstance(v, list) else {None: "", True: "1", False: ""}.get(v, str(v)) if v is None or isinstance(v, bool) else str(v)
                    if text not in seen:
                        seen.add(text)
                        kept.append(v)
                a[at[0]] = (key, [(str(i), v) for i, v in enumerate(kept)])
            else:
                a[at[0]] = (key, both(mine, value))
    return a


def tree(rng, depth=3):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(["5", "7", "x", "", None, 5, True, False, 1.5])
    if kind < 0.65:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: tree(rng, depth - 1) for k in rng.sample(["0", "1", "2", "a", "b"], rng.randint(0, 4))}


def test_documents_against_the_recursive_rule(spark):
    rng = random.Random(11)
    redirect = [(d, rng.randint(1, 30)) for d in range(100, 220)]
    key = lambda: rng.choice(["sp_statistics", "sp_leagues", "sp_leagues", "sp_other"])
    held = {}
    for e in [*range(1, 33), *[d for d, _ in redirect]]:
        for k in {key(), key()}:
            held[e, k] = rng.choice([json.dumps(tree(rng)), json.dumps({"a": tree(rng), "b": tree(rng)}), json.dumps([tree(rng), tree(rng)]), "", "no json", None, '"text"'])
    df = spark.createDataFrame([(*k, v) for k, v in held.items()], DOCS)
    got = {(r.entity_id, r.key): r.doc for r in documents.merge_documents(df, spark.createDataFrame(redirect, LINKS)).collect()}
    to, want = dict(redirect), {}
    for e, k in held:
        if e in to:
            continue
        want[e, k] = held[e, k]
    for (e, k), doc in sorted(held.items(), key=lambda x: x[0][0]):
        if e in to and k != "sp_other":
            read = lambda t: (lambda x: x if isinstance(x, list) else None)(pairs(json.loads(t)) if t and t != "no json" else None)
            mine, theirs = read(want.get((to[e], k))), read(doc)
            if theirs:
                want[to[e], k] = json.dumps(plain(both(mine, theirs) if mine else theirs))
    assert got.keys() == want.keys()
    for at, doc in want.items():
        if doc in (None, "", "no json") or not isinstance(json.loads(doc), (list, dict)):
            assert got[at] == doc
        else:
            assert json.dumps(plain(pairs(json.loads(got[at])))) == json.dumps(plain(pairs(json.loads(doc)))), at


def test_lists_are_joined_and_empty_tables_stay_empty(spark):
    rows = [(1, "sp_statistics", '{"g": {"m": ["a"], "q": [["x"]]}}'), (2, "sp_statistics", '{"g": {"m": ["b", "a"], "q": [["y"]], "z": {"1": 2}}}'), (3, "sp_statistics", '{"g": {"m": {"k": "c"}}}')]
    out = documents.merge_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(2, 1), (3, 1)], LINKS))
    assert [r.doc for r in out.collect()] == ['{"g":{"m":{"0":"a","1":"b","k":"c"},"q":[["x"]],"z":{"1":2}}}']
    assert documents.merge_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([(2, 1)], LINKS)).count() == 0
    assert documents.merge_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LINKS)).count() == 3
