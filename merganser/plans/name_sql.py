"""DuckDB SQL of the name functions, for the comparison of results."""

from __future__ import annotations

from merganser.functions import names as N


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g')"


def norm_surname(x: str) -> str:
    x = f"replace({x}, '''', '')"
    x = f"(CASE WHEN starts_with({x}, 'mac') AND strlen({x}) > 4 THEN concat('mc', substr({x}, 4)) ELSE {x} END)"
    x = rf"regexp_replace({x}, '^({N.PARTICLE})\s+', '')"
    x = rf"regexp_replace({x}, '^({N.PARTICLE})({N.ARTICLE})\s*', '')"
    return f"replace({x}, ' ', '')"


def canonical(x: str) -> str:
    table = N.alias_table()
    return f"coalesce(MAP([{', '.join(map(q, table))}], [{', '.join(map(q, table.values()))}])[{x}], {x})"


def parsed(source: str) -> str:
    """CTEs that end in ``parsed``: source's columns with first, last, middle, norm_last."""
    old, new = N.fold_table()
    special = "p3x"
    for letter, plain in N.SPECIAL_MORE.items():
        special = f"replace({special}, {q(letter)}, {q(plain)})"
    return rf"""
p1 AS (SELECT *, regexp_replace({trimmed(f"regexp_replace(translate(nfc_normalize(title), {q(N.QUOTES)}, {q(chr(39) * 4)}), {q(N.POSITION)}, '')")}, '\s+', ' ', 'g') AS p1x FROM {source}),
p2 AS (SELECT *, {trimmed(f"regexp_replace(regexp_replace(lower(p1x), {q(N.SUFFIX)}, ''), {q(N.INNER_SUFFIX)}, ' ', 'g')")} AS p2x FROM p1),
p3 AS (SELECT *, CASE WHEN contains(p2x, ',') THEN concat({trimmed("substr(p2x, instr(p2x, ',') + 1)")}, ' ', {trimmed("substr(p2x, 1, instr(p2x, ',') - 1)")}) ELSE p2x END AS p3x FROM p2),
p4 AS (SELECT *, string_split(lower(translate({special}, {q(old)}, {q(new)})), ' ') AS w FROM p3),
p5 AS (SELECT *, w[1] AS first, CASE WHEN len(w) > 1 THEN w[-1] ELSE '' END AS last, CASE WHEN len(w) > 2 THEN array_to_string(w[2:len(w) - 1], ' ') ELSE '' END AS middle FROM p4),
parsed AS (SELECT * EXCLUDE (p1x, p2x, p3x, w), {norm_surname("last")} AS norm_last FROM p5)"""


def variants(x: str) -> str:
    return f"(CASE WHEN contains({x}, '-') THEN list_distinct([{x}]) || list_filter([replace({x}, '-', ' '), replace({x}, '-', ''), split_part({x}, '-', 1)], lambda v: v <> {x}) ELSE [{x}] END)"


def typo(a: str, b: str) -> str:
    return f"(greatest(strlen({a}), strlen({b})) >= 4 AND levenshtein({a}, {b}) BETWEEN 1 AND CASE WHEN greatest(strlen({a}), strlen({b})) >= 6 THEN 2 ELSE 1 END)"


def initial(x: str) -> str:
    return rf"(CASE WHEN strlen({x}) <= 2 AND ends_with({x}, '.') THEN regexp_replace({x}, '\.+$', '') WHEN strlen({x}) = 1 THEN {x} ELSE '' END)"


def pairs(source: str = "persons") -> str:
    """CTEs that end in ``pairs``: every pair of the cross product is compared, the earlier first."""
    parts = lambda x: rf"string_split({x}, '-')"
    inside = lambda whole, part: f"(len({parts(whole)}) > 1 AND list_contains({parts(whole)}, {part}))"
    return f"""{parsed(source)},
canon AS (SELECT *, {variants("first")} AS v FROM parsed),
named AS (SELECT *, list_transform(v, lambda x: {canonical("x")}) AS c, {norm_surname("first")} AS norm_first, {initial("first")} AS ini FROM canon),
crossed AS (
 SELECT a.entity_id AS id_a, b.entity_id AS id_b, a.ord AS ord_a, b.ord AS ord_b, a.first AS fa, b.first AS fb, a.last AS la, b.last AS lb, a.norm_last AS na, b.norm_last AS nb,
  a.middle AS ma, b.middle AS mb, a.norm_first AS nfa, b.norm_first AS nfb, a.ini AS ia, b.ini AS ib, a.v AS va, b.v AS vb, a.c AS ca, b.c AS cb,
  a.norm_last = b.norm_last AS same FROM named a JOIN named b ON a.ord < b.ord),
near AS (SELECT *, NOT same AND {typo("na", "nb")} AS near FROM crossed),
comp AS (SELECT *, NOT same AND NOT near AND ({inside("na", "nb")} OR {inside("nb", "na")}) AS comp FROM near),
hits AS (SELECT *, CASE WHEN same OR near OR comp THEN list_filter(flatten(list_transform(range(1, len(va) + 1), lambda i: list_transform(range(1, len(vb) + 1), lambda j: {{'e': va[i] = vb[j], 'a': va[i] = vb[j] OR ca[i] = cb[j]}}))), lambda p: p.a)[1] END AS hit FROM comp),
scored AS (SELECT *, CASE
 WHEN la = '' OR lb = '' THEN CASE WHEN fa = fb AND la = '' AND lb = '' THEN '100 exact' END
 WHEN fa = fb AND la = lb THEN '100 exact'
 WHEN fa = fb AND same THEN '95 normalization'
 WHEN NOT same AND NOT near AND NOT comp THEN CASE WHEN (fa = lb AND la = fb) OR (nfa = nb AND na = nfb) THEN '50 reversal' END
 WHEN hit IS NOT NULL AND same AND hit.e THEN '90 french_compound'
 WHEN hit IS NOT NULL AND same THEN '70 nickname'
 WHEN hit IS NOT NULL AND near THEN '60 nickname+typo'
 WHEN hit IS NOT NULL AND comp THEN '60 nickname+compound'
 WHEN same AND {typo("fa", "fb")} THEN '65 typo'
 WHEN comp AND {typo("fa", "fb")} THEN '50 typo'
 WHEN (ia <> '' AND starts_with(fb, ia)) OR (ib <> '' AND starts_with(fa, ib)) THEN '50 initial'
 WHEN same AND ((ma <> '' AND concat(fa, ma) = fb) OR (mb <> '' AND concat(fb, mb) = fa)) THEN '55 middle_name' END AS verdict FROM hits),
pairs AS (SELECT id_a, id_b, ord_a, ord_b, CAST(split_part(verdict, ' ', 1) AS INTEGER) AS certainty, split_part(verdict, ' ', 2) AS scenario FROM scored WHERE verdict IS NOT NULL)"""


def groups(source: str = "persons") -> str:
    """CTEs that end in ``members``: going through the entities one by one, a leader takes its later matches."""
    return f"""{pairs(source)},
dense AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS i FROM {source}),
cfg AS (SELECT count(*) AS n FROM dense),
adj AS (SELECT da.i AS i0, list(db.i) AS nb FROM pairs JOIN dense da ON da.ord = ord_a JOIN dense db ON db.ord = ord_b GROUP BY da.i),
st(i, taken, seed, members) AS (
 SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), false, CAST([] AS BIGINT[])
 UNION ALL
 SELECT i + 1, CASE WHEN list_contains(taken, i + 1) THEN taken ELSE list_concat(taken, list_filter(coalesce(a.nb, CAST([] AS BIGINT[])), lambda x: NOT list_contains(taken, x))) END,
  NOT list_contains(taken, i + 1),
  CASE WHEN list_contains(taken, i + 1) THEN CAST([] AS BIGINT[]) ELSE list_filter(coalesce(a.nb, CAST([] AS BIGINT[])), lambda x: NOT list_contains(taken, x)) END
 FROM st LEFT JOIN adj a ON a.i0 = st.i + 1 WHERE st.i + 1 < (SELECT n FROM cfg)),
led AS (SELECT d.ord AS group_ord, m.ord AS ord FROM st JOIN dense d ON d.i = st.i, unnest(st.members) AS t(k) JOIN dense m ON m.i = k WHERE seed),
rows AS (SELECT led.group_ord, p.id_a, p.id_b, p.ord_a, p.ord_b, p.certainty, p.scenario FROM led JOIN pairs p ON p.ord_a = led.group_ord AND p.ord_b = led.ord),
best AS (SELECT group_ord, max(certainty) AS certainty, first(scenario ORDER BY certainty DESC, ord_b) AS scenario FROM rows GROUP BY group_ord),
members AS (
 SELECT group_ord, id_a AS entity_id, ord_a AS ord, b.certainty, b.scenario FROM (SELECT DISTINCT group_ord, id_a, ord_a FROM rows) r JOIN best b USING (group_ord)
 UNION ALL SELECT r.group_ord, r.id_b, r.ord_b, b.certainty, b.scenario FROM rows r JOIN best b ON b.group_ord = r.group_ord)"""
