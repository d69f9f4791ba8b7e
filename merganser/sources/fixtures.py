"""Relations of the engine, derived from the supplied tables by one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

PERSONS = """
SELECT c_custkey AS entity_id, c_custkey AS ord,
 CASE c_custkey % 7 WHEN 5 THEN concat(l, ', ', f) WHEN 6 THEN concat(f, ' ', l, ' Jr.') WHEN 4 THEN concat(f, ' ', l, ' (G)') ELSE concat(f, ' ', l) END AS title,
 CAST(c_nationkey AS varchar(20)) AS team, c_mktsegment AS category,
 CASE WHEN c_custkey % 5 = 0 THEN concat('u', CAST(c_custkey % 40 AS varchar(20)), '@x.org') ELSE '' END AS email
FROM customer
JOIN (VALUES (0,'Michael'),(1,'Mike'),(2,'John'),(3,'J.'),(4,'Jean-Pierre'),(5,'Jean'),(6,'Marc'),(7,'Mark'),(8,'José'),(9,'Mathew'),(10,'Matthew')) AS fn(i, f) ON fn.i = c_custkey % 11
JOIN (VALUES (0,'Smith'),(1,'Smyth'),(2,'O''Connor'),(3,'OConnor'),(4,'MacBeth'),(5,'McBeth'),(6,'Smith-Jones'),(7,'Núñez'),(8,'Alden'),(9,'Elder'),(10,'van der Berg'),(11,'Vanderberg'),(12,'Tremblay')) AS ln(i, l) ON ln.i = CAST(floor(c_custkey / 11) AS int) % 13
UNION ALL
SELECT 100000000 + c_custkey, 100000000 + c_custkey, l, CAST(c_nationkey AS varchar(20)), c_mktsegment, ''
FROM customer
JOIN (VALUES (0,'Jean Pierre Roy'),(1,'Jeanpierre Roy'),(2,'Roy Jean'),(3,'Jean Roy'),(4,'Pele'),(5,'PELE'),(6,'Mary Ann Alden'),(7,'Maryann Alden'),(8,'Alden Mary')) AS odd(i, l) ON odd.i = CAST(floor(c_custkey / 14) AS int) % 9
WHERE c_custkey % 14 = 3
"""

RELATIONS = {
    "persons": PERSONS,
    "entities": f"""
SELECT entity_id, CASE WHEN entity_id % 13 = 0 THEN 'team' ELSE 'player' END AS kind, CASE WHEN entity_id % 11 = 0 THEN 'draft' ELSE 'publish' END AS status, title, CAST(entity_id % 1000 AS int) AS day
FROM ({PERSONS}) AS everyone
""",
    "composed_persons": """
SELECT c_custkey AS entity_id, c_custkey AS ord, concat(f, ' ', l) AS title FROM customer
JOIN (VALUES (0,'\u0410\u043d\u0434\u0440\u0435\u0439'),(1,'\u0410\u043d\u0434\u0440\u0435\u0438\u0306'),(2,'Jos\u00e9'),(3,'Jose\u0301'),(4,'\u1112\u1161\u11ab'),(5,'\ud55c'),(6,'\u304b\u3099'),(7,'\u304c')) AS fn(i, f) ON fn.i = c_custkey % 8
JOIN (VALUES (0,'\u0427\u0430\u0439\u043a\u0438\u043d'),(1,'\u0427\u0430\u0438\u0306\u043a\u0438\u043d'),(2,'\u1e69et'),(3,'s\u0307\u0323et'),(4,'s\u0323\u0307et'),(5,'\u0391\u0313\u0301\u03b3'),(6,'\u1f0c\u03b3'),(7,'Nguy\u0302\u0303n'),(8,'O\u2019Neil')) AS ln(i, l) ON ln.i = CAST(floor(c_custkey / 8) AS int) % 9
""",
    "terms": """
SELECT o_custkey AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'status' ELSE 'priority' END AS taxonomy, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS term FROM orders
""",
    "requests": """
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 19 = 0 THEN -c_custkey ELSE c_custkey END AS primary_id,
 CASE WHEN c_custkey % 23 = 0 THEN CAST(NULL AS varchar(20)) WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN '0,0'
  WHEN c_custkey % 7 = 2 THEN concat(CAST(c_custkey + 1 AS varchar(20)), ',', CAST(c_custkey AS varchar(20)))
  WHEN c_custkey % 7 = 3 THEN concat('-', CAST(c_custkey + 1 AS varchar(20)), ',', CAST(c_custkey + 1 AS varchar(20)), ',', CAST(c_custkey + 2 AS varchar(20)), ',0')
  WHEN c_custkey % 29 = 0 THEN '1,2,3,4,5,6,7,8,9,10,11' ELSE CAST(c_custkey + 3 AS varchar(20)) END AS dups
FROM customer
""",
    "participation": "SELECT o_orderkey AS event_id, o_custkey AS entity_id FROM orders",
    "redirect": """
SELECT s_suppkey AS dup_id, s_suppkey - h AS primary_id FROM supplier CROSS JOIN (SELECT CAST(floor(COUNT(*) / 2) AS BIGINT) AS h FROM supplier) AS half WHERE s_suppkey >= h AND s_suppkey - h < h
""",
    "redirect_many": "SELECT s_suppkey AS dup_id, s_suppkey - s_suppkey % 5 AS primary_id FROM supplier WHERE s_suppkey % 5 > 0",
    "links": """
SELECT c_custkey AS dup_id, CASE WHEN c_custkey % 64 = 0 THEN c_custkey + 63 ELSE c_custkey - 1 END AS primary_id FROM customer WHERE c_custkey % 64 > 0 OR CAST(floor(c_custkey / 64) AS int) % 7 = 3
UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 64 = 17 AND CAST(floor(c_custkey / 64) AS int) % 5 = 1
UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey % 64 = 0
""",
    "boxscore": """
SELECT l_orderkey AS event_id, l_returnflag AS team, l_suppkey AS player_id, 'qty' AS stat,
 CAST(CAST(SUM(l_quantity) AS BIGINT) AS varchar(20)) AS value,
 CAST(MIN(l_linenumber) AS BIGINT) * 1000000000 + l_suppkey * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos
FROM lineitem GROUP BY l_orderkey, l_returnflag, l_suppkey
""",
    "appearance": "SELECT l_orderkey AS event_id, l_suppkey AS entity_id FROM lineitem",
    "attrs": """
SELECT o_orderkey AS attr_id, o_custkey AS entity_id, 'sp_team' AS key,
 CASE WHEN o_orderkey % 11 = 0 THEN '0' WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS value FROM orders
""",
    "person_redirect": "SELECT c_custkey AS dup_id, c_custkey - 1 AS primary_id FROM customer WHERE c_custkey % 2 = 1",
    "players": "SELECT s_suppkey AS entity_id, 'player' AS kind, 'publish' AS status, s_name AS title FROM supplier",
    "player_attrs": """
SELECT l_suppkey * 1000 + l_linenumber * 100 + ascii(l_returnflag) % 5 * 10 + ascii(l_linestatus) % 5 AS attr_id, l_suppkey AS entity_id,
 CASE l_linenumber % 5 WHEN 0 THEN 'sp_number' WHEN 1 THEN 'sp_team' WHEN 2 THEN 'sp_past_team' WHEN 3 THEN 'sp_club' ELSE 'mail' END AS key,
 CASE WHEN l_suppkey % 3 = 0 AND l_returnflag = 'A' THEN '0' WHEN l_suppkey % 4 = 0 AND l_returnflag = 'R' THEN 'x9' ELSE CAST(MAX(l_partkey) % 30 AS varchar(20)) END AS value
FROM lineitem WHERE (l_suppkey + l_linenumber) % 4 > 0 GROUP BY l_suppkey, l_linenumber, l_returnflag, l_linestatus
""",
    "player_terms": """
SELECT DISTINCT l_suppkey AS entity_id, CASE WHEN l_linenumber < 3 THEN 'league' ELSE 'season' END AS taxonomy,
 CASE WHEN l_linenumber < 3 THEN l_returnflag ELSE CAST(l_linenumber + l_suppkey % 3 AS varchar(20)) END AS term
FROM lineitem WHERE NOT (l_suppkey % 5 = 0 AND l_linenumber < 3)
""",
    "images": "SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('img', CAST(s_suppkey AS varchar(20))) ELSE '' END AS image FROM supplier",
    "timeline": """
SELECT l_orderkey AS event_id, l_returnflag AS team, l_suppkey AS player_id, l_linenumber AS at_, (l_linenumber * 7) % 5 AS minute FROM lineitem
""",
    "positions": """
SELECT l_orderkey AS event_id, l_suppkey AS player_id, CAST(CAST(MAX(l_quantity) AS BIGINT) AS varchar(20)) AS value, CAST(MIN(l_linenumber) AS BIGINT) * 100000000 + l_suppkey AS pos FROM lineitem GROUP BY l_orderkey, l_suppkey
""",
    "rosters": """
SELECT l_partkey % 40 AS list_id, l_suppkey AS player_id, CAST(CAST(MAX(l_quantity) AS BIGINT) AS varchar(20)) AS value, MIN(l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS pos FROM lineitem WHERE l_partkey % 11 < 3 GROUP BY l_partkey % 40, l_suppkey
""",
    "teams": "SELECT p_partkey AS entity_id, p_name AS title FROM part WHERE p_partkey % 2 = 0",
    "leaves": """
SELECT l_suppkey AS entity_id, l_returnflag AS k1, CASE WHEN l_suppkey % 5 = 0 AND l_returnflag = 'R' THEN CAST(NULL AS varchar(20)) ELSE l_linestatus END AS k2, CAST(CAST(SUM(l_quantity) AS BIGINT) AS varchar(20)) AS value
FROM lineitem WHERE (l_suppkey + CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) % 3 <> 0
GROUP BY l_suppkey, l_returnflag, CASE WHEN l_suppkey % 5 = 0 AND l_returnflag = 'R' THEN CAST(NULL AS varchar(20)) ELSE l_linestatus END
""",
    "backups": """
SELECT concat('merge_', CAST(1704067200 + event_id AS varchar(20)), '_', lpad(CAST(event_id AS varchar(20)), 8, CASE WHEN event_id % 17 = 0 THEN '-' ELSE '0' END)) AS backup_id,
 user_id, CASE WHEN event_id % 3 = 0 THEN props ELSE concat('{"primary_name": "P', CAST(user_id AS varchar(20)), '"}') END AS payload, ts AS created_at,
 CASE event_type WHEN 'error' THEN 'reverted' WHEN 'signup' THEN CAST(NULL AS varchar(20)) ELSE 'active' END AS status FROM events
""",
    "references": """
SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS attr_id, l_orderkey AS entity_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'sp_player' WHEN 1 THEN 'sp_offense' WHEN 2 THEN 'sp_defense' ELSE 'sp_other' END AS key,
 CAST(l_suppkey AS varchar(20)) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey
""",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


#: Rows of a part into which a table is dealt.
PART_ROWS = 500_000


def dealt(df: DataFrame, column: str, rows: int = PART_ROWS) -> DataFrame:
    """A table of files, its rows of one key in one part. The number of parts grows with the table, so a part does not; counting reads the files' ends only."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, column)


def relation(spark: SparkSession, sf_dir: str, name: str, by_order: bool = False, rows: int = PART_ROWS) -> DataFrame:
    """``by_order``: lines are dealt by their order, ``rows`` a part, which serves groups within an order and joins by it, too."""
    text = RELATIONS[name].replace("varchar(20)", "string").replace("{", "{{").replace("}", "}}")
    used = {t: df for t, df in tables(spark, sf_dir).items() if f" {t}" in text or f"\n{t}" in text}
    if by_order:
        used["lineitem"] = dealt(used["lineitem"], "l_orderkey", rows)
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}")
    return spark.sql(text, **used)


def with_relations(*names: str) -> str:
    """The start of a DuckDB statement over these relations."""
    return "WITH RECURSIVE " + ",\n".join(f'"{n}" AS ({RELATIONS[n]})' for n in names)
