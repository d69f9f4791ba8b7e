"""Line dedup by a log-template tree, with DataFrame functions alone.

A line is parsed by a tree of fixed depth: the number of its tokens, then its leading tokens; a token with a digit is a
variable field. In each leaf the tokens of a place that too few documents share become variable fields, too, and what is
left of the line is its template. A template is recurring if its lines stand in ``min_docs`` documents and at least
``constant`` of its fields are constant; lines of recurring templates that have ``min_tokens`` tokens are dropped,
everywhere. A passage, a line of ``long_tokens`` tokens or more, recurs by itself from two documents on that have the same masked
line; unless its template is dropped anyway the document with the least id keeps it, so that copies of a text don't empty
each other.

Everything is counted on hashes: first by (leaf, line), so a line that a third of all documents share is a row per map task
and then one row; leaves of too few documents can hold no recurring template, and their lines go no further. The text
of each other line is fetched from one document that has it, by a join on (id, line), which no line or leaf can make
hot. Supports and recurrences count distinct ids: where an id has several lines of one leaf (numbered rows, log files), which
is looked up apart, it is taken off the sums again except once. Rows without an id count as one document, and are cleaned row by row.

Defined results: a null text counts as empty and stays null; an empty text has one empty line, which stays. Line feeds
between lines that stay are kept. Rows that repeat an id are cleaned together, each by the same decisions, and count as one
document. An empty table gives an empty result. Other columns are carried if asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.common import Workspace

FIELD = "<*>"


def masked(line):
    """A line with single spaces, and the variable field in place of each token with a digit."""
    line = F.trim(line)
    odd = F.contains(line, F.lit("  "))
    for blank in "\t\r\x0b\f":
        odd = odd | F.contains(line, F.lit(blank))
    line = F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"\S*[0-9]\S*", FIELD)).otherwise(line)


def once(c):
    """c as a row of its own: nothing above computes it a second time."""
    return F.explode(F.array(c))


def tokens(line):
    """How many tokens a masked line has."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def parsed(docs: DataFrame, id_col: str, text_col: str, min_tokens: int, depth: int) -> DataFrame:
    """(id, line, h, n, leaf): the masked form of each distinct line of each document that has enough tokens, its hash and tokens."""
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array_distinct(F.split(F.col(f"`{text_col}`"), "\n"))).alias("raw"))
    some = lines.select("id", once(masked(F.col("raw"))).alias("line")).select("id", "line", once(tokens(F.col("line"))).alias("n")).filter(F.col("n") >= min_tokens)
    return some.select("id", "line", F.xxhash64("line").alias("h"), "n", F.xxhash64("n", F.substring_index("line", " ", depth)).alias("leaf"))


def several(facts: DataFrame, work: Workspace) -> DataFrame | None:
    """(id, leaf, line, c): the masked lines, and how often, of ids that have several lines of a leaf; None if there are none."""
    pairs = work.write(facts.groupBy("id", "leaf").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("of"), F.col("leaf").alias("in_leaf")), "pairs")
    if not pairs.limit(1).count():
        return None
    own = facts.join(pairs, F.col("id").eqNullSafe(F.col("of")) & (F.col("leaf") == F.col("in_leaf")), "left_semi")
    return work.write(own.groupBy("id", "leaf", F.col("h").alias("line")).agg(F.count("*").alias("c")), "several")


def documents_of(rows: DataFrame, own: DataFrame | None, *key: str) -> DataFrame:
    """Distinct ids of each key: the sum of rows' n_docs, less what an id with several lines adds beyond one."""
    counts = rows.select(*key, "n_docs")
    if own is not None:
        beyond = rows.drop("n_docs").join(own, ["leaf", "line"]).groupBy("id", *key).agg((1 - F.sum("c")).alias("n_docs")).filter("n_docs < 0")
        counts = counts.unionByName(beyond.select(*key, "n_docs"))
    return counts.groupBy(*key).agg(F.sum("n_docs").alias("total"))


def recurring(facts: DataFrame, lines: DataFrame, min_docs: int, constant: float, long_tokens: int, own: DataFrame | None, work: Workspace) -> DataFrame:
    """(line, template, n_docs, keeper): the hash of each masked line to drop, its template and in how many documents that recurs;
    of passages the id that keeps it instead.

    facts: (id, leaf, h, n) of all lines; lines: (id, h, line) of all lines; own: what several() finds.
    """
    counts = facts.groupBy("leaf", "h", "n").agg(F.count("*").alias("n_docs"), F.count("id").alias("named"), F.min("id").alias("rep"), F.max("id").alias("other"))
    busy = counts.groupBy("leaf").agg(F.sum("n_docs").alias("all_docs")).filter(F.col("all_docs") >= min_docs).select("leaf")
    wanted = counts.join(busy, "leaf").select(F.col("rep").alias("id"), "h", "leaf", "n_docs")
    # read three times below
    named = lines.select("id", "h", "line").join(wanted, ["id", "h"]).select("leaf", "h", "line", "n_docs")
    nameless = lines.filter("id is null").select("h", "line").join(wanted.filter("id is null").drop("id"), "h").select("leaf", "h", "line", "n_docs")
    distinct = work.write(named.unionByName(nameless).distinct(), "candidates")
    fields = distinct.select("leaf", F.col("h").alias("line"), "n_docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    support = documents_of(fields, own, "leaf", "at", "token").withColumnRenamed("total", "support")
    general = fields.join(support, ["leaf", "at", "token"]).withColumn("field", F.when((F.col("support") >= min_docs) & (F.col("token") != FIELD), F.col("token")).otherwise(FIELD))
    templates = general.groupBy("leaf", "line", "n_docs").agg(F.array_sort(F.collect_list(F.struct("at", "field")))["field"].alias("fields"))
    enough = templates.filter(F.size(F.filter("fields", lambda t: t != FIELD)) >= constant * F.size("fields"))
    totals = documents_of(enough, own, "leaf", "fields").filter(F.col("total") >= min_docs)
    found = enough.join(totals, ["leaf", "fields"]).select("line", F.array_join("fields", " ").alias("template"), F.col("total").alias("n_docs"), F.lit(None).cast(facts.schema["id"].dataType).alias("keeper"))
    twice = (F.col("rep") != F.col("other")) | ((F.col("named") > 0) & (F.col("named") < F.col("n_docs")))
    passages = counts.filter((F.col("n") >= long_tokens) & twice).select(F.col("h").alias("line"), F.lit(None).cast("string").alias("template"), "n_docs", F.col("rep").alias("keeper"))
    return found.unionByName(passages)


def _without_id(base: DataFrame, known: DataFrame, n_lines, names: list[str], work: Workspace) -> DataFrame:
    """Rows without an id, each cleaned by itself: its lines meet the known ones one by one, and what is left is put together again."""
    rows = work.write(base.withColumn("row", F.monotonically_increasing_id()), "without-id")
    lines = rows.select("row", F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("h", F.xxhash64(masked(F.col("raw"))))
    left = lines.join(known.select("known"), F.col("h") == F.col("known"), "left_anti").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "raw")))["raw"].alias("kept"))
    kept = F.when(F.col("text").isNotNull(), F.coalesce("kept", F.array().cast("array<string>")))
    return rows.join(left, "row", "left").select("key", "text", n_lines.alias("n"), kept.alias("kept"), *names)


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), depth: int = 3, min_docs: int = 10, min_tokens: int = 5, constant: float = 0.6, long_tokens: int = 50, work: Workspace | None = None) -> DataFrame:
    """id, text without the lines of recurring templates, n_lines, n_dropped; and the columns of ``carry``.

    The templates themselves are left in the workspace's table ``known``.
    """
    work = work or Workspace(docs.sparkSession, "line-templates")
    lines = parsed(docs, id_col, text_col, min_tokens, depth)
    facts = work.write(lines.select("id", "leaf", "h", "n"), "facts")
    known = work.write(recurring(facts, lines, min_docs, constant, long_tokens, several(facts, work), work), "known")
    # each document's lines to drop: a set of hashes no larger than the document
    known = known.groupBy(F.col("line").alias("known")).agg(F.min("keeper").alias("keeper"), F.bool_or(F.col("keeper").isNull()).alias("all"))
    found = facts.join(known, F.col("h") == F.col("known")).filter("id is not null and (all or id <> keeper)").groupBy("id").agg(F.collect_set("h").alias("drop"))
    # carried columns get plain names meanwhile, so that none can clash
    carry = [c for c in carry if c not in (id_col, text_col)]
    names = [f"c{k}" for k in range(len(carry))]
    base = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    out = base.filter("key is not null").join(found, F.col("key") == F.col("id"), "left")
    kept = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("drop", F.xxhash64(masked(line))))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    some = out.select("key", "text", n_lines.alias("n"), F.when(F.col("drop").isNotNull(), kept).alias("kept"), *names)
    some = some.unionByName(_without_id(base.filter("key is null"), known, n_lines, names, work))
    return some.select(
        F.col("key").alias(id_col),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias(text_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)],
    )
