"""The corpus operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merganser.llm.common import Workspace, crc32_text, documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.line_templates import drop_recurring_lines

    return drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.token_files import read_token_files, write_token_files

    work = Workspace(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), work.path("shards"), vocabulary("byte_bpe_50k.json"), work)
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.licenses import license_scan

    docs = documents(spark, sf_dir)
    # the table has no paths: each document is a folder of its own, so no statement spreads to unrelated documents
    return license_scan(docs, path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"), F.lit("text")))


def page_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence scan where files share folders: pages below the paths of their URLs inherit."""
    from merganser.llm.licenses import license_scan
    from merganser.llm.pages import page_path, page_text

    files = table(spark, sf_dir, "pages").select("page_id", page_path(F.col("url")).alias("path"), page_text(F.col("html")).alias("text"))
    return license_scan(files, "page_id", path=F.col("path"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.decontaminate import contaminated, contamination

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.packing import pack_best_fit

    packed = pack_best_fit(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.language_id import language_id, train

    docs = documents(spark, sf_dir)
    return language_id(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id",
        F.coalesce(F.expr(crc32_text("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__lang_score").alias("score"),
    )


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.chat import chat_digests, format_chats

    said = "</s>[INST] ok [/INST]"
    marked = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    return chat_digests(Workspace(spark, "chats").write(format_chats(turns), "formatted"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merganser.llm.collocations import collocations

    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_templates": op3_line_templates,
    "op4_token_files": op4_token_files,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_chat_format": op11_chat_format,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_collocations": op13_collocations,
    "page_license_scan": page_license_scan,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_MASKED = r"regexp_replace(regexp_replace(trim(raw, ' '), '[ \t\x0B\f\r]+', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g')"


def _license_sql(threshold: float = 0.8) -> str:
    from merganser.llm.licenses import LICENCE_FILE, TEMPLATES, WORD, vectors

    units, idf, other = vectors(TEMPLATES)
    template = ", ".join(f"({k}, '{TEMPLATES[k][0]}', '{w}', {x!r}::DOUBLE, {idf[w]!r}::DOUBLE)" for k, v in enumerate(units) for w, x in v.items())
    return rf"""
WITH template(k, license, word, x, idf) AS (VALUES {template}),
files AS (SELECT doc_id, concat_ws('/', source, lang, doc_id, 'text') AS path, lower(coalesce(text, '')) AS text FROM documents),
lines AS (SELECT doc_id, len(regexp_split_to_array(text, '[^a-z0-9]+')) AS size, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM files),
words AS (SELECT doc_id, size, i, regexp_extract_all(line, '{WORD}') AS w FROM lines),
each AS (SELECT doc_id, size, i, len(w) AS n, unnest(w) AS word FROM words),
y AS (SELECT doc_id, size, i, n, word, count(*) * coalesce((SELECT max(idf) FROM template t WHERE t.word = each.word), {other!r}::DOUBLE) AS y FROM each GROUP BY doc_id, size, i, n, word),
norms AS (SELECT doc_id, i, sqrt(sum(y * y)) AS norm FROM y GROUP BY doc_id, i),
dots AS (SELECT doc_id, i, size, n, k, license, sum(x * y) AS dot FROM y JOIN template USING (word) GROUP BY doc_id, i, size, n, k, license),
scored AS (SELECT doc_id, license, n, size, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, i) WHERE round(dot / norm, 6) >= {threshold}),
best AS (SELECT doc_id, license, score, 2 * n >= size AS alone FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, n DESC, size) = 1),
named AS (SELECT f.doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, license, score, alone FROM files f LEFT JOIN best b ON b.doc_id = f.doc_id),
licensed AS (SELECT dir AS above, license AS of_ FROM named WHERE license IS NOT NULL AND (alone OR regexp_matches(name, '{LICENCE_FILE}')) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
up AS (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM named WHERE license IS NULL)),
near AS (SELECT dir, above AS from_, of_ FROM (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM up) JOIN licensed USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY k DESC) = 1)
SELECT doc_id, coalesce(license, of_) AS license, score, CASE WHEN license IS NOT NULL THEN 'own' WHEN of_ IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN license IS NULL THEN from_ END AS inherited_from
FROM named LEFT JOIN near USING (dir)
"""


def _page_license_sql(threshold: float = 0.8) -> str:
    """Lines and then windows of pages, with folders by URL; what follows the statements is as in the scan of documents."""
    from merganser.llm.licenses import BLOCKS, TEMPLATES, WORD, necessary, vectors
    from merganser.llm.pages import ARTICLE, BEFORE, REPLACED

    every = TEMPLATES + BLOCKS
    units, idf, other = vectors(every)
    template = ", ".join(f"({k}, '{every[k][0]}', '{w}', {x!r}::DOUBLE, {idf[w]!r}::DOUBLE)" for k, v in enumerate(units) for w, x in v.items())
    listed = [re.findall(WORD, t.lower()) for _, t in every]
    places = {(w, at, len(words)) for v, words in zip(units, listed, strict=True) for at, w in enumerate(words) if w in necessary(v, threshold)}
    place = ", ".join(f"('{w}', {at}, {n})" for w, at, n in sorted(places))
    text = "article"
    for pattern, by in REPLACED:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')"
    files = rf"""pages_ AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS url, regexp_replace(lower(html), '{BEFORE}', '\1') AS html FROM pages),
articles AS (SELECT page_id, lower(regexp_extract(url, '^[^/]*')) || coalesce(nullif(regexp_extract(url, '(?s)/.*$'), ''), '/') AS path, coalesce(nullif(regexp_extract(html, '{ARTICLE}', 1), ''), html) AS article FROM pages_),
files AS (SELECT page_id AS doc_id, path, coalesce({text}, '') AS text FROM articles),"""
    windows = rf"""template_(k, license, word, x, idf) AS (VALUES {template}),
place(word, at_, n) AS (VALUES {place}),
rest AS (SELECT doc_id, len(regexp_split_to_array(text, '[^a-z0-9]+')) AS size, regexp_extract_all(text, '{WORD}') AS w FROM files ANTI JOIN best_ USING (doc_id)),
laid AS (SELECT DISTINCT doc_id, size, w[greatest(p - at_, 1):greatest(p - at_, 1) + n - 1] AS w FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM rest) r JOIN place ON place.word = r.w[p]),
told AS (SELECT doc_id, size, row_number() OVER () AS i, w FROM laid),
each_ AS (SELECT doc_id, size, i, len(w) AS n, unnest(w) AS word FROM told),
y_ AS (SELECT doc_id, size, i, n, word, count(*) * coalesce((SELECT max(idf) FROM template_ t WHERE t.word = each_.word), {other!r}::DOUBLE) AS y FROM each_ GROUP BY doc_id, size, i, n, word),
norms_ AS (SELECT i, sqrt(sum(y * y)) AS norm FROM y_ GROUP BY i),
dots_ AS (SELECT doc_id, i, size, n, k, license, sum(x * y) AS dot FROM y_ JOIN template_ USING (word) GROUP BY doc_id, i, size, n, k, license),
scored_ AS (SELECT doc_id, license, n, size, round(dot / norm, 6) AS score FROM dots_ JOIN norms_ USING (i) WHERE round(dot / norm, 6) >= {threshold}),
best AS (SELECT * FROM best_ UNION ALL SELECT doc_id, license, score, 2 * n >= size AS alone FROM scored_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, n DESC, size) = 1),
named AS"""
    sql = re.sub(r"(?m)^files AS .*$", lambda _: files, _license_sql(threshold)).replace("\nbest AS (", "\nbest_ AS (").replace("named AS", windows, 1)
    return f"SELECT doc_id AS page_id, license, score, origin, inherited_from FROM ({sql})"


def _chat_sql() -> str:
    said = "'</s>[INST] ok [/INST]'"
    marks = r"regexp_replace(regexp_replace({}, '(<)(\\*(\||/?s>|</?SYS>>))', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g')"
    return f"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
-- an opening mark is 12 code points, a role and a line end; a closing one 11; one between texts of a message 10
m AS (SELECT *, length({marks.format("text")}) AS size, CASE WHEN before = role THEN 10 ELSE 12 + 1 + 11 + length(replace(replace({marks.format("role")}, chr(92), chr(92) || 'b'), chr(10), chr(92) || 'n')) END AS marks FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
 length(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size + marks) AS BIGINT) AS formatted_chars, count(DISTINCT turn // 1024) AS n_sections
FROM m GROUP BY conv_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_exact_dedup": rf"""
WITH d AS (SELECT doc_id, {_NORM} AS norm, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id,
 first_value(doc_id) OVER w AS keep_id,
 count(*) OVER (PARTITION BY norm) AS group_size,
 row_number() OVER w = 1 AS kept,
 sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
 SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS sh FROM w, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
 UNION ALL SELECT doc_id, list_aggregate(w, 'string_agg', ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op7_decontamination": rf"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
 SELECT item, 13 AS n, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s FROM iw, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
 UNION ALL SELECT item, len(w), list_aggregate(w, 'string_agg', ' ') FROM iw WHERE len(w) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
occ AS (SELECT DISTINCT p.doc_id, p.i, p.n, win.item FROM places p JOIN win ON win.n = p.n AND win.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op3_line_templates": rf"""
WITH raw AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
m AS (SELECT doc_id, raw, {_MASKED} AS line FROM raw),
l AS (SELECT DISTINCT doc_id, line, string_split(line, ' ') AS t FROM m WHERE len(string_split(line, ' ')) >= 5),
f AS (SELECT doc_id, line, len(t) AS n, t[1:3] AS head, at_, t[at_] AS token FROM l, unnest(range(1, len(t) + 1)) AS u(at_)),
s AS (SELECT n, head, at_, token, count(DISTINCT doc_id) AS support FROM f GROUP BY n, head, at_, token),
g AS (SELECT line, n, head, list(CASE WHEN support >= 10 AND token <> '<*>' THEN token ELSE '<*>' END ORDER BY at_) AS fields
 FROM (SELECT DISTINCT line, n, head, at_, token FROM f) JOIN s USING (n, head, at_, token) GROUP BY line, n, head),
e AS (SELECT * FROM g WHERE len(list_filter(fields, lambda x: x <> '<*>')) >= 0.6 * n),
k AS (SELECT n, head, fields FROM e JOIN l USING (line) GROUP BY n, head, fields HAVING count(DISTINCT doc_id) >= 10),
passages AS (SELECT line, min(doc_id) AS keeper FROM l WHERE len(t) >= 50 GROUP BY line HAVING count(DISTINCT doc_id) >= 2),
drops AS (SELECT doc_id, raw FROM m JOIN e USING (line) JOIN k USING (n, head, fields) UNION SELECT doc_id, raw FROM m JOIN passages USING (line) WHERE doc_id <> keeper),
every AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
c AS (SELECT doc_id, count(*) AS n_lines, count(drops.raw) AS n_dropped, coalesce(string_agg(every.raw, chr(10) ORDER BY i) FILTER (WHERE drops.raw IS NULL), '') AS kept
 FROM every LEFT JOIN drops USING (doc_id, raw) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256 FROM documents LEFT JOIN c USING (doc_id)
""",
    "op5_license_scan": _license_sql(),
    "page_license_scan": _page_license_sql(),
    "op11_chat_format": _chat_sql(),
    "op13_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase FROM w, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
inner_ AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longer FROM f, unnest(range(2, m)) AS s(k), unnest(range(1, m - k + 2)) AS t(i) GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN inner_ i ON i.lang = f.lang AND i.phrase = f.phrase WHERE m >= 2 AND (longer IS NULL OR 100 * longer < 100 * f)),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS left_, array_to_string(w[k + 1:], ' ') AS right_ FROM kept, unnest(range(1, m)) AS s(k)),
scored AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n, CAST(1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
 FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = left_ JOIN f r ON r.lang = c.lang AND r.phrase = right_ JOIN sizes ON sizes.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
""",
}
