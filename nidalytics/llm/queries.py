"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nidalytics.llm import audit, bpe, chunks, lexical, lines, lm, mixing, nearest, quality, repeats, simhash, unigram, warc
from nidalytics.llm.common import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
DOCUMENTS = "doc_id long, text string, source string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", DOCUMENTS)


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query()
def op1_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm.scores(documents(spark, sf), RANKS, PATTERN)


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS x, strlen(coalesce(html, '')) AS n FROM pages),
    g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY x) END AS first FROM p)
    SELECT page_id, n AS payload_bytes, sha256(x) AS payload_digest,
      CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM g"""
)
def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(read(spark, sf, "pages", "page_id long, url string, html string"))


@query()
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(documents(spark, sf), RANKS, PATTERN)


@query(
    f"""
    WITH t AS (SELECT doc_id, {LOWER} AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY x)"""
)
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.copies(documents(spark, sf))


@query()
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf))


# lines, words and windows of each row; r numbers the rows
QUALITY = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
    three AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
    many AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM three WHERE g IS NOT NULL) WHERE n > 1),
    hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + d AS i FROM many, (VALUES (0), (1), (2)) AS s(d)) GROUP BY r),
    per_word AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
      count(*) FILTER (WHERE regexp_matches(w, '\p{L}')) AS lettered FROM words GROUP BY r),
    lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM docs),
    per_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup,
      count(*) FILTER (WHERE regexp_matches(l, '^[\x20\x09-\x0D]*[-*\x{2022}]')) AS bullets,
      count(*) FILTER (WHERE regexp_matches(l, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) AS dots
      FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
    facts AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
      coalesce(h.n, 0)::BIGINT AS n_repeat_words, coalesce(lettered, 0) AS lettered, coalesce(n_lines, 0) AS n_lines,
      coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots
      FROM docs d LEFT JOIN per_word USING (r) LEFT JOIN per_line USING (r) LEFT JOIN hit h USING (r)),
    base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)"""


@query(
    QUALITY
    + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
        OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * lettered < 70 * n_words OR 100 * bullets > 90 * n_lines
        OR 100 * dots > 30 * n_lines) AS kept
    FROM base"""
)
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(documents(spark, sf))


# every two distinct word sets that share a word are counted
@query(
    r"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lines AS (SELECT r, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line_no FROM rows),
    placed AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, r, line_no) AS place,
      list_sort(list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS s FROM lines),
    sets AS (SELECT s, min(place) AS first, len(s) AS n FROM placed WHERE len(s) > 0 GROUP BY s),
    words AS (SELECT first, n, unnest(s) AS w FROM sets),
    near AS (SELECT DISTINCT a FROM (SELECT a.first AS a, b.first AS b FROM words a JOIN words b
        ON a.w = b.w AND b.first < a.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.first, b.first, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n))),
    gone AS (SELECT p.r, p.line_no FROM placed p JOIN sets USING (s) WHERE p.place > first OR first IN (SELECT a FROM near))
    SELECT doc_id, count(*) FILTER (WHERE len(s) > 0) AS n_lines, count(g.r) AS n_removed,
      coalesce(array_to_string(list_sort(list(g.line_no) FILTER (WHERE g.r IS NOT NULL)), ','), '') AS removed
    FROM placed p LEFT JOIN gone g ON p.r = g.r AND p.line_no = g.line_no GROUP BY p.r, doc_id"""
)
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.repeated_lines(documents(spark, sf)).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


# targets by water filling; v is the place in the Pareto order
MIX = rf"""
    WITH digests AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
      md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(source, 'null') || '|' || md5(coalesce(text, ''))) AS digest FROM documents),
    turns AS (SELECT *, row_number() OVER (PARTITION BY digest) - 1 AS turn FROM digests),
    rows AS (SELECT doc_id, source, size, ('0x' || substr(CASE WHEN turn = 0 THEN digest ELSE md5(digest || '|' || turn) END, 1, 12))::BIGINT
        / 281474976710656.0::DOUBLE AS u FROM turns),
    placed AS (SELECT *, u / (u + (1 - u) * sqrt(size + 1.0::DOUBLE)) AS v FROM rows),
    sums AS (SELECT source, sum(size)::BIGINT AS s FROM rows GROUP BY source),
    weighted AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM sums),
    filled AS (SELECT *, (sum(s) OVER () - coalesce(3 * sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_words,
      (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_weight
      FROM weighted WINDOW o AS (ORDER BY s / w, source NULLS LAST)),
    level AS (SELECT left_words, left_weight FROM filled WHERE 3 * s * left_weight > w * left_words ORDER BY left_weight DESC LIMIT 1),
    target AS (SELECT f.source, s, least((3 * s)::DOUBLE, coalesce((w * l.left_words)::DOUBLE / l.left_weight, (3 * s)::DOUBLE)) AS target
      FROM filled f LEFT JOIN level l ON true),
    parts AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM target),
    celled AS (SELECT p.*, t.s, t.target, t.whole, t.target - t.whole * t.s AS remains, ceil(n / 1000.0::DOUBLE) AS cells,
      sqrt(t.s::DOUBLE / n + 1) AS g FROM placed p JOIN parts t ON p.source IS NOT DISTINCT FROM t.source
      JOIN (SELECT source, count(*)::DOUBLE AS n FROM rows GROUP BY source) c ON p.source IS NOT DISTINCT FROM c.source),
    ordered AS (SELECT *, row_number() OVER () AS r, least(floor(v * g / (v * g + 1 - v) * cells), cells - 1) AS cell FROM celled),
    -- the order up to the document that would exceed the target, then what fits of the rest of its cell
    p1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= remains AS t1 FROM ordered),
    last AS (SELECT source, min(cell) AS last_cell FROM (SELECT source, cell, remains,
      sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS upto FROM ordered GROUP BY source, cell, remains) WHERE upto >= remains GROUP BY source),
    e1 AS (SELECT p1.*, cell IS NOT DISTINCT FROM last_cell AS here,
      remains - coalesce(sum(size) FILTER (WHERE t1) OVER (PARTITION BY p1.source), 0) AS gap FROM p1 LEFT JOIN last ON p1.source IS NOT DISTINCT FROM last.source),
    p2 AS (SELECT *, t1 OR (fits AND sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= gap) AS t2
      FROM (SELECT *, here AND NOT t1 AND size BETWEEN 1 AND gap AS fits FROM e1)),
    e2 AS (SELECT * EXCLUDE (gap, fits), remains - coalesce(sum(size) FILTER (WHERE t2) OVER (PARTITION BY source), 0) AS gap FROM p2),
    p3 AS (SELECT *, t2 OR (fits AND sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= gap) AS t3
      FROM (SELECT *, here AND NOT t2 AND size BETWEEN 1 AND gap AS fits FROM e2)),
    e3 AS (SELECT * EXCLUDE (gap, fits), remains - coalesce(sum(size) FILTER (WHERE t3) OVER (PARTITION BY source), 0) AS gap FROM p3),
    p4 AS (SELECT *, t3 OR (fits AND sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= gap) AS t4
      FROM (SELECT *, here AND NOT t3 AND size BETWEEN 1 AND gap AS fits FROM e3)),
    e4 AS (SELECT * EXCLUDE (gap, fits), remains - coalesce(sum(size) FILTER (WHERE t4) OVER (PARTITION BY source), 0) AS gap FROM p4)"""


@query(
    MIX
    + """
    SELECT doc_id, size, s AS source_size, target, (size * (whole + CASE WHEN remains > 0 AND t4 THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM e4"""
)
def op8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf))


@query()
def op9_chunk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.repeated(documents(spark, sf)).drop("text_key")


@query()
def op10_unigram_count(spark: SparkSession, sf: str) -> DataFrame:
    return unigram.token_counts(documents(spark, sf), PIECES)


@query(
    """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr,
      coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr)::INT AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
)
def op11_top_k(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "embeddings", "vec_id long, embedding array<float>")
    return nearest.top_inner_products(table, F.col("vec_id") % 50 == 0)


@query(
    r"""
    WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    facts AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
    marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    masks AS (SELECT f.doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(f.doc_id > first, false)::INT AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM facts f LEFT JOIN marks m ON f.doc_id = m.doc_id),
    counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM masks GROUP BY part, fails),
    f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.name || b.name || c.name || d.name || e.name AS filter_order
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31),
    steps AS (SELECT filter_order, step, bits[step] AS mine, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS s(step)),
    told AS (SELECT part, filter_order, step::INT AS step, mine,
        coalesce(sum(n) FILTER (fails & (before | mine) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fails & before = 0 AND fails & mine > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails & before > 0 AND fails & mine > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = mine), 0)::BIGINT AS unique_fails,
        coalesce(sum(n_good) FILTER (fails & before = 0 AND fails & mine > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(n_toxic) FILTER (fails & before = 0 AND fails & mine > 0), 0)::BIGINT AS toxic_lost
      FROM counted, steps GROUP BY part, filter_order, step, mine)
    SELECT * EXCLUDE (mine), (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM told"""
)
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id long, text string, lang string")
    return audit.five_filters(docs, read(spark, sf, "labels", "doc_id long, quality int, toxic int"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    f"""
    WITH rows AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ts FROM documents),
    sized AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM rows),
    total AS (SELECT count(*) FILTER (n > 0)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
    asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
    found AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM sized) SEMI JOIN asked USING (t) GROUP BY r, t),
    weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY t, docs),
    scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM asked JOIN weights USING (t) JOIN found USING (t) JOIN sized USING (r), total GROUP BY item_id, r, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
)
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(read(spark, sf, "benchmark", "item_id long, text string"), read(spark, sf, "documents", "doc_id long, text string"))
