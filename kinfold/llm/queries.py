"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import ann, byte_bpe, chat, divergence, langid, lines, mixing, near_dedup, prefix_tokens, quality, repeats, runs, warc

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

TOKEN_LIMIT = 4096


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, r)
), told AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p'))
    + length('<|im_start|><|im_end|>') + 2 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id"""


@query("op1_chat_format", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(given.unionByName(extra)))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedupe_lines(table(spark, sf_dir, "documents", "doc_id", "text"), search="segments", equal_least=1)
    return done.select("row.doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    learned = langid.train(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", langid.predict(learned, "text").alias("p")).select("doc_id", "held_out", "p.*")


@query("op4_graph_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(ann.build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))


@query("op5_prefix_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = docs.withColumn("p", prefix_tokens.prefix_changes("text"))
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("p.n_tokens").alias("n_tokens"), (F.col("p.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), own AS (
  SELECT source, source_size, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), level AS (
  SELECT cap / weight AS ratio, sum(cap) AS cap_at, sum(weight) AS weight_at FROM own GROUP BY 1
), swept AS (
  SELECT ratio, ((SELECT sum(source_size) FROM own) - coalesce(sum(cap_at) OVER earlier, 0))
    / ((SELECT sum(weight) FROM own) - coalesce(sum(weight_at) OVER earlier, 0)) AS share FROM level
  WINDOW earlier AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN s.share IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), s.share * weight) END AS target,
    CAST(('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM own, (SELECT min_by(share, ratio) AS share FROM swept WHERE share <= ratio) AS s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM docs WHERE size > 0
  UNION ALL SELECT *, NULL FROM docs WHERE size = 0
), counted AS (
  SELECT doc_id, size, source_size, target,
    coalesce(least(floor(place * (target / source_size) + u) - floor((place - 1) * (target / source_size) + u), 3), 0) AS copies
  FROM ranked JOIN goals ON ranked.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM counted"""


@query("op6_source_mixing", MIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query("op7_hyperminhash_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = byte_bpe.encode(docs).select("doc_id", "ids", byte_bpe.decode("ids").alias("raw"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


DIVERGENCE_SQL = r"""
WITH given AS (
  SELECT doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), counted AS (
  SELECT doc_id, lang, w, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) AS upper, length(regexp_replace(body, '[^.,;:!?]', '', 'g')) AS marks,
    length(body) AS chars, strlen(body) AS bytes FROM given
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, piece) AS c FROM (
    SELECT doc_id, i, list_slice(w, i, i + 7) AS piece FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM counted WHERE n_words >= 8))
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows WHERE c > 1) GROUP BY 1
), shares AS (
  SELECT doc_id, lang, n_words, k, [upper, n_symbols, marks, chars - word_chars, bytes - chars, greatest(word_chars - upper - marks - n_symbols, 0)][k] / greatest(bytes, 1) AS p
  FROM counted, (SELECT unnest(range(1, 7)) AS k)
), class_reference AS (
  SELECT lang, k, quantile_cont(round(p, 4), 0.5) AS q FROM shares GROUP BY 1, 2
), spoken AS (
  SELECT doc_id, lang, lower(replace(x, '|', '')) AS word FROM (SELECT doc_id, lang, unnest(w) AS x FROM counted)
), ranked AS (
  SELECT lang, word, count(*) AS q, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM spoken WHERE word <> '' GROUP BY 1, 2
), top AS (
  SELECT * FROM ranked WHERE k <= 16
), known AS (
  SELECT lang, sum(q) AS q FROM top GROUP BY 1
), totals AS (
  SELECT lang, sum(n_words) AS n FROM counted GROUP BY 1
), hits AS (
  SELECT doc_id, lang, word, count(*) AS p FROM spoken GROUP BY 1, 2, 3
), word_bins AS (
  SELECT c.doc_id, t.k, coalesce(h.p, 0) AS p, t.q FROM counted c JOIN top t ON c.lang IS NOT DISTINCT FROM t.lang LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.word = t.word
), bins AS (
  SELECT 'c' AS part, doc_id, p, q FROM shares JOIN class_reference r ON shares.lang IS NOT DISTINCT FROM r.lang AND shares.k = r.k
  UNION ALL SELECT 'w', doc_id, p, q FROM word_bins
  UNION ALL SELECT 'w', c.doc_id, greatest(c.n_words - b.p, 0), t.n - k.q FROM counted c JOIN (SELECT doc_id, sum(p) AS p FROM word_bins GROUP BY 1) b ON b.doc_id = c.doc_id
    JOIN known k ON c.lang IS NOT DISTINCT FROM k.lang JOIN totals t ON c.lang IS NOT DISTINCT FROM t.lang
), scaled AS (
  SELECT part, doc_id, p / nullif(sum(p) OVER own, 0) AS x, q / nullif(sum(q) OVER own, 0) AS y FROM (SELECT part, doc_id, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM bins)
  WINDOW own AS (PARTITION BY part, doc_id)
), far AS (
  SELECT part, doc_id, sqrt(greatest(sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2), 0)) AS d
  FROM scaled WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2
), judged AS (
  SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, len(c.lines) - len(list_distinct(c.lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    a.d AS character_distance, b.d AS word_distance, c.n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * c.n_words AS base_failed
  FROM counted c LEFT JOIN repeated r USING (doc_id) LEFT JOIN far a ON a.doc_id = c.doc_id AND a.part = 'c' LEFT JOIN far b ON b.doc_id = c.doc_id AND b.part = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, round(character_distance, 6) AS character_distance, round(word_distance, 6) AS word_distance,
  base_failed, NOT base_failed AND NOT (coalesce(character_distance, 0) > 0.16 AND n_words >= 20) AND NOT (coalesce(word_distance, 0) > 0.33 AND n_words >= 50) AS kept FROM judged"""


@query("op9_divergence_rules", DIVERGENCE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.divergence_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.round("character_distance", 6).alias("character_distance"),
        F.round("word_distance", 6).alias("word_distance"), "base_failed", "kept")


WARC_SQL = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), chief AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM own
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM chief"""


@query("op10_warc_chain", WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


RUN_SQL = r"""
WITH given AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), hashed AS (
  SELECT doc_id, w, len(w) AS n, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, b: STEPS) AS raw FROM given
), planted AS (
  SELECT doc_id, w, n, xor(raw, 4294967295) AS h, CAST(floor(xor(raw, 4294967295) / 10) AS BIGINT) AS g FROM hashed
), placed AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM planted
), words AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM placed
), word AS (
  SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM words
), equal AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
  FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), run AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM run GROUP BY doc_id, start, length
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs)
), kept AS (
  SELECT word.doc_id, string_agg(w, ' ' ORDER BY i) AS body FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT given.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM given LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
CRC_STEP = "xor({0} >> 1, 3988292384 * ({0} & 1))"


def _crc_steps() -> str:
    """A byte enters the running CRC-32; eight steps of one bit, each named once so that the text stays short."""
    steps = "xor(h, b)"
    return f"list_reduce(list_prepend({steps}, CAST(range(8) AS BIGINT[])), lambda c, k: {CRC_STEP.format('c')})"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where a tenth of the texts goes on periodically from some word on, by the CRC-32 of the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    docs = docs.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    docs = docs.withColumn("p", period)
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", source(i).cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", RUN_SQL.replace("STEPS", _crc_steps()))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text")))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", runs.strongest("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), word AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n_all FROM word GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL
), lang_sum AS (
  SELECT lang, count(*) AS v, sum(n_all) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(s.total, 0) AS total, coalesce(l.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) s USING (lang, source) LEFT JOIN lang_sum l USING (lang)
), share AS (
  SELECT g.lang, g.source, k.term, CAST(1 + (1000000000 * (CAST(coalesce(n, 0) AS HUGEINT) + 1)) // (total + v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (CAST(n_all AS HUGEINT) + 1)) // (lang_total + v) AS BIGINT) AS r, coalesce(n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), valued AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN valued x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - r) * (p - r)) // r AS BIGINT) FROM share WHERE n > 0 AND p > r
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= 200"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


REPEAT_SQL = """
WITH given AS (
  SELECT row_number() OVER () AS d, doc_id, encode(coalesce(text, '')) AS raw, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), place AS (
  SELECT d, n, raw, unnest(range(n - 399)) AS i FROM given WHERE n >= 400
), string AS (
  SELECT d, i, md5(array_slice(raw, i + 1, i + 400)) AS h FROM place
), again AS (
  SELECT d, i FROM string SEMI JOIN (SELECT h FROM string GROUP BY h HAVING count(*) > 1) USING (h)
), edge AS (
  SELECT d, i, CASE WHEN i > 400 + lag(i, 1, -1000) OVER (PARTITION BY d ORDER BY i) THEN 1 ELSE 0 END AS new FROM again
), numbered AS (
  SELECT d, i, sum(new) OVER (PARTITION BY d ORDER BY i) AS span FROM edge
), span AS (
  SELECT d, min(i) AS low, max(i) + 400 AS high FROM numbered GROUP BY d, span
), bound AS (
  SELECT d, n, raw, coalesce(lag(high) OVER (PARTITION BY d ORDER BY low), 0) AS a, low AS b FROM (
    SELECT given.d, n, raw, low, high FROM given JOIN span USING (d) UNION ALL SELECT d, n, raw, n, NULL FROM given)
), kept AS (
  SELECT d, string_agg(CASE WHEN b > a THEN hex(array_slice(raw, a + 1, b)) ELSE '' END, '' ORDER BY a, b) AS raw FROM bound GROUP BY d
), told AS (
  SELECT d, count(*) AS n_spans, sum(high - low) AS n_removed FROM span GROUP BY d
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept.raw)) AS kept_sha256 FROM given JOIN kept USING (d) LEFT JOIN told USING (d)"""


@query("op13_repeated_substrings", REPEAT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
