"""The operators of this folder as queries over the given tables.

`QUERIES: {name: (function(spark, dir) -> DataFrame, SQL or None)}`. The SQL states a query's rows
where SQL can do so on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, jaccard, language, lines, packing, quality, quotes, resample, segments, substrings, toxicity, urls


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo a number; it decides who trains and who is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public tokenizer, by default that of the packing query; the file stays there."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(_read(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


def quoted_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The given conversations, whose messages quote nothing, as mail: each message quotes the one before.

    Every third quotes it whole below an announcement, with the one before that nested; every third breaks
    its lines after seven words; every third quotes its second half.
    """
    said = _read(spark, folder, "conversations")
    parts = F.split(F.trim(F.col("text")), r"\s+")

    def earlier(by: int) -> DataFrame:
        return said.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("text").alias(f"text_{by}"), parts.alias(f"parts_{by}"))

    def marked(lines: Column, mark: str) -> Column:
        return F.array_join(F.transform(lines, lambda line: F.concat(F.lit(mark), line)), "\n")

    half = F.floor(F.size("parts_1") / 2).cast("int")
    broken = F.transform(F.sequence(F.lit(0), F.size("parts_1") - 1, F.lit(7)), lambda i: F.array_join(F.slice("parts_1", i + 1, F.lit(7)), " "))
    quote = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("> "), F.array_join(F.slice("parts_1", half + 1, F.size("parts_1")), " ")))
        .when(F.col("turn") % 3 == 2, marked(broken, "> "))
        .otherwise(F.concat_ws("\n", F.lit("On that day they wrote:"), marked(F.split("text_2", "\n"), ">> "), marked(F.split("text_1", "\n"), "> ")))
    )
    mail = said.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    quoting = F.when(F.col("text_1").isNotNull(), quote)
    out = quotes.conversations(mail.withColumn("text", F.concat_ws("\n", quoting, "text")))
    return out.withColumnRenamed("conv", "conv_id")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.remove_repeats(_read(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.drop_lines(_read(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    keys = {name: F.col(name) for name in ("doc_id", "lang", "source")}
    judged = quality.judge(quality.measured(_read(spark, folder, "documents"), "text", keys))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_read(spark, folder, "pages"), "url", {"page_id": F.col("page_id")})


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    """From the labelled rows that are not held out."""
    return toxicity.fit(docs, _read(spark, folder, "labels").filter(remainder(5) != 0))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.score(docs, toxicity_model(spark, folder, docs), "text", {"doc_id": F.col("doc_id"), "held_out": remainder(5) == 0})


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "similarity")


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    model = language.fit(docs.filter(remainder(4) != 2))
    return language.predict(docs, model, "text", {"doc_id": F.col("doc_id"), "held_out": remainder(4) == 2})


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    out = jaccard.link(_read(spark, folder, "documents"), shingle=3, threshold=0.9)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links", "copies")


def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return segments.top_k(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    out = resample.resample(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    out = align.compare(_read(spark, folder, "documents"), *paths)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


LINE_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
first AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(doc_id > first_doc, false) AS gone FROM keyed k LEFT JOIN first USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SUBSTRING_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
    SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 12), 'string_agg', ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
again AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM windows) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM again),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words),
marked AS (SELECT e.*, g.i IS NOT NULL AS out FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i),
told AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT out), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN told USING (doc_id)
"""

TOP_K_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: A word's CRC-32 is folded over its bytes, bit by bit.
RESAMPLE_SQL = r"""
WITH texts AS (
    SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
    SELECT side, row, unnest(list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS word FROM texts),
spelled AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM words)),
hashed AS (
    SELECT word, xor(list_reduce(
        list_concat([4294967295::BIGINT], list_transform(range(0, len(digits) // 2), lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
        lambda crc, byte: list_reduce(
            list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 10000 AS bucket
    FROM spelled),
counts AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS total_s, sum(t) AS total_t FROM counts),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(total_s + 10000 AS DOUBLE)
        / (CAST(s + 1 AS DOUBLE) * CAST(total_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM counts, totals),
weights AS (
    SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
    FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
        (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM ranked
"""

QUOTE_SQL = r"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, regexp_split_to_array(trim(text), '\s+') AS parts FROM conversations),
quoted AS (
    SELECT a.conv_id, a.turn, 1 AS level,
        CASE WHEN a.turn % 3 = 0 THEN array_to_string(list_slice(b.parts, len(b.parts) // 2 + 1, len(b.parts)), ' ') ELSE b.text END AS passage
    FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
    UNION ALL
    SELECT a.conv_id, a.turn, 2, b.text FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn - 2 WHERE a.turn % 3 = 1),
worded AS (
    SELECT conv_id, turn, level, true AS is_quote, passage AS source_text FROM quoted
    UNION ALL SELECT conv_id, turn, 0, false, text FROM said
    UNION ALL SELECT conv_id, turn, 0, false, line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM said)
        WHERE len(regexp_extract_all(lower(line), '[\p{L}\p{N}_]+')) < 5),
words AS (SELECT *, regexp_extract_all(lower(source_text), '[\p{L}\p{N}_]+') AS w FROM worded),
grams AS (
    SELECT DISTINCT conv_id, turn, level, is_quote, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
first AS (SELECT conv_id, gram, min(turn) AS source FROM grams WHERE NOT is_quote GROUP BY ALL),
sizes AS (SELECT conv_id, turn, level, count(*) AS size FROM grams WHERE is_quote GROUP BY ALL),
votes AS (
    SELECT g.conv_id, g.turn, g.level, source, count(*) AS n FROM grams g JOIN first f ON g.conv_id = f.conv_id AND g.gram = f.gram
    WHERE is_quote AND source < g.turn GROUP BY ALL),
best AS (
    SELECT conv_id, turn, level, arg_min(source, (-n, source)) AS source FROM votes JOIN sizes USING (conv_id, turn, level)
    WHERE 4 * n >= size GROUP BY ALL),
told AS (
    SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked, arg_min(source, level) AS parent
    FROM sizes LEFT JOIN best USING (conv_id, turn, level) GROUP BY ALL),
placed AS (
    SELECT conv_id, turn, turn AS thread, 0 AS depth FROM said LEFT JOIN told USING (conv_id, turn) WHERE parent IS NULL
    UNION ALL
    SELECT t.conv_id, t.turn, p.thread, p.depth + 1 FROM placed p JOIN told t ON p.conv_id = t.conv_id AND p.turn = t.parent)
SELECT conv_id, thread, depth, turn, role, regexp_replace(regexp_replace(text, '^\s*\n', ''), '\s+$', '') AS text, parent,
    coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
FROM said JOIN placed USING (conv_id, turn) LEFT JOIN told USING (conv_id, turn)
"""

QUALITY_SQL = r"""
WITH words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (
    SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 7), 'string_agg', ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
    SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
rated AS (
    SELECT *, CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS m0, CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS m1,
        CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS m2, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS m3
    FROM counted),
micro AS (
    SELECT lang, source, unnest([0, 1, 2, 3, 4, 5]) AS m,
        CAST(floor(unnest([m0, m1, m2, m3, CAST(n_words AS DOUBLE), CAST(n_lines AS DOUBLE)]) * 1000000) AS BIGINT) AS v FROM rated),
bins AS (
    SELECT lang, source, m, CASE WHEN length(bin(v)) > 8 THEN (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) ELSE v END AS bin FROM micro),
grouped AS (
    SELECT 'own' AS grp, lang, source, m, bin FROM bins
    UNION ALL SELECT 'lang', lang, NULL, m, bin FROM bins
    UNION ALL SELECT 'all', NULL, NULL, m, bin FROM bins),
upto AS (
    SELECT DISTINCT grp, lang, source, m, bin, count(*) OVER (PARTITION BY grp, lang, source, m ORDER BY bin) AS upto,
        count(*) OVER (PARTITION BY grp, lang, source, m) AS n FROM grouped),
quantiles AS (
    SELECT grp, lang, source, m, max(n) AS n, CAST(min(bin) FILTER (100 * upto >= 25 * n) AS DOUBLE) / 1000000 AS q25,
        CAST(min(bin) FILTER (100 * upto >= 50 * n) AS DOUBLE) / 1000000 AS q50, CAST(min(bin) FILTER (100 * upto >= 75 * n) AS DOUBLE) / 1000000 AS q75
    FROM upto GROUP BY ALL),
sized AS (
    SELECT q.*, greatest(s.q50, 1.0::DOUBLE) AS size FROM quantiles q JOIN quantiles s
    ON q.grp = s.grp AND q.lang IS NOT DISTINCT FROM s.lang AND q.source IS NOT DISTINCT FROM s.source AND s.m = CASE q.m WHEN 1 THEN 5 ELSE 4 END
    WHERE q.m < 4),
cuts AS (
    SELECT grp, lang, source, m, n, 'high' AS side, q75 + 3.0::DOUBLE * greatest(q75 - q25, CASE m WHEN 2 THEN 16 ELSE 1 END / size) AS cut FROM sized
    UNION ALL SELECT grp, lang, source, 4, n, 'low', q25 - 3.0::DOUBLE * greatest(q75 - q25, 1 / size) FROM sized WHERE m = 3),
wider AS (
    SELECT l.lang, m, side, (l.n * l.cut + 200 * a.cut) / (l.n + 200) AS cut
    FROM cuts l JOIN cuts a USING (m, side) WHERE l.grp = 'lang' AND a.grp = 'all'),
limits AS (
    SELECT o.lang, o.source, m, side,
        (o.n * CASE side WHEN 'high' THEN least(o.cut, w.cut) ELSE greatest(o.cut, w.cut) END + 200 * w.cut) / (o.n + 200) AS cut
    FROM cuts o JOIN wider w USING (m, side) WHERE o.grp = 'own' AND o.lang IS NOT DISTINCT FROM w.lang),
flat AS (
    SELECT lang, source, max(cut) FILTER (m = 0) AS c0, max(cut) FILTER (m = 1) AS c1, max(cut) FILTER (m = 2) AS c2,
        max(cut) FILTER (m = 3) AS c3, max(cut) FILTER (m = 4) AS c4 FROM limits GROUP BY ALL),
judged AS (
    SELECT r.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        m0 <= c0 AND m1 <= c1 AND m2 <= c2 AND m3 <= c3 AND m3 >= c4 AS within
    FROM rated r JOIN flat f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept, n_lines FROM judged
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
grams AS (
    SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + 2), 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS class FROM grams GROUP BY doc_id),
classes AS (SELECT class, any_value(n) AS n, min(doc_id) AS least, count(*) AS copies FROM sets GROUP BY class),
members AS (SELECT class, n, g FROM classes JOIN grams ON doc_id = least),
pairs AS (
    SELECT x.class AS a, y.class AS b FROM members x JOIN members y ON x.g = y.g AND x.class <> y.class AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
    GROUP BY x.class, y.class, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT class AS node, class AS peer FROM classes UNION SELECT node, b FROM reach JOIN pairs ON peer = a),
components AS (SELECT node AS class, min(least) AS component_id FROM reach JOIN classes ON peer = class GROUP BY node),
degrees AS (SELECT a AS class, sum(copies) AS others FROM pairs JOIN classes ON b = class GROUP BY a)
SELECT doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    CAST(coalesce(copies - 1, 0) + coalesce(others, 0) AS BIGINT) AS n_links, coalesce(copies, 1) AS copies
FROM documents LEFT JOIN sets s USING (doc_id) LEFT JOIN classes USING (class) LEFT JOIN components USING (class) LEFT JOIN degrees USING (class)
"""

QUERIES = {
    "op1_chat_formatting": (op1_chat_formatting, None),
    "quoted_conversations": (quoted_conversations, QUOTE_SQL),
    "op2_substring_dedup": (op2_substring_dedup, SUBSTRING_SQL),
    "op3_line_dedup": (op3_line_dedup, LINE_SQL),
    "op4_quality_rules": (op4_quality_rules, QUALITY_SQL),
    "op5_url_filters": (op5_url_filters, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_packing": (op7_packing, None),
    "op8_benchmark_decontamination": (op8_benchmark_decontamination, None),
    "op9_language_id": (op9_language_id, None),
    "op10_ngram_jaccard_join": (op10_ngram_jaccard_join, JACCARD_SQL),
    "op11_exact_top_k": (op11_exact_top_k, TOP_K_SQL),
    "op12_importance_resampling": (op12_importance_resampling, RESAMPLE_SQL),
    "op13_cross_tokenizer_alignment": (op13_cross_tokenizer_alignment, None),
}
