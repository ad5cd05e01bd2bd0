"""The numbered queries: thin contracts over the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import collocations, compression_quality, importance, license_scan, mixing, ngram_join, ogg, pii, quality_rules, sentencepieces, simhash, suffix_dedup, token_cache
from tarnwork.llm.common import shared_dir, table, texts

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2")
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(table(spark, sf_dir, "documents")).select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    n = F.octet_length("raw").cast("bigint")
    padded = F.greatest(F.lit(1), F.ceil(n / ogg.BLOCK)) * ogg.BLOCK
    fill = F.expr(f"unhex(repeat('ff', {ogg.BLOCK}))")
    payload = F.concat("raw", F.substring(fill, F.lit(1), (padded - n).cast("int"))).alias("payload")
    media = ogg.read_media(ogg.write_media(rows.select(F.struct("doc_id", n.alias("n_bytes")).alias("row"), payload), id_col="row"), id_col="row")
    return media.select(
        "row.doc_id", "row.n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model).select("doc_id", (~compression_quality.training_row()).alias("held_out"), "score", "predicted")


def encoded(docs: DataFrame) -> DataFrame:
    path = tokenizer_path(PIECES)
    rows = sentencepieces.decode(sentencepieces.encode(docs, path), path)
    joined = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " "), 256)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), joined("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), joined("span_ends").alias("span_ends_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{shared_dir(spark)}/tarnwork/token-counts-{uuid.uuid4().hex}"  # a new store: every distinct text is a miss
    counts = token_cache.cached_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTES), store)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def span_text(column: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), pii.tagger(spark))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules, "op2_license_scans": op2_license_scans, "op3_mixing": op3_mixing,
        "op4_media_columns": op4_media_columns, "op5_quality_classifier": op5_quality_classifier, "op6_sentencepiece": op6_sentencepiece,
        "op7_token_counts": op7_token_counts, "op8_suffix_dedup": op8_suffix_dedup, "op9_pii": op9_pii, "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_importance_resampling": op11_importance_resampling, "op12_simhash_near_dedup": op12_simhash_near_dedup,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op11_importance_resampling": OP11_SQL, "op13_phrase_collocations": OP13_SQL}


WORD_COUNT_SQL = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
OP3_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST({WORD_COUNT_SQL} AS BIGINT) AS size FROM documents),
goal AS (
  SELECT source, source_size, rk, CAST([5, 2, 1][(rk - 1) % 3 + 1] AS BIGINT) AS weight, 3 * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM rows GROUP BY source)),
levels AS (SELECT *, CAST(cap AS DOUBLE) / weight AS level FROM goal),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY level, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY level, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total
  FROM levels),
marked AS (SELECT *, level * CAST(rest AS DOUBLE) + CAST(below AS DOUBLE) <= CAST(total AS DOUBLE) AS capped FROM filled),
aims AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    weight * (CAST(total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE) / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE)) END AS target
  FROM marked),
queued AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ASC NULLS LAST, size, r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached
  FROM (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM rows)),
readings AS (
  SELECT q.r, q.doc_id, q.source, q.size, e.epoch, CAST(reached + (e.epoch - 1) * a.source_size AS DOUBLE) / a.target AS finish
  FROM queued q JOIN aims a ON q.source IS NOT DISTINCT FROM a.source JOIN (SELECT unnest([1, 2, 3]) AS epoch) e ON a.target > 0 AND e.epoch <= ceil(a.target / a.source_size)),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, doc_id ASC NULLS LAST, epoch, size, r ROWS UNBOUNDED PRECEDING) AS used FROM readings),
taken AS (SELECT r, count(*) AS times FROM merged WHERE used <= (SELECT sum(size) FROM rows) GROUP BY r)
SELECT rows.doc_id, rows.size, aims.source_size, aims.target, rows.size * coalesce(times, 0) AS taken
FROM rows JOIN aims ON rows.source IS NOT DISTINCT FROM aims.source LEFT JOIN taken ON rows.r = taken.r
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
inner_parts AS (
  SELECT lang, f, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (
    SELECT lang, f, ws, m, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM f WHERE k > 2))),
kept AS (
  SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = f.lang AND i.phrase = f.phrase AND 100 * i.f >= 80 * f.f)),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM kept),
parts AS (
  SELECT cuts.lang, cuts.phrase, cuts.c, cuts.f AS a, h.f AS l, t.f AS r, 2000000 * cuts.f // (h.f + t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(cuts.ws[1 : c], ' ') JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(cuts.ws[c + 1 :], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total ON ranked.lang = total.lang WHERE rank <= 2000
"""

OP11_SQL = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT side, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM texts),
features AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
known AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS b FROM known, tbl),
counts AS (SELECT b, CAST(count(CASE WHEN side = 0 THEN 1 END) AS DOUBLE) AS s, CAST(count(CASE WHEN side = 1 THEN 1 END) AS DOUBLE) AS t FROM features JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS g FROM counts, totals),
sums AS (SELECT r, count(*) AS n, sum(g) AS g FROM features JOIN hashed USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, words.r, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(CAST(floor(CAST(g AS DOUBLE) / n) AS BIGINT), 0) AS weight, CAST('0x' || left(sha256('7:' || id), 8) AS BIGINT) AS h FROM words LEFT JOIN sums ON sums.r = words.r WHERE side = 0),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank, count(*) OVER () AS n FROM final WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM final LEFT JOIN ranked USING (r)
"""
