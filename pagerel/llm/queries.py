"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerel.llm import audit, chunks, lines, mixing, neighbours, packing, pii, quality, resampling, sharding, simhash, suffixes, toxicity
from pagerel.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.written(F.col("_base")), 256).alias("base_sha256"),
                        pii.written(F.col("_all")).alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents``: 3-word shingles, at most 2 bits apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards whose counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, shards=40).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: weights 5, 2, 1, 150 % of all words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_rate=2.0)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without strings of 50 bytes that a smaller
    document has."""
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= toxicity.REJECT).alias("toxic"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk fingerprints of every document and of its edited text."""
    return chunks.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of ``embeddings`` for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=10).withColumnRenamed("id", "vec_id")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, the runs that go, and what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = F.transform("_gone", lambda r: F.concat_ws("-", r["first"], r["last"]))
    return lines.repeated_lines(docs).select(
        "doc_id", F.col("_n_lines").cast("bigint").alias("n_lines"),
        F.aggregate("_gone", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1).alias("n_removed"),
        F.array_join(gone, ",").alias("removed"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, by language, in every order of them."""
    flags = audit.flagged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return audit.interactions(audit.with_labels(flags, table(spark, sf_dir, "labels")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten percent of ``documents`` drawn towards the words of ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, sf_dir, "benchmark"), runs=1, buckets=10_000, percent=10, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_suffixes": op6_suffixes,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_neighbours": op9_neighbours,
    "op10_lines": op10_lines,
    "op11_audit": op11_audit,
    "op12_quality": op12_quality,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS key,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) AS nth FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * 2.0::DOUBLE AS cap FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT l.source, l.source_size, least(l.cap, coalesce((SELECT level FROM l AS m WHERE m.level * m.w <= m.cap ORDER BY m.cap / m.w, m.level DESC LIMIT 1) * l.w, l.cap)) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-1|' || key || '|' || nth), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS luck
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN luck < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
""",
    "op10_lines": r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(l[i : i + 2], chr(10)) AS run
  FROM d, unnest(range(1, greatest(len(l) - 1, 1))) AS u(i) WHERE len(l) >= 3),
f AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM w WHERE trim(translate(run, chr(10) || chr(13) || chr(9), '   ')) <> ''),
g AS (
  SELECT DISTINCT doc_id, pos + k AS line FROM f, unnest([0, 1, 2]) AS u(k) WHERE nth > 1),
e AS (
  SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM g),
r AS (
  SELECT doc_id, min(line) AS a, max(line) AS b FROM e GROUP BY doc_id, grp),
x AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, CAST(sum(b - a + 1) AS BIGINT) AS n_removed FROM r GROUP BY doc_id),
p AS (
  SELECT d.doc_id, string_agg(l[u.i + 1], chr(10) ORDER BY u.i) AS kept
  FROM d, unnest(range(0, len(l))) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.line = u.i) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN p USING (doc_id)
""",
    "op11_audit": r"""
WITH l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS oldest FROM d),
m AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > oldest THEN 16 ELSE 0 END AS mask FROM w),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
         CAST(coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1 : step - 1], '') IF x <> '']), 0) AS INTEGER) AS before
  FROM o, unnest(range(1, 6)) AS u(step)),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
""",
    "op13_resampling": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM unnest(range(0::BIGINT, 256)) AS u(i)),
d AS MATERIALIZED (
  SELECT doc_id, text, row_number() OVER () AS r FROM documents),
x AS (
  SELECT 'd' AS kind, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
words AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM x)),
crc AS (
  SELECT word, h, 4294967295::BIGINT AS c, 0 AS i FROM words
  UNION ALL
  SELECT word, h, xor(c >> 8, t[(xor(c, ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) & 255) + 1]), i + 1 FROM crc, crc_table WHERE 2 * i < length(h)),
bucket AS (
  SELECT word, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * i = length(h)),
n AS (
  SELECT b, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM x JOIN bucket USING (word) GROUP BY b),
g AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
w AS (
  SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM x JOIN bucket USING (word) JOIN g USING (b) WHERE kind = 'd' GROUP BY r),
s AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN w USING (r)),
f AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM s),
k AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM k
""",
}
