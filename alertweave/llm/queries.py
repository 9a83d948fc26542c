"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    out = shards(common.table(spark, sf_dir, "documents"), leaves=8)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fitted, held_out, scored

    docs = common.table(spark, sf_dir, "documents")
    out = scored(docs, fitted(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    out = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(common.table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated

    return repeated(common.table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import components

    return components(common.table(spark, sf_dir, "documents"), percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mixture

    return Mixture(common.table(spark, sf_dir, "documents")).taken()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination, judged

    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(common.table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extracted

    return extracted(common.table(spark, sf_dir, "pages"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    out = resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality_model": op2_quality_model,
        "op3_license_scan": op3_license_scan,
        "op4_quality_rules": op4_quality_rules,
        "op5_secret_scan": op5_secret_scan,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_near_dedup": op8_near_dedup,
        "op9_mixing": op9_mixing,
        "op10_decontamination": op10_decontamination,
        "op11_collocations": op11_collocations,
        "op12_html_extraction": op12_html_extraction,
        "op13_importance": op13_importance,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIX_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM h)),
m AS (SELECT w, min(doc_id) AS m FROM p WHERE length(w) = 100 GROUP BY w),
s AS (SELECT p.doc_id, p.i FROM p JOIN m USING (w) WHERE m.m < p.doc_id),
b AS (SELECT p.doc_id, p.i, substr(p.w, 1, 2) AS byte, max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS start FROM p LEFT JOIN s USING (doc_id, i)),
g AS (SELECT doc_id, i, byte, start IS NOT NULL AND i - start < 50 AS gone FROM b),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN a USING (doc_id)
"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (g) GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, coalesce(min(r.b), w.doc_id) AS component_id, coalesce(min(r.b), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""

BENCH_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 12], ' ') AS g, len(ws[i:i + 12]) AS n FROM bi),
di AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, item_id, bw.n FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM di) x JOIN bw USING (g, n)),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hit),
h AS (SELECT doc_id, count(*) AS n_hit FROM cov GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


COLLOCATION_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS j FROM f WHERE k >= 2),
s AS (SELECT cut.lang, cut.k, cut.phrase, a, j, x.c AS l, y.c AS r, 1000 * a * n // (x.c * y.c) AS score
  FROM cut JOIN t USING (lang) JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(p[:j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(p[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT b.*, n FROM b JOIN t USING (lang) WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = b.lang AND z.k > b.k AND z.c >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""

#: CRC-32 of a feature, byte by byte, over a table made by its rule (polynomial 0xEDB88320).
IMPORTANCE_SQL = f"""
WITH RECURSIVE bits AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
f AS (SELECT side, id, unnest(ws) AS g FROM w UNION ALL SELECT side, id, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) FROM w),
d AS (SELECT g, string_split(regexp_replace(hex(encode(g)), '(..)', '\\1 ', 'g'), ' ') AS bytes FROM (SELECT DISTINCT g FROM f)),
h AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT for b in bytes if b <> '']), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 AS bucket FROM d, crc),
c AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN h USING (g) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM c, a),
m AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN h USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
s AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN m USING (id) WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM s WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, place AS rank FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND place <= 25 * n // 100
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can give all columns. The others use trained models, tokenizers, pseudorandom
    draws or tests of randomness; tests hold them against brute force."""
    return {"op6_suffix_dedup": SUFFIX_SQL, "op8_near_dedup": NEAR_SQL, "op10_decontamination": BENCH_SQL, "op11_collocations": COLLOCATION_SQL, "op13_importance": IMPORTANCE_SQL}
