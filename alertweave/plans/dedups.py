"""Deduplication and its audits over the alerts view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import bundles as B
from ..operators import dedup as D
from ..operators import joins
from ..sources.views import HALF_HOUR, MILLISECOND, alerts, sightings, with_views
from .registry import query

VALUES = ["user_name", "ip", "domain"]


def fingerprints(spark, d, minutes: int = 30):
    slots = {"user": F.array("user_name"), "ip": F.array("ip"), "domain": F.array("domain")}
    return D.fingerprints(alerts(spark, d), slots, minutes)


#: Rule names compare trimmed and in lower case, none as an empty one.
NAME = "coalesce(lower(trim(alert_name, ' ')), '')"

#: Of the three slots an alert may lack some. Two alerts with at most three slots reach 0.8 only
#: where they have the same slots and agree in all.
PAIRS = f""", a AS (SELECT *, {HALF_HOUR} AS bucket, {NAME} AS name FROM alerts),
p AS (SELECT c.alert_id, e.alert_id AS earlier, e.ts AS ets FROM a c JOIN a e ON c.customer = e.customer AND c.name = e.name AND c.bucket = e.bucket
 AND c.user_name IS NOT DISTINCT FROM e.user_name AND c.ip IS NOT DISTINCT FROM e.ip AND c.domain IS NOT DISTINCT FROM e.domain AND coalesce(c.user_name, c.ip, c.domain) IS NOT NULL AND (e.ts, e.alert_id) < (c.ts, c.alert_id)),
b AS (SELECT alert_id, arg_min(earlier, (ets, earlier)) AS matched_alert_id FROM p GROUP BY alert_id),
l1 AS (SELECT a.alert_id, a.customer, CASE WHEN matched_alert_id IS NULL THEN 'NEW' ELSE 'DUPLICATE' END AS verdict, CASE WHEN matched_alert_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, matched_alert_id FROM a LEFT JOIN b USING (alert_id))"""


def on(body: str) -> str:
    return with_views("alerts", PAIRS + body)


def lcs_sql(pairs: str, name: str = "ratio") -> str:
    """x, y, r for the text pairs of a relation: the token-sort ratio. The longest common
    subsequence goes a character of y at a time, with a bit for each character of x."""
    return f""", tx AS (SELECT DISTINCT x, y, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda t: t <> '')), ' ') AS a, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(y), '\\s+'), lambda t: t <> '')), ' ') AS b FROM {pairs}),
lcs AS (SELECT x, y, a, b, 0 AS i, (1::HUGEINT << length(a)) - 1 AS bits FROM tx UNION ALL
 SELECT x, y, a, b, i + 1, ((bits + (bits & m)) | (bits - (bits & m))) & ((1::HUGEINT << length(a)) - 1)
 FROM (SELECT *, coalesce(list_sum(list_transform(range(1, length(a) + 1), lambda k: CASE WHEN a[k] = b[i + 1] THEN 1::HUGEINT << (k - 1) ELSE 0::HUGEINT END)), 0)::HUGEINT AS m FROM lcs WHERE i < length(b))),
{name} AS (SELECT x, y, CASE WHEN length(a) + length(b) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * (length(a) - bit_count(bits)) / (length(a) + length(b)) END AS r FROM lcs WHERE i = length(b))"""


def hundredths(x: str) -> str:
    """Rounded from the number's exact value, as formatting does."""
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def tenths(x: str) -> str:
    """The number's shortest decimal rounded half up, as the queries do; SQL's round takes the
    number times ten, which may be a half when the number is below one."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 30)), 1) AS DOUBLE)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def type_score(r: str) -> str:
    """A type that only one alert has scores 0; one that both lack adds nothing either."""
    return f"coalesce({hundredths(f'{r}.r')}, 0.0::DOUBLE)"


EITHER = " + ".join(f"(coalesce({a}, {b}) IS NOT NULL)::INT" for a, b in (("user_name", "user_b"), ("ip", "ip_b"), ("domain", "domain_b")))

L2 = (
    """, l AS (SELECT a.* FROM a JOIN l1 USING (alert_id) WHERE l1.verdict = 'NEW'),
s2 AS (SELECT customer, bucket, name, user_name, ip, domain, arg_min(alert_id, (ts, alert_id)) AS fid, min(ts) AS fts FROM a GROUP BY ALL),
sa AS (SELECT DISTINCT customer, bucket, name, user_name, ip, domain FROM l),
sp AS (SELECT sa.*, s2.user_name AS user_b, s2.ip AS ip_b, s2.domain AS domain_b, fid, fts FROM sa JOIN s2 ON sa.customer IS NOT DISTINCT FROM s2.customer AND sa.bucket IS NOT DISTINCT FROM s2.bucket AND sa.name <> s2.name),
vp AS (SELECT * FROM (SELECT user_name AS x, user_b AS y FROM sp UNION SELECT ip, ip_b FROM sp UNION SELECT domain, domain_b FROM sp) WHERE x IS NOT NULL AND y IS NOT NULL)"""
    + lcs_sql("vp")
    + f""", sc AS (SELECT sp.*, {hundredths(f"({type_score('d')} + {type_score('i')} + {type_score('u')}) / nullif({EITHER}, 0)")} AS score FROM sp LEFT JOIN ratio u ON u.x = user_name AND u.y = user_b LEFT JOIN ratio i ON i.x = ip AND i.y = ip_b LEFT JOIN ratio d ON d.x = domain AND d.y = domain_b),
m2 AS (SELECT l.alert_id, max(score) AS score, arg_min(fid, (-score, fts, fid)) AS mid FROM l JOIN sc ON l.name = sc.name AND {" AND ".join(f"l.{c} IS NOT DISTINCT FROM sc.{c}" for c in ("customer", "bucket", "user_name", "ip", "domain"))} WHERE score >= 80 AND (fts, fid) < (l.ts, l.alert_id) GROUP BY l.alert_id),
l2 AS (SELECT l.alert_id, CASE WHEN mid IS NULL THEN 'NEW' ELSE 'SIMILAR' END AS verdict, coalesce(score, 0.0::DOUBLE) AS score, mid AS matched_alert_id FROM l LEFT JOIN m2 USING (alert_id))"""
)
BOTH = L2 + ", dd AS (SELECT l1.alert_id, CASE WHEN l1.verdict = 'DUPLICATE' THEN 'DUPLICATE' ELSE l2.verdict END AS verdict, CAST(CASE WHEN l1.verdict = 'DUPLICATE' THEN 1 WHEN l2.verdict = 'SIMILAR' THEN 2 ELSE 0 END AS INTEGER) AS layer, coalesce(l1.matched_alert_id, l2.matched_alert_id) AS matched_alert_id FROM l1 LEFT JOIN l2 USING (alert_id))"


@query(on(" SELECT alert_id, verdict, confidence, matched_alert_id FROM l1"))
def dedup_l1(spark, d):
    return D.dedup_l1(fingerprints(spark, d))


@query(on(" SELECT customer, verdict, count(*) AS n FROM l1 GROUP BY customer, verdict"))
def dedup_verdicts(spark, d):
    v = D.dedup_l1(fingerprints(spark, d), keep=["customer"])
    return A.count_by(v, "customer", "verdict")


@query(on(""", s AS (SELECT DISTINCT customer, alert_name, bucket, user_name, ip, domain FROM a),
q AS (SELECT (x.user_name = y.user_name)::INT + (x.ip = y.ip)::INT + (x.domain = y.domain)::INT AS matched FROM s x JOIN s y ON x.customer = y.customer AND x.alert_name = y.alert_name AND x.bucket = y.bucket)
SELECT CAST(matched AS BIGINT) AS matched, count(*) AS n FROM q WHERE matched > 0 GROUP BY matched"""))
def l1_candidate_counts(spark, d):
    return D.l1_counts(fingerprints(spark, d)).groupBy("matched").agg(F.sum("n").alias("n"))


@query(on(""", s AS (SELECT DISTINCT customer, alert_name, bucket, user_name, ip, domain FROM a),
q AS (SELECT (x.user_name = y.user_name)::INT + (x.ip = y.ip)::INT + (x.domain = y.domain)::INT AS matched FROM s x JOIN s y ON x.customer = y.customer AND x.alert_name = y.alert_name AND x.bucket = y.bucket)
SELECT CASE matched WHEN 3 THEN 1.0 WHEN 2 THEN 0.6667 ELSE 0.3333 END::DOUBLE AS confidence, count(*) AS n FROM q WHERE matched > 0 GROUP BY matched"""))
def l1_confidence(spark, d):
    return D.l1_counts(fingerprints(spark, d)).groupBy("confidence").agg(F.sum("n").alias("n"))


@query(recursive(on(L2 + " SELECT alert_id, verdict, score, matched_alert_id FROM l2")))
def dedup_l2(spark, d):
    fp = fingerprints(spark, d)
    return D.dedup_l2(fp, VALUES, D.dedup_l1(fp))


@query(recursive(on(BOTH + " SELECT alert_id, verdict, layer, matched_alert_id FROM dd")))
def dedup(spark, d):
    return D.dedup(fingerprints(spark, d), VALUES).drop("confidence")


LISTS = (
    f""", s AS (SELECT *, {HALF_HOUR} AS bucket FROM sightings),
e1 AS (SELECT c.alert_id, arg_min(e.alert_id, (e.ts, e.alert_id)) AS matched FROM s c JOIN s e ON c.customer = e.customer AND c.alert_name = e.alert_name AND c.bucket = e.bucket AND c.users = e.users AND c.ips = e.ips AND c.domains = e.domains
 AND len(c.users) + len(c.ips) + len(c.domains) > 0 AND (e.ts, e.alert_id) < (c.ts, c.alert_id) GROUP BY c.alert_id),
l AS (SELECT * FROM s WHERE alert_id NOT IN (SELECT alert_id FROM e1)),
fb AS (SELECT customer, bucket, alert_name, users, ips, domains, arg_min(alert_id, (ts, alert_id)) AS fid, min(ts) AS fts FROM s GROUP BY ALL),
fa AS (SELECT DISTINCT customer, bucket, alert_name, users, ips, domains FROM l),
sp AS (SELECT row_number() OVER () AS p, fa.*, fb.users AS users_b, fb.ips AS ips_b, fb.domains AS domains_b, fid, fts FROM fa JOIN fb ON fa.customer = fb.customer AND fa.bucket = fb.bucket AND fa.alert_name <> fb.alert_name),
k AS (SELECT p, 'domains' AS kind, domains AS a, domains_b AS b FROM sp UNION ALL SELECT p, 'ips', ips, ips_b FROM sp UNION ALL SELECT p, 'users', users, users_b FROM sp),
kk AS (SELECT * FROM k WHERE len(a) + len(b) > 0),
av AS (SELECT p, kind, b, unnest(a) AS x, unnest(range(len(a))) AS i FROM kk WHERE len(a) > 0 AND len(b) > 0),
vp AS (SELECT p, kind, i, x, unnest(b) AS y FROM av)"""
    + lcs_sql("vp")
    + f""", bm AS (SELECT p, kind, i, max(r) AS r FROM vp JOIN ratio USING (x, y) GROUP BY p, kind, i),
ty AS (SELECT p, kind, {hundredths("list_reduce(list_prepend(0.0::DOUBLE, list(r ORDER BY i)), lambda u, v: u + v) / count(*)")} AS r FROM bm GROUP BY p, kind),
al AS (SELECT p, list(coalesce(r, 0.0::DOUBLE) ORDER BY kind) AS rs FROM kk LEFT JOIN ty USING (p, kind) GROUP BY p),
sc AS (SELECT sp.*, {hundredths("list_reduce(list_prepend(0.0::DOUBLE, rs), lambda u, v: u + v) / len(rs)")} AS score FROM sp JOIN al USING (p)),
m2 AS (SELECT l.alert_id, max(score) AS score, arg_min(fid, (-score, fts, fid)) AS mid FROM l JOIN sc USING (customer, bucket, alert_name, users, ips, domains) WHERE score >= 80 AND (fts, fid) < (l.ts, l.alert_id) GROUP BY l.alert_id)
SELECT l.alert_id, CASE WHEN mid IS NULL THEN 'NEW' ELSE 'SIMILAR' END AS verdict, coalesce(score, 0.0::DOUBLE) AS score, mid AS matched_alert_id FROM l LEFT JOIN m2 USING (alert_id)"""
)


@query(with_views("alerts sightings", f""", s AS (SELECT DISTINCT customer, alert_name, {HALF_HOUR} AS bucket, list_sort(list_distinct(list_filter(users, lambda x: x <> ''))) AS u, list_sort(list_distinct(ips)) AS i, list_sort(list_distinct(domains)) AS d FROM sightings),
q AS (SELECT (x.u = y.u AND len(x.u) > 0)::INT + (x.i = y.i AND len(x.i) > 0)::INT + (x.d = y.d AND len(x.d) > 0)::INT AS matched,
 (len(x.u) + len(y.u) > 0)::INT + (len(x.i) + len(y.i) > 0)::INT + (len(x.d) + len(y.d) > 0)::INT AS slots FROM s x JOIN s y USING (customer, alert_name, bucket))
SELECT CAST(matched AS BIGINT) AS matched, slots, count(*) AS n FROM q WHERE matched > 0 GROUP BY ALL"""))
def l1_counts_lists(spark, d):
    """Pairs by slots that agree and slots that either has, over alerts that lack some."""
    slots = {"user": F.col("users"), "ip": F.col("ips"), "domain": F.col("domains")}
    return D.l1_counts(D.fingerprints(sightings(spark, d), slots)).select("matched", F.col("union_").cast("int").alias("slots"), "n")


@query(recursive(with_views("alerts sightings", LISTS)))
def dedup_l2_lists(spark, d):
    """Layer two over alerts with several values of a type, or none."""
    s = sightings(spark, d)
    fp = D.fingerprints(s, {"user": F.col("users"), "ip": F.col("ips"), "domain": F.col("domains")})
    return D.dedup_l2(fp, ["users", "ips", "domains"], D.dedup_l1(fp))


@query(on(" SELECT l1.verdict, alerts.alert_name, count(*) AS n, avg(confidence) AS mean_confidence FROM l1 JOIN alerts USING (alert_id) GROUP BY ALL"))
def dedup_dashboard(spark, d):
    v = D.dedup_l1(fingerprints(spark, d), keep=["alert_name"])
    return v.groupBy("verdict", "alert_name").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


@query(recursive(on(BOTH + """, x AS (SELECT dd.verdict, dd.layer, alert_name AS rule, CASE k % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE '' END AS severity, l1.confidence, coalesce(k % 4 = 0, false) AS bare FROM dd JOIN alerts USING (alert_id) JOIN l1 USING (alert_id)),
f AS (SELECT 'total' AS section, '' AS item, '' AS kind FROM x UNION ALL SELECT 'verdicts', verdict, '' FROM x UNION ALL SELECT 'layers', CAST(layer AS VARCHAR), '' FROM x
 UNION ALL SELECT 'severity', CASE severity WHEN '' THEN 'UNKNOWN' ELSE severity END, verdict FROM x UNION ALL SELECT 'confidence', CASE WHEN confidence = 1 THEN '100.0' ELSE '0.0' END, '' FROM x
 UNION ALL SELECT 'slots', unnest(['ip', 'domain']), CASE WHEN confidence = 1 THEN 'matched' ELSE 'missed' END FROM x WHERE NOT bare UNION ALL SELECT 'data_quality', '', '' FROM x WHERE bare
 UNION ALL SELECT 'rules', rule, verdict FROM x JOIN (SELECT rule FROM x WHERE rule <> '' GROUP BY rule ORDER BY count(*) DESC, rule LIMIT 15) USING (rule))
SELECT section, item, kind, count(*) AS n FROM f GROUP BY ALL""")))
def dedup_dashboard_full(spark, d):
    v = D.dedup(fingerprints(spark, d), VALUES).join(alerts(spark, d).select("alert_id", "alert_name", "k"), "alert_id")
    k, hit, none = F.col("k"), F.col("confidence") == 1, F.array().cast("array<string>")
    slots = F.when(k % 4 == 0, none).otherwise(F.array(F.lit("ip"), F.lit("domain")))
    entries = v.select(
        "verdict", "layer", F.col("alert_name").alias("rule"), F.when(k % 3 == 0, "High").when(k % 3 == 1, "Low").otherwise("").alias("severity"), "confidence",
        F.when(hit, slots).otherwise(none).alias("matched_slots"), F.when(~hit, slots).otherwise(none).alias("missed_slots"), slots.alias("filled_slots"),
    )
    return D.dashboard(entries)


def _pairs(spark, d):
    kept = ["ts", "k", "ip", "domain", "alert_name"]
    a = D.dedup_l1(fingerprints(spark, d), keep=kept)
    return joins.fp_pairs(a.select("alert_id", F.col("matched_alert_id").alias("parent"), *kept), "alert_id", "parent", alerts(spark, d).select("alert_id", *kept))


FP = ", fp AS (SELECT l1.alert_id AS dup, matched_alert_id AS can, (epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 AS gap, x.k AS xk, y.k AS yk FROM l1 JOIN alerts x USING (alert_id) JOIN alerts y ON y.alert_id = matched_alert_id)"


@query(on(FP + " SELECT dup, can, gap FROM fp"))
def fp_pairs(spark, d):
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _pairs(spark, d).select(F.col("dup_alert_id").alias("dup"), F.col("can_alert_id").alias("can"), ((s("dup_ts") - s("can_ts")) / 1e6).alias("gap"))


@query(on(FP + " SELECT dup, CASE WHEN xk % 10 = 0 THEN 'TEST' WHEN xk % 2 = 0 AND xk <> yk THEN 'FP' WHEN xk IS NULL OR xk % 2 = 0 THEN 'UNKNOWN' ELSE 'TP' END AS verdict FROM fp"))
def fp_verdict(spark, d):
    p = _pairs(spark, d)
    ip = F.when(F.col("dup_k") % 2 == 0, "").otherwise(F.col("dup_ip"))
    return p.select(F.col("dup_alert_id").alias("dup"), D.fp_verdict(ip, F.lit(None).cast("string"), F.col("dup_k") != F.col("can_k"), F.col("dup_k") % 10 == 0).alias("verdict"))


AUDIT = "CASE WHEN xk % 10 = 0 THEN 'TEST_ALERT' WHEN xk <> yk THEN CASE WHEN xk % 4 < 2 THEN 'LIKELY_FALSE_POSITIVE' ELSE 'POSSIBLE_FALSE_POSITIVE' END WHEN xk % 3 = 0 THEN 'WEAK_HASH_RISK' ELSE 'LIKELY_TRUE_POSITIVE' END"


def _audit(spark, d):
    p = _pairs(spark, d)
    k = F.col("dup_k")
    return p.select(F.col("dup_alert_id").alias("dup"), F.col("can_alert_id").alias("can"), D.fp_audit((k != F.col("can_k")).cast("int"), F.when(k % 4 < 2, 0.25).otherwise(0.75), F.when(k % 3 == 0, 1).otherwise(3), k % 10 == 0).alias("verdict"))


@query(on(FP + f" SELECT dup, {AUDIT} AS verdict FROM fp"))
def fp_audit(spark, d):
    return _audit(spark, d).select("dup", "verdict")


@query(on(FP + f", v AS (SELECT can, {AUDIT} AS verdict FROM fp) SELECT verdict, count(*) AS duplicates, count(DISTINCT can) AS canonicals FROM v GROUP BY verdict"))
def fp_summary(spark, d):
    return _audit(spark, d).groupBy("verdict").agg(F.count("*").alias("duplicates"), F.count_distinct("can").alias("canonicals"))


@query(on(FP + " SELECT dup, CASE WHEN xk IS NULL THEN 0 WHEN xk = yk THEN 2 ELSE 1 END::BIGINT AS shared, CASE WHEN xk <> yk THEN 2 ELSE 0 END::BIGINT AS differ, CASE WHEN xk IS NULL THEN 0.0 WHEN xk = yk THEN 1.0 ELSE 1 / 3 END::DOUBLE AS similarity FROM fp"))
def ioc_diff(spark, d):
    """A missing value is no indicator; alerts without any are similar by 0."""
    a, b = (F.array_compact(F.array(F.concat(F.lit("ip:"), F.col(f"{s}_ip")), F.concat(F.lit("k:"), F.col(f"{s}_k").cast("string")))) for s in ("dup", "can"))
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return _pairs(spark, d).select(F.col("dup_alert_id").alias("dup"), shared.cast("bigint").alias("shared"), (union - shared).cast("bigint").alias("differ"), (shared / F.greatest(union, F.lit(1))).alias("similarity"))


@query(on(FP + " SELECT dup, CASE WHEN xk = yk THEN 100.0 ELSE 50.0 END::DOUBLE AS by_type, CASE WHEN xk = yk THEN 100.0 ELSE 100 / 3 END::DOUBLE AS by_value FROM fp"))
def observable_similarity(spark, d):
    side = lambda s: {"ip": F.array(F.col(f"{s}_ip")), "file_hash": F.array(F.col(f"{s}_k").cast("string"))}
    by_type, by_value = D.observable_similarity(side("dup"), side("can"))
    return _pairs(spark, d).select(F.col("dup_alert_id").alias("dup"), by_type.alias("by_type"), by_value.alias("by_value"))


@query(on(FP + " SELECT dup, round(0.8 * (0.3 + CASE WHEN xk = yk THEN 1 ELSE 0 END) / 1.3 + 0.2 * exp(-gap / 3600 / 24) + 0.15, 9) AS score FROM fp"))
def weighted_similarity(spark, d):
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = (s("dup_ts") - s("can_ts")) / 1e6 / 3600
    yes = F.lit(True)
    score = D.weighted_similarity({"ip": F.col("dup_ip") == F.col("can_ip"), "file_hash": F.col("dup_k") == F.col("can_k")}, {"ip": yes, "file_hash": yes}, age, F.col("dup_alert_name") == F.col("can_alert_name"))
    return _pairs(spark, d).select(F.col("dup_alert_id").alias("dup"), F.round(score, 9).alias("score"))


@query(with_views("alerts", "SELECT alert_id, CASE (k % 2) + (k % 3 > 0)::INT + 1 WHEN 1 THEN 'WEAK' WHEN 2 THEN 'MODERATE' ELSE 'STRONG' END AS rating FROM alerts"))
def hash_quality(spark, d):
    src, dst = F.when(F.col("k") % 2 == 1, F.col("ip")), F.when(F.col("k") % 3 > 0, F.col("domain")).otherwise("")
    return alerts(spark, d).select("alert_id", D.hash_quality(src, dst, F.col("alert_name")).alias("rating"))


def keyed(a):
    """Alerts with composite keys for one or two sources, and the group that a key can't leave."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    sources = F.when(F.col("k") % 5 == 0, F.array("ip", "user_name")).otherwise(F.array("ip"))
    b = F.floor(ms / 1_800_000)
    return a.select("alert_id", "ts", ms.alias("ms"), T.composite_keys(sources, F.array("domain"), F.col("alert_name"), b).alias("keys"), "domain", "alert_name", b.alias("bucket"))


#: A source that is missing makes the key of an empty one; an alert without time meets no other.
KEYS = f""", r AS (SELECT alert_id, domain, alert_name, {HALF_HOUR} AS bucket, CASE WHEN k % 5 = 0 THEN list_sort(list_distinct([coalesce(ip, ''), coalesce(user_name, '')])) ELSE [coalesce(ip, '')] END AS s, row_number() OVER (PARTITION BY domain, alert_name, {HALF_HOUR} ORDER BY {MILLISECOND}, alert_id) AS rn FROM alerts),
st AS (SELECT DISTINCT domain, alert_name, bucket, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BIGINT[]) AS ids, CAST(NULL AS BIGINT) AS alert_id, CAST(NULL AS BIGINT) AS dup, CAST(0 AS BIGINT) AS added FROM r UNION ALL
 SELECT domain, alert_name, bucket, rn, ks || new, ids || list_transform(new, lambda x: alert_id), alert_id, dup, len(new) FROM (
  SELECT r.domain, r.alert_name, r.bucket, r.rn, st.ks, st.ids, r.alert_id,
   CASE WHEN r.bucket IS NULL THEN NULL WHEN list_contains(ks, s[1]) THEN ids[list_position(ks, s[1])] WHEN list_contains(ks, s[2]) THEN ids[list_position(ks, s[2])] END AS dup,
   CASE WHEN r.bucket IS NULL THEN s WHEN list_contains(ks, s[1]) THEN [] WHEN len(s) = 1 OR list_contains(ks, s[2]) THEN [s[1]] ELSE s END AS new
  FROM st JOIN r ON r.domain IS NOT DISTINCT FROM st.domain AND r.alert_name IS NOT DISTINCT FROM st.alert_name AND r.bucket IS NOT DISTINCT FROM st.bucket AND r.rn = st.rn + 1))"""


@query(recursive(with_views("alerts", KEYS + " SELECT alert_id, dup AS duplicate_of FROM st WHERE rn > 0")))
def hash_dedup(spark, d):
    return D.hash_dedup(keyed(alerts(spark, d)), 1_800_000, ["domain", "alert_name", "bucket"])


@query(recursive(with_views("alerts", KEYS + """, p AS (SELECT bucket, count(*) AS n, count(dup) AS d, CAST(sum(added) AS BIGINT) AS active_entries FROM st WHERE rn > 0 GROUP BY bucket),
c AS (SELECT bucket, active_entries, CAST(sum(n) OVER (ORDER BY bucket NULLS FIRST) AS BIGINT) AS total, CAST(sum(d) OVER (ORDER BY bucket NULLS FIRST) AS BIGINT) AS duplicates FROM p)
SELECT bucket, total, total - duplicates AS new, duplicates, active_entries, """ + tenths("duplicates / total * 100") + " AS dedup_rate FROM c")))
def key_statistics(spark, d):
    a = keyed(alerts(spark, d))
    judged = D.key_verdicts(a, 1_800_000, ["domain", "alert_name", "bucket"]).join(a.select("alert_id", "bucket"), "alert_id")
    return D.key_statistics(judged)


@query(on(FP + " SELECT dup, CASE WHEN xk = yk THEN 100.0 ELSE round((100 + 100 + 80) / 3, 2) END::DOUBLE AS score FROM fp"))
def context_similarity(spark, d):
    """One identity with a name and a sector, one indicator with a pattern."""
    weights = {"identity": {"name": 60.0, "sector": 20.0, "roles": 20.0}, "indicator": {"pattern": 80.0, "valid_from": 20.0}}
    obj = lambda kind, **p: F.struct(F.lit(kind).alias("type"), F.create_map(*[x for n, v in p.items() for x in (F.lit(n), v)]).alias("props"))
    k = lambda s: F.col(f"{s}_k").cast("string")
    side = lambda s: F.array(obj("identity", name=F.lit("n"), sector=F.lit("s")), obj("indicator", pattern=F.col(f"{s}_ip"), valid_from=F.lit("x")), obj("malware", name=k(s)), obj("identity", name=F.lit("other"), sector=k(s), roles=F.lit("r")))
    # two identities: the first agrees in all, the other in name and role but for the sector
    return _pairs(spark, d).select(F.col("dup_alert_id").alias("dup"), F.round(D.context_similarity(side("dup"), side("can"), weights), 2).alias("score"))


@query(with_views("alerts", "SELECT alert_id, CASE k % 5 WHEN 0 THEN 'pre_extracted' WHEN 1 THEN 'endpoint' WHEN 2 THEN 'siem' WHEN 3 THEN 'cloud_siem' ELSE 'generic' END AS vendor, ip AS sources, CASE k % 5 WHEN 0 THEN '9.9.9.9,' || domain WHEN 1 THEN '9.9.9.9' WHEN 3 THEN '' ELSE domain END AS dests, alert_name AS category FROM alerts"))
def vendor_extract(spark, d):
    a = alerts(spark, d)
    k = F.col("k") % 5
    js = lambda **kw: F.to_json(F.struct(*[v.alias(n) for n, v in kw.items()]))
    ip, dom, name = F.col("ip"), F.col("domain"), F.col("alert_name")
    nine = F.lit("9.9.9.9")
    payload = (
        F.when(k == 0, js(sourceIps=F.array(ip), destIps=F.array(nine), domains=F.array(dom), alertCategory=name))
        .when(k == 1, js(DetectName=name, LocalIP=ip, NetworkAccesses=F.array(F.struct(nine.alias("RemoteAddress")))))
        .when(k == 2, js(search_name=name, src_ip=ip, dest_ip=dom))
        .when(k == 3, js(AlertName=name, Entities=F.to_json(F.array(F.struct(F.lit("ip").alias("Type"), ip.alias("Address"))))))
        .otherwise(js(attacker_ip=ip, target_ip=dom, title=name))
    )
    out = B.vendor_extracted(a.withColumn("payload", payload))
    return out.select("alert_id", "vendor", F.array_join("sources", ",").alias("sources"), F.array_join("dests", ",").alias("dests"), "category")
