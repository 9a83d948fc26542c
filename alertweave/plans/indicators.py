"""Indicators, nested documents, rendered text and term weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import bundles as B
from ..operators import filters
from ..operators import tfidf as TF
from ..sources.views import HALF_HOUR, alerts, bundles, table, with_views
from ..storage import written
from .dedups import lcs_sql
from .registry import query

IPS = "CASE k % 4 WHEN 0 THEN ' 010.000.' || CAST(k AS VARCHAR) || '.7/24 ' WHEN 1 THEN 'FE80::' || CAST(k AS VARCHAR) WHEN 2 THEN '1.2.x.' || CAST(k AS VARCHAR) ELSE '2001:DB8:0:0:1::/64' END"


def raw_ips(a):
    k = F.col("k").cast("string")
    m = F.col("k") % 4
    return F.when(m == 0, F.concat(F.lit(" 010.000."), k, F.lit(".7/24 "))).when(m == 1, F.concat(F.lit("FE80::"), k)).when(m == 2, F.concat(F.lit("1.2.x."), k)).otherwise("2001:DB8:0:0:1::/64")


@query(with_views("alerts", f"""SELECT alert_id, CASE k % 4 WHEN 0 THEN '10.0.' || CAST(k AS VARCHAR) || '.7' WHEN 1 THEN 'fe80:0000:0000:0000:0000:0000:0000:' || lpad(CAST(k AS VARCHAR), 4, '0') WHEN 2 THEN '1.2.x.' || CAST(k AS VARCHAR) ELSE '2001:0db8:0000:0000:0001:0000:0000:0000' END AS ip FROM alerts"""))
def norm_ip(spark, d):
    a = alerts(spark, d)
    return a.select("alert_id", T.norm_ip(raw_ips(a)).alias("ip"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)), ':(80|443)$', '') || regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS url FROM pages")
def norm_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.norm_url(F.col("url")).alias("url"))


@query(with_views("alerts", """, x AS (SELECT alert_id, CASE k % 7 WHEN 0 THEN 'https://a.example/' WHEN 1 THEN 'u@a.example' WHEN 2 THEN sha256(CAST(k AS VARCHAR)) WHEN 3 THEN 'fe80::1' WHEN 4 THEN ip WHEN 5 THEN 'word' ELSE ' ' END AS v, k FROM alerts)
SELECT alert_id, CASE k % 7 WHEN 0 THEN 'URL' WHEN 1 THEN 'Email' WHEN 2 THEN 'Hash' WHEN 3 THEN 'IPv6' WHEN 4 THEN 'IPv4' WHEN 5 THEN 'Other' ELSE '' END AS ioc_type FROM x"""))
def ioc_type(spark, d):
    m = F.col("k") % 7
    v = F.when(m == 0, "https://a.example/").when(m == 1, "u@a.example").when(m == 2, F.sha2(F.col("k").cast("string"), 256)).when(m == 3, "fe80::1").when(m == 4, F.col("ip")).when(m == 5, "word").otherwise(" ")
    return alerts(spark, d).select("alert_id", T.ioc_type(v).alias("ioc_type"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'suspicious_activity' WHEN 2 THEN 'port_scan' WHEN 3 THEN 'identity_change' ELSE 'other' END AS category, CASE WHEN o_orderkey % 5 = 4 THEN 'unclassified' ELSE 'threat' END AS kind FROM orders")
def alert_category(spark, d):
    names = ["Threat - Basic Brute Force - Rule", "Threat - Login from Suspicious Country - Rule", "Threat - Port scan seen - Rule", "Threat - Users Added to a role - Rule", "Something else"]
    name = F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.alert_category(name).alias("category"), T.detection_category(name).alias("kind"))


@query(with_views("containers", "SELECT container_id, string_split(rule, ' - ')[-1] AS tail, len(string_split(rule, ' - ')) AS parts, length(rule) AS n FROM containers"))
def title_parts(spark, d):
    from ..sources.views import containers

    p = F.split("rule", " - ")
    return containers(spark, d).select("container_id", F.element_at(p, -1).alias("tail"), F.size(p).cast("bigint").alias("parts"), F.length("rule").cast("bigint").alias("n"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority ELSE 'Audit - ' || o_orderpriority END AS rule FROM orders")
def rule_from_search(spark, d):
    m, p = F.col("o_orderkey") % 3, F.col("o_orderpriority")
    raw = F.when(m == 0, F.concat(F.lit("Endpoint - Threat - "), p, F.lit(" - Rule"))).when(m == 1, F.concat(F.lit("Access - "), p, F.lit(" - Rule Clone"))).otherwise(F.concat(F.lit("Audit - "), p))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.rule_of_search(raw).alias("rule"))


@query(f"SELECT event_id, regexp_replace('at ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' seen ' || CAST(user_id AS VARCHAR), '{T.TIMES}', ' ', 'g') AS text FROM events")
def scrub_time(spark, d):
    raw = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" seen "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", T.scrub_time(raw).alias("text"))


@query(with_views("alerts", "SELECT alert_id, ip AS src_ip, 'two words' AS title, user_name AS user_name FROM alerts"))
def parse_kv(spark, d):
    raw = F.concat(F.lit('x=0 src_ip='), "ip", F.lit(' title="two words" user='), "user_name", F.lit(" x=1"))
    m = T.parsed_kv(raw)
    return alerts(spark, d).select("alert_id", F.try_element_at(m, F.lit("src_ip")).alias("src_ip"), F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("user")).alias("user_name"))


WORDS_OF_PAGES = "SELECT DISTINCT unnest(regexp_extract_all(html || ' userName=x src_user user_priority ownerEmail' || page_id, '[A-Za-z][A-Za-z0-9_-]*')) AS key FROM pages"
SEAMS = "list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(key, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda t: t <> ''), lambda t: lower(t))"


@query(f"WITH k AS ({WORDS_OF_PAGES}) SELECT key, list_has_any({SEAMS}, {T.NAME_TOKENS}) AND NOT list_has_any({SEAMS}, {T.OTHER_TOKENS}) AS identity FROM k")
def identity_fields(spark, d):
    """The attribute names and words of pages that name a person or account."""
    p = table(spark, d, "pages").select(F.concat("html", F.lit(" userName=x src_user user_priority ownerEmail"), F.col("page_id").cast("string")).alias("t"))
    keys = p.select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z][A-Za-z0-9_-]*"), F.lit(0))).alias("key")).distinct()
    return keys.select("key", T.is_identity_key(F.col("key")).alias("identity"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'none' END AS value FROM documents")
def lift_first(spark, d):
    m = F.col("doc_id") % 3
    return table(spark, d, "documents").select("doc_id", T.first_filled(F.when(m == 0, F.col("lang")).otherwise("  "), F.when(m == 1, F.col("source")), F.lit("none")).alias("value"))


@query("SELECT doc_id, 'source ' || source || ' lang ' || lang || ' zone x' AS text FROM documents")
def priority_text(spark, d):
    """Pairs with listed keys first, in the list's order; the rest by key."""
    first = F.array(F.lit("source"), F.lit("lang"))
    pairs = F.array(F.struct(F.lit("lang").alias("k"), F.col("lang").alias("v")), F.struct(F.lit("zone").alias("k"), F.lit("x").alias("v")), F.struct(F.lit("source").alias("k"), F.col("source").alias("v")))
    rank = lambda k: F.when(F.array_position(first, k) > 0, F.array_position(first, k)).otherwise(99)
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(rank(p["k"]).alias("r"), p["k"].alias("k"), p["v"].alias("v"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(ordered, lambda p: F.concat_ws(" ", p["k"], p["v"])), " ").alias("text"))


@query(with_views("alerts", "SELECT alert_id, sha256('ip:' || ip) AS ip_hash, sha256('user:' || user_name) AS user_hash, sha256('domain:' || domain) AS domain_hash FROM alerts"))
def slot_hashes(spark, d):
    one = lambda c: F.array(F.col(c))
    return alerts(spark, d).select("alert_id", T.slot_hash("ip", one("ip")).alias("ip_hash"), T.slot_hash("user", one("user_name")).alias("user_hash"), T.slot_hash("domain", one("domain")).alias("domain_hash"))


@query(with_views("alerts", f"SELECT alert_id, sha256(s || '|' || domain || '|' || alert_name || '|' || CAST({HALF_HOUR} AS VARCHAR)) AS key FROM (SELECT *, unnest([ip, user_name]) AS s FROM alerts)"))
def composite_keys(spark, d):
    b = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1_800_000)
    return alerts(spark, d).select("alert_id", F.explode(T.composite_keys(F.array("user_name", "ip", "ip"), F.array("domain"), F.col("alert_name"), b)).alias("key"))


@query(with_views("alerts", "SELECT alert_id, alert_name, ip, domain, user_name, sha256(CAST(k AS VARCHAR)) AS file_hash, false AS error FROM alerts"))
def parse_bundle(spark, d):
    p = B.normalised(B.parsed(bundles(spark, d)))
    j = lambda c, n: F.array_join(c, ",").alias(n)
    return p.select("alert_id", "alert_name", j("ips", "ip"), j("domains", "domain"), j("users", "user_name"), j("file_hashs", "file_hash"), "error")


@query(with_views("alerts", "SELECT alert_id, ip AS ips, user_name AS users, CASE WHEN k % 2 = 0 THEN user_name || '@' || domain ELSE '' END AS emails FROM alerts"))
def notable_iocs(spark, d):
    fields = F.create_map(F.lit("src_ip"), F.concat("ip", F.lit(":443")), F.lit("dest_ip"), F.lit("host-1"), F.lit("user"), F.concat(F.lit('["'), "user_name", F.lit('"]')), F.lit("sender"), F.when(F.col("k") % 2 == 0, F.concat("user_name", F.lit("@"), "domain")).otherwise("nobody"))
    j = lambda kind: F.array_join(B.notable_iocs(fields, kind, B.NOTABLE_FIELDS[kind]), ",").alias(f"{kind}s")
    return alerts(spark, d).select("alert_id", j("ip"), j("user"), j("email"))


@query(with_views("alerts", "SELECT alert_id, CAST(5 AS BIGINT) AS n_objects, CAST(4 AS BIGINT) AS n_observables, ip AS first_ip, domain AS first_domain FROM alerts"))
def flatten_alert(spark, d):
    return B.flattened(bundles(spark, d)).select("alert_id", "n_objects", "n_observables", "first_ip", "first_domain")


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) AS p_k, CAST(NULL AS VARCHAR) AS p_raw FROM events")
def json_expand(spark, d):
    return B.json_expanded(table(spark, d, "events"), "props", "p_", ["k"]).select("event_id", "p_k", "p_raw")


@query("SELECT doc_id, 'lang ' || lang || ' source ' || source AS text FROM documents")
def notable_text(spark, d):
    m = F.create_map(F.lit("source"), F.upper("source"), F.lit("lang"), F.col("lang"), F.lit("seen"), F.lit("2024-05-06 07:08"), F.lit("none_key"), F.lit(" None "), F.lit("drop"), F.lit("x"))
    return table(spark, d, "documents").select("doc_id", T.rendered(m, drop=["drop"]).alias("text"))


@query("SELECT doc_id, 'lang ' || lang AS text FROM documents")
def entity_text(spark, d):
    """Only keys of an allow-list."""
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.rendered(m, keep=["lang"]).alias("text"))


@query("SELECT doc_id, unnest(['drop', 'lang', 'seen']) AS key, unnest(['dropped', 'kept', 'only_time']) AS fate FROM documents")
def explain_keys(spark, d):
    """What rendering did with each key."""
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("seen"), F.lit("2024-05-06"), F.lit("drop"), F.lit("x"))
    long = table(spark, d, "documents").select("doc_id", F.explode(m).alias("key", "value"))
    v = F.trim(F.col("value"))
    fate = F.when(F.col("key") == "drop", "dropped").when(F.lower(v).isin(*T.EMPTY_VALUES) | (v == ""), "empty").when(F.trim(T.scrub_time(v)) == "", "only_time").otherwise("kept")
    return long.select("doc_id", "key", fate.alias("fate"))


NOTABLE = """, a AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'settings' WHEN 1 THEN 'soar_event' WHEN 2 THEN 'notable' ELSE 'notification' END AS family FROM orders)""".replace(", a AS", "WITH a AS", 1)


def _artifact():
    m, k = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    return F.when(m == 0, F.lit('{"SA_DISPOSITION":"x"}')).when(m == 1, F.lit('{"soar_event":"y"}')).when(m == 2, F.concat(F.lit('{"rule_id":"'), k, F.lit('"}'))).otherwise('{"other":1}')


@query(NOTABLE + " SELECT id, family FROM a")
def artifact_family(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), filters.artifact_family(_artifact()).alias("family"))


@query(NOTABLE + " SELECT id, CASE WHEN family = 'notable' THEN CAST(id AS VARCHAR) ELSE 'z' END AS rule_id FROM a")
def notable_select(spark, d):
    first = filters.first_notable(F.array(F.lit('{"soar_event":"e","rule_id":"no"}'), _artifact(), F.lit('{"rule_id":"z"}')))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get_json_object(first, "$.rule_id").alias("rule_id"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), nn AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
x AS (SELECT doc_id, term, (1 + ln(tf.n)) * (ln((1 + nn.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nn), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY doc_id)
SELECT doc_id, term, round(w / l, 6) AS weight FROM x JOIN l USING (doc_id)""")
def tfidf(spark, d):
    docs = table(spark, d, "documents")
    # words of ASCII letters, so that both engines agree on what a word is
    return TF.weights(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0)), grams=1).select("doc_id", "term", F.round("weight", 6).alias("weight"))


TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]{2,}')"
TW = f"""WITH w AS (SELECT doc_id, {TERMS} AS ws FROM documents)"""


@query(TW + """, t AS (SELECT DISTINCT doc_id, unnest(ws) AS term FROM w UNION SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
f AS (SELECT term FROM t GROUP BY term HAVING count(*) >= 2) SELECT doc_id, count(*) AS terms FROM t JOIN f USING (term) GROUP BY doc_id""")
def tfidf_bigrams(spark, d):
    return TF.term_numbers(table(spark, d, "documents"), "doc_id", TF.words(F.col("text")), grams=2)


@query(TW + """, u AS (SELECT doc_id, unnest(ws) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS n FROM u GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), nn AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
x AS (SELECT doc_id, term, (1 + ln(tf.n)) * (ln((1 + nn.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nn), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY doc_id), y AS (SELECT doc_id, term, w / l AS weight FROM x JOIN l USING (doc_id)),
c AS (SELECT term, avg(weight) - 0.05 AS coef FROM y GROUP BY term), z AS (SELECT doc_id, term, round(weight * coef, 9) AS contribution FROM y JOIN c USING (term)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, term) AS INTEGER) AS rank FROM z) SELECT doc_id, term, contribution, rank FROM r WHERE rank <= 12""")
def top_terms(spark, d):
    m = TF.matched(table(spark, d, "documents"), "doc_id", TF.words(F.col("text")), grams=1, min_df=2, few=200_000)
    lists = written(TF.listed(m, "doc_id"), "weights")
    coef = TF.flat(lists, m, "doc_id").groupBy("term").agg((F.avg("weight") - 0.05).alias("coef"))
    return TF.top_listed(lists, m, coef, "doc_id", 12)


OTHERS = ["10.1.2.3", "172.16.9.9", "172.32.0.1", "192.168.7.7", "169.254.0.9", "93.184.0.1", "8.8.8.80"]
SUFFIXES = ["", "www.", "a.b.", "not"]


@query(with_views("alerts", f""", x AS (SELECT alert_id, CAST({[*T.COMMON_ADDRESSES, *OTHERS]} AS VARCHAR[])[1 + alert_id % {len(T.COMMON_ADDRESSES) + len(OTHERS)}] AS ip, CAST({SUFFIXES} AS VARCHAR[])[1 + alert_id % 4] || CAST({[*T.COMMON_DOMAINS, 'h0.test']} AS VARCHAR[])[1 + alert_id // 4 % {len(T.COMMON_DOMAINS) + 1}] AS dom FROM alerts)
SELECT alert_id, ip IN ({str(T.COMMON_ADDRESSES)[1:-1]}) OR ip LIKE '10.%' OR ip LIKE '192.168.%' OR ip LIKE '169.254.%' OR regexp_matches(ip, '^172[.](1[6-9]|2[0-9]|3[01])[.]') AS ip_blocked,
 regexp_matches(dom, '(^|[.])({'|'.join(x.replace('.', '[.]') for x in T.COMMON_DOMAINS)})$') AS domain_blocked FROM x"""))
def ioc_blocklist(spark, d):
    """All listed addresses and domains, their neighbours, subdomains and look-alikes."""
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), (i % len(xs)).cast("int"))
    i = F.col("alert_id")
    ip = pick([*T.COMMON_ADDRESSES, *OTHERS], i)
    dom = F.concat(pick(SUFFIXES, i), pick([*T.COMMON_DOMAINS, "h0.test"], F.floor(i / 4)))
    return alerts(spark, d).select("alert_id", T.blocked_ioc(F.lit("ip"), ip).alias("ip_blocked"), T.blocked_ioc(F.lit("domain"), dom).alias("domain_blocked"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id, v FROM e WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS a, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS c FROM q JOIN e ON e.vec_id IS DISTINCT FROM q.vec_id)
SELECT q.vec_id AS a, (SELECT count(*) FROM p WHERE p.a = q.vec_id AND c >= 0.2) AS n FROM (SELECT DISTINCT vec_id FROM q) q""")
def cosine_match(spark, d):
    """Each twentieth vector against all vectors at 0.2; 0 without a match."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.cosine_counts(e.filter("vec_id % 20 = 0"), e, 0.2)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id, v FROM e WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS a, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS c FROM q JOIN e ON e.vec_id IS DISTINCT FROM q.vec_id)
SELECT q.vec_id AS a, (SELECT count(*) FROM p WHERE p.a = q.vec_id AND c >= 0.1) AS n FROM (SELECT DISTINCT vec_id FROM q) q""")
def cosine_match_all(spark, d):
    """``cosine_match`` at 0.1: more matches for each vector."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.cosine_counts(e.filter("vec_id % 20 = 0"), e, 0.1)


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM e GROUP BY ALL), l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY label)
SELECT label, i - 1 AS dim, round(m / l, 6) AS x FROM m JOIN l USING (label)""")
def embedding_pool(spark, d):
    """Mean of the vectors of a label, scaled to unit length, a row for each dimension."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    m = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    return m.join(length, "label").select("label", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("m") / F.col("len"), 6).alias("x"))


@query(with_views("alerts", "SELECT alert_id, CASE WHEN k % 3 = 0 THEN 1.0 WHEN k % 3 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS grounded FROM alerts"))
def groundedness(spark, d):
    """Share of claimed addresses that the evidence has; 1 without claims."""
    rx, m = F.lit(r"\d+\.\d+\.\d+\.\d+"), F.col("k") % 3
    claim = F.when(m == 0, "nothing").when(m == 1, F.concat(F.lit("saw "), "ip", F.lit(" and 9.9.9.9"))).otherwise("saw 9.9.9.9")
    c = F.array_distinct(F.regexp_extract_all(claim, rx, F.lit(0)))
    e = F.array_distinct(F.regexp_extract_all(F.concat(F.lit("evidence "), "ip"), rx, F.lit(0)))
    score = F.when(F.size(c) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(c, e)) / F.size(c))
    return alerts(spark, d).select("alert_id", score.alias("grounded"))


@query("WITH RECURSIVE q AS (SELECT p_partkey, p_name AS x, p_brand || ' ' || p_name AS y FROM part)" + lcs_sql("q") + " SELECT p_partkey, round(r, 2) AS ratio FROM q JOIN ratio USING (x, y)")
def token_sort_ratio(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_name").alias("other"))
    return p.select("p_partkey", F.round(S.token_sort_ratio("p_name", "other"), 2).alias("ratio"))


def entity_spans(docs, size=600, step=500):
    """Capitalised words in overlapping windows, each match at its own place in the text. A
    match at an inner edge of a window may be a cut word and is dropped: the next window has
    it whole. Words that no overlap holds are found in the whole text."""
    n, least = F.length("text"), size - step - 1
    wins = docs.filter("text is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step))).alias("at"), "text", n.alias("n")).select("doc_id", "at", "n", F.expr(f"substring(text, at + 1, {size})").alias("w"))
    found = wins.select("doc_id", "at", "n", F.explode(T.spans(F.col("w"), r"(?U)\b[A-Z][a-z]{5,}\b")).alias("m"))
    whole = ((F.col("m.first") > 0) | (F.col("at") == 0)) & ((F.col("m.end") < size) | (F.col("at") + F.col("m.end") == F.col("n")))
    short = found.filter(whole).select("doc_id", F.col("m.found").alias("value"), (F.col("at") + F.col("m.first")).cast("long").alias("start"))
    wide = docs.select("doc_id", F.explode(T.spans(F.col("text"), rf"(?U)\b[A-Z][a-z]{{{max(5, least - 1)},}}\b")).alias("m")).select("doc_id", F.col("m.found").alias("value"), F.col("m.first").cast("long").alias("start"))
    return short.unionByName(wide)


@query("""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS g, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS f FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, unnest(f) AS value, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM s WHERE len(f) > 0),
p AS (SELECT doc_id, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i) - length(value) AS BIGINT) AS start FROM i)
SELECT doc_id, value, start, 1.0::DOUBLE AS score FROM p WHERE regexp_full_match(value, '[A-Z][a-z]{5,}')""")
def span_dedupe(spark, d):
    """Entity spans of overlapping windows, in the text's own offsets: one of each label and
    place, the best scored."""
    spans = entity_spans(table(spark, d, "documents"))
    return spans.withColumn("score", F.lit(1.0)).groupBy("doc_id", "value", "start").agg(F.max("score").alias("score"))


#: Letters whose counts stand for an encoder here; a model's is a parameter of the operator.
COUNTED = "aeinst"


@query(f"""WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), w AS (SELECT text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM t),
i AS (SELECT text, ws, unnest(range(0, greatest((len(ws) + 63) // 64, 1))) AS i FROM w), p AS (SELECT text, array_to_string(ws[64 * i + 1:64 * i + 64], ' ') AS p FROM i),
d AS (SELECT text, unnest(string_split('{COUNTED}', '')) AS c, p FROM p), m AS (SELECT text, c, avg(length(p) - length(replace(p, c, ''))) AS m FROM d GROUP BY text, c),
l AS (SELECT text, sqrt(sum(m * m)) AS l FROM m GROUP BY text)
SELECT doc_id, CAST(strpos('{COUNTED}', c) - 1 AS INTEGER) AS dim, round(CASE WHEN l > 0 THEN m / l ELSE 0 END, 6) AS x FROM documents JOIN m ON m.text = coalesce(documents.text, '') JOIN l ON l.text = m.text""")
def text_pool(spark, d):
    """Vectors of whole texts from windows of 64 words, a row for each dimension."""
    from ..operators.pooling import pooled

    def encode(words):
        text = F.array_join(words, " ")
        return F.array(*[(F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in COUNTED])

    out = pooled(table(spark, d, "documents"), "doc_id", "text", encode, 64)
    return out.select("doc_id", F.posexplode("vector").alias("dim", "x")).select("doc_id", "dim", F.round("x", 6).alias("x"))
