"""Scalar expressions over indicators, titles and rendered text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, sums_before

#: Severity words and their numbers.
SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0, "informational": 0}

#: What counts as no value in a rendered notable.
EMPTY_VALUES = ("none", "null", "-", "unknown")

#: Fixed value: dates, long numbers, years and clock times that rendering removes.
TIMES = r"20\d{2}[-/]\d{1,2}[-/]\d{1,2}(?:[T ][\d:.]+(?:Z|[+-]\d{2}:?\d{2})?)?|\b\d{9,}(?:\.\d+)?\b|\b20[2-3]\d\b|\b\d{1,2}:\d{2}(?::\d{2})?\b"

#: Category by the first text that a search name contains.
CATEGORIES = [
    ("Brute Force", "brute_force"), ("Port scan", "port_scan"), ("Canary", "port_scan"), ("Failed Login", "failed_login"),
    ("Suspicious", "suspicious_activity"), ("Defender", "defender_alert"), ("Heartbeat", "heartbeat"), ("Risk", "risk_threshold"),
    ("Added to a role", "identity_change"), ("Rights Delegation", "identity_change"),
]

#: Tokens of keys that name a person or account, and of keys that only describe one.
NAME_TOKENS = ["user", "users", "username", "account", "accountname", "actor", "caller", "principal", "upn", "entity", "sid", "duser", "object", "owner"]
OTHER_TOKENS = [
    "type", "category", "priority", "priorities", "severity", "severities", "urgency", "country", "city", "state", "dept", "department",
    "title", "error", "count", "score", "id", "first", "last", "bunit", "watchlist", "email", "domain", "status", "time", "date", "tag",
    "role", "realname", "nick", "field", "length", "hash",
]

#: Fixed value: where a key's name is cut into tokens.
KEY_SEAMS = r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])"

#: Addresses and domains too common to tell alerts apart.
COMMON_ADDRESSES = ["8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220", "0.0.0.0", "127.0.0.1", "255.255.255.255"]
COMMON_NETWORKS = r"^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)"
COMMON_DOMAINS = [
    "microsoft.com", "windows.com", "windowsupdate.com", "google.com", "googleapis.com", "gstatic.com", "github.com", "amazon.com",
    "amazonaws.com", "cloudflare.com", "akamaized.net", "fastly.net", "cloudfront.net", "akamai.com", "example.com", "localhost",
]

#: What saved-search names begin and end with.
SEARCH_PREFIXES = ("Endpoint - ", "Threat - ", "Access - ", "Network - ")
SEARCH_SUFFIXES = (" - Rule Clone", " - Rule")


def severity_number(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.coalesce(word, F.lit("")))), F.lit(-1))


def norm_ip(value: Column) -> Column:
    """Without a prefix length; IPv4 octets lose leading zeros, IPv6 is written in full."""
    v = F.element_at(F.split(F.trim(value), "/"), 1)
    octets = F.split(v, r"\.")
    plain = F.forall(octets, lambda o: o.rlike(r"^\d+$"))
    v4 = F.array_join(F.transform(octets, lambda o: F.coalesce(F.nullif(F.regexp_replace(o, "^0+", ""), F.lit("")), F.lit("0"))), ".")
    low = F.lower(v)
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = groups(F.element_at(F.split(low, "::", 2), 1)), groups(F.element_at(F.split(low, "::", 2), -1))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    full = F.when(low.contains("::"), filled).otherwise(F.split(low, ":"))
    v6 = F.array_join(F.transform(F.slice(full, 1, 8), lambda g: F.when(F.length(g) >= 4, g).otherwise(F.lpad(g, 4, "0"))), ":")
    return F.when(v.contains(":") & ~v.contains("."), v6).when((F.size(octets) == 4) & plain, v4).otherwise(low)


def norm_domain(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"\.$", "")


def norm_plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def norm_url(value: Column) -> Column:
    """Scheme and host in lower case, the scheme's own port and the fragment dropped, the
    rest as it is; no scheme means http. One regular expression takes the parts."""
    v = F.trim(value)
    rx = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(v, rx, i)
    scheme = F.when(part(1) == "", "http").otherwise(F.lower(part(1)))
    user = F.regexp_extract(part(2), r"^(.*@)", 1)
    host = F.lower(F.regexp_extract(part(2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    port = F.regexp_replace(F.regexp_extract(part(2), r":(\d+)$", 1), "^0+", "")
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    net = F.concat(user, host, F.when((port == "") | own, "").otherwise(F.concat(F.lit(":"), port)))
    query = F.when(part(4) == "", "").otherwise(F.concat(F.lit("?"), part(4)))
    path = F.when((net != "") & (part(3) != "") & ~part(3).startswith("/"), F.concat(F.lit("/"), part(3))).otherwise(part(3))
    mark = F.when((net != "") | (path == "") | path.startswith("/"), F.lit("://")).otherwise(F.lit(":"))
    return F.concat(scheme, mark, net, path, query)


def ioc_type(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(v == "", "").when(v.rlike(r"^https?://"), "URL").when(v.contains("@") & v.contains("."), "Email").when(v.rlike(r"^[0-9a-fA-F]{32,128}$"), "Hash")
        .when(v.contains(":"), "IPv6").when(v.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), "IPv4").otherwise("Other")
    )


def alert_category(search: Column) -> Column:
    out = None
    for text, name in CATEGORIES:
        out = F.when(search.contains(text), name) if out is None else out.when(search.contains(text), name)
    return out.otherwise("other")


def detection_category(title: Column) -> Column:
    t = F.trim(title)
    return F.when(t.contains(" - "), F.lower(F.trim(F.element_at(F.split(t, " - "), 1)))).otherwise("unclassified")


def rule_of_search(search: Column) -> Column:
    """The saved search's name without the listed prefixes and suffixes, each once, in order."""
    for p in SEARCH_PREFIXES:
        search = F.regexp_replace(search, f"^{p}", "")
    for s in SEARCH_SUFFIXES:
        search = F.regexp_replace(search, f"{s}$", "")
    return search


def scrub_time(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + TIMES, " ")


def parsed_kv(text: Column) -> Column:
    """map of key="value" and key=value pairs; the last of a key counts."""
    rx = r'(\w+)="([^"]*)"|(\w+)=(\S+)'
    whole = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    value = lambda m: F.when(m.rlike(r'^\w+="[^"]*"$'), F.regexp_extract(m, r'="([^"]*)"$', 1)).otherwise(F.regexp_extract(m, r"^\w+=(.*)$", 1))
    # sorted by key and place, the last of a key is the one before another key
    pairs = F.array_sort(F.transform(whole, lambda m, i: F.struct(F.regexp_extract(m, r"^(\w+)=", 1).alias("k"), i.alias("i"), value(m).alias("v"))))
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: F.coalesce(F.get(ps, i + 1)["k"] != p["k"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def key_tokens(key: Column) -> Column:
    return F.transform(F.filter(F.split(key, KEY_SEAMS), lambda t: t != ""), F.lower)


def is_identity_key(key: Column) -> Column:
    t = key_tokens(key)
    return F.arrays_overlap(t, F.array(*map(F.lit, NAME_TOKENS))) & ~F.arrays_overlap(t, F.array(*map(F.lit, OTHER_TOKENS)))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def rendered(entries: Column, drop: Sequence[str] = (), keep: Sequence[str] | None = None) -> Column:
    """A map of strings as ``key value`` text: sorted keys, times scrubbed, empty values and
    their keys gone, lower case."""
    def clean(e: Column) -> Column:
        return F.struct(e["key"].alias("key"), F.trim(scrub_time(e["value"])).alias("value"))

    def wanted(e: Column) -> Column:
        ok = e["value"].isNotNull() & (e["value"] != "") & ~F.lower(e["value"]).isin(*EMPTY_VALUES)
        if drop:
            ok = ok & ~e["key"].isin(*drop)
        return ok & e["key"].isin(*keep) if keep is not None else ok

    pairs = F.filter(F.transform(F.array_sort(F.map_entries(entries)), clean), wanted)
    return F.lower(F.array_join(F.transform(pairs, lambda e: F.concat_ws(" ", e["key"], e["value"])), " "))


def slot_hash(slot: str, values: Column) -> Column:
    """SHA-256 of the slot's name and its sorted distinct values; null without any."""
    v = F.sort_array(F.array_except(values, F.array(F.lit(""), F.lit(None).cast("string"))))
    return F.sha2(F.concat(F.lit(f"{slot}:"), F.nullif(F.array_join(v, ","), F.lit(""))), 256)


def composite_keys(sources: Column, dests: Column, category: Column, bucket: Column) -> Column:
    """A SHA-256 key for each distinct source, sorted; without sources, for an empty one."""
    s = F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit("")))
    d = F.array_join(F.array_sort(dests), ",")
    return F.transform(s, lambda x: F.sha2(F.concat_ws("|", x, d, category, bucket.cast("string")), 256))


def blocked_ioc(kind: Column, value: Column) -> Column:
    """Indicators too common to tell alerts apart: private, link-local, loopback, broadcast
    and public resolver addresses; common domains and what is below them. Other kinds never."""
    ip = value.rlike(COMMON_NETWORKS) | value.isin(*COMMON_ADDRESSES)
    # the value's own suffixes, looked up among the listed ones
    parts = F.split(F.lower(value), r"\.")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    domain = tail(1).isin(*[d for d in COMMON_DOMAINS if "." not in d]) | tail(2).isin(*[d for d in COMMON_DOMAINS if "." in d])
    return F.when(kind == "ip", ip).when(kind == "domain", domain).otherwise(F.lit(False))


def slug(value: Column) -> Column:
    """A value as one token: lower case, other characters as single underscores, none at the
    ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def elided(value: Column, most: int = 46, head: int = 26, tail: int = 18) -> Column:
    """Long values lose their middle, as names often differ at the end only."""
    return F.when(F.char_length(value) <= most, value).otherwise(F.concat(F.left(value, F.lit(head)), F.lit("\u2026"), F.right(value, F.lit(tail))))


def key_at(text: Column, offset: Column) -> Column:
    """The key of the ``key: value`` line that holds a place of the text."""
    line = F.concat(F.substring_index(F.left(text, offset), "\n", -1), F.substring_index(F.substr(text, offset + 1), "\n", 1))
    return F.substring_index(line, ":", 1)


def detection_domain(search: Column, rules: dict[str, Sequence[str]]) -> Column:
    """The domain whose list has exactly this search name."""
    out = F.lit("Unclassified")
    for domain, names in reversed(list(rules.items())):
        out = F.when(F.trim(search).isin(*names), domain).otherwise(out)
    return out


def folded(value: Column, fixes: dict[str, str], empty: str, placeholders: Sequence[str] = ("", "None")) -> Column:
    """Known misspellings become the right value, placeholders and null the name for none."""
    out = value
    for wrong, right in fixes.items():
        out = F.when(value == wrong, right).otherwise(out)
    return F.when(value.isNull() | value.isin(*placeholders), empty).otherwise(out)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<first, end, found>> of the leftmost non-overlapping matches, each at its
    own place, in characters. The stretches between matches give the offsets."""
    kind = "array<struct<first:int,end:int,found:string>>"
    size = lambda s: F.coalesce(F.char_length(s), F.lit(0))

    def placed(z: Column) -> Column:
        at = sums_before(F.transform(z, lambda x: size(x["gap"]) + size(x["found"])))
        each = F.zip_with(z, at, lambda x, n: F.struct((n + size(x["gap"])).alias("first"), (n + size(x["gap"]) + size(x["found"])).alias("end"), x["found"].alias("found")))
        return F.filter(each, lambda x: x["found"].isNotNull())

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(zipped, placed).cast(kind)).otherwise(F.array().cast(kind))
