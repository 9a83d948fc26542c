"""Nested alert documents: parsing, flattening, vendor formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OBJECT = "struct<type:string,value:string,name:string,description:string,created:string,user_id:string,account_login:string,hashes:map<string,string>,external_references:array<struct<source_name:string,external_id:string>>,extensions:map<string,struct<vendor_specific:struct<notable_fields:map<string,string>,result:map<string,string>>>>>"
BUNDLE = f"struct<type:string,objects:array<{OBJECT}>>"
#: The file hashes that count, in order.
HASHES = ("MD5", "SHA-1", "SHA-256", "SHA-512")
SLOTS = ("ip", "user", "email", "domain", "url", "file_hash")
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def _values(objects: Column, *kinds: str) -> Column:
    return F.transform(F.filter(objects, lambda o: o["type"].isin(*kinds)), lambda o: o["value"])


def _clean(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def notable_iocs(fields: Column, kind: str, names: list[str]) -> Column:
    """Values of the named fields that fit the kind: addresses without port, domains that
    are no addresses, mail with an @. A JSON list gives its strings."""
    raw = F.transform(F.array(*[F.try_element_at(fields, F.lit(n)) for n in names]), lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    v = F.transform(F.filter(F.flatten(F.filter(raw, lambda x: x.isNotNull())), lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.trim(x))
    if kind == "ip":
        v = F.filter(F.transform(v, lambda x: F.when(x.contains(":") & x.contains("."), F.element_at(F.split(x, ":"), 1)).otherwise(x)), lambda x: x.rlike(IPV4))
    if kind == "domain":
        v = F.filter(v, lambda x: ~x.rlike(IPV4))
    if kind == "email":
        v = F.filter(v, lambda x: x.contains("@"))
    return v


#: The notable fields that hold each kind of indicator.
NOTABLE_FIELDS = {
    "ip": ["src_ip", "dest_ip", "src", "dest"], "user": ["user", "src_user"], "domain": ["domain", "dest_domain"],
    "email": ["sender", "recipient"], "url": ["url"], "file_hash": ["file_hash"],
}


def parsed(df: DataFrame, bundle: str = "bundle", include_email_objects: bool = False, field_map: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds alert_name, description, the six lists of indicators and ``error`` (the bundle
    can't be read). The last indicator names the alert."""
    fields = NOTABLE_FIELDS if field_map is None else field_map
    df = df.withColumn("__b", F.from_json(bundle, BUNDLE))
    o = F.coalesce(F.col("__b.objects"), F.array().cast(f"array<{OBJECT}>"))
    last = lambda kind, f: F.try_element_at(F.filter(o, lambda x: x["type"] == kind), F.lit(-1))[f]
    users = F.flatten(F.transform(F.filter(o, lambda x: x["type"] == "user-account"), lambda x: F.array(x["user_id"], x["account_login"])))
    hashes = F.flatten(F.transform(F.filter(o, lambda x: x["type"] == "file"), lambda x: F.array(*[F.try_element_at(x["hashes"], F.lit(h)) for h in HASHES])))
    vendor = F.transform(F.filter(o, lambda x: x["type"] == "indicator"), lambda x: F.get(F.map_values(x["extensions"]), F.lit(0))["vendor_specific"])
    notable = F.coalesce(F.try_element_at(F.filter(F.transform(vendor, lambda v: F.coalesce(v["notable_fields"], v["result"])), lambda v: v.isNotNull()), F.lit(1)), F.create_map().cast("map<string,string>"))
    own = {
        "ip": _values(o, "ipv4-addr", "ipv6-addr"), "user": users, "email": _values(o, "email-addr") if include_email_objects else F.array().cast("array<string>"),
        "domain": _values(o, "domain-name"), "url": _values(o, "url"), "file_hash": hashes,
    }
    cols = {f"{k}s": _clean(F.concat(v, notable_iocs(notable, k, fields[k]))) for k, v in own.items()}
    out = df.withColumns({"alert_name": F.coalesce(last("indicator", "name"), F.lit("")), "description": F.coalesce(last("identity", "description"), F.lit("")), "error": F.col("__b.objects").isNull() & F.try_parse_json(bundle).isNull(), **cols})
    return out.drop("__b")


NORMS = {"ip": T.norm_ip, "user": T.norm_plain, "email": T.norm_plain, "domain": T.norm_domain, "url": T.norm_url, "file_hash": T.norm_plain}


def normalised(df: DataFrame) -> DataFrame:
    """The lists of indicators in normal form, sorted and distinct."""
    return df.withColumns({f"{k}s": F.array_sort(_clean(F.transform(f"{k}s", NORMS[k]))) for k in SLOTS})


def flattened(df: DataFrame, bundle: str = "bundle") -> DataFrame:
    """Counts and first values per object type, for profiling."""
    b = F.from_json(bundle, BUNDLE)["objects"]
    n = lambda *k: F.size(F.filter(b, lambda o: o["type"].isin(*k))).cast("bigint")
    attack = F.flatten(F.transform(F.filter(b, lambda o: o["type"] == "attack-pattern"), lambda o: F.transform(F.coalesce(o["external_references"], F.array().cast("array<struct<source_name:string,external_id:string>>")), lambda r: r["external_id"])))
    return df.withColumns({
        "n_objects": F.size(b).cast("bigint"), "n_observables": n("ipv4-addr", "ipv6-addr", "domain-name", "url", "file", "user-account"),
        "first_ip": F.get(_values(b, "ipv4-addr", "ipv6-addr"), F.lit(0)), "first_domain": F.get(_values(b, "domain-name"), F.lit(0)), "attack_ids": F.array_join(attack, ";"),
    })


def json_expanded(df: DataFrame, column: str, prefix: str, fields: list[str]) -> DataFrame:
    """Named fields of a JSON column as ``prefix`` columns; what can't be read stays raw."""
    m = F.from_json(column, "map<string,string>")
    out = df.withColumn("__m", m)
    cols = {f"{prefix}{f}": F.try_element_at("__m", F.lit(f)) for f in fields}
    return out.withColumns(cols | {f"{prefix}raw": F.when(F.col("__m").isNull(), F.col(column))}).drop("__m")


def vendor_extracted(df: DataFrame, payload: str = "payload") -> DataFrame:
    """vendor, sources, dests (with domains), category, source and alert_key of raw payloads
    in five formats; the first that fits counts."""
    m = F.from_json(payload, "map<string,string>")
    out = df.withColumn("__m", m)
    g = lambda k: F.try_element_at("__m", F.lit(k))
    has = lambda *ks: F.exists(F.map_keys("__m"), lambda k: k.isin(*ks))
    many = lambda *ks: F.coalesce(*[F.from_json(g(k), "array<string>") for k in ks], F.array().cast("array<string>"))
    one = lambda *ks: F.filter(F.array(F.coalesce(*[F.nullif(g(k), F.lit("")) for k in ks])), lambda x: x.isNotNull())
    vendor = (
        F.when(has("DetectName", "DetectId", "CompositeId"), "endpoint").when(has("search_name", "rule_name", "_raw"), "siem").when(has("AlertName"), "cloud_siem")
        .when(has("sourceIps", "source_ips"), "pre_extracted").otherwise("generic")
    )
    out = out.withColumn("vendor", vendor)
    v = F.col("vendor")
    remote = F.filter(F.transform(F.from_json(g("NetworkAccesses"), "array<struct<RemoteAddress:string>>"), lambda x: x["RemoteAddress"]), lambda x: x.isNotNull() & (x != ""))
    entities = F.transform(F.filter(F.from_json(g("Entities"), "array<struct<Type:string,Address:string>>"), lambda e: F.lower(e["Type"]).isin("ip") & e["Address"].isNotNull()), lambda e: e["Address"])
    none = F.array().cast("array<string>")
    pick = lambda pre, end, siem, cloud, other: F.when(v == "pre_extracted", pre).when(v == "endpoint", end).when(v == "siem", siem).when(v == "cloud_siem", cloud).otherwise(other)
    return out.withColumns({
        "sources": pick(many("sourceIps", "source_ips"), one("LocalIP"), one("src_ip"), F.coalesce(entities, none), one("src_ip", "source_ip", "sourceAddress", "attacker_ip")),
        "dests": pick(F.concat(many("destIps", "dest_ips"), many("domains")), F.coalesce(remote, none), one("dest_ip"), none, one("dest_ip", "destination_ip", "destinationAddress", "target_ip")),
        "category": pick(
            F.coalesce(g("alertCategory"), g("alert_category"), F.lit("unknown")), F.coalesce(g("Name"), g("DetectName"), g("Tactic"), F.lit("Endpoint Detection")),
            F.coalesce(g("search_name"), g("rule_name"), F.lit("SIEM Alert")), F.coalesce(g("AlertName"), F.lit("Cloud SIEM Alert")), F.coalesce(g("alert_name"), g("rule_name"), g("title"), F.lit("unknown")),
        ),
        "alert_key": pick(F.coalesce(g("alertId"), g("alert_id")), F.coalesce(g("CompositeId"), g("DetectId")), F.coalesce(g("source_guid"), g("event_id")), g("SystemAlertId"), g("alert_id")),
    }).drop("__m")
