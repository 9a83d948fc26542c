"""Layer one: verdicts of sets of many slots, and how often alerts are dealt."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from alertweave.operators import dedup as D
from alertweave.plans.registry import QUERIES

SLOTS = [f"s{i}" for i in range(7)]


def brute(rows, threshold):
    """The best earlier alert of each by the rule as documented."""
    out = {}
    for i, ts, c, *vals in rows:
        found = []
        for j, t, e, *own in rows:
            if c is not None and c == e and (t, j) < (ts, i):
                same = sum(x is not None and x == y for x, y in zip(vals, own))
                union = sum(x is not None or y is not None for x, y in zip(vals, own))
                if same and (conf := round(same / union, 4)) >= threshold:
                    found.append((-conf, t, j))
        best = min(found, default=None)
        out[i] = ("DUPLICATE", -best[0], best[2]) if best else ("NEW", 0.0, None)
    return out


def test_verdicts_of_sets_of_many_slots(spark):
    rng = random.Random(11)
    at = datetime(2024, 5, 1, 10, 0)
    kinds = [[rng.choice([None, "x", "x", "x", "y"]) for _ in SLOTS] for _ in range(40)] + [[None] * len(SLOTS)]
    rows = [(i, at + timedelta(seconds=rng.randrange(60)), rng.choice(["c", "d", None]), *rng.choice(kinds)) for i in range(300)]
    df = spark.createDataFrame(rows, "alert_id bigint, ts timestamp, customer string, " + ", ".join(f"{s} string" for s in SLOTS)).withColumn("alert_name", F.lit("r"))
    fp = D.fingerprints(df, {s: F.array(s) for s in SLOTS})
    for threshold in (0.5, 0.8, 0.8571, 1.0):
        got = D.dedup_l1(fp, threshold, keep=["customer", "s0"]).collect()
        assert {r.alert_id: (r.verdict, r.confidence, r.matched_alert_id) for r in got} == brute(rows, threshold)
        assert {(r.alert_id, r.customer, r.s0) for r in got} == {(i, c, v[0]) for i, _, c, *v in rows}


def test_alerts_are_dealt_once_for_their_verdicts(spark, sf_dir):
    """Besides the table of sets, alerts are scanned and shuffled once, and not broadcast to."""
    plan = QUERIES["dedup_verdicts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "event_id" in line for line in plan.splitlines()) == 1, plan
