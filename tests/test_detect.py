import csv
import math
import os

import pytest
from pyspark.sql import functions as F

from flowwarden.functions.severity import severity_score
from flowwarden.functions.text import percent_text, strip_emoji
from flowwarden.operators import chain as C
from flowwarden.operators import detect as D
from flowwarden.operators import prepare as P

COLUMNS = ("flow_id long, duration long, protocol_type string, service string, flag string, src_bytes long, "
           "dst_bytes long, count long, srv_count long, serror_rate double, num_failed_logins long, "
           "dst_host_count long, intrusion_probability double")


def flow(flow_id=0, duration=0, protocol_type="tcp", service="http", flag="SF", src_bytes=0, dst_bytes=0, count=0,
         srv_count=0, serror_rate=0.0, num_failed_logins=0, dst_host_count=0, p=0.02):
    return (flow_id, duration, protocol_type, service, flag, src_bytes, dst_bytes, count, srv_count, serror_rate,
            num_failed_logins, dst_host_count, p)


def graded(spark, rows, threshold=0.01):
    df = D.predict_class(spark.createDataFrame(rows, COLUMNS), threshold)
    return D.summarise_action(D.grade(df))


EDGES = [
    ({"src_bytes": 10000}, 0), ({"src_bytes": 10001}, 1), ({"src_bytes": 50000}, 1), ({"src_bytes": 50001}, 2),
    ({"src_bytes": 100000}, 2), ({"src_bytes": 100001}, 3),
    ({"count": 20}, 0), ({"count": 21}, 1), ({"count": 100}, 1), ({"count": 101}, 2), ({"count": 300}, 2), ({"count": 301}, 3),
    ({"num_failed_logins": 1}, 0), ({"num_failed_logins": 2}, 1), ({"num_failed_logins": 3}, 1),
    ({"num_failed_logins": 4}, 2), ({"num_failed_logins": 5}, 2), ({"num_failed_logins": 6}, 3),
    ({"serror_rate": 0.1}, 0), ({"serror_rate": 0.11}, 1), ({"serror_rate": 0.3}, 1), ({"serror_rate": 0.31}, 2),
    ({"serror_rate": 0.5}, 2), ({"serror_rate": 0.51}, 3),
    ({"dst_host_count": 50}, 0), ({"dst_host_count": 51}, 2), ({"dst_host_count": 100}, 2), ({"dst_host_count": 101}, 3),
    ({"srv_count": 20}, 0), ({"srv_count": 21}, 2), ({"duration": 1000}, 0), ({"duration": 1001}, 1),
    ({"p": 0.4999}, 0), ({"p": 0.5}, 1), ({"p": 0.7}, 2), ({"p": 0.9}, 3),
    ({"src_bytes": None}, 0), ({"serror_rate": math.nan}, 0), ({"serror_rate": None}, 0), ({"p": 0.02}, 0),
]


def test_band_edges(spark):
    rows = graded(spark, [flow(flow_id=i, **kw) for i, (kw, _) in enumerate(EDGES)]).orderBy("flow_id").collect()
    assert [r["severity_score"] for r in rows] == [pts for _, pts in EDGES]


def test_levels(spark):
    rows = graded(spark, [
        flow(0, p=0.001, src_bytes=10**6), flow(1), flow(2, src_bytes=200000, duration=2000),
        flow(3, src_bytes=200000, count=400, srv_count=30), flow(4, src_bytes=200000, count=400, duration=1001, p=0.02),
    ]).orderBy("flow_id").collect()
    assert [r["severity_level"] for r in rows] == [0, 1, 2, 3, 2]
    assert rows[0]["action_summary"] == "Normal traffic"
    assert [r["severity_name"] for r in rows] == ["NORMAL", "LOW RISK", "MEDIUM RISK", "HIGH RISK", "MEDIUM RISK"]


def test_published_summaries(spark):
    rows = graded(spark, [
        flow(0, duration=7, protocol_type="icmp", service="ftp", src_bytes=2282, dst_bytes=3287, count=15, srv_count=36,
             dst_host_count=129, p=0.05275423),
        flow(1, src_bytes=60000, count=250, num_failed_logins=6, p=0.99999, dst_host_count=200),
        flow(2, p=0.0105),
    ]).orderBy("flow_id").collect()
    assert rows[0]["severity_level"] == 2 and rows[0]["action_summary"] == (
        "MEDIUM RISK: Review immediately and monitor source. Likely intrusion with 5.3% confidence. "
        "Check logs for similar activity.")
    assert rows[1]["action_summary"] == (
        "HIGH RISK - CRITICAL: Block source IP immediately! Serious attack detected with 100.0% confidence. "
        "Initiate incident response. Password attack in progress! Possible data exfiltration! Active port scanning detected!")
    assert rows[2]["action_summary"].endswith(f"Confidence: {0.0105:.1%}.")


#: The lists that the published log shows for its two levels.
PUBLISHED_LISTS = {
    2: (["Mark this traffic for immediate security review", "Slow down or limit data from this source", "Activate intrusion detection systems"],
        ["Monitor this source IP in real-time", "Check security logs for previous activity", "Look up IP reputation online"]),
    3: (["BLOCK this source IP immediately", "Add IP to firewall blacklist", "Drop all packets from this source", "Cut off active connections"],
        ["Check if other IPs from same network are attacking", "Look for signs of system compromise", "Check if IP is part of known botnet"]),
}


def test_published_run(spark):
    """All 20 flows of the published run: class, level, summary, log entries and totals."""
    with open(os.path.join(os.path.dirname(__file__), "published_flows.csv"), encoding="utf-8") as f:
        published = list(csv.DictReader(f))
    kinds = dict(x.split() for x in COLUMNS.split(", "))
    typed = lambda name, text: text if kinds[name] == "string" else float(text) if kinds[name] == "double" else int(text)
    rows = [tuple(i if name == "flow_id" else typed(name, r[name]) for name in kinds) for i, r in enumerate(published)]
    g = graded(spark, rows)
    got = g.orderBy("flow_id").collect()
    for r, want in zip(got, published):
        assert (r["predicted_class"], str(r["severity_level"]), r["severity_name"], r["action_summary"]) == (
            want["predicted_class"], want["severity_level"], want["severity_name"], want["action_summary"]), r["flow_id"]
    assert [r["severity_score"] for r in got if r["flow_id"] in (2, 6)] == [5, 5]
    entries = D.alerts(g).orderBy("sample_index").collect()
    assert [r["sample_index"] for r in entries] == [2, 6, *range(10, 20)]
    for r in entries:
        now, watch = PUBLISHED_LISTS[r["severity_level"]]
        now = now + ["Block port scan - probing for weaknesses"] * (r["sample_index"] in (12, 16))
        assert (r["immediate_actions"], r["monitoring_actions"]) == (now, watch)
        assert r["network_features"]["src_bytes"] == float(published[r["sample_index"]]["src_bytes"]) and r["network_features"]["dst_ip"] is None
    log = C.append_flows(g, at="2025-11-23 09:26:34.284704")
    assert tuple(C.log_summary(log).select("total_blocks", "total_intrusions", "is_valid").first()) == (13, 12, True)
    assert {r["severity_name"]: r["n"] for r in C.log_severity(log).collect()} == {"LOW RISK": 0, "MEDIUM RISK": 2, "HIGH RISK": 10}


def test_logged_lists(spark):
    g = graded(spark, [flow(0, src_bytes=20000, count=150, srv_count=30),
                       flow(1, src_bytes=200000, count=400, num_failed_logins=7)])
    full = {r["flow_id"]: r for r in D.respond(g).collect()}
    assert full[0]["monitoring_actions"][-2:] == [
        "High outbound data - possible data theft", "Many connections - possible network scan"]
    assert full[1]["immediate_actions"][4:] == [
        "Lock user accounts - password guessing attack", "Large data transfer - investigate data theft",
        "Block port scan - probing for weaknesses"]
    logged = {r["sample_index"]: r for r in D.alerts(g).collect()}
    assert len(logged[0]["monitoring_actions"]) == 3 and len(logged[1]["immediate_actions"]) == 7
    assert logged[0]["network_features"]["src_bytes"] == 20000.0
    assert logged[0]["network_features"]["src_ip"] is None


def test_percent_text_equals_python(spark):
    values = [i / 2000 for i in range(2001)] + [0.0527542307972908, 0.0125, 0.0375]
    rows = spark.createDataFrame([(v,) for v in values], "p double").select("p", percent_text(F.col("p")).alias("t")).collect()
    assert all(r["t"] == f"{r['p']:.1%}" for r in rows)


def test_indicators(spark):
    df = spark.createDataFrame([flow(0, src_bytes=100001, dst_bytes=99, count=301, serror_rate=0.6, num_failed_logins=4,
                                     dst_host_count=101), flow(1, dst_bytes=500)], COLUMNS)
    rows = {r["flow_id"]: r for r in D.with_indicators(df).collect()}
    assert len(rows[0]["indicators"]) == 6 and len(rows[0]["shown_indicators"]) == 3
    assert rows[0]["indicators"][4] == "4 failed logins - password guessing attack"
    assert rows[1]["indicators"] == []


def test_absent_columns_count_as_zero(spark):
    df = spark.createDataFrame([(1, 200000)], "flow_id long, src_bytes long").withColumn("intrusion_probability", F.lit(0.2))
    assert df.select(severity_score(df, "intrusion_probability").alias("s")).first()["s"] == 3
    assert [s[:9] for s in D.with_indicators(df).first()["indicators"]] == ["Extremely", "One-sided"]


def test_empty_and_one_class(spark):
    empty = graded(spark, [])
    assert D.detection_summary(empty).first()["intrusion_pct"] == 0.0
    assert [r["n"] for r in D.severity_breakdown(empty).collect()] == [0, 0, 0, 0]
    assert D.alerts(graded(spark, [flow(p=0.0)])).count() == 0


def test_missing_class_is_an_attack(spark):
    rows = P.label_flows(spark.createDataFrame([("normal",), (None,), ("neptune",)], "class string")).collect()
    assert [r["y"] for r in rows] == [0, 1, 1]


@pytest.mark.parametrize("text,want", [("a\U0001F600b", "ab"), ("\U0001F680✅ ok", " ok"), ("éß", "éß"),
                                       ("Ⓜx中", "x"), ("", "")])
def test_strip_emoji(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(strip_emoji(F.col("t")).alias("t")).first()["t"] == want
