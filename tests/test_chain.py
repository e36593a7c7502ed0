import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowwarden.operators import chain as C
from flowwarden.plans import queries as Q
from flowwarden.session import shared_folder
from flowwarden.sources import log_io as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def log(spark):
    path = shared_folder(spark)
    Q.alert_log(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def bad_segments(log):
    return {r["segment"]: r["first_bad_block"] for r in C.verify_chain(log).where("not is_valid").collect()}


def test_valid(log):
    assert bad_segments(log) == {}
    assert C.log_summary(log).first()["is_valid"] is True


def test_segments_are_bounded(log):
    assert log.groupBy("segment").count().agg(F.max("count")).first()[0] <= C.SEGMENT_SPAN + 1


def test_altered_feature(log):
    forged = log.withColumn("network_features", F.when(
        (F.col("segment") == 3) & (F.col("block_index") == 7),
        F.col("network_features").withField("src_bytes", F.lit(1.0))).otherwise(F.col("network_features")))
    assert bad_segments(forged) == {3: 7}


def test_altered_list(log):
    forged = log.withColumn("immediate_actions", F.when(
        (F.col("segment") == 1) & (F.col("block_index") == 2), F.array(F.lit("x"))).otherwise(F.col("immediate_actions")))
    assert bad_segments(forged) == {1: 2}


def test_removed_block(log):
    assert bad_segments(log.where(~((F.col("segment") == 2) & (F.col("block_index") == 5)))) == {2: 6}


def test_swapped_blocks(log):
    swap = F.when(F.col("segment") != 4, F.col("block_index")).when(F.col("block_index") == 5, 6).when(
        F.col("block_index") == 6, 5).otherwise(F.col("block_index"))
    assert list(bad_segments(log.withColumn("block_index", swap))) == [4]


def test_rewritten_hash_breaks_the_successor(log):
    forged = log.withColumn("hash", F.when(
        (F.col("segment") == 0) & (F.col("block_index") == 0), F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")))
    assert bad_segments(forged) == {0: 0}


def test_cut_tail_is_seen_by_the_heads(log):
    heads = C.chain_heads(log, levels=2)
    last = log.where("segment = 5").agg(F.max("block_index")).first()[0]
    cut = log.where(~((F.col("segment") == 5) & (F.col("block_index") == last)))
    assert bad_segments(cut) == {}
    assert {r["level"] for r in C.verify_sealed(cut, heads).collect()} == {1, 2, 3}
    assert C.verify_sealed(log, heads).count() == 0


def test_same_log_for_any_partitioning(spark, log):
    alerts = C.placed_alerts(Q.graded(spark, SF))
    want = {(r["segment"], r["block_index"]): r["hash"] for r in log.select("segment", "block_index", "hash").collect()}
    for n in (1, 5):
        got = C.append_entries(alerts.repartition(n)).select("segment", "block_index", "hash").collect()
        assert {(r["segment"], r["block_index"]): r["hash"] for r in got} == want


def test_separator_in_text_is_escaped(spark):
    row = lambda a, b: (1, 0.5, 1, a, b, "s", ["i"], ["m"], None)
    schema = ("sample_index long, intrusion_probability double, severity_level int, severity_name string, priority string, "
              "action_summary string, immediate_actions array<string>, monitoring_actions array<string>, "
              "network_features struct<duration:double,protocol_type:string,service:string,flag:string,src_bytes:double,"
              "dst_bytes:double,count:double,srv_count:double,serror_rate:double,num_failed_logins:double,"
              "dst_host_count:double,src_ip:string,dst_ip:string>")
    payloads = lambda rows: C.timed(spark.createDataFrame(rows, schema)).select(C.payload().alias("p")).distinct().count()
    assert payloads([row("a|b", "c"), row("a", "b|c")]) == 2
    listed = lambda now, p=0.5: (1, p, 1, "a", "b", "s", now, ["m"], None)
    rows = [listed(["a; b"]), listed(["a", "b"]), listed(["a\\; b"]), listed(["a"], 0.5 + 1e-9), listed(["a"])]
    assert payloads(rows) == len(rows)


def test_altered_time(log):
    forged = log.withColumn("timestamp", F.when(
        (F.col("segment") == 2) & (F.col("block_index") == 4), F.lit("2024-01-01 00:00:00.000000")).otherwise(F.col("timestamp")))
    assert bad_segments(forged) == {2: 4}
    genesis = log.withColumn("timestamp", F.when((F.col("segment") == 1) & (F.col("block_index") == 0), F.lit("x")).otherwise(F.col("timestamp")))
    assert bad_segments(genesis) == {1: 0}
    assert log.where("timestamp IS NULL").count() == 0 and "timestamp" in C.log_view(log).columns


def test_a_log_goes_on_from_stored_heads(spark, log):
    """Three runs over the same ids: one chain for each segment, one genesis block, no block twice."""
    flows, heads, parts = Q.graded(spark, SF).drop("ts").where("flow_id < 3000"), None, []
    for run in range(3):
        new = C.append_flows(flows.where(f"flow_id % 3 = {run} OR flow_id = 7"), heads=heads, at=f"run {run}").cache()
        heads = C.merged_heads(heads, C.segment_heads(new)).cache()
        parts.append(new)
        whole = parts[0] if run == 0 else whole.unionByName(new)  # noqa: F821
        assert bad_segments(whole) == {}
    assert whole.groupBy("segment", "block_index").count().where("count > 1").count() == 0
    assert whole.where("block_index = 0").count() == 3 and {r["timestamp"] for r in whole.select("timestamp").distinct().collect()} == {f"run {i}" for i in range(3)}
    assert {tuple(r) for r in C.segment_heads(whole).collect()} == {tuple(r) for r in heads.collect()}
    assert {tuple(r) for r in C.chain_heads(whole, 2).collect()} == {tuple(r) for r in C.chain_heads(heads, 2).collect()}


def test_pages_cover_the_log(log):
    view = C.log_view(log)
    order = [(r["segment"], r["id"]) for r in view.select("segment", "id").orderBy("segment", "id").collect()]
    for page in (1, 37, len(order) // 10 + 1):
        rows = C.log_page(view, page).orderBy("position").collect()
        assert [(r["segment"], r["id"]) for r in rows] == order[(page - 1) * 10: page * 10]
    assert C.log_page(view, 10**6).count() == 0
    after = C.log_page_after(view, *order[99]).collect()
    assert [(r["segment"], r["id"]) for r in after] == order[100:110]


def test_export_and_read_back(spark, log):
    path = L.export_log(log, shared_folder(spark), "20240101_000000", "2024-01-01 00:00:00")
    back = L.read_log(spark, path)
    assert bad_segments(back) == {} and back.count() == log.count()
    info = L.read_log_documents(spark, path).select("blockchain_info.*").collect()
    assert sum(r["total_blocks"] for r in info) == log.count() and all(r["is_valid"] for r in info)


def _document(n):
    blocks, previous = [], "0"
    for i in range(n):
        data = {"message": "start"} if i == 0 else {
            "sample_index": i, "intrusion_probability": 0.0527542307972908 * i, "severity_name": "HIGH RISK",
            "network_features": {"src_bytes": 1e16, "serror_rate": 1e-7, "service": "ftp é"}}
        body = {"index": i, "timestamp": f"t{i}", "data": data, "previous_hash": previous}
        previous = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
        blocks.append({**body, "hash": previous})
    return {"blockchain_info": {"total_blocks": n, "total_intrusions": n - 1, "export_timestamp": "t", "is_valid": True},
            "blocks": blocks}


def test_single_document_logs(spark, tmp_path):
    good, bad, cut = _document(5), _document(5), _document(6)
    bad["blocks"][2]["data"]["network_features"]["src_bytes"] = 2.0
    del cut["blocks"][3]
    for name, doc in (("good", good), ("bad", bad), ("cut", cut)):
        (tmp_path / f"blockchain_threat_log_{name}.json").write_text(json.dumps(doc, indent=2))
    got = {r["file"].split("_")[-1]: (r["blocks"], r["alerts"], r["is_valid"])
           for r in L.verify_documents(spark, str(tmp_path)).collect()}
    assert got == {"good.json": (5, 4, True), "bad.json": (5, 4, False), "cut.json": (5, 4, False)}
    view = C.log_view(L.read_documents(spark, str(tmp_path / "blockchain_threat_log_good.json")))
    assert view.count() == 4 and {r["source_ip"] for r in view.collect()} == {"N/A"}


@pytest.mark.parametrize("indent", [None, 2, 4])
@pytest.mark.parametrize("split", [997, 4096, 60_000])
def test_a_document_is_read_by_many_tasks(spark, tmp_path, indent, split):
    """Wherever the file is cut, each block is read once, whole."""
    doc = _document(120)
    doc["blocks"][7]["data"]["network_features"]["service"] = 'x"},\n    {\n {"index": 3, "blocks": ['         # escaped in the text
    (tmp_path / "log.json").write_text(json.dumps(doc, indent=indent))
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        pieces = L.split_documents(spark, str(tmp_path))
        assert split > 10_000 or pieces.rdd.getNumPartitions() > 4
        found = [json.JSONDecoder().raw_decode(r["raw"])[0] for r in pieces.collect()]
        log = L.read_documents(spark, str(tmp_path)).orderBy("block_index").collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert sorted(found, key=lambda b: b["index"]) == doc["blocks"]
    assert [(r["block_index"], r["hash"]) for r in log] == [(b["index"], b["hash"]) for b in doc["blocks"]]


def test_documents_without_blocks_or_of_another_layout(spark, tmp_path):
    folders = {}
    for name, texts in {"none": [json.dumps({**_document(1), "blocks": []}, indent=2)],
                        "mixed": [json.dumps(_document(3), indent=2), json.dumps(_document(3))],
                        "short": [json.dumps(_document(1))]}.items():
        folders[name] = tmp_path / name
        folders[name].mkdir()
        for i, text in enumerate(texts):
            (folders[name] / f"{i}.json").write_text(text)
    assert L.read_documents(spark, str(folders["none"])).count() == 0
    assert L.read_documents(spark, str(folders["short"])).count() == 1
    with pytest.raises(Exception, match="another layout"):
        L.read_documents(spark, str(folders["mixed"])).count()


def test_exported_documents_are_the_log(spark, log):
    path = L.export_documents(log, shared_folder(spark), "20240101_000000", "2024-01-01 00:00:00")
    back = L.read_documents(spark, path)
    assert bad_segments(back) == {} and back.count() == log.count()
    assert spark.read.text(path, wholetext=True).where("get_json_object(value, '$.blockchain_info.is_valid') = 'true'").count() \
        == log.select("segment").distinct().count()


def test_documents_are_indented_a_block_at_a_time(spark, tmp_path, monkeypatch):
    """No Python worker gets a whole document, and the files are what Python writes of the whole."""
    texts = ["a\nb \"c\" \\ {}", "d\u00e9\u4e16 [\n    {\n", "", "\u2028 e, f"]
    blocks = [(s, i, "0" * i, f"{t}{i}", t, 1e-7 * i) for s in (0, 7, -3) for i, t in enumerate(texts * 25)]
    log = spark.createDataFrame(blocks, "segment long, block_index int, previous_hash string, hash string, action_summary string, "
                                "intrusion_probability double").selectExpr(
        "*", "CASE WHEN block_index > 0 THEN cast(block_index * 2 AS bigint) END AS sample_index", "1 AS severity_level", "cast(null AS string) AS severity_name",
        "cast(null AS string) AS priority", "array('x', action_summary) AS immediate_actions", "cast(array() AS array<string>) AS monitoring_actions",
        "from_json('{\"src_bytes\": 3}', '" + L.LOG_DATA_SCHEMA["network_features"].dataType.simpleString() + "') AS network_features")
    indented = L._indented.func

    def short_only(texts):
        if (texts.str.len() > 2000).any():
            raise ValueError("a whole document in a worker")
        return indented(texts)

    monkeypatch.setattr(L, "_indented", F.pandas_udf(short_only, "string"))
    path = L.export_documents(log, str(tmp_path / "log"), "20240101_000000", "2024-01-01 00:00:00")
    found = {int(f.parent.name.split("=")[1]): f.read_text() for f in (tmp_path / "log").rglob("*.txt")}
    assert set(found) == {0, 7, -3} and path.startswith(str(tmp_path))
    whole = L._verified_documents(log, "2024-01-01 00:00:00").select("segment", F.to_json(F.struct("blockchain_info", "blocks"))).collect()
    assert found == {s: json.dumps(json.loads(text), indent=2) + "\n" for s, text in whole}
    assert [len(json.loads(t)["blocks"]) for t in found.values()] == [100, 100, 100]


def test_head_levels_follow_the_ids(spark):
    ids = [0, 5, 999_999, 2**62, 2**62 + 1]
    log = spark.createDataFrame([(i // 1000, 0, f"h{i}") for i in ids], "segment long, block_index int, hash string")
    assert C.head_levels(log) == 5 and C.head_levels(log.where("segment < 1000")) == 0
    heads = C.chain_heads(log)
    assert heads.agg(F.max("n_heads")).first()[0] <= C.SEGMENT_SPAN
    assert heads.where("level = 6").count() == 1
    assert C.verify_sealed(log, heads).count() == 0


def test_large_ids_keep_their_segment(spark):
    ids = [2**60 + 1, 2**60 + 2, -1, 1999]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(C.segment_of(F.col("i")).alias("s")).collect()
    assert [r["s"] for r in got] == [(2**60 + 1) // 1000, (2**60 + 2) // 1000, 0, 1]
