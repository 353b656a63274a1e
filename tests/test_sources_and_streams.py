"""Byte parsers, capture folders, ledgers and streams."""

import hashlib
import json
from functools import reduce
from operator import xor

import pytest
from pyspark.sql import functions as F

from tillsight.functions import text, values
from tillsight.sources import capture, legacy, parsers, settings, spool, tickets
from tillsight.streaming import live, state


def frame(data, sequence="1", address="01", kind="N"):
    body = b"\x02" + f"{address}{len(data):03}{kind}{data}{sequence}".encode("latin-1")
    return body + f"{reduce(xor, body, 0):02X}".encode() + b"\x03"


def test_frames_and_noise():
    good = frame("=K") + b"\x06" + b"??" + frame("=T1/$5000")
    found, issues, acks = parsers.frames(good)
    assert [f[3] for f in found] == ["=K", "=T1/$5000"] and all(f[5] for f in found) and acks == 1 and issues == ["unframed_bytes:14:2"]
    bad = bytearray(frame("=K"))
    bad[8] ^= 1
    assert parsers.frames(bytes(bad))[1] == ["bcc_mismatch:0"]
    assert parsers.frames(b"\x0201")[1] == ["truncated_header:0:3"] and parsers.frames(b"\x0201900N=K")[1] == ["truncated_frame:0:9"]
    assert parsers.frames(b"") == ([], [], 0)


def test_tickets(spark):
    stream = b"\x1b@PRECONTO N. PB-77\nTAVOLO T-9\n2x Pane  10,00\nTOTALE 100,00\n\x1dV\x00\x1b@COMANDA\n1x Acqua\n\x1bm-1x Voce\nresto"
    lines = tickets.ticket_lines(spark.createDataFrame([("a", bytearray(stream)), ("b", None)], "job_id string, client_raw binary"))
    docs = tickets.ticket_documents(lines).orderBy("ordinal").collect()
    assert [(d.type, d.complete) for d in docs] == [("PRE_BILL", True), ("KITCHEN_ORDER", True), ("ORDER_CHANGE", False)]
    assert (docs[0].external_code, docs[0].table_code, str(docs[0].total), docs[0].n_items) == ("PB-77", "T-9", "100.0000", 1)
    items = [(r.ordinal, r.description, r.quantity, r.amount) for r in tickets.ticket_items(lines).orderBy("ordinal").collect()]
    assert items == [(1, "Pane", 2, 10), (2, "Acqua", 1, None), (3, "Voce", -1, None)]


def test_pictures_code_pages_and_control_sequences():
    picture = b"\x1dv0\x00\x02\x00\x02\x00\x1dV\x00\x0a"  # four bytes that look like a cut
    read = lambda w, h, bits: (f"TAVOLO {w}{h}{len(bits)}", 90.0 if h == 2 else 10.0)
    data = b"\x1bt\x10caff\xe8\n\x1b!\x08uno" + picture + b"due\n\x1dk\x04A1\x00\x1d(k\x02\x00xxtre\tquattro\n\x10\x04\x01\x1dVA\x03fine"
    assert list(tickets.read_lines(data)) == [(1, True, 3, "caffè"), (1, True, 12, "unodue"), (1, True, 44, "tre    quattro"), (2, False, len(data) - 4, "fine")]
    assert [x[3] for x in tickets.read_lines(data, ocr=read)] == ["caffè", "uno", "TAVOLO 224", "due", "tre    quattro", "fine"]
    assert list(tickets.read_lines(b"")) == [] and list(tickets.read_lines(b"\x1b")) == [] and list(tickets.read_lines(b"\x1dk")) == []


def test_parse_by_kind(spark):
    j = spark.createDataFrame([("a", "pos", b"COMANDA\n1x X\x1bm", None), ("b", "rch", frame("=K", address="00", kind="z"), b""), ("c", "other", b"?", None), ("d", None, None, None)], "job_id string, kind string, client_raw binary, device_raw binary")
    got = parsers.parse(j).collect()
    assert {(r.job_id, r.type, r.parser) for r in got} == {("a", "KITCHEN_ORDER", "pos"), ("b", "COMMERCIAL_DOCUMENT", "rch")}
    assert len({r.parser_version for r in got}) == 2 and all(len(r.parser_version) == 64 for r in got)
    assert {(r.job_id, r.frame_id is None) for r in parsers.frame_rows(j).collect()} >= {("b", False)}


def job(root, name, tamper=None, ready=True, device="pos_1"):
    folder = root / device / name
    folder.mkdir(parents=True)
    raw = {"client.raw": b"ordine" + b"\x1dV\x00", "device.raw": b"\x10\x00"}
    events, last, at = [], "0" * 64, {}
    for k, (d, part) in enumerate([("client_to_device", b"ordine"), ("client_to_device", b"\x1dV\x00"), ("device_to_client", b"\x10\x00")]):
        e = {"sequence": k + 1, "direction": d, "kind": "data", "offset": at.get(d, 0), "length": len(part), "payload_sha256": hashlib.sha256(part).hexdigest(), "previous_event_sha256": last}
        last = hashlib.sha256(bytes.fromhex(last) + capture.canonical(e)).hexdigest()
        events.append(e | {"event_sha256": last})
        at[d] = at.get(d, 0) + len(part)
    about = {"session_id": "s", "job_id": name, "device_id": device}
    files = {n: {"name": n, "size": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in raw.items()}
    manifest = json.dumps({"session": about, "status": "COMPLETE", "files": files}).encode()
    if tamper:
        tamper(raw, events)
    for n, b in raw.items():
        (folder / n).write_bytes(b)
    (folder / "timeline.jsonl").write_text("\n".join(map(json.dumps, events)))
    (folder / "session.json").write_text(json.dumps({"session": about}))
    (folder / "manifest.json").write_bytes(manifest)
    if ready:
        (folder / ".ready").write_text(json.dumps({"job_id": name, "manifest_sha256": hashlib.sha256(manifest).hexdigest()}))


def test_capture_folders(spark, tmp_path):
    job(tmp_path, "good")
    job(tmp_path, "open", ready=False)
    job(tmp_path, "altered", lambda raw, ev: raw.update({"client.raw": b"ordina" + b"\x1dV\x00"}))
    job(tmp_path, "rechained", lambda raw, ev: ev[1].update({"length": 2}))
    got = {r.job_id: r for r in capture.jobs(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["altered", "good", "rechained"] and got["good"].failures == [] and got["good"].captured_bytes == 11
    assert "file:client.raw" in got["altered"].failures and "payload:0" in got["altered"].failures
    assert "chain:1" in got["rechained"].failures


def test_strict_json():
    assert capture.strict_json(b'{"a": 1}') == {"a": 1}
    for bad in (b'{"a": 1, "a": 2}', b'{"a": NaN}', b"\xff", b"{"):
        with pytest.raises(ValueError):
            capture.strict_json(bad)


def test_fair_batches_go_round(spark):
    m = spark.createDataFrame([(f"j{i}",) for i in range(5)], "job_path string")
    assert [r.job_path for r in capture.fair_batch(m, 3, "j2").collect()] == ["j3", "j4", "j0"]


def test_ledger(spark):
    lines, last = [], "0" * 64
    for k in range(4):
        e = {"sequence": k, "event": "PRINTED", "job_id": f"j{k}", "previous_chain_hash": last}
        body = capture.canonical(e)
        last = hashlib.sha256(bytes.fromhex(last) + len(body).to_bytes(8, "big") + body).hexdigest()
        lines.append(json.dumps(e | {"chain_hash": last}))
    rows = [("r", k, x) for k, x in enumerate(lines)] + [("q", k, x.replace("j2", "j9")) for k, x in enumerate(lines)]
    got = capture.ledger(spark.createDataFrame(rows, "route string, position int, line string")).collect()
    assert [r.chain_ok for r in got if r.route == "r"] == [True] * 4 and [r.chain_ok for r in got if r.route == "q"] == [True, True, False, True]


EVENTS = "event_id bigint, user_id bigint, ts timestamp"


def stream_of(spark, tmp_path, rows, name="in"):
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.mode("append").parquet(f"{tmp_path}/{name}")
    return live.published(spark, f"{tmp_path}/{name}", EVENTS)


def run(df, tmp_path, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_stream_sessions(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:04:00"), (3, 7, "2024-01-01 00:20:00"), (4, 8, "2024-01-02 00:00:00")]
    got = run(live.sessions(stream_of(spark, tmp_path, rows), "user_id"), tmp_path, "sessions").collect()
    assert sorted((r.user_id, r.n) for r in got) == [(7, 1), (7, 2)]


def test_stream_once_and_pairs(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:01:00"), (3, 8, "2024-01-01 00:00:30")]
    s = stream_of(spark, tmp_path, rows)
    assert run(live.once(s, ["event_id"]), tmp_path, "once").count() == 3
    batch = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string")
    pairs = {(r.a_id, r.b_id) for r in live.paired(batch.where("event_id = 1"), batch.where("event_id = 2"), "user_id", 60).collect()}
    got = {(r.a_id, r.b_id) for r in run(live.paired(s.where("event_id = 1"), s.where("event_id = 2"), "user_id", 60), tmp_path, "paired").collect()}
    assert pairs == got == {(1, 2)}


def test_incremental_runs_add_nothing_twice(spark, tmp_path):
    out = f"{tmp_path}/out"
    s = stream_of(spark, tmp_path, [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:01:00")])
    step = lambda b: b.select("event_id", (F.col("user_id") * 2).alias("v"))
    for cp in ("a", "a", "b"):
        live.incremental(s, step, out, ["event_id"], f"{tmp_path}/{cp}").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    s = stream_of(spark, tmp_path, [(3, 9, "2024-01-01 00:02:00")])
    live.incremental(s, step, out, ["event_id"], f"{tmp_path}/a").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_retries():
    left = [OSError(), OSError()]

    def act():
        if left:
            raise left.pop()

    waits = []
    assert live.retried(act, sleep=waits.append) == 3 and waits == [0.05, 0.1]
    with pytest.raises(OSError):
        live.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_scalar_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    ts = lambda x: F.lit(x).cast("timestamp")
    assert one(text.identity(F.lit("  Caffè\tÉ ß ﬁ"))) == "CAFFE E SS FI"
    assert one(text.price_description(F.lit(" STRAẞE  x"))) == "strasse x"
    assert one(values.local_to_utc(ts("2026-03-29 02:30:00"), "Europe/Rome")) is None
    assert str(one(values.local_to_utc(ts("2026-10-25 02:30:00"), "Europe/Rome", ts("2026-10-25 00:31:00")))) == "2026-10-25 00:30:00"
    assert str(one(values.local_to_utc(ts("2026-10-25 02:30:00"), "Europe/Rome", ts("2026-10-25 01:31:00")))) == "2026-10-25 01:30:00"
    assert [one(values.year_near(F.lit(y), F.lit(2026))) for y in (25, 99, 75)] == [2025, 1999, 2075]
    assert [one(text.table_code(F.lit(x))) for x in ("O1-R", "OVEST-1", "1O")] == ["01-R", "OVEST-1", "10"]
    assert one(values.xor_checksum(F.lit(bytearray(b"\x01\x03\xff")))) == 0x01 ^ 0x03 ^ 0xFF and one(values.xor_checksum(F.lit(bytearray()))) == 0
    assert one(values.quantity_label(F.lit("2.5000").cast("decimal(19,4)"))) == "2,5" and one(values.quantity_label(F.lit("2.0000").cast("decimal(19,4)"))) == "2"
    assert one(values.canonical_json({"b": F.lit("è\x01\""), "a": F.lit(None).cast("int")})) == json.dumps({"a": None, "b": "è\x01\""}, separators=(",", ":"), ensure_ascii=False)


def test_spooled_jobs_are_read_back(spark, tmp_path):
    chunks = [("j1", "pos_1", "s", 2, "client_to_device", bytearray(b"ne")), ("j1", "pos_1", "s", 1, "client_to_device", bytearray(b"ordi")), ("j1", "pos_1", "s", 3, "device_to_client", bytearray(b"ok")), ("j2", "rch_1", "s", 1, "client_to_device", bytearray(b"x"))]
    rows = spark.createDataFrame(chunks, "job_id string, device_id string, session_id string, sequence int, direction string, payload binary")
    for f in spool.job_files(spool.contiguous_chunks(rows)).collect():
        folder = tmp_path / f.device_id / f.job_id
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f.role).write_bytes(f.content)
    got = {r.job_id: r for r in capture.jobs(spark, str(tmp_path)).collect()}
    assert {k: list(r.failures) for k, r in got.items()} == {"j1": [], "j2": []}
    assert bytes(got["j1"].client_raw) == b"ordine" and bytes(got["j1"].device_raw) == b"ok"


def legacy_job(root, code, tamper=False):
    folder = root / code
    (folder / "PHARSED").mkdir(parents=True)
    files = {"request_raw": b"abcdef", "response_raw": b"\x06", "timeline": b'{"sequence":1,"direction":"CLIENT -> RCH","job_offset":0,"session_offset":0,"byte_count":6}\n{"sequence":2,"direction":"RCH -> CLIENT","job_offset":0,"session_offset":0,"byte_count":1}\n'}
    manifest = {"schema": "v1", "codice_doc": code, "job_id": f"job-{code}", "session_id": "s", "status": "ready", "raw_complete": True, "timeline_complete": True, "request_size": 6, "response_size": 1, "printer_ip": "10.0.0.1", "printer_port": 23, "files": {k: f"{k}.bin" for k in files}, "sha256": {k: hashlib.sha256(b).hexdigest() for k, b in files.items()}}
    body = json.dumps(manifest).encode()
    for k, b in files.items():
        (folder / f"{k}.bin").write_bytes(b + b"!" * (tamper and k == "request_raw"))
    (folder / "manifest.json").write_bytes(body)
    (folder / ".ready").write_text(json.dumps({"schema": "v1", "codice_doc": code, "manifest_sha256": hashlib.sha256(body).hexdigest()}))
    d = {"document_id": f"d-{code}", "ordinal": 1, "type": "C", "canonical_type": "commerciale", "complete": True, "classification_evidence": "x", "source": {"frame_ids": [1, 2], "start_offset": 0, "end_offset": 9 if tamper else 6}, "semantic": {"issues": [{"code": "odd"}]}}
    parsed = json.dumps({"schema": "v1", "codice_doc": code, "documents": [d]}).encode()
    (folder / "PHARSED" / "parsed.json").write_bytes(parsed)
    (folder / ".parsed").write_text(json.dumps({"schema": "v1", "status": "parsed", "codice_doc": code, "metadata_sha256": hashlib.sha256(parsed).hexdigest(), "document_count": 1}))


def test_legacy_layouts(spark, tmp_path):
    root = tmp_path / "captures"
    legacy_job(root, "0001")
    legacy_job(root, "0002", tamper=True)
    (root / "0003").mkdir()
    got = {r.code: r for r in legacy.legacy_jobs(spark, str(root), "v1").collect()}
    assert set(got) == {"0001", "0002"} and got["0001"].failures == [] and got["0001"].target == "10.0.0.1:23" and got["0001"].complete
    assert set(got["0002"].failures) == {"file:request_raw", "request_size"}
    assert all("manifest_schema" in r.failures for r in legacy.legacy_jobs(spark, str(root), "v2").collect())
    docs = {r.document_id: r for r in legacy.parsed_documents(spark, str(root), "v1").collect()}
    assert docs["d-0001"].failures == [] and docs["d-0001"].issues == ["odd"] and docs["d-0001"].type == "COMMERCIAL_DOCUMENT" and docs["d-0002"].failures == ["range"]
    readers = {"legacy": lambda r: r, "parsed": lambda r: r}
    assert legacy.chosen({"legacy": "/a", "parsed": None}, readers) == {"legacy": "/a"}
    for roots in ({}, {"legacy": "/a", "parsed": "/b"}, {"other": "/a"}):
        with pytest.raises(ValueError):
            legacy.chosen(roots, readers)


def test_settings(spark):
    good = {"timezone": "Europe/Rome", "roots": {"spool": "/srv/spool"}, "correlation": {"minimum_score": 70}, "devices": [{"device_id": "pos_1", "type": "pos", "host": "10.0.0.1", "port": 9100}]}
    s = settings.checked(json.dumps(good))
    assert s.numbers["correlation.minimum_score"] == 70 and s.numbers["rules.close_minutes"] == 120
    assert [r.device_id for r in s.device_table(spark).collect()] == ["pos_1"]
    for bad in ({"timezone": "Mars/Base"}, {"roots": {"a": "/etc"}}, {"roots": {"a": "/x/../y"}}, {"correlation": {"minimum_score": 101}}, {"devices": []}, {"devices": good["devices"] * 2}, {"surprise": 1}):
        with pytest.raises(ValueError):
            settings.checked(json.dumps(good | bad))


def test_keyed_state_follows_each_table(spark, tmp_path):
    schema = "device_id string, table_code string, document_id string, type string, time timestamp, item_key string, quantity decimal(19,4)"
    at = lambda m: f"2024-01-01 10:{m:02}:00"
    papers = [("d", "T1", "k1", "KITCHEN_ORDER", at(0), "A", 3), ("d", "T1", "k1", "KITCHEN_ORDER", at(0), "B", 1), ("d", "T1", "h1", "ORDER_CHANGE", at(5), "A", -1), ("d", "T1", "h1", "ORDER_CHANGE", at(5), "B", -1), ("d", "T1", "h1", "ORDER_CHANGE", at(5), "C", -1), ("d", "T2", "h2", "ORDER_CHANGE", at(6), "A", 2)]
    later = [("d", "T1", "h3", "ORDER_CHANGE", at(9), "A", 4), ("d", "T1", "k2", "KITCHEN_ORDER", at(20), "D", 1)]
    for n, rows in enumerate((papers, later)):
        spark.createDataFrame(rows, schema.replace("timestamp", "string").replace("decimal(19,4)", "int")).selectExpr("device_id", "table_code", "document_id", "type", "CAST(time AS TIMESTAMP) AS time", "item_key", "CAST(quantity AS DECIMAL(19,4)) AS quantity").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = state.table_lines(live.published(spark, f"{tmp_path}/in", schema)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.table_code, r.document_id, r.item_key): (r.before, r.after) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("T1", "k1", "A"): (None, 3), ("T1", "k1", "B"): (None, 1), ("T1", "h1", "A"): (3, 2), ("T1", "h1", "B"): (1, None), ("T2", "h2", "A"): (None, 2), ("T1", "h3", "A"): (2, 6), ("T1", "k2", "A"): (6, None), ("T1", "k2", "D"): (None, 1)}
