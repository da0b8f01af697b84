import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import usage
from folioflow.plans.session import TOOLS, Session, ToolError, call, register
from folioflow.sources import files, sinks
from folioflow.streaming import pipelines


def test_import_files(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes(b"# T\r\nx\0")
    (tmp_path / "b.html").write_text("<h1>T</h1><p>x")
    (tmp_path / "c.docx").write_bytes(sinks.docx_bytes("one\ntwo & <three>"))
    (tmp_path / "d.csv").write_text("a,b")
    (tmp_path / "e.png").write_bytes(b"x")
    (tmp_path / "f.docx").write_bytes(b"not a zip")
    df = files.read_files(spark, str(tmp_path))
    assert "LessThanOrEqual(length,31457280)" in df._jdf.queryExecution().toString()
    r = {x.file_name: x for x in files.import_files(df).collect()}
    assert r["a.MD"].text == "# T\nx" and r["a.MD"].format == "markdown"
    assert r["b.html"].text == "# T\n\nx" and r["c.docx"].text == "one\n\ntwo & <three>"
    assert r["d.csv"].error and r["d.csv"].text is None and r["f.docx"].error
    assert r["e.png"].needs_ocr and r["e.png"].text == "" and r["e.png"].warnings


def test_names_and_urls(spark):
    df = spark.createDataFrame([("A.Tar.HTM", "https://x/?text=a%20b&c=1"), ("noext", "https://x/")], "n string, u string")
    rows = df.select(files.extension(F.col("n")), files.format_of(F.col("n")), files.text_from_url(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [("htm", "html", "a b"), ("noext", None, None)]


def test_sinks(spark, tmp_path):
    conv = spark.createDataFrame([(1, "a\nb"), (2, "")], "doc_id long, text string")
    sinks.write_text(conv, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    sinks.write_docx(conv, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1
    f = spark.createDataFrame([(1, "y", 5, 6), (1, "x", 1, 2)], "doc_id long, id string, start_pos int, end_pos int")
    assert sinks.id_list(f).collect()[0].ids == "[x, y]"


def test_pdf_document(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, page int, text string")
    pages = spark.createDataFrame([(1, 3), (2, 2)], "doc_id long, n_pages int")
    r = {x.doc_id: x for x in files.pdf_document(rows, pages).collect()}
    assert r[1].text == "a\n\nb" and r[1].warnings[0].startswith("1 page contained") and r[2].warnings[0].startswith("2 pages contained") and r[2].text == ""


REQUEST = "method string, url string, origin string, content_type string, body string"
U = "https://app.example/api/usage"


def _status(spark, rows):
    return [r.status for r in usage.admit(spark.createDataFrame(rows, REQUEST)).collect()]


def test_admission(spark):
    o, t = "https://app.example", "application/json; charset=utf-8"
    good = json.dumps({"event": "document_import", "feature": "import", "variant": "pdf", "sizeBucket": "small", "outcome": "success", "filename": "x"})
    rows = [
        ("POST", U, o, t, good), ("GET", U, o, t, good), ("POST", U, "https://evil.example", t, good), ("POST", U, o, "text/plain", good), ("POST", "https://app.example/x", o, t, good),
        ("POST", U, o, t, "[1]"), ("POST", U, o, t, "null"), ("POST", U, o, t, "{"), ("POST", U, o, t, json.dumps({"event": "nope"})), ("POST", U, o, t, json.dumps({"event": "button_click"})),
        ("POST", U, o, t, json.dumps({"event": "button_click", "button": "export_docx"})), ("POST", U, o, t, json.dumps({"event": "page_view", "pad": "x" * 1100})),
        ("POST", U, o, t, json.dumps({"event": "page_view", "variant": 3})), ("POST", U, o, t, None), (None, U, o, t, good), ("POST", U, None, t, good),
    ]
    assert _status(spark, rows) == [204, 405, 403, 415, 404, 400, 400, 400, 400, 400, 204, 400, 400, 400, 405, 403]
    points = usage.data_points(usage.admit(spark.createDataFrame(rows, REQUEST))).collect()
    assert [list(p.blobs) for p in points] == [["document_import", "import", "pdf", "small", "success", "none"], ["button_click", "none", "none", "none", "none", "export_docx"]]
    assert points[0]["index"] == "document_import" and list(points[0].doubles) == [1.0]


def _run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_usage_stream(spark, tmp_path):
    body = json.dumps({"event": "page_view"})
    rows = [{"ts": f"2024-01-01T00:0{m}:00Z", "method": "POST", "url": U, "origin": "https://app.example", "content_type": "application/json", "body": body} for m in (0, 1, 6)]
    rows.append({**rows[0], "body": "{}"})
    rows.append({**rows[0], "ts": "2024-01-01T01:00:00Z"})
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = pipelines.json_stream(spark, str(tmp_path), f"ts timestamp, {REQUEST}")
    got = _run(pipelines.usage_counts(stream), "usage_counts", "append")
    assert sorted(r.n for r in got) == [1, 2]


def test_once_and_settled(spark, tmp_path):
    rows = [("s", "a", "2024-01-01T00:00:00Z"), ("s", "a", "2024-01-01T00:00:05Z"), ("t", "a", "2024-01-01T00:00:00Z")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.json").write_text("\n".join(json.dumps(dict(zip(("session", "event", "ts"), r))) for r in rows))
    assert len(_run(pipelines.once_per_session(pipelines.json_stream(spark, str(tmp_path / "e"), "session string, event string, ts timestamp")), "once", "append")) == 2
    edits = [(1, "a long enough text", "2024-01-01T00:00:00.000Z"), (1, "a long enough text, changed", "2024-01-01T00:00:01.000Z"), (1, "short", "2024-01-01T00:00:01.500Z"), (2, "x" * 20, "2024-01-01T05:00:00Z")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text("\n".join(json.dumps(dict(zip(("doc_id", "text", "ts"), r))) for r in edits))
    got = _run(pipelines.settled_edits(pipelines.json_stream(spark, str(tmp_path / "d"), "doc_id long, text string, ts timestamp")), "settled", "append")
    assert [r.text for r in got] == ["a long enough text, changed"]


def test_progress(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": 1, "text": "x"}))
    seen = []
    listener = pipelines.Progress(lambda key, rows: seen.append(rows))
    spark.streams.addListener(listener)
    try:
        _run(pipelines.document_statistics(pipelines.json_stream(spark, str(tmp_path), "doc_id long, text string")), "progress_stream", "append")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(listener.rows.values()) == 1 and seen


def test_document_stream_and_current_results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": 1, "text": "mail a@b.co"}))
    docs = pipelines.json_stream(spark, str(tmp_path), "doc_id long, text string")
    stats = _run(pipelines.document_statistics(docs), "doc_stats_stream", "append")
    assert (stats[0].n_chars, stats[0].n_words) == (11, 2)
    found = _run(pipelines.document_findings(docs), "findings_stream", "append")
    assert [r.placeholder for r in found] == ["EMAIL"]
    current = spark.createDataFrame([(1, stats[0].doc_fingerprint)], "doc_id long, doc_fingerprint string")
    results = spark.createDataFrame([(1, stats[0].doc_fingerprint), (1, "old")], "doc_id long, doc_fingerprint string")
    assert pipelines.current_results(results, current).count() == 1


def test_approval_stream(spark, tmp_path):
    steps = [[(1, 1, "edit", "A"), (1, 2, "approve", "A"), (2, 1, "edit", "B")], [(1, 3, "edit", "A2"), (2, 2, "approve", "old")]]
    stream = pipelines.json_stream(spark, str(tmp_path), "doc_id long, seq long, kind string, snapshot string", 1)
    q = pipelines.approvals(stream).writeStream.outputMode("update").format("memory").queryName("approvals").start()
    try:
        for n, rows in enumerate(steps):
            (tmp_path / f"{n}.tmp").write_text("\n".join(json.dumps(dict(zip(("doc_id", "seq", "kind", "snapshot"), r))) for r in rows))
            (tmp_path / f"{n}.tmp").rename(tmp_path / f"{n}.json")
            q.processAllAvailable()
    finally:
        q.stop()
    got = [(r.doc_id, r.approved, r.snapshot) for r in spark.sql("SELECT * FROM approvals").collect()]
    assert sorted(got) == [(1, False, "A2"), (1, True, "A"), (2, False, "B"), (2, False, "B")]


def test_session_tools():
    kept = []
    s = Session(sink=lambda name, text: kept.append((name, text)) or True, detector=lambda t: [(0, 3, "PERSON", 0.9)])
    assert len(TOOLS) == 14
    with pytest.raises(ToolError):
        call(s, "prepare_agent_handoff")
    call(s, "set_document_content", {"text": "Ada mails a@b.co, then A@b.co. [x](https://e.example)"})
    assert call(s, "get_document_state")["safetyFindingCount"] == 2
    with pytest.raises(ToolError):
        call(s, "get_converted_text")
    s.approve()
    assert call(s, "get_converted_text", {"maxCharacters": 5})["nextCursor"] == 5
    assert call(s, "list_document_assets", {"limit": 1})["nextCursor"] == 1
    call(s, "set_conversion_options", {"mode": "ai"})
    assert not s.approved
    ids = [f["id"] for f in call(s, "get_safety_findings")["findings"]]
    assert "value" not in call(s, "get_safety_findings")["findings"][0]
    for bad in ({}, {"findingIds": []}, {"findingIds": ["nope"]}, {"findingIds": ["x" * 101]}):
        with pytest.raises(ToolError):
            call(s, "redact_document_findings", bad)
    assert call(s, "redact_document_findings", {"findingIds": ids})["redacted"] == 2
    assert s.markdown.startswith("Ada mails [EMAIL_1], then [EMAIL_1].")
    call(s, "run_deep_privacy_scan")
    assert call(s, "get_handoff_readiness")["checks"]["deepPrivacyScanComplete"]
    call(s, "prepare_agent_handoff", {"appendReferences": False})
    s.approve()
    assert call(s, "copy_converted_text")["copied"] and call(s, "download_converted_text")["filename"] == "converted-text.txt"
    assert len(kept) == 2
    for name, args in (("get_converted_text", {"cursor": -1}), ("get_converted_text", {"cursor": 9999}), ("get_safety_findings", {"limit": 3}), ("set_conversion_options", {}), ("set_conversion_options", {"mode": "x"}), ("nope", {}), ("get_document_state", [1])):
        with pytest.raises(ToolError):
            call(s, name, args)
    call(s, "clear_document")
    assert s.readiness()["readiness"] == "empty"
    with pytest.raises(ToolError):
        s.approve()
    call(s, "insert_sample_document")
    assert s.references and s.approved is False


def test_registration_is_all_or_nothing():
    tools = {}
    assert register(tools.__setitem__, tools.pop, Session()) == 14 and tools["get_document_state"]()["markdownLength"] == 0

    def fails(name, fn):
        if name == "clear_document":
            raise RuntimeError
        tools[name] = fn

    tools.clear()
    assert register(fails, tools.pop, Session()) == 0 and tools == {}


def test_entry_points(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 30
    assert set(e.entry(spark).columns) == {"handoff_id", "text"}
