import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import language
from folioflow.operators import assets, entities, handoff, ocr, paging
from folioflow.operators.convert import convert

ENT = "doc_id long, seq int, entity string, entity_group string, index int, word string, start_pos int, end_pos int, score double"


def test_chunks_cover_and_overlap():
    words = [f"word{i:03d}" for i in range(120)]
    text = " ".join(words)
    count = lambda s: len(s.split()) + 2
    chunks = list(entities.token_chunks(text, 18, 5, count))
    assert all(n <= 18 and count(t) == n for t, _, n in chunks)
    assert all(text[o : o + len(t)] == t for t, o, _ in chunks)
    assert chunks[0][1] == 0 and chunks[-1][1] + len(chunks[-1][0]) == len(text)
    assert all(b[1] < a[1] + len(a[0]) for a, b in zip(chunks, chunks[1:]))
    assert list(entities.token_chunks("", 18, 5, count)) == [] == list(entities.token_chunks(None, 18, 5, count))
    long = "x" * 100
    assert [t for t, _, _ in entities.token_chunks(long, 10, 0, len)] == ["x" * 10] * 10


def test_usable_tokens():
    assert entities.usable_tokens([None, 10, 1e9]) == 504 and entities.usable_tokens([128, 512]) == 120 and entities.usable_tokens([]) == 504


def test_word_pieces_are_put_back(spark):
    text = "Contact Marisol Bennett at 742 Evergreen Terrace, Riverton."
    pieces = [("B-GIVENNAME", 1, "Mari"), ("I-GIVENNAME", 2, "##sol"), ("I-GIVENNAME", 3, "Bennett"), ("B-STREET", 6, "742"), ("I-STREET", 7, "Evergreen"), ("I-STREET", 8, "Terrace"), ("I-STREET", 9, ","), ("I-STREET", 10, "Riverton"), ("O", 11, ".")]
    rows = [(1, i, e, None, n, w, None, None, 0.9) for i, (e, n, w) in enumerate(pieces)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = entities.model_findings(spark.createDataFrame(rows, ENT), docs).orderBy("start_pos").collect()
    assert [(r.value, r.placeholder) for r in found] == [("Marisol Bennett", "PERSON"), ("742 Evergreen Terrace, Riverton", "LOCATION")]


def test_entities_are_filtered_and_deduplicated(spark):
    text = "Ada Lovelace met Acme in Paris"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [("PERSON", 0, 12, 0.9), ("GIVENNAME", 0, 3, 0.7), ("ORG", 17, 21, 0.99), ("CITY", 25, 30, 0.8), ("CITY", 24, 30, 0.66), ("CITY", 25, 30, 0.5), ("PERSON", 5, 99, 0.9), ("PERSON", 3, 4, 0.9)]
    rows = [(1, i, None, g, None, None, a, b, s) for i, (g, a, b, s) in enumerate(spans)]
    found = entities.model_findings(spark.createDataFrame(rows, ENT), docs).orderBy("start_pos").collect()
    assert [(r.value, r.model_label, r.placeholder) for r in found] == [("Ada Lovelace", "PERSON", "PERSON"), ("Paris", "CITY", "LOCATION")]
    assert found[0].id == "local-ai-0-12-PERSON" and found[0].line == 1


def test_label_families(spark):
    labels = ["B-EMAIL ADDRESS", "credit-card", "ORG", "zzz", "I-dob", "ssn", "E-blood type", "phone"]
    rows = spark.createDataFrame([(x,) for x in labels], "l string").select("l", entities.family(entities.label_key(F.col("l")))["placeholder"].alias("p")).collect()
    assert [r.p for r in rows] == ["LOCATION", "FINANCIAL_DATA", None, "PERSONAL_DATA", "PERSON", "IDENTITY_DATA", "HEALTH_DATA", "CONTACT"]


HANDOFF = "handoff_id long, markdown string, plain_text string, conversion_mode string, append_references boolean, reference_count int, broken array<string>, findings array<struct<id:string,severity:string>>, deep_scan_status string, import_warnings array<string>, human_approved boolean"


def test_readiness(spark):
    ok = ("# T", "# T", "ai", True, 0, [], [], "complete", [])
    rows = [(1, *ok, True), (2, *ok, False), (3, "x", "x", "plain", True, 0, ["a"], [("f", "high")], "idle", ["w"], True), (4, " \n", "", None, None, None, None, None, None, None, None)]
    got = {r.handoff_id: r for r in handoff.summarise(spark.createDataFrame(rows, HANDOFF)).collect()}
    assert [got[i].readiness for i in (1, 2, 3, 4)] == ["ready", "review", "review", "empty"]
    assert got[2].content_checks_pass and got[2].headline == "Human approval is the last step" and len(got[2].next_steps) == 1
    assert got[3].headline == "Approved with unresolved checks" and got[3].high_count == 1
    assert [s.split(" ")[0] for s in got[3].next_steps] == ["Set", "Run", "Review", "Review", "Review", "Human"]
    assert got[4].next_steps == ["Paste or import a document."] and got[4].finding_count == 0
    snaps = {r.handoff_id: r.snapshot for r in handoff.approval_snapshot(spark.createDataFrame(rows, HANDOFF)).collect()}
    assert json.loads(snaps[3])["finding_ids"] == ["f"] and snaps[1] == snaps[2]


WORDS = "doc_id long, page int, line int, pos int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, image_width double, image_height double"


def _words(spark):
    rows = [(1, 1, 0, 0, "Email", 90.0, 20.0, 10.0, 60.0, 20.0, 200.0, 100.0), (1, 1, 0, 1, " a@example.test ", 90.0, 62.0, 20.0, 184.0, 38.0, 200.0, 100.0), (1, 1, 1, 0, " ", 1.0, 0.0, 0.0, 1.0, 1.0, 200.0, 100.0), (1, 1, 2, 0, "Thanks!", 90.0, 20.0, 50.0, 20.0, 60.0, 200.0, 100.0)]
    return spark.createDataFrame([*rows, rows[0]], WORDS)


def test_recognised_text_and_boxes(spark):
    words = ocr.mapped_words(_words(spark))
    assert [(r.start_pos, r.end_pos, r.line) for r in words.orderBy("start_pos").collect()] == [(0, 5, 0), (6, 20, 0), (21, 28, 2)]
    assert ocr.page_text(_words(spark)).collect()[0].text == "Email a@example.test\nThanks!"
    boxes = {r.text: r for r in ocr.unit_boxes(words).collect()}
    assert set(boxes) == {"Email", "a@example.test"} and boxes["Email"].x == 0.1 and boxes["Email"].width == pytest.approx(0.2)
    found = spark.createDataFrame([(1, 1, "f", 6, 20)], "doc_id long, page int, id string, start_pos int, end_pos int")
    s = ocr.suggestions(found, words).collect()
    assert len(s) == 1 and s[0].x < 0.31 and s[0].width > 0.6 and s[0].line == 0
    drawn = spark.createDataFrame([(1, 0.5, 0.5, -0.2, 0.1), (1, 0.5, 0.5, 0.001, 0.1)], "doc_id long, x double, y double, width double, height double")
    chosen = spark.createDataFrame([(1, "f")], "doc_id long, id string")
    assert ocr.redaction_boxes(ocr.suggestions(found, words), chosen, drawn).count() == 2
    px = ocr.pixel_boxes(spark.createDataFrame([(0.101, 0.2, 0.001, 0.1)], "x double, y double, width double, height double"), F.lit(100), F.lit(100)).collect()[0]
    assert (px.left, px.top, px.px_width, px.px_height) == (10, 20, 1, 11)


def test_verification_and_pages(spark):
    pages = spark.createDataFrame([(1, "Now ADA-x and ｂ"), (2, None)], "doc_id long, text string")
    found = spark.createDataFrame([(1, "Email address", 5), (1, "Email address", 1), (1, "IP address", 3)], "doc_id long, title string, start_pos int")
    values = spark.createDataFrame([(1, "ada x"), (1, "b"), (2, "abc")], "doc_id long, value string")
    r = {x.doc_id: x for x in ocr.verification(pages, found, values).collect()}
    assert (r[1].remaining, r[1].titles, r[1].still_visible, r[1].passed) == (3, ["Email address", "IP address"], 1, False)
    assert r[2].passed and not r[2].has_text
    own = spark.createDataFrame([(1, 1, "one"), (1, 2, ""), (1, 3, "three")], "doc_id long, page int, text string")
    rec = spark.createDataFrame([(1, 2, "two"), (1, 3, ""), (1, 1, None)], "doc_id long, page int, text string")
    assert ocr.merge_pages(own, rec).collect()[0].text == "one\n\ntwo\n\nthree"
    res = spark.createDataFrame([(1, 2, 54.5), (1, 3, 55.0), (1, 4, None)], "doc_id long, page int, confidence double")
    assert [x.warning for x in ocr.low_confidence_warnings(res).collect()] == ["Page 2 OCR confidence was 55%"]
    items = spark.createDataFrame([(1, 1, "b", 50.0, 700.4), (1, 1, "a", 10.0, 699.0), (1, 1, "c", 1.0, 10.0), (1, 1, "  ", 1.0, 300.0)], "doc_id long, page int, text string, x double, y double")
    assert ocr.layout_rows(items).collect()[0].text == "a b\nc"
    names = spark.createDataFrame([("private.scan.jpg",), (".png",), (None,)], "n string").select(ocr.redacted_file_name(F.col("n"))).collect()
    assert [x[0] for x in names] == ["private.scan-redacted.png", "image-redacted.png", "image-redacted.png"]
    scale = spark.range(1).select(ocr.raster_scale(F.lit(3600), F.lit(100)), ocr.raster_scale(F.lit(10), F.lit(10))).collect()[0]
    assert tuple(scale) == (0.5, 1.0)


def test_text_pages():
    page = paging.page_at("safe " * 700, 0, "ai")
    assert page["nextCursor"] == 1000 and len(json.dumps(page)) < 1500
    hard = "\\\"\0\n" * 500
    cursor, seen = 0, ""
    while cursor is not None:
        p = paging.page_at(hard, cursor, "ai")
        assert p["text"] and len(json.dumps(p, ensure_ascii=False, separators=(",", ":"))) <= 1400
        seen, cursor = seen + p["text"], p["nextCursor"]
    assert seen == hard
    assert paging.page_at("", 0, "ai")["nextCursor"] is None
    assert paging.truncate_json("\0" * 500, 180, 280) == ("\0" * 46, True) and paging.truncate_json("ab", 180, 280) == ("ab", False)


def test_page_tables(spark):
    df = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None)], "doc_id long, text string")
    a = paging.text_cursors(df, "doc_id", "text").orderBy("doc_id", "cursor").collect()
    b = paging.text_pages(df, "doc_id", "text").orderBy("doc_id", "cursor").collect()
    assert [(r.doc_id, r.cursor, r.next_cursor, len(r.text)) for r in a] == [(1, 0, 1000, 1000), (1, 1000, 2000, 1000), (1, 2000, None, 500), (2, 0, None, 0), (3, 0, None, 0)]
    assert [(r.doc_id, r.cursor, r.next_cursor) for r in b] == [(r.doc_id, r.cursor, r.next_cursor) for r in a]
    items = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "doc_id long, i int")
    rows = paging.item_pages(items, "doc_id", ["i"]).orderBy("doc_id", "i").collect()
    assert [(r.page_no, r.next_cursor) for r in rows] == [(0, 2), (0, 2), (1, 4), (1, 4), (2, None), (0, None)]


def test_assets(spark):
    src = "[a](https://a.example/x) https://a.example/x https://b.example/y, (https://c.example) https://b.example/y, m@x.co m@x.co [n][none]"
    docs = spark.createDataFrame([(1, src), (2, None)], "doc_id long, text string")
    conv = convert(docs, "doc_id", "text")
    found = assets.assets(docs, conv)
    assert [(r.type, r.value) for r in found.orderBy("pos").collect()] == [("link", "https://a.example/x"), ("link", "https://b.example/y,"), ("email", "m@x.co"), ("email", "m@x.co")]
    items = assets.asset_items(found, conv).orderBy("item_no").collect()
    assert [r.category for r in items] == ["asset"] * 4 + ["reference", "broken-reference"] and items[-1].value == "none"


def test_language_guess(spark):
    texts = {
        "eng": "The committee has decided that the report will be published after the meeting, because there was not enough time to read all of the comments before it.",
        "deu": "Die Kommission hat beschlossen, dass der Bericht nach der Sitzung veröffentlicht wird, weil vorher nicht genug Zeit war, um alle Anmerkungen zu lesen.",
        "fra": "Le comité a décidé que le rapport serait publié après la réunion, parce qu'il n'y avait pas assez de temps pour lire toutes les remarques avant celle-ci.",
        "spa": "El comité ha decidido que el informe se publicará después de la reunión, porque no había tiempo suficiente para leer todos los comentarios antes de ella.",
        "nld": "De commissie heeft besloten dat het verslag na de vergadering wordt gepubliceerd, omdat er niet genoeg tijd was om alle opmerkingen van tevoren te lezen.",
    }
    df = spark.createDataFrame([*texts.items(), ("none", "too short"), ("null", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in language.detect(df, "doc_id", "text").collect()}
    assert all(got[k].code == k and got[k].detected for k in texts)
    assert (got["none"].code, got["none"].detected, got["null"].confidence) == ("eng", False, "low")


def test_random_page_texts_round_trip():
    rng = random.Random(4)
    for _ in range(20):
        s = "".join(rng.choice("ab\"\\\n\té日") for _ in range(rng.randrange(0, 4000)))
        out, cursor = "", 0
        while cursor is not None:
            p = paging.page_at(s, cursor, "plain")
            out, cursor = out + p["text"], p["nextCursor"]
        assert out == s


def test_pages_and_current_boxes(spark):
    df = spark.createDataFrame([([2, 3],), ([],), (None,)], "p array<int>").select(ocr.pages_to_read(F.col("p"))).collect()
    assert [r[0] for r in df] == [[2, 3], [1], [1]]
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    read = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ocr.with_current_boxes(docs, read).collect()) == [1, 3]
