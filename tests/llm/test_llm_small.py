"""Small cases of every training-text operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("folioflow.llm.queries")

from folioflow.llm import common, language, leakage, packing, personal_data, pseudonyms, scan_repair, splitting, text_quality, visible_form
from folioflow.llm.common import cut_lineage

CLASH = ["key", "body", "text", "idx", "n_words", "code", "h", "w", "value", "__text"]


def clashing(df):
    """The table with columns named like those that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# ---- 1: splitting ---------------------------------------------------------------------


def rule_tokens(text):
    return sum(-(-len(m) // 8) for m in re.findall(r"[^\W_]+", text)) + len(re.findall(r"[^\w \t\r\n\xa0]|_", text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Zé9.,\n-_\t;!", max_size=400), st.integers(1, 40), st.integers(0, 50))
def test_pieces_hold_what_they_say(text, budget, overlap):
    pieces = splitting.split_text(text, budget, overlap)
    covered = 0
    for i, (a, b, n) in enumerate(pieces):
        assert rule_tokens(text[a:b]) == n
        assert a <= covered and (b > covered or len(pieces) == 1 or not text)
        if len(pieces) > 1:
            assert n <= budget
        if i and overlap:
            assert rule_tokens(text[a:covered]) <= overlap
        covered = b
    assert covered == len(text)


def test_cut_at_the_topic_change():
    a = "The harbour pilot guides ships. Ships wait at the harbour. The pilot knows every ship. " * 3
    b = "Bakers knead dough at night. The oven heats the dough. Bread leaves the oven warm. " * 3
    text = a.strip() + " " + b.strip()
    budget = rule_tokens(text) - 20
    assert text[splitting.split_text(text, budget, 0)[1][0] :].startswith("Bakers")


def test_split_rows(spark):
    rows = [(1, "one two. " * 40, 7, 20, 5), (1, "one two. " * 40, 7, 20, 5), (2, None, 0, 20, 5), (3, "", None, 20, None), (4, "a b", 0, None, 2), (5, "x" * 4000, 3, 0, -1), (6, "a. b. c.", 0, 4, 99)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, text_offset int, token_budget int, overlap_tokens int")
    source = clashing(df.withColumnRenamed("text", "body2")).withColumn("t", F.col("body2"))
    assert splitting.split_oversized(source, text_col="t").filter("chunk_id = 1 AND piece_no = 0").count() == 2
    out = splitting.split_oversized(source, text_col="t", once=True).orderBy("chunk_id", "piece_no").collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_id, []).append(r)
    assert len(by[1]) > 3 and all(p.token_count <= 20 for p in by[1]) and by[1][0].piece_offset == 7
    assert (by[2][0].text, by[2][0].token_count, by[3][0].text, by[4][0].n_pieces) == (None, 0, "", 1)
    assert len(by[5]) == 500 and {p.token_count for p in by[5]} == {1}
    assert all(p.token_count <= 4 for p in by[6])
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_texts_of_one_id_are_kept(spark):
    rows = [(1, "first text here", 0, 2, 0), (1, "second text here", 0, 2, 0), (None, "third text here", 0, 2, 0), (None, "fourth text here", 0, 2, 0)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, text_offset int, token_budget int, overlap_tokens int")
    assert {r.text.split()[0] for r in splitting.split_oversized(df, once=True).filter("piece_no = 0").collect()} == {"first", "second", "third", "fourth"}


def brute_similarities(words):
    out = [0.0] * (len(words) + 1)
    for i in range(1, len(words)):
        a, b = (collections.Counter(x) for x in (words[max(0, i - splitting.BLOCK) : i], words[i : i + splitting.BLOCK]))
        out[i] = sum(a[w] * b[w] for w in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return out


def test_sliding_similarities_against_brute_force():
    rng = random.Random(5)
    for n in (0, 1, 2, 30, 79, 80, 81, 300):
        words = [rng.choice("abcdefghijklmnop") + str(i // 60) * rng.randrange(2) for i in range(n)]
        assert np.allclose(splitting._similarities(words), brute_similarities(words))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "beta", "gamma", "delta.", "eps,", "zeta.\n", "eta\n\n"]), min_size=5, max_size=80), st.integers(2, 20), st.integers(0, 5))
def test_the_deepest_valley_of_the_window_is_cut(words, budget, overlap):
    """Each cut is at the boundary of the strongest tier of its window whose valley is the deepest; kind and place break ties."""
    text = " ".join(words)
    tokens = splitting.token_spans(text)
    pieces = splitting.split_text(text, budget, overlap)
    starts = [t[0] for t in tokens]
    for (a, b, n), _ in zip(pieces, pieces[1:]):
        first = next(i for i, x in enumerate(starts) if x >= a)
        found = [(m.end(), *splitting._TIER[m.lastgroup]) for m in splitting._BOUNDARY.finditer(text) if m.end() not in (0, len(text))]
        covered = max([0, *(next(i for i, x in enumerate([*starts, len(text)]) if x >= p[1]) for p in pieces if p[1] < b)])
        limit = starts[first + budget]
        for floor in (starts[max(covered, first + budget // 2)], starts[covered] if covered > first else starts[first]):
            inside = [f for f in found if floor < f[0] <= limit]
            if inside:
                tier = min(f[1] for f in inside)
                own = [f for f in found if f[1] == tier]
                depth = dict(zip((f[0] for f in own), splitting._valleys(text, [f[0] for f in own])))
                assert b == max((f for f in inside if f[1] == tier), key=lambda f: (depth[f[0]], f[2], f[0]))[0]
                break


# ---- 2: visible form ------------------------------------------------------------------


def test_forms():
    t = visible_form.Transducer()
    same = {
        "Café": ["Café", "Ｃａｆé", "Саfé", "C​a­fé", "Cafe​́"],
        "a-b c": ["a‑b c", "a－b　c", "a‐b  c"],
        "Naïve": ["Nаïve", "Naïve"],
    }
    for want, forms in same.items():
        for f in forms:
            assert t.apply(f) == want, ascii(f)
    for kept in ("Северный мост", "Νέα Γέφυρα", "x²½", "北橋商会", "a–b", "CAFE"):
        assert t.apply(kept) == kept
    for text, want in (
        ("кey τoken Ꭺpple օrder ﬁle Ⅳ", "key token Apple order file IV"), ("\u212bå \u212a ﾊﾞｽ ｶﾞ", "Åå K バス ガ"), ("e" + "\u200b" * 9 + "\u0301" + "e" + "\u200b" * 500 + "\u0301", "éé"), ("a\u0323\u0302 a\u0302\u0323", "ậ ậ"), ("1\u0301 ;", "1\u0301 ;"), ("ﾡￂ", "가"),
    ):
        assert t.apply(text) == want, ascii(t.apply(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé\u0301\u0323\u200b\u0308Ａ\u3000 \u2011сoαйё北²-1_Å\uff9e\uff76\uffa1\uffc2\u1100\u1161\u11a8ﬁⅣк\u3099\u212a", max_size=30))
def test_form_is_stable_and_offsets_hold(s):
    t = visible_form.Transducer()
    once = t.apply(s)
    assert t.apply(once) == once
    form, at = t.with_offsets(s)
    assert len(form) == len(at) and list(at) == sorted(at)
    assert all(s[i] == c for i, c in zip(at, form) if c.isascii() and s[i].isascii())


def test_a_second_pass_changes_nothing():
    t = visible_form.Transducer()
    chars = [*t.plain, *visible_form._MARKS, *t.alike, *"abe1 _", *map(chr, range(0x370, 0x590))]
    rng = random.Random(1)
    for _ in range(20_000):
        once = t.apply("".join(rng.choice(chars) for _ in range(rng.randrange(1, 9))))
        assert t.apply(once) == once, ascii(once)


def test_conflicts_are_found():
    with pytest.raises(visible_form.Conflict):
        visible_form.Transducer({"a": {"x": "y"}, "b": {"x": "z"}})
    with pytest.raises(visible_form.Conflict):
        visible_form.Transducer({"a": {"x": "y", "y": "z"}})


def test_phrases(spark):
    rules = spark.createDataFrame([(1, "Amber Bastion", False), (2, "Façаde", False), (3, "raw", True), (4, None, False), (5, " ", False), (6, "Amber Bastion", None)], "rule_no int, phrase string, raw_only boolean")
    rows = [(1, "x Amber Bastion"), (2, "x Аmber　Bastion y"), (2, "x Аmber　Bastion y"), (3, "amber bastion"), (4, None), (5, ""), (6, "Façade and Façаde"), (7, "plain Façade")]
    df = clashing(spark.createDataFrame(rows, "id long, t string"))
    got = {(r.id, r.rule_no) for r in visible_form.find_phrases(df, ["id"], "t", rules).collect()}
    assert got == {(2, 1), (2, 6), (7, 2)}
    assert {(r.id, r.rule_no) for r in visible_form.find_phrases(df, ["id"], "t", rules, block=1).collect()} == got
    assert visible_form.find_phrases(df, ["id"], "t", rules.limit(0)).count() == 0
    every = {(r.id, r.rule_no) for r in visible_form.find_phrases(df, ["id"], "t", rules, hidden_only=False).collect()}
    assert {(1, 1), (6, 2)} <= every
    assert [r.f for r in visible_form.visible_form(df, "t", "f").filter("id IN (4, 5)").orderBy("id").collect()] == [None, ""]


# ---- 3: language ----------------------------------------------------------------------

PROSE = {
    "eng": "The records team keeps the original pages in a locked cabinet. The complaint file requires a written reason for each exception. The supplier handbook was stored under the wrong reference.",
    "deu": "Die Registratur bewahrt die Originalseiten in einem verschlossenen Schrank auf. Der Buchhalter liest den Mietvertrag langsam noch einmal. Die Nachtschicht zeigt auf zwei Seiten dieselbe Summe.",
    "fra": "Le comptable range les enveloppes par couleur et par année. La bibliothécaire relit lentement le contrat de bail. L'équipe de nuit indique le même total sur deux pages différentes.",
}


def test_gradients_against_differences():
    net = {k: v.astype(np.float64) for k, v in language.init_network(1, 3).items()}
    texts, y = [b"abcdefg", b"xy", b"hello there"], np.array([0, 1, 2])
    _, grad = language._gradients(net, texts, y)

    def loss():
        at = [language.log_probabilities(net, t)[:, c] for t, c in zip(texts, y)]
        return -np.concatenate(at).mean()

    rng = np.random.default_rng(0)
    for k in ("Uf", "Ub", "W", "b", "Bf", "Bb", "Ef", "Eb"):
        at = (ord("e"), *rng.integers(0, net[k].shape[1], 1)) if k[0] == "E" else tuple(rng.integers(0, s) for s in net[k].shape)
        old = net[k][at]
        vals = []
        for d in (1e-4, -1e-4):
            net[k][at] = old + d
            vals.append(loss())
        net[k][at] = old
        assert grad[k][at] == pytest.approx((vals[0] - vals[1]) / 2e-4, rel=1e-3, abs=1e-7)


def test_network_learns_in_a_small_fixture():
    rng = random.Random(2)
    words = {"eng": "the of and to in that with from this have".split(), "deu": "der die und mit für nicht eine sich auf werden".split()}
    texts, codes = zip(*[(" ".join(rng.choices(words[c], k=8)), c) for c in words for _ in range(150)])
    order = rng.sample(range(300), 300)
    train, held = order[:240], order[240:]
    net = language.train_network([texts[i] for i in train], [codes[i] for i in train], epochs=4, batch=32, hidden=6)
    got = language.Reader(net).pooled([texts[i].encode() for i in held], block=7)[:, :-1].argmax(1)
    assert np.mean([language.CLASSES[g] == codes[i] for g, i in zip(got, held)]) > 0.9


def test_reader_is_the_network():
    net = language.load_network()
    texts = [b"The records team keeps the pages.", b"", b"x", "Grüße".encode() * 300]
    got = language.Reader(net).pooled(texts)
    for t, row in zip(texts, got):
        want = np.zeros(len(language.CLASSES))
        for at in range(0, len(t), language.PIECE_BYTES):
            want += language.log_probabilities(net, t[at : at + language.PIECE_BYTES]).sum(0)
        assert row[-1] == len(t) and np.allclose(row[:-1], want, atol=1e-3 * (1 + len(t)))


def test_what_begins_or_ends_alike_is_read_once():
    texts = [b"the records team", b"the records office", b"the", b"the records team", b"a post office", b"the\0", b"the\0\0"]
    reader = language.Reader(language.load_network())
    for d, read in enumerate((texts, [t[::-1] for t in texts])):
        number, scores, _ = reader._direction(texts, d, 1000)
        assert len(scores) == len({t[:n] for t in read for n in range(1, len(t) + 1)}) == len(set(number.tolist()))


@pytest.mark.parametrize("factor", [1, 20])
def test_shared_reading_is_the_network(monkeypatch, factor):
    rng = random.Random(5)
    net = language.load_network()
    net["W"] *= factor  # such scores need wider exponentials
    texts = [b"the records team " * 150, b"the records team " * 149 + b"the record", b"team", b"", b"e", b"\0", b"\0\0"]
    texts += ["".join(rng.choices("aé \0", k=rng.randint(0, 9))).encode() * rng.choice((1, 1, 1, 40)) for _ in range(80)]
    want = [sum((language.log_probabilities(net, t[at : at + language.PIECE_BYTES]).sum(0) for at in range(0, len(t), language.PIECE_BYTES)), np.zeros(len(language.CLASSES))) for t in texts]
    for block, group in ((1, 1 << 21), (2, 50), (7, 3000), (5000, 1 << 21)):
        monkeypatch.setattr(language, "GROUP_BYTES", group)
        got = language.Reader(net).pooled(texts, block)
        assert got[:, -1].tolist() == [len(t) for t in texts]
        for t, row, w in zip(texts, got, want):
            assert np.isfinite(row).all() and np.allclose(row[:-1], w, rtol=1e-4, atol=1e-4 * factor * (1 + len(t)))
    assert language.Reader(net).pooled([]).shape == (0, len(language.CLASSES) + 1)


def test_parts_hold_all_rows():
    for texts in (["ab", None, "c", "", "d" * 9, "e"], ["x" * 20, "y"], [None], ["abc"] * 4):
        parts = language.parts_of(texts, 3)
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
        assert all(a < b and sum(len(t or "") for t in texts[a + 1 : b]) < 3 for a, b in parts)


def test_every_byte_has_a_label():
    net = language.load_network()
    text = "Wörter und Namen".encode()
    got = np.exp(language.log_probabilities(net, text))
    assert got.shape == (len(text), len(language.CLASSES)) and np.allclose(got.sum(1), 1, atol=1e-4)


def test_held_out_sentences():
    for code, text in PROSE.items():
        for s in language.sentences(text):
            got = language.Reader(language.load_network()).pooled([s[2].encode()])
            assert language.CLASSES[int(got[0, :-1].argmax())] == code


def test_labels():
    assert [language.language_code(x) for x in ("en", "EN-gb", "pt_BR", "deu", "und", "xx", "", None, " fr ")] == ["eng", "eng", "por", "deu", None, None, None, None, "fra"]


def test_documents(spark):
    rows = [
        (1, PROSE["eng"], "eng"), (2, PROSE["eng"], "fra"), (3, PROSE["eng"], None), (4, PROSE["eng"] + "\n\n" + PROSE["fra"], "en"), (5, None, None), (6, "", "eng"), (7, "One sentence only about the old paper files.", None),
        (8, "- the file\n- the list\n- the note\n- the page", None), (9, PROSE["deu"], "DE-at"), (9, PROSE["deu"], "DE-at"),
    ]
    df = clashing(spark.createDataFrame(rows, "id long, t string, l string"))
    out = language.detect_languages(df, "id", "t", "l")
    found = {(r.id, r.code) for r in out.filter("is_case AND counts").collect()}
    assert found == {(2, "eng"), (3, "eng"), (4, "eng"), (4, "fra")}
    four = out.filter("id = 4").orderBy("seg_no").collect()
    assert [s.code for s in four] == ["eng", "fra"] and rows[3][1][four[1].start_pos : four[1].end_pos].strip() == PROSE["fra"]
    assert out.filter("id = 5").collect()[0].detected is False and out.filter("id = 9").count() == 2
    assert language.detect_languages(df.limit(0), "id", "t").count() == 0


# ---- 4: scanned pages -----------------------------------------------------------------

OCR = "doc_id long, page int, line int, pos int, text string, confidence double"


def page_rows(doc, page, lines, low=()):
    return [(doc, page, n, p, w, 40.0 if w in low else 93.0) for n, line in lines for p, w in enumerate(line.split())]


def test_defects_and_paragraphs(spark):
    body = ["The records team keeps the original pages in a locked", "cabinet although the office was moved to another town", "and the cross-border transfer form is still being read", "by the night shift of the records team in the office."]
    rows = []
    for d in range(1, 9):
        rows += page_rows(d, 1, [(i, t) for i, t in enumerate(body)] + [(7, "[1]")])
    bad = [(0, "Firm Handbook"), (1, "The rec0rds tearn keeps the original pages in the off-"), (2, "ice although the cross-"), (3, "border transfer form is still being read by the night")]
    rows += page_rows(20, 1, bad + [(8, "– 1 –")], low=("rec0rds", "tearn"))
    rows += page_rows(20, 2, [(0, "Firm Handbook"), (1, "shift."), (2, "   ")])
    rows += [(None, 1, 1, 1, "x", 1.0), (30, 1, 0, 0, None, None), (31, 1, 0, 0, "alone", None)] + rows[:5]
    df = clashing(spark.createDataFrame(rows, OCR))
    repair = scan_repair.Repair(df, cut_lineage)
    got = {(r.doc_id, r.page, r.line, r.defect) for r in repair.defects().collect()}
    assert {x for x in got if x[0] < 9} == {(d, 1, 7, "running") for d in range(1, 9)}
    assert {x for x in got if x[0] == 20} == {(20, 1, 0, "running"), (20, 1, 8, "running"), (20, 2, 0, "running"), (20, 1, 1, "broken"), (20, 1, 1, "misread")}
    text = " ".join(r.text for r in repair.paragraphs().filter("doc_id = 20").orderBy("page", "paragraph").collect())
    assert text == "The records team keeps the original pages in the office although the cross-border transfer form is still being read by the night shift."
    assert scan_repair.Repair(df.limit(0), cut_lineage).defects().count() == 0


def test_cut_words_misread_elsewhere_too(spark):
    rows = [r for d in range(1, 9) for r in page_rows(d, 1, [(0, "the archive of the office is kept in"), (1, "the archive of the town and the archive.")])]
    rows += page_rows(20, 1, [(0, "the arcbive of the office is kept in"), (1, "the archive of the town and the arc-"), (2, "bive of the office is kept in the town.")], low=("arcbive",))
    repair = scan_repair.Repair(spark.createDataFrame(rows, OCR), cut_lineage)
    got = {(r.line, r.defect) for r in repair.defects().filter("doc_id = 20").collect()}
    assert got == {(0, "misread"), (1, "broken"), (2, "misread")}


def test_paragraphs_repair_cut_words(spark):
    rows = [r for d in range(1, 9) for r in page_rows(d, 1, [(0, "the archive of the office is kept in"), (1, "the records of the town and the archive.")])]
    lines = [(0, "tbe office is kept and the (reco-"), (1, "rcls), of the town and of octa-"), (2, "tbe is kept in")]
    rows += page_rows(20, 1, lines, low=("tbe", "rcls),")) + page_rows(20, 2, [(0, "the town and the Arc-")]) + page_rows(20, 3, [(0, "bive."), (1, "The office.")], low=("bive.",))
    repair = scan_repair.Repair(spark.createDataFrame(rows, OCR), cut_lineage)
    text = " ".join(r.text for r in repair.paragraphs().filter("doc_id = 20").orderBy("page", "paragraph").collect())
    assert text == "the office is kept and the (records), of the town and of octatbe is kept in the town and the Archive. The office."


def test_odd_parts_of_cut_words_and_compounds(spark):
    rows = [r for d in range(1, 9) for r in page_rows(d, 1, [(0, "the cross-border forms of the border office"), (1, "are kept with the cross-border forms.")])]
    lines = [(0, "it was for conse-"), (1, "rvaçã0 and for the f0-"), (2, "rm of the cross-"), (3, "bordcr forms and bordcr of cross-bordcr and Sect-"), (4, "2nd of the end.")]
    rows += page_rows(20, 1, lines, low=("bordcr", "cross-bordcr"))
    repair = scan_repair.Repair(spark.createDataFrame(rows, OCR), cut_lineage)
    got = {r.line for r in repair.defects().filter("doc_id = 20 AND defect = 'misread'").collect()}
    assert got == {1, 3}  # 'f0-' too is on line 1
    alone = page_rows(21, 1, [(0, "it was for the f0-"), (1, "rm of the cross-"), (2, "bordcr forms."), (3, "see bordcr."), (4, "see cross-bordcr.")], low=("bordcr.", "bordcr", "cross-bordcr."))
    repair = scan_repair.Repair(spark.createDataFrame(rows + alone, OCR), cut_lineage)
    got = {r.line for r in repair.defects().filter("doc_id = 21 AND defect = 'misread'").collect()}
    assert got == {0, 2, 3, 4}


def test_pages_delivered_many_times(spark):
    rows = [r for d in range(1, 4) for r in page_rows(d, 1, [(0, "the archive of the office is kept in"), (1, "the records of the town.")])]
    once = spark.createDataFrame(rows, OCR)
    many = spark.createDataFrame(rows + rows[:12] * 50 + [(1, 1, 0, 0, "tha", 10.0), (1, 1, 0, 1, "archive", None)], OCR)
    facts = lambda df, hot: sorted(map(str, scan_repair.layout(df, hot).filter("kind = 'page'").select("doc_id", "page", "lines", "poss", "texts").collect()))
    assert facts(many, 100) == facts(many, 10**9) == facts(once, 10**9)


def test_anagram_hash():
    h = scan_repair.anagram_hash
    assert h("abc") == h("cab") != h("abd") and h("") == 0


def test_the_bitmap_of_forms_has_the_hashes_of_spark(spark):
    """Forms pass by a hash in Python what the JVM put in by its own."""
    import xxhash

    words = ["", "a", "größe", "acc0rdance", "北橋", "x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(r.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(r.w, 42) for r in rows)


# ---- 5: personal data -----------------------------------------------------------------

NOTE = (
    "Dear Dr. Noor Zandhurst,\n\nContact: Piet van Fennmark, p.fennmark@kontorhaus.test, +44 7700 900123\n"
    "Her mother, A. O'Dornette, lives at Flat 2, 9 Quarry Lane, Fennbridge 98266.\nPassport QQ 12 52 50 C, issued to Fennmark, Piet\n"
    "Batch 0722-3629-9720 was scrapped on 02.08.2021. Invoice KL-15526 totals 320.00. fennmark wrote: use zero seven seven zero zero nine zero"
)


def test_values():
    got = [(NOTE[a:b], k) for a, b, k in personal_data.find_values(NOTE, visible_form.Transducer())]
    assert got == [
        ("Noor Zandhurst", "PERSON"), ("Piet van Fennmark", "PERSON"), ("p.fennmark@kontorhaus.test", "EMAIL"), ("+44 7700 900123", "PHONE"), ("A. O'Dornette", "PERSON"),
        ("Flat 2, 9 Quarry Lane, Fennbridge 98266", "LOCATION"), ("QQ 12 52 50 C", "IDENTITY_DATA"), ("Fennmark, Piet", "PERSON"), ("fennmark", "PERSON"), ("zero seven seven zero zero nine zero", "PHONE"),
    ]


def test_disguised_values_keep_their_offsets():
    t = "Mail: no​or (at) kontorhaus (dot) test or ＋４４　７７００ ９００１２３"
    got = [(t[a:b], k) for a, b, k in personal_data.find_values(t, visible_form.Transducer())]
    assert got == [("no​or (at) kontorhaus (dot) test", "EMAIL"), ("＋４４　７７００ ９００１２３", "PHONE")]


def test_values_in_ordinary_sentences():
    t = visible_form.Transducer()
    for text, want in (
        ("Yesterday Peter Jones met Anna Schmidt near John Street.", [("Peter Jones", "PERSON"), ("Anna Schmidt", "PERSON")]),
        ("Dear Mr Иванов Петров,", [("Иванов Петров", "PERSON")]),
        ("Maria Rossi, born on 12/03/1975, has the CPF 529.982.247-25.", [("Maria Rossi", "PERSON"), ("12/03/1975", "BIRTH_DATE"), ("529.982.247-25", "IDENTITY_DATA")]),
        ("The CPF 529.982.247-26 has a wrong check, and 12/03/1975 is no birth.", []),
        ("_anna@x.example_ and -bob@y.example, " + "a" * 80 + "@z.example", [("anna@x.example", "EMAIL"), ("bob@y.example", "EMAIL"), ("a" * 80 + "@z.example", "EMAIL")]),
        ("plus one two three four five six seven", [("plus one two three four five six seven", "PHONE")]),
    ):
        assert [(text[a:b], k) for a, b, k in personal_data.find_values(text, t)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzABZ0189 -./éÉßøИваньП李小龙عليאबकि٣", max_size=40), st.sampled_from(["PHONE", "IDENTITY_DATA", "BIRTH_DATE"]))
def test_feistel_round_trip(v, kind):
    c = pseudonyms.Feistel(b"secret")
    e = c.encrypt(v, kind)
    assert c.decrypt(e, kind) == v and len(e) == len(v)
    for a, b in zip(v, e):
        assert unicodedata.category(a) == unicodedata.category(b)
        assert a == b or pseudonyms._place(a)


@pytest.mark.parametrize("name", ["Иванов Петров", "José Müßig", "Łukasz Żółć", "李小龙", "محمد علي", "Γιώργος Παπάς", "김철수", "נועה כהן", "अनिल कुमार"])
def test_no_name_stays_in_clear(name):
    """Every letter has an alphabet, and over many keys a letter stays no more often than by chance."""
    assert all(pseudonyms._place(c) for c in name if c.isalnum())
    n = 200
    same = total = 0
    for i in range(n):
        e = pseudonyms.Feistel(b"%d" % i).encrypt(name, "PERSON")
        assert e != name
        same += sum(a == b for a, b in zip(name, e) if a.isalnum())
        total += sum(c.isalnum() for c in name)
    chance = sum(1 / len(pseudonyms._place(c)[0]) for c in name if c.isalnum()) / sum(c.isalnum() for c in name)
    assert same / total < chance + 4 * (chance / total) ** 0.5 + 0.005


VALID = {"dni": "12345678Z", "codice fiscale": "RSSMRA85T10A562S", "nir": "269054958815780", "cpf": "52998224725", "steuer-id": "86095742719", "pesel": "44051401359", "bsn": "111222333", "pt nif": "501964843"}


def test_checked_numbers_stay_valid():
    names = [s[0] for s in pseudonyms.SCHEMES]
    assert set(names) == set(VALID)
    for name, v in VALID.items():
        assert names[pseudonyms.scheme_of(v)] == name
        e = pseudonyms.Feistel(b"k").encrypt(v, "IDENTITY_DATA")
        assert e != v and names[pseudonyms.scheme_of(e)] == name and pseudonyms.Feistel(b"k").decrypt(e, "IDENTITY_DATA") == v


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"\A(?:[0-9]{9}|[0-9]{11}|[XYZ0-9][0-9]{7}[A-Z])\Z"))
def test_numbers_turn_back(v):
    c = pseudonyms.Feistel(b"k")
    e = c.encrypt(v, "IDENTITY_DATA")
    assert c.decrypt(e, "IDENTITY_DATA") == v and pseudonyms.scheme_of(e) == pseudonyms.scheme_of(v)


def test_feistel_formats():
    c, other = pseudonyms.Feistel(b"k"), pseudonyms.Feistel(b"l")
    for size in (2, 10, 37, 1000):
        assert sorted(c.permute(i, size, b"t") for i in range(size)) == list(range(size))
    d = c.encrypt("2024-02-29", "BIRTH_DATE")
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", d) and c.decrypt(d, "BIRTH_DATE") == "2024-02-29"
    assert personal_data.canonical_value("29.2.2024", "BIRTH_DATE") == personal_data.canonical_value("29/02/2024", "BIRTH_DATE") == "2024-02-29"
    assert c.encrypt("+44 7700 900123", "PHONE") != other.encrypt("+44 7700 900123", "PHONE")
    # The second block of a long value depends on the first.
    assert c.encrypt("a" * 16 + "same", "x")[16:] != c.encrypt("b" * 16 + "same", "x")[16:]
    with pytest.raises(ValueError):
        pseudonyms.Feistel(b"")
    with pytest.raises(TypeError):
        personal_data.redact_personal_data(None, "id", "t")


def test_redaction_links_equal_values(spark):
    rows = [(1, "Contact: Noor Zandhurst, noor@x.test, 202-555-0115"), (2, "Dear Noor Zandhurst,\nMail: NOOR@x.test or 202.555.0115"), (3, None), (4, ""), (4, "")]
    df = clashing(spark.createDataFrame(rows, "id long, t string"))
    out = {r.id: r for r in personal_data.redact_personal_data(df, "id", "t", b"key").collect()}
    find = lambda kind, s: re.search(rf"\[{kind} ([^\]]+)\]", s)[1]
    for kind in ("PERSON", "EMAIL", "PHONE"):
        assert find(kind, out[1].redacted_text) == find(kind, out[2].redacted_text)
    assert "Zandhurst" not in out[1].redacted_text and out[3].redacted_text is None and out[4].redacted_text == "" and out[4].n_values == 0
    assert personal_data.find_personal_data(df, "id", "t", b"key").count() == 6
    assert personal_data.find_personal_data(df.limit(0), "id", "t", b"key").count() == 0


# ---- 6: packing -----------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 64))
def test_best_fit_against_brute_force(sizes, capacity):
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        room = min(fits) if fits else None
        if room is None:
            rooms.append(capacity - sizes[i])
        else:
            rooms[rooms.index(room)] -= sizes[i]
        want[i] = capacity if room is None else room
    where = packing.best_fit_decreasing(sizes, capacity)
    fill = {}
    for s, c in zip(sizes, where):
        fill[c] = fill.get(c, 0) + s
    assert sorted(fill.values()) == sorted(capacity - r for r in rooms)
    assert len(set(where)) == (max(where) + 1 if where else 0)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(900, "word " * 1000), (901, None), (902, ""), (0, "again")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, t string"))
    windows = spark.createDataFrame([(1, "a", 64), (2, "b", 200), (3, "c", None), (4, "d", 0), (1, "a", 64)], "window_id int, window_name string, capacity int")
    sizes = {}
    for r in packing.token_counts(df, "doc_id", "t").collect():
        sizes.setdefault(r.doc_id, []).append(r.n_tokens)
    out = packing.pack(df, windows, text_col="t", shard_items=50)
    rows = out.collect()
    assert {r.window_id for r in rows} == {1, 2}
    for w in (1, 2):
        mine = [r for r in rows if r.window_id == w]
        per, fill = {}, {}
        for r in mine:
            per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            assert r.piece == 0 or max(sizes[r.doc_id]) > r.capacity
        assert per == {k: sum(v) for k, v in sizes.items() if sum(v)}
        assert max(fill.values()) <= mine[0].capacity
    assert min(r.used for r in packing.fill_report(out).collect()) > 0.9
    assert packing.pack(df.limit(0), windows, text_col="t").count() == 0 == packing.pack(df, windows.limit(0), text_col="t").count()


def test_huge_capacities_and_many_windows(spark):
    assert len(set(packing.best_fit_decreasing([10**8 - 5, 5, 3, 2, 10**8], 10**8))) == 2 + 1
    df = spark.createDataFrame([(None, "one two three")] * 6 + [(1, "four five")], "doc_id long, t string")
    windows = spark.createDataFrame([(i, "w", 10 + i) for i in range(packing.WINDOW_BLOCK + 1)], "window_id int, window_name string, capacity int")
    out = packing.pack(df, windows, text_col="t", shard_items=2)
    per = {r.window_id: (r.c, r.n) for r in out.groupBy("window_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("n")).collect()}
    assert len(per) == packing.WINDOW_BLOCK + 1 and len(set(per.values())) == 1 and per[0][0] == 7
    assert out.filter("window_id = 0").select(F.split("container", ":")[0].alias("s")).distinct().count() > 1  # rows without an id are spread


# ---- 7: leaks -------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 30)))) for i in range(12)] + [(99, None), (98, "too short to leak"), (0, "a second text of item zero with twelve words in it now yes")]
    docs = []
    for d in range(80):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        src = rng.choice(items[:12])[1].split()
        a = rng.randrange(0, len(src))
        ws[5:5] = src[a : a + rng.randrange(4, 16)]
        docs.append((d, rng.choice([" ", ", ", "\n", " **"]).join(x.upper() if rng.random() < 0.3 else x for x in ws)))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (202, docs[0][1])]
    want, longest = set(), {}
    for d, t in docs:
        ws = leakage.words(t or "")
        for i, t2 in items:
            w2 = leakage.words(t2 or "")
            runs = [next((k for k in range(min(len(ws) - a, len(w2) - b)) if ws[a + k] != w2[b + k]), min(len(ws) - a, len(w2) - b)) for a in range(len(ws)) for b in range(len(w2))]
            if max(runs, default=0) >= 10:
                longest[d, i] = max(max(runs), longest.get((d, i), 0))
        grams = {tuple(ws[i : i + 10]) for i in range(len(ws) - 9)}
        for i, t2 in items:
            w2 = leakage.words(t2 or "")
            if any(tuple(w2[k : k + 10]) in grams for k in range(len(w2) - 9)):
                want.add((d, i))
    df = clashing(spark.createDataFrame(docs, "doc_id long, t string"))
    it = clashing(spark.createDataFrame(items, "item_id long, t string"))
    for most in (leakage.BROADCAST_ROWS, 0):  # by broadcast and by a salted shuffle
        got = leakage.find_leaks(df, it, text_col="t", item_text="t", broadcast_rows=most, salt=3).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and want
        assert len(got) == len(want)
        assert {(r.doc_id, r.item_id): r.longest_run for r in got} == longest
    assert leakage.find_leaks(df, it.limit(0), text_col="t", item_text="t").count() == 0 == leakage.find_leaks(df.limit(0), it, text_col="t", item_text="t").count()


def test_words_ignore_markup():
    assert leakage.words("**The** [choir](https://x.test/a) of​ R­osa <b>is</b> [x][y-1] Été") == ["the", "choir", "of", "rosa", "is", "x", unicodedata.normalize("NFC", "été")]


def test_prefix_tokens_meet_every_window(spark):
    ws = [f"a{i}" for i in range(40)]
    known = leakage.shingles(spark.createDataFrame([(1, 1, " ".join(ws)), (2, 1, " ".join(ws[:10]))], "id long, twin long, body string"))
    counts = known.filter("id = 1").select("hash", (F.col("pos") * 7 % 5).cast("long").alias("n"))
    at = {(r.id, r.pos) for r in leakage.prefix_tokens(known, counts).collect()}
    assert all(any((1, j) in at for j in range(i, i + 6)) for i in range(31)) and len(at) < 20
    want = {min(range(i, i + 6), key=lambda j: (j * 7 % 5, j)) for i in range(31)}
    assert {j for i, j in at if i == 1} == want and {j for i, j in at if i == 2} == {0}


def test_the_filter_passes_what_is_in_it(spark):
    known = leakage.shingles(spark.createDataFrame([(1, 1, " ".join(f"a{i}" for i in range(3000)))], "id long, twin long, body string"))
    bits, data = common.bitmap(known, known.count())
    h = np.array([r.hash for r in known.select("hash").collect()], np.int64).view(np.uint64)
    f = common.Filter(bits, data.value)
    assert len(f.passing(h)) == len(h) and len(f.passing(h * np.uint64(0x9E3779B97F4A7C15))) < 600


def test_many_items(spark):
    """A hundred thousand items take the same two scans; one shingle is in a third of all documents."""
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(c), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000))) for k, c in enumerate("abcdefghijkl")]).alias("text"))
    hot = items.filter("item_id = 7").first().text
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("before it " + hot)).otherwise(F.lit("nothing of the kind is here")).alias("text"))
    got = leakage.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.longest_run) for r in got} == {(i, 7, 12) for i in range(0, 900, 3)}


# ---- 8: statistics --------------------------------------------------------------------

KINDS = {
    "prose": "The records team keeps the original pages. The complaint file requires a reason.\n\n- one item\n- another\n",
    "list": "- the file\n- the note (AB-12)\n  - the page\n1. one\n2. two\n",
    "table": "a;b;c\n1;2;3\n4;5;x\n",
    "junk": "TLJyaHTBrrdeXAPXuOF73zvHjGmVfOBHRlw4Mk" * 12,
}


def test_kinds(spark):
    rows = [(i, t) for i, t in enumerate(KINDS.values())] + [(10, None), (11, ""), (12, " \n\t"), (13, "Same sentence here again and again. " * 30), (14, "x" * 90_000), (14, "x" * 90_000)]
    df = clashing(spark.createDataFrame(rows, "id long, t string"))
    out = text_quality.text_statistics(df, "id", "t")
    got = {r.id: r for r in out.collect()}
    assert [got[i].text_kind for i in range(4)] == list(KINDS)
    assert got[10].text_kind is None and got[11].n_words == 0 and got[12].mean_word_length is None and got[13].text_kind == "junk"
    assert got[14].n_chars == 90_000 and got[14].n_words == 1
    for spread in (text_quality.SPREAD_CHARS, 30_000):  # a repeated row stays a row at every size
        assert text_quality.text_statistics(df, "id", "t", spread_chars=spread).filter("id = 14").count() == 2
    assert text_quality.text_statistics(df.limit(0), "id", "t").count() == 0


def test_chunks_give_the_same_statistics(spark):
    rng = random.Random(8)
    parts = [*KINDS.values(), PROSE["deu"], "a b\n\n\nc", "Repeat this long line please now.\n" * 3, "İ the And\r\n", "one line without an end " * 40, "\n\n> \n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["a b, c. " * 15_000, "x" * 9000 + "\n" + "y " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    whole = {r.id: r for r in text_quality.text_statistics(df, "id", "t", chunk_chars=1 << 30).collect()}
    assert whole[40].n_lines == 1
    for chunk, spread in ((64, 1 << 20), (4096, 1 << 20), (64, 500), (100, 100), (4096, 8192)):
        assert {r.id: r for r in text_quality.text_statistics(df, "id", "t", chunk_chars=chunk, spread_chars=spread).collect()} == whole, (chunk, spread)


def test_case_of_letters_makes_no_prose():
    line = " ".join(["the", "and", "The", "AND", "tHe", "aNd", "thE", "anD", "THe", "ANd", "ThE", "AnD", "THE", "And", "tHE", "aND"] * 3)
    assert text_quality.line_kind(line) == text_quality.line_kind(line.lower()) == "junk"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="the a.\n-;x1İ>", max_size=300), st.integers(1, 60), st.randoms())
def test_merging_is_associative(text, size, rng):
    parts = [text_quality.partial(text[i : i + size]) for i in range(0, len(text), size)] or [text_quality.partial("")]
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [text_quality.merge(parts[i], parts[i + 1])]
    assert text_quality.finish(parts[0]) == text_quality.finish(text_quality.partial(text))
