from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import checks, text


def reference_fingerprint(s: str) -> str:
    """Two 32-bit lanes over UTF-16 units, straight from the definition."""
    data = s.encode("utf-16-be")
    a, b = 0x811C9DC5, 0x9E3779B9
    for i in range(0, len(data), 2):
        c = int.from_bytes(data[i : i + 2], "big")
        a = (a ^ c) * 0x01000193 % 2**32
        b = (b ^ (c + i // 2)) * 0x85EBCA6B % 2**32

    def base36(n):
        out = ""
        while n:
            n, r = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out or "0"

    return f"{len(data) // 2}:{base36(a)}:{base36(b)}"


def test_fingerprint(spark):
    texts = ["", "a", "Grüße\n\nan alle", "x😀y", "日本", "abc" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fingerprint(F.col("t")).alias("f"), text.utf16_length(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.f == reference_fingerprint(r.t)
        assert r.n == len(r.t.encode("utf-16-be")) // 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.builds(lambda c, n: c * n, st.sampled_from("aé日😀"), st.integers(400, 1300))), max_size=12))
def test_fingerprints_in_step(texts):
    assert text.fingerprint_batch(texts) == [None if t is None else reference_fingerprint(t) for t in texts]


def test_matches_and_lines(spark):
    t = "éa@b.co x\ny@z.org, no@ end q@r.io"
    pattern = r"(?ia)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    rows = df.select("t", F.explode(text.matches(F.col("t"), pattern)).alias("m")).select("m.*", text.line_of(F.col("t"), F.col("m.start_pos")).alias("line")).collect()
    assert [(r.value, r.line) for r in rows] == [("a@b.co", 1), ("y@z.org", 2), ("q@r.io", 2)]
    assert all(t[r.start_pos : r.start_pos + len(r.value)] == r.value for r in rows)


def test_counts(spark):
    df = spark.createDataFrame([("a b  c\r\nd\0",), ("",), ("   ",)], "t string")
    rows = df.select(text.newline(F.col("t")).alias("t")).select(text.word_count(F.col("t")), text.line_count(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(4, 2), (0, 0), (0, 1)]


def test_checksums(spark):
    cards = ["4111 1111 1111 1111", "4111111111111112", "1111111111111", "5500-0000-0000-0004", "123"]
    ibans = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "DE89 3704 0044 0532 0130 00", "XX", ""]
    ips = ["2001:db8::1", "::1", "1:2:3:4:5:6:7:8", "1:2:3", "1:::2", "1::2::3", "12345::1", "1:2:3:4:5:6:7::8"]
    for values, column, plain in ((cards, checks.luhn_valid, checks.luhn), (ibans, checks.iban_valid, checks.iban), (ips, checks.ipv6_valid, checks.ipv6)):
        rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", column(F.col("v")).alias("ok")).collect()
        assert {r.v: r.ok for r in rows} == {v: plain(v) for v in values}
    assert checks.luhn(cards[0]) and not checks.luhn(cards[1]) and not checks.luhn(cards[2])
    assert checks.iban(ibans[0]) and not checks.iban(ibans[1]) and checks.iban(ibans[2])
    assert [checks.ipv6(v) for v in ips] == [True, True, True, False, False, False, False, False]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789", min_size=12, max_size=20))
def test_luhn_against_definition(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    assert checks.luhn(s) == (13 <= len(s) <= 19 and len(set(s)) > 1 and total % 10 == 0)


def test_editing(spark):
    from folioflow.functions import editing

    df = spark.createDataFrame([("see [a b] \n\n", "a b", " http://x "), ("none", "q", "x\ny"), (None, "q", "u")], "t string, l string, u string")
    rows = df.select(editing.locate_reference(F.col("t"), F.col("l")), editing.fix_reference(F.col("t"), F.col("l"), F.col("u")), editing.preview(F.col("t")), editing.truncated(F.col("t"), 3)).collect()
    assert tuple(rows[0])[:3] == (4, "see [a b]\n\n[a b]: <http://x>", "see [a b]") and rows[0][3] == ("see", True)
    assert tuple(rows[1])[:3] == (-1, None, "none") and rows[2][1] is None


def test_sql_functions(spark):
    from folioflow.functions.register import register

    names = register(spark)
    assert len(names) == 8
    spark.createDataFrame([(1, "mail a@b.co and more words"), (2, None)], "id long, t string").createOrReplaceTempView("reg_docs")
    one = spark.sql("SELECT convert_markdown('# T', 'plain') a, html_to_markdown('<p>x') b, nfkc('ｘ') c, language_code('x') d, nfkc(NULL) e").collect()[0]
    assert tuple(one) == ("T", "x", "x", "eng", None)
    assert [(r.id, r.rule, r.value) for r in spark.sql("SELECT id, f.* FROM reg_docs, LATERAL scan_findings(t) f").collect()] == [(1, "email", "a@b.co")]
    assert spark.sql("SELECT c.* FROM reg_docs, LATERAL chunk_text(t, 8, 1) c").count() == 1
    assert [r.next_cursor for r in spark.sql("SELECT p.* FROM reg_docs, LATERAL text_pages(t) p").collect()] == [None]
