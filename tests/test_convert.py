import pytest

from folioflow.operators.convert import MODES, convert, convert_text, references
from folioflow.sources.html import html_to_markdown


def test_reference_order_and_sections():
    src = 'See [the guide][g], [site](https://example.com) and [again](https://example.com).\n\n[g]: ./guide.pdf "Course guide"\n'
    text, refs, broken = convert_text(src, "readable")
    assert [r.url for r in refs] == ["./guide.pdf", "https://example.com"] and not broken
    assert "References\n1. the guide — ./guide.pdf — Course guide" in text


def test_broken_reference():
    assert convert_text("Read [missing][source].", "plain") == ("Read missing.", [], ["source"])


def test_definition_in_fence_is_text():
    text, refs, _ = convert_text("```\n[a]: https://x.example\n```\n[a]", "plain")
    assert refs == [] and text == "[a]: https://x.example\n[a]"


def test_modes():
    src = "# Heading\n\n- [x] **Done**\n- Item"
    assert convert_text(src, "plain")[0] == "Heading\n\nDone\nItem"
    assert convert_text(src, "readable")[0] == "Heading\n───────\n\n☑ Done\n- Item"
    assert convert_text(src, "ai")[0].startswith("<untrusted_document>\n# Heading")
    with pytest.raises(ValueError):
        convert_text(src, "loud")


@pytest.mark.parametrize(
    "src, plain, readable",
    [
        ("| a | b |\n| --- | --- |\n| 1 | `2` |", "a\tb\n1\t2", "a\tb\n1\t2"),
        ("> quoted\n1. one\n2) two", "quoted\none\ntwo", "│ quoted\n1. one\n2) two"),
        ("a\n\n\n\nb\n***\nc", "a\n\nb\nc", "a\n\nb\nc"),
        ("~~~\n```\nx\n~~~\ny", "```\nx\ny", "```\nx\ny"),
        ("&lt;b&gt;x &amp; &#65;&#x42; &bogus; <i>y</i><!-- z -->", "x & AB &bogus; y", "x & AB &bogus; y"),
        ("**b** *i* __u__ ~~s~~ `c` \\*", "b i u s c *", "b i u s c *"),
        ("", "", ""),
        ("\r\n \r", "", ""),
        ("- [ ] open", "open", "☐ open"),
        ("&#1114112;", "&#1114112;", "&#1114112;"),
    ],
)
def test_blocks(src, plain, readable):
    assert convert_text(src, "plain")[0] == plain
    assert convert_text(src, "readable")[0] == readable


def test_links_of_all_kinds():
    src = "![pic](a.png 'T') [](u) ![](v) [s] [S][] <x>\n[s]: <http://s> (st)\n"
    text, refs, broken = convert_text(src, "plain", False)
    assert text == "pic Link Image s S"
    assert [(r.kind, r.url, r.title, r.defined) for r in refs] == [("image", "a.png", "T", False), ("link", "u", None, False), ("image", "v", None, False), ("link", "http://s", "st", True)]
    assert broken == []


def test_convert_table(spark):
    df = spark.createDataFrame([(1, "# A [x](y)", "ai", None), (2, None, None, False), (3, "", "plain", True)], "doc_id long, text string, mode string, append boolean")
    rows = {r.doc_id: r for r in convert(df, "doc_id", "text", mode_col="mode", append_col="append").collect()}
    assert rows[1].text.startswith("<untrusted_document>\n# A x") and rows[1].references[0].url == "y"
    assert rows[2].text == "" and rows[2].references == [] and rows[3].broken == []
    assert references(convert(df, "doc_id", "text")).count() == 1
    assert set(MODES) == {"plain", "readable", "ai"}


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<h1>T</h1><p>a <b>b</b> <i>c</i> <a href='u'>d</a> <img src=s alt=t>", "# T\n\na **b** *c* [d](u) ![t](s)"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x<li>y</ol>", "- a\n  - b\n- c\n\n1. x\n2. y"),
        ("<table><tr><th>h<td>i</tr><tr><td>1<td>2</table>", "| h | i |\n| 1 | 2 |"),
        ("<pre>x  y\nz</pre><hr><blockquote><p>q</p></blockquote>", "```\nx  y\nz\n```\n\n---\n\n> q"),
        ("<script>var a='</p>'</script><style>p{}</style><!-- c --><p>x<p>y", "x\n\ny"),
        ("<p>a<br>b</p>tail<div>c</div>", "a\nb\n\ntailc"),
        ("<p><b>open<p>next", "**open**\n\n**next**"),
        ("<head><title>T</title></head><body>x</body>", "x"),
        ("&amp;&nbsp;x", "& x"),
        ("", ""),
        (None, ""),
    ],
)
def test_html(html, markdown):
    assert html_to_markdown(html) == markdown
