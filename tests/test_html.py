import html as html_lib
import re
from html.entities import name2codepoint

from hypothesis import given, settings, strategies as st

from textcards.functions import html as H
from textcards.functions.html import paragraph_text


def page(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    return df.select(paragraph_text("html").alias("t")).first()["t"]


def test_paragraphs_only(spark):
    html = ("<html><head><title>T</title><style>p{x}</style>"
            "<script>var t=\"</p>\";</script></head><body><nav><p>menu</p></nav>"
            "<!-- <p>comment</p> --><div>not a paragraph</div>"
            "<p>First <b>bold</b>   text.</p><p>  </p><P class='x'>Second&amp;more &copy; &middot; "
            "&quot;q&quot;</P><pre>pre is not p</pre></body></html>")
    assert page(spark, html) == "menu\nFirst bold text.\nSecond&more © · \"q\""


def test_unclosed_paragraph_closed_by_next(spark):
    html = "<article><p><b>one<br><p>two</p><p>three</article><footer>f</footer>"
    assert page(spark, html) == "one\ntwo\nthree"


def test_text_nodes_stripped_and_joined(spark):
    html = "<p>Hel<i>lo</i>\n <a href='#'> world </a>\t!</p>"
    assert page(spark, html) == "Hel lo world !"


def test_empty_and_null(spark):
    assert page(spark, "") == ""
    assert page(spark, None) == ""
    assert page(spark, "<div>no paragraphs</div>") == ""


def test_entity_amp_decoded_last(spark):
    assert page(spark, "<p>&amp;lt; a</p>") == "&lt; a"


def test_character_references(spark):
    assert page(spark, "<p>it&#8217;s 5&#x20AC; &mdash; &rsquo;</p>") == "it\u2019s 5\u20ac \u2014 \u2019"
    assert page(spark, "<p>&amp;#65; &#0; &#1114112; &#xD800; &#150; &nosuch; &lt</p>") == \
        "&#65; \ufffd \ufffd \ufffd \u2013 &nosuch; &lt"


def test_less_than_that_opens_no_tag(spark):
    assert page(spark, "<p>if a < b and c > d then <b>x</b> <3</p>") == "if a < b and c > d then x <3"


def py_paragraphs(html):
    """Plain-Python statement of the P1 rules (test oracle)."""
    h = re.sub(r"<!--.*?-->", "", html or "", flags=re.S)
    for tag in H.DROPPED_BLOCK_TAGS:
        h = re.sub(rf"<{tag}\b[^>]*>.*?</{tag}\s*>", "", h, flags=re.S | re.I)
    h = re.sub(r"<p(\s[^>]*)?>", "\x01\x02", h, flags=re.I)
    h = re.sub(r"</?(" + "|".join(H.BLOCK_TAGS) + r")(\s[^>]*)?>", "\x01", h, flags=re.I)
    paras = []
    for piece in h.split("\x01"):
        if not piece.startswith("\x02"):
            continue
        body = re.sub(r"</?[a-zA-Z][^>]*>|<[!?][^>]*>", "\x03", piece[1:])
        body = re.sub(r"&(#\d{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z]\w{1,30});", lambda m: html_lib.unescape(m[0])
                      if m[1][0] == "#" or m[1] in name2codepoint or m[1] == "apos" else m[0], body)
        text = " ".join(n.strip() for n in body.split("\x03") if n.strip())
        if text:
            paras.append(text)
    return re.sub(r"[ \t]+", " ", "\n".join(paras)).strip()


BITS = st.sampled_from(["<p>", "</p>", "<P class='a'>", "<div>", "</div>", "<b>", "</b>", "<br>",
                        "<script>var t='</p>';</script>", "<!-- <p>x</p> -->", "<pre>",
                        "&amp;", "&copy;", "&lt;b&gt;", "&#8217;", "&#x20AC;", "&mdash;", "&rsquo;", "&amp;#65;", "&nosuch;", "& ",
                        "a < b", "&#150;", "&apos;", "<", "&eacute", "&#55296;", "text", "more words", " ", "\n", "\t",
                        "<li>", "</li>", "<h2>", "</h2>", "a.b", "<style>p{}</style>"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(BITS, max_size=20).map("".join), min_size=1, max_size=6))
def test_paragraphs_match_python_statement(spark, pages):
    df = spark.createDataFrame([(h,) for h in pages], "html string")
    for r in df.select("html", paragraph_text("html").alias("t")).collect():
        assert r["t"] == py_paragraphs(r["html"]), r["html"]


def test_references_of_any_length(spark):
    page = ("<p>&#0000000065; &#x000000041; &#" + "0" * 500 + "66; &#x" + "0" * 99 + "1F642; &#99999999999999999999; "
            "&#xFFFFFFFFFFFFFFFFFFFF; &#0000; &#x0; &#1114112; &#150;</p>")
    got = spark.createDataFrame([(page,)], "h string").select(paragraph_text("h")).first()[0]
    assert got == "A A B \U0001f642 \ufffd \ufffd \ufffd \ufffd \ufffd \u2013"
