from __future__ import annotations

import base64
import hashlib
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from wordloom.llm import media

SCHEMA = "page_id bigint, url string, html string, items string, digest int"
PAYLOADS = "digest string, payload binary, url int"


def digest(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><img src='no.png'>";</script></head><body>
<p>First &amp; <b>bold</b> text<!-- <img src="no2.png"> --> goes on.<img src="a.png" alt="An  alt"> Then more.</p>
<figure><img src="/b.png"><img src="c.png" alt="own"><figcaption>The <i>caption</i> &lt;1&gt;</figcaption></figure>
<p>1 < 2 and <br>a break</p><video src='v.mp4' title=Film></video><img alt="no address"><iframe src=//other.example/x></iframe>
<img src="data:image/png;base64,{inline}"><p>End""".replace("{inline}", base64.b64encode(b"inline bytes").decode())


def test_order_positions_captions():
    items = media.parse(PAGE, "http://site.example/dir/page")
    assert [x["pos"] for x in items] == list(range(len(items)))
    short = [x["text"] if x["kind"] == "text" else (x["media"]["url"], x["media"]["caption"]) for x in items]
    base = "http://site.example/"
    assert short == ["First & bold text goes on.", (base + "dir/a.png", "An alt"), "Then more.", (base + "b.png", "The caption <1>"), (base + "dir/c.png", "The caption <1>"), "1 < 2 and", "a break", (base + "dir/v.mp4", "Film"), ("http://other.example/x", None), ("data:image/png;base64", None), "End"]


def test_every_address_of_a_tag():
    page = '<img srcset="a.png 1x, b.png 2x"><video src=v.mp4 poster="p.png"></video><noscript>turn it on <img src="lazy.png"></noscript><img src="a.png" data-src="a.png">'
    assert [x["media"]["url"] for x in media.parse(page)] == ["a.png", "b.png", "v.mp4", "p.png", "lazy.png", "a.png"]


@pytest.mark.parametrize("limit", [10**6, 1, 2])
def test_payloads_join_by_digest(spark, limit):
    base = "http://site.example/dir/page"
    rows = [(1, base, PAGE, "x", 1), (1, base, PAGE, "x", 1), (2, None, '<img src="a.png">', None, None), (3, "u", None, None, None), (4, "u", "", "y", 2), (None, base, '<img src="a.png"><img src="zz.png">', None, None)]
    known = [(digest("http://site.example/dir/a.png"), b"A2", 1), (digest("http://site.example/dir/a.png"), b"A1", 1), (None, b"none", None), (digest("http://site.example/b.png"), b"B", None)]
    out = media.sequences(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, PAYLOADS), limit).collect()
    assert len(out) == 6
    first = [r for r in out if r.page_id == 1]
    for r in first:
        found = {x.media.url: x.media.payload and bytes(x.media.payload) for x in r["items"] if x.kind == "media"}
        assert found["http://site.example/dir/a.png"] == b"A1" and found["http://site.example/b.png"] == b"B" and found["data:image/png;base64"] == b"inline bytes"
        assert (r.n_text, r.n_media, r.n_resolved) == (5, 6, 3) and [x.pos for x in r["items"]] == list(range(11))
    rest = {r.page_id: (r.n_text, r.n_media, r.n_resolved) for r in out if r.page_id != 1}
    assert rest == {2: (0, 1, 0), 3: (0, 0, 0), 4: (0, 0, 0), None: (0, 2, 1)}


def test_empty_tables(spark):
    pages, known = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], PAYLOADS)
    assert media.sequences(pages, known).collect() == []
    one = spark.createDataFrame([(1, "u", "<p>hi<img src=x>" + "long " * 200_000, None, None)], SCHEMA)
    assert [(r.n_text, r.n_media, r.n_resolved) for r in media.sequences(one, known).collect()] == [(2, 1, 0)]


class Plain(HTMLParser):
    """Visible text and images by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.hidden += 1
        elif tag == "img" and dict(attrs).get("src"):
            self.out.append(("img", dict(attrs)["src"]))
        elif tag in media.BLOCKS:
            self.out.append(("break", ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in media.BLOCKS:
            self.out.append(("break", ""))

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(("text", data))


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    out, text = [], ""
    for kind, x in [*parser.out, ("break", "")]:
        if kind == "text":
            text += x
            continue
        if text.split():
            out.append(" ".join(text.split()))
        text = ""
        if kind == "img":
            out.append(("img", x))
    return out


PIECES = st.sampled_from(["<p>", "</p>", "word ", "two words", "&amp;", "<b>", "</b>", "<br>", '<img src="i1">', "<img src='i2' alt='x'>", "<div class='a>b'>", "</div>", "<script>x<1</script>", "<!-- c -->", "é", "\n"])


@given(st.lists(PIECES, max_size=25))
@settings(max_examples=300, deadline=None)
def test_against_the_standard_parser(pieces):
    page = "".join(pieces)
    got = [x["text"] if x["kind"] == "text" else ("img", x["media"]["url"]) for x in media.parse(page)]
    assert got == plain(page)


def test_query_over_all_pages(spark, sf):
    out = media.op1_media_sequences(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = out.collect()
    assert len(rows) == pages.count() and all(r["items"] for r in rows)
    html = {r.page_id: r.html for r in pages.collect()}
    shown = {r.page_id: plain(r.html) for r in media.illustrated(pages).collect()}
    got = {r.page_id: r["items"] for r in rows}
    assert sum([x.text for x in got[k] if x.kind == "text"] == [x for x in shown[k] if isinstance(x, str) and x != f"Picture beside {k}"] for k in html) >= 0.95 * len(html)

    def picture(text):
        return b"GIF89a" + hashlib.sha256(text.encode()).digest()

    n = 0
    for r in rows:
        want = [(media.MEDIA_SITE + f"{r.page_id + 1}.gif", f"Picture beside {r.page_id}", html.get(r.page_id + 1))]
        want += [("data:image/gif;base64", "inline", str(r.page_id))] + [(media.MEDIA_SITE + "0.gif", "logo", html.get(0))] * (r.page_id % media.SHARED_EVERY == 0)
        want = [(u, c, None if t is None else picture(t)) for u, c, t in want]
        found = [(x.media.url, x.media.caption, x.media.payload and bytes(x.media.payload)) for x in r["items"] if x.kind == "media"]
        assert found == want and [x.pos for x in r["items"]] == list(range(len(r["items"])))
        assert r["items"][0].kind == "media" and (r.n_media, r.n_resolved) == (len(want), sum(p is not None for _, _, p in want))
        n += r.n_resolved
    assert n > 2 * len(rows) - 10


def test_pages_are_parsed_once(spark, sf, tmp_path):
    """The plan that ran has one parse; references read its shuffle again."""
    out = media.op1_media_sequences(spark, sf)
    out.write.parquet(str(tmp_path / "out"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan
