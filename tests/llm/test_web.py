"""HTML extraction and WARC archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from corpus_blend.llm import html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
<body><header><h1>Site</h1><a href="/">Home</a></header><nav class="menu"><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="wrap-1"><article class="post post-{n}">
<header><h1>Title &amp; <b>more</b></h1><span>by someone</span></header>
<p>First   paragraph<br>goes on&nbsp;here, with <a href="/x">a link</a>.<p><b>Second &lt;one&gt;
<div class="ad">Buy!</div><!-- <p>hidden</p> --><ul><li>item 1<li>item 2</ul><form><input><p>search</p></form>
<p hidden>secret</p><p style="display: none">secret</p><table><tr><td>x<td>y</table></article>
<section class="comments"><p>A reader's comment that is much longer than anything in the article itself, again and again.</p></section>
</div><aside><p>Related things</p></aside><footer>&copy; us</footer></body></html>"""
TEXT = "Title & more\n\nFirst paragraph goes on here, with a link.\n\nSecond <one>\n\nitem 1\n\nitem 2\n\nx\n\ny"


def test_article_without_what_surrounds_it():
    assert html_text.extract(PAGE.format(n=1)) == TEXT


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("just text", "just text"), ("<p>a</p>b<p>c", "a\n\nb\n\nc"), ("<div>a<p>b</div>", "a\n\nb"), ("a < b &amp; c &am", "a < b & c &am"),
    ("<p>x<script>y", "x"), ("<!-- never closed <p>x", ""), ("<p title='a>b'>x</p>", "x"), ('<p title="broken>x</p>', "x"),
    ("</div></p>x", "x"), ("<P>A<BR/>B</P>", "A B"), ("<p>a\n\t b\x0bc</p>", "a b c"), ("<textarea><p>no</p></textarea>yes", "yes"),
])
def test_broken_and_odd_markup(source, text):
    assert html_text.extract(source) == text


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000
    assert html_text.extract(deep) == "deep"
    long = "<article>" + "".join(f"<p>paragraph {i} {'word ' * 20}</p>" for i in range(5000)) + "</article>"
    assert html_text.extract(long).count("\n\n") == 4999
    assert html_text.extract("<p 'x" * 3000) == ""


def test_a_host_agrees_on_a_path(spark):
    """On one page of the host the comments outweigh the content; the other pages outvote it."""
    good = "<body><div class='c12'><p>{}</p></div><div class='below'><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", good.format("content " * 30, "talk")) for i in range(5)]
    rows += [(9, "http://h.example/9", good.format("short content", "talk " * 300))]
    rows += [(10, "http://other.example/", good.format("x", "talk " * 300)), (11, None, good.format("x", "talk " * 300))]
    rows += [(12, "no url at all: %%", "<p>y</p>"), (13, "http://h.example/", None), (14, "http://h.example/", "<main><p>z</p></main>")]
    rows += [(0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' host", "'c' path", "'c' id", "1 text")
    got = sorted((r.id, r.url, r.text) for r in html_text.extract_text(frame).na.fill("", ["url"]).collect())
    talk, content = ("talk " * 300).strip(), ("content " * 30).strip()
    texts = {9: "short content", 10: talk, 11: talk, 12: "y", 13: "", 14: "z"} | {i: content for i in range(5)}
    assert got == sorted((i, u or "", texts[i]) for i, u, _ in rows)
    assert html_text.extract_text(frame.where("false")).count() == 0


# --- WARC -------------------------------------------------------------------------------


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def pages(n=120):
    rng = random.Random(0)
    texts = ["", "same", "same but long " * 500] + [rng.randbytes(rng.randrange(3000)).hex() for _ in range(20)]
    rows = [(i, f"http://x/{i} a\nb", rng.choice(texts)) for i in range(n)]
    return rows + [(500, None, None), (501, "http://x", "é" * 70_000), (None, "http://x", "without an id"), (7, rows[7][1], rows[7][2])]


def warc_model(rows, min_bytes):
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, _, text in rows:
        size, text = len((text or "").encode()), text or ""
        again = size >= min_bytes and i != first.get(text, i)
        out.append((i, size, b32(text), "revisit" if again else "response", first[text] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("split", "file", "min_bytes"), [(1 << 24, 1 << 28, 0), (700, 9000, 0), (4096, 1 << 28, 10)])
def test_archives_round_trip(spark, tmp_path, split, file, min_bytes):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 id", "2 payload", "3 digest", "4 original", "5 path")
    folder = str(tmp_path / "warc")
    files = warc.write_warc(frame, folder, min_bytes=min_bytes, file_bytes=file)
    assert sum(r.records for r in files.collect()) == len(rows)
    number = lambda urn: None if urn in (None, "urn:page:null") else int(urn.split(":")[-1])
    found = warc.read_warc(spark, folder, split).collect()
    got = sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found), key=str)
    assert got == warc_model(rows, min_bytes)
    payloads = {number(r.record_id): r.payload for r in found if r.record_type == "response"}
    assert all(payloads[i] == (t or "").encode() for i, _, t in rows if i in payloads)


def test_no_pages_give_no_records(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id bigint, url string, html string")
    (tmp_path / "none").mkdir()
    assert warc.write_warc(frame, str(tmp_path / "none")).count() == 0
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def archive():
    """Records whose compressed bytes hold gzip magic that begins no record."""
    parts = []
    for i in range(40):
        body = warc.MAGIC * (i % 7) + gzip.compress(b"not a record", mtime=0) + bytes(random.Random(i).randbytes(200))
        parts.append(gzip.compress(warc.record(i, None, body, None, "1970-01-01T00:00:00Z"), 0, mtime=0))
    return parts


def test_every_split_finds_each_record_once():
    parts = archive()
    data = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    for size in (1, 13, 257, 5000, len(data)):
        found = [p for at in range(0, len(data), size) for p, _ in warc.records(Source(data), at, at + size)]
        assert found == starts


def test_damage_is_an_error():
    data = b"".join(archive())
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(Source(data[:-5]), 0, len(data)))
    whole = warc.record(1, None, b"payload", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole.replace(b"payload\r\n\r\n", b"changed\r\n\r\n"))
