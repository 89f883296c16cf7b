import hashlib
import zlib

import pytest

from trajspark.llm import warc, wrapper_text as X
from trajspark.llm.common import new_folder, storage

BIG = "<p>" + "é text " * 40 + "</p>"
PAGES = [(5, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (None, "http://a/4", BIG), (1, "http://b/\n5", "short"),
         (3, "http://b/6", "short"), (4, "http://b/7", None), (6, "http://b/8", ""), (7, "http://b/9", "x" * 300_000), (2, "http://a/2", BIG)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    folder = new_folder(spark, "w")
    rows = warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        html = next((h or "").encode() for i, u, h in PAGES if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        revisit = html == BIG.encode() and r.page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload == (None if revisit else html)
    assert {r.url for r in rows if r.page_id == 1} == {"http://b/%0A5"}
    empty = new_folder(spark, "w")
    assert warc.read_archives(spark, empty, warc.write_archives(pages.limit(0), empty)).count() == 0


def test_warc_damage_is_found():
    one = warc.record_bytes("response", 1, "http://x/", b"payload " * 50, hashlib.sha256(b"payload " * 50).hexdigest(), None)
    two = one + one

    def read_from(data, step=7):
        at = 0

        def read(n):
            nonlocal at
            out = data[at:at + min(n, step)]
            at += len(out)
            return out
        return read

    assert len([warc.parse(m) for m in warc.members(read_from(two))]) == 2
    with pytest.raises(warc.CorruptRecord):
        list(warc.members(read_from(two[:-9])))
    with pytest.raises(warc.CorruptRecord):
        list(warc.members(read_from(one + b"not gzip")))
    raw = zlib.decompress(one, 31)
    for bad in (raw.replace(b"payload pay", b"payload pax"), raw[:-6] + b"\r\n\r\n", raw.replace(b"Content-Length: 4", b"Content-Length: 5", 2)):
        with pytest.raises(warc.CorruptRecord):
            warc.parse(bad)


def page(k, body, extra=""):
    nav = "".join(f"<li><a href='/{i}'>n{i}{k}</a></li>" for i in range(3 + k % 3))
    return (f"<!DOCTYPE html><html><head><title>t{k}</title><script>var t='</p>';</script></head><body><nav><ul>{nav}</ul></nav>"
            f"<!-- ad --><div class=\"ad\">buy {k}</div>{extra}{body}<footer>&copy; x {k}</footer></body></html>")


def test_main_text_of_article_pages():
    known = X.learn_host([page(k, f"<article><h1>H{k}</h1>" + f"<p>para &amp; {k}</p>" * (k + 1) + "</article>") for k in range(6)])
    html = page(9, "<article><h1>Big\n  title</h1><p><b>One</b> &lt;two&gt;<br><p>three<div class='share-buttons social'>share</div></article>")
    assert X.main_text(html, known) == "Big title\nOne <two>\nthree"
    assert X.main_text(html, None) == X.main_text(html, known)
    assert ")+" in known["wrapper"] and "(<li> <a> # </a> </li>)+" in known["wrapper"]


def test_main_text_without_article_elements():
    body = lambda k: (f"<div id='content'><p>Story {k} with some words.</p><p>More of {k}.</p></div><div class='comments'><p>nice {k}</p></div>"  # noqa: E731
                      "<form><input><p>Sign up</p></form><p>All rights reserved by us</p>")
    known = X.learn_host([page(k, body(k)) for k in range(6)])
    assert known["fixed"] == ["All rights reserved by us", "Sign up"]
    assert X.main_text(page(8, body(8)), known) == "Story 8 with some words.\nMore of 8."


def test_main_text_where_the_wrapper_saw_nothing():
    body = lambda k, lead="", mid="": (f"<div class='content'>{lead}<h1>T{k}</h1>" + f"<p>para {k} of the story</p>" * (k % 3 + 2)
                                       + mid + f"<p>last {k}</p></div>")
    known = X.learn_host([page(k, body(k)) for k in range(12)])
    html = page(20, body(20, "<p>Lead before the title.</p>", "<div>a quote</div><p>after the quote</p>"))
    assert X.main_text(html, known) == X.main_text(html, None)
    assert {"Lead before the title.", "a quote", "after the quote", "last 20"} <= set(X.main_text(html, known).split("\n"))


def test_main_text_counts_all_pages_of_a_host(spark):
    more = lambda k, plain: f"<a href='/'>x</a> more text of {k}" if k in plain else f"<a href='/'>elsewhere {k}</a> tail"
    body = lambda k, plain: f"<div class='content'><p>Story {k}.</p></div><div class='box'><p>{more(k, plain)}</p></div>"
    for plain, kept in (((17,), ()), ((17, 41), (17, 41))):
        rows = [(k, "http://h/x", page(k, body(k, plain))) for k in range(60)]
        got = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {k: f"Story {k}." + (f"\nx more text of {k}" if k in kept else "") for k in range(60)}


def test_main_text_keeps_constants_of_the_article(spark):
    body = lambda k: (f"<div class='content'><h2>Ingredients</h2><ul><li>{k} eggs</li></ul><p>By <b>Ann {k}</b> and <i>Bo {k}</i></p>"  # noqa: E731
                      f"<h2>Summary</h2><p>Dish {k}.</p></div><div><p>All rights reserved</p></div>")
    text = lambda k: f"Ingredients\n{k} eggs\nBy Ann {k} and Bo {k}\nSummary\nDish {k}."
    for n in (5, 40):
        rows = [(k, "http://h/x", page(k, body(k))) for k in range(n)]
        got = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {k: text(k) for k in range(n)}
    known = X.learn_host([page(k, body(k)) for k in range(6)])
    odd = page(7, body(7).replace("eggs</li>", "eggs</li><li>All rights reserved</li>"))
    assert X.main_text(odd, known) == text(7).replace("eggs", "eggs\nAll rights reserved")


def test_extract_handles_odd_rows(spark):
    rows = [(i, f"http://h{i % 2}/x", page(i, f"<article><p>a{i}</p></article>"), "t") for i in range(8)]
    rows += [(None, None, "plain text", "t"), (20, "no url", None, "t"), (21, "http://h0/", "", "t"), (1, *rows[1][1:])]
    got = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(
        [(str(i), f"a{i}", 2) for i in [*range(8), 1]] + [("None", "plain text", 10), ("20", "", 0), ("21", "", 0)])
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = "<p>" + "<b>word " * 30_000
    assert X.main_text(long, None).count("word") == 30_000
