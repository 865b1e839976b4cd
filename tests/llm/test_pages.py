"""HTML extraction and WARC round trips."""

import gzip
import hashlib
import random

import pytest

from pixelstrata.llm import html_templates as H, warc as W

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x = "</p><article>no</article>";</script><style>p{}</style></head>
<body><div class="site-header">Top</div><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">Cookies?</div><form><p>Search<input></form>
<article class="post"><header><h1>A &amp; B</h1></header><p><b>First&nbsp;line<br>goes  on<p>Second &lt;b&gt; &#233;<ul><li>one<li>two</ul>
<aside>Side</aside><div class="ad-slot">Buy</div><section id="comments"><p>Nice!</p></section><p style="display: none">hid</p><table><tr><td>x<td>y</table></article>
<footer>&copy; us</footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE, frozenset()) == "A & B\n\nFirst line goes on\n\nSecond <b> é\n\none\n\ntwo\n\nx\n\ny"


@pytest.mark.parametrize("source,want", [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<div><p>x</div>tail", "x\n\ntail"), ("<p>a < b</p>", "a < b"), ("<p title='>'>q</p>", "q"),
    ("<main><p>m</main><p>out", "m"), ("<article></article><p>left", "left"), ("<p>a</p><!-- x <p>no</p> --><p>b", "a\n\nb"), ("<p>x<script>1", "x"), ("<a href='x>broken", "broken"),
    ("<p>one <i>two</p> three</i>", "one two\n\nthree"),
])
def test_broken_markup(source, want):
    assert H.main_text(source, frozenset()) == want


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_by_host(spark):
    """Unmarked furniture goes where it recurs on its host, and stays elsewhere."""
    body = lambda k: f"<body><div><p>Same box</div><div><p>Text number {k} of many</div></body>"
    rows = [(k, f"https://a.example/{k}", body(k)) for k in range(20)] + [(100 + k, f"https://b{k}.example/x", body(k)) for k in range(20)]
    rows += [(200 + k, "https://c.example/x", body(7)) for k in range(20)]  # copies of one page are one page
    rows += [(300, None, body(1)), (301, "not a url", None), (302, "https://a.example/0", body(0)), (302, "https://a.example/0", body(0))]
    out = {}
    for r in H.extract(pages_of(spark, rows)).collect():
        out.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert all(out[k] == [f"Text number {k} of many"] for k in range(20))
    assert all(out[100 + k] == [f"Same box\n\nText number {k} of many"] for k in range(20))
    assert all(out[200 + k] == ["Same box\n\nText number 7 of many"] for k in range(20))
    assert out[301] == [""] and out[302] == ["Text number 0 of many"] * 2 and out[300] == ["Same box\n\nText number 1 of many"]


def test_articles_are_never_template(spark):
    rows = [(k, "https://a.example/", f"<body><div>Box</div><article><p>Licence<p>Own {k}</article>") for k in range(30)]
    assert {r.text for r in H.extract(pages_of(spark, rows)).collect()} == {f"Licence\n\nOwn {k}" for k in range(30)}


@pytest.mark.parametrize("tag", ["article", "main"])
def test_boxes_inside_articles(spark, tag):
    """Boxes that recur in different articles go; copies of an article with other surroundings keep theirs."""
    source = lambda k, own: f"<body><p>{k}</p><{tag}><div><h1>{own}</h1><p>Words of {own} that are long enough</p></div><div>Share <b>this</b></div><ul><li>Menu</ul><p>Licence</{tag}>"
    rows = [(k, "https://a.example/", source(k, f"title {k}")) for k in range(20)] + [(100 + k, "https://b.example/", source(k, "one")) for k in range(20)]
    out = {r.page_id: r.text for r in H.extract(pages_of(spark, rows)).collect()}
    assert all(out[k] == f"title {k}\n\nWords of title {k} that are long enough\n\nLicence" for k in range(20))
    assert all(out[100 + k] == "one\n\nWords of one that are long enough\n\nShare this\n\nMenu\n\nLicence" for k in range(20))


@pytest.mark.parametrize("small", [True, False])
def test_templates_do_not_depend_on_the_size_of_the_host(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(H, "SMALL", -1)
    rows = [(k, "https://a.example/", f"<body>{'<div><p>Section box</div>' * (k < 8)}<p>Own {k}") for k in range(400)]
    out = {r.page_id: r.text for r in H.extract(pages_of(spark, rows)).collect()}
    assert out == {k: f"Own {k}" for k in range(400)}


def test_joined_templates_equal_sent_ones(spark, monkeypatch):
    rows = [(k, "https://a.example/", f"<body><div><p>Same</div><p>Own {k}") for k in range(12)]
    want = sorted(map(tuple, H.extract(pages_of(spark, rows)).collect()))
    monkeypatch.setattr(H, "SMALL", -1)
    assert sorted(map(tuple, H.extract(pages_of(spark, rows)).collect())) == want


def test_extraction_of_empty_table_and_long_page(spark):
    df = pages_of(spark, [(1, "https://a.example/", "<article>" + "<p>word &amp; word " * 100_000)])
    assert H.extract(df).first().n_chars == 100_000 * 11 + 99_999 * 2
    assert H.extract(df.limit(0)).count() == 0


def test_query_on_whole_table(spark, sf):
    import html
    import re

    from pixelstrata.llm.queries import QUERIES

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op2_html_extraction"](spark, sf).collect()
    assert sorted(r.page_id for r in out) == sorted(source)
    for r in out:
        article = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def reference(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        again = first.get(p) if first.get(p) != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if again is None else "revisit", again, u))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_warc_round_trip(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(W, "SMALL", -1)
    long = "é\n" * 60
    rows = [(5, "https://a.example/é?q=1 2", long), (3, "u", long), (4, None, long), (7, "x%41", "short"), (6, "x", "short"), (8, "y", None), (9, "y", ""), (9, "y", ""), (3, "u", long), (None, "n", long), (10, "big", "z\x1f" * 400_000)]
    got = W.round_trip(pages_of(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == reference(rows)
    assert W.round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_headers_of_any_length(spark):
    rng = random.Random(5)
    letters = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40_000))
    rows = [(1, "https://a.example/" + "x" * 200_000, "one"), (2, "https://a.example/" + letters, "two"), (3, "u", "three")]
    assert sorted(map(tuple, W.round_trip(pages_of(spark, rows).coalesce(1)).collect()), key=str) == reference(rows)


def test_lost_records_are_an_error(spark, monkeypatch):
    read = W.read_archives
    monkeypatch.setattr(W, "read_archives", lambda files: read(files).where("record_id <> '2'"))
    with pytest.raises(ValueError, match="1 records read of 2 written"):
        W.round_trip(pages_of(spark, [(1, "u", "one"), (2, "u", "two")]))


def test_ranges_of_any_size_give_every_record_once(tmp_path):
    """Records with the gzip magic inside their bytes, at every range size."""
    rng = random.Random(4)
    texts = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 900))) + W.MAGIC * rng.randrange(3) for _ in range(60)]
    data = b"".join(W.record(k, "u", t, hashlib.sha256(t).hexdigest(), None) for k, t in enumerate(texts))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 60  # whole file is a valid archive
    read = lambda offset, n: data[offset : offset + n]
    for step in (1, 7, 100, 1000, 4096, len(data)):
        found = [W.parse(m)["#payload"] for a in range(0, len(data), step) for m in W.members(read, len(data), a, min(a + step, len(data)))]
        assert found == texts


def test_small_ranges_in_spark(spark, tmp_path):
    rows = [(k, "u", f"page {k} " * (k % 50)) for k in range(300)]
    files = W.write_archives(pages_of(spark, rows).coalesce(1), f"file:{tmp_path}/w")
    got = W.read_archives(files.select("path", "size"), split_bytes=500).collect()
    assert sorted(int(r.record_id) for r in got) == list(range(300))
    assert all((r.payload or b"").decode() == rows[int(r.record_id)][2] for r in got if r.record_type == "response")


def test_warc_query(spark, sf):
    from pixelstrata.llm.queries import QUERIES

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_warc_round_trip"](spark, sf).collect()), key=str) == reference(rows)
