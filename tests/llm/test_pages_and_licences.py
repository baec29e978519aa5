import base64
import collections
import gzip
import hashlib
import html as entities
import re
import textwrap
import time

import pytest
from oracle import run_sql, same

from lumengrid.llm import htmltext, licences, queries, warc
from lumengrid.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t = "<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="ad">Buy &amp; buy
<article><header><h1>The &quot;title&quot;</h1></header><p>First <b>bold
 text<br>next</b>&nbsp;line<p>Second &lt;tag&gt; &#233;<ul><li>one<li>two</ul><form>Name <input></form>
<aside>Side</aside><div id="comments"><p>A comment</p></div><table><tr><td>x<td>y</table></article>
<section class="related-posts"><p>More</p></section><footer>&copy; me</footer></body></html>"""


def test_article_page():
    assert htmltext.main_text(PAGE) == 'The "title"\n\nFirst bold text next line\n\nSecond <tag> é\n\none\n\ntwo\n\nx\n\ny'


def test_page_without_article_uses_text_to_tag_ratios():
    prose = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(6))
    links = "".join(f"<div><a href=x><i><b>l{k}</b></i></a></div>" for k in range(12))
    found = htmltext.main_text(f"<html><body>{links}{prose}<div class='comments'><p>{'word ' * 80}</p></div>{links}</body></html>").split("\n\n")
    assert [x for x in found if x.startswith("word")] == [("word " * 60 + str(k)).strip() for k in range(6)]
    assert len(found) <= 8


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>no", "<!-- no", "<nav>no</nav>"])
def test_pages_without_text(page):
    assert htmltext.main_text(page) == ""


@pytest.mark.parametrize(
    "page",
    [
        "<script>var s = '<!--';</script><article><p>the text</article>",
        "<style>/* <!-- */</style><article><p>the text</article>",
        "<article><p title='<!--'>the text</article>",
        "<article><p>the text</article><script>'<!--'</script><!-- open <p>no",
        "<html><head><title>x</title><body><article><p>the text</article>",
        "<head><meta charset=utf-8><noscript><link href=x></noscript><template><p>no</p></template><article><p>the text</article>",
        "<head><noscript><style>no</style><body><article><p>the text</article>",
        "<head><title>x</title>the text",
        "<!-- <!-- --><p>the text",
    ],
)
def test_pages_of_ordinary_markup_are_whole(page):
    assert htmltext.main_text(page) == "the text"


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "own"), (2, "u", "<p>a", "own"), (2, "u", "<p>a", "own"), (3, "u", "<article>" + "<p>word</p>" * 30_000, "own"), (None, "u", "plain &lt; text <", "own")], "page_id long, url string, html string, text string")
    out = htmltext.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text[:14]) for r in out) == [(0, "plain < text <"), (1, ""), (2, "a"), (2, "a"), (3, "word\n\nword\n\nwo")]
    assert len(next(r.text for r in out if r.page_id == 3)) == 30_000 * 6 - 2
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf_dir):
    for r in queries.op2_html_text(spark, sf_dir).join(table(spark, sf_dir, "pages", "page_id", "html"), "page_id").collect():
        article = re.sub("<br>", " ", r.html.split("<article>")[1].split("</article>")[0])
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def chosen_blocks(page, **options):
    blocks = htmltext.parse(page).blocks
    return [b[0] for b, keep in zip(blocks, htmltext.regions(blocks, **options), strict=True) if keep]


def test_ratios_find_the_article_without_its_tag(spark, sf_dir):
    found = wanted = right = exact = 0
    rows = table(spark, sf_dir, "pages", "html").collect()
    for r in rows:
        blocks = collections.Counter(chosen_blocks(r.html))
        plain = collections.Counter(chosen_blocks(r.html.replace("<article", "<div").replace("</article", "</div")))
        wanted, found, right, exact = wanted + blocks.total(), found + plain.total(), right + (blocks & plain).total(), exact + (blocks == plain)
    assert right >= 0.98 * wanted and right >= 0.98 * found and exact >= 0.9 * len(rows)


COMMENTS = '<div id="comments"><ol>' + "".join(
    f'<li class="comment"><article class="comment-body"><footer>by x</footer><div class="comment-content"><p>What I as a reader think about it, number {k}, is long enough to look like prose in every way.</p></div></article></li>' for k in range(6)
) + "</ol></div>"
TEASER = "<aside><article><h2>Teaser</h2><p>A teaser that is long enough to look like prose, with some more words to read on.</p></article></aside>"


def in_body(page, before, after):
    return re.sub(r"(<body[^>]*>)", lambda m: m[1] + before, page, count=1).replace("</body>", after + "</body>")


def as_div(page):
    return page.replace("<article", "<div").replace("</article", "</div")


CHANGES = {
    "comments in articles": lambda h: h.replace("</article>", "</article>" + COMMENTS, 1),
    "teaser after": lambda h: h.replace("</article>", "</article>" + TEASER, 1),
    "teaser before": lambda h: h.replace("<article>", TEASER + "<article>", 1),
    "form around": lambda h: in_body(h, "<form id=aspnetForm>", "</form>"),
    "form around, no article": lambda h: as_div(in_body(h, "<form id=aspnetForm>", "</form>")),
    "sidebar wrap, no article": lambda h: as_div(in_body(h, '<div class="content-sidebar-wrap">', "</div>")),
    "comments enabled": lambda h: in_body(h, '<div class="comments-enabled">', "</div>"),
    "ad free": lambda h: in_body(h, '<div class="page ad-free">', "</div>"),
    "tagged article": lambda h: h.replace("<article>", '<article class="entry tag-legal">'),
}


@pytest.mark.parametrize("change", CHANGES)
def test_pages_keep_their_article_and_only_that(spark, sf_dir, change):
    for r in table(spark, sf_dir, "pages", "html").collect():
        assert htmltext.main_text(CHANGES[change](r.html)) == htmltext.main_text(r.html)


def test_pages_without_names_or_structure(spark, sf_dir):
    found = wanted = right = 0
    for r in table(spark, sf_dir, "pages", "html").collect():
        bare = re.sub(r"<(/?)(article|nav|aside|footer|header|main|form|section)\b", r"<\1div", re.sub(r' (class|id)="[^"]*"', "", r.html))
        a, b = (collections.Counter(htmltext.main_text(h).split("\n\n")) for h in (r.html, bare))
        wanted, found, right = wanted + a.total(), found + b.total(), right + (a & b).total()
    assert right >= 0.95 * wanted and right >= 0.85 * found


@pytest.mark.parametrize("page", ["<i><p>" + "<b>" * 40_000 + "</i>" * 40_000, "<a " * 40_000, "<form>x" * 40_000, "<form>" * 40_000 + "<article>x" * 40_000, "<div class=ad><article>x</div>" * 40_000, "<" * 300_000])
def test_hostile_pages_take_no_squares(page):
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 8


def test_smoothing_matters(spark, sf_dir):
    rows = [r.html.replace("<article", "<div").replace("</article", "</div") for r in table(spark, sf_dir, "pages", "html").collect()]
    assert any(chosen_blocks(h) != chosen_blocks(h, sigma=0.01) for h in rows)


def test_regions_are_taken_whole():
    prose, link = ("word " * 60, 2), ("l", 12)
    page = [(*link, False, False, 1)] * 8 + [(*prose, False, False, 2), ("short", 2, False, False, 2), (*link, False, False, 2), ("Advert", 2, False, True, 3), *[(*prose, False, False, 2)] * 6] + [(*link, False, False, 4)] * 8
    assert htmltext.regions(page) == [False] * 8 + [True, True, True, False] + [True] * 6 + [False] * 8


def test_ratios_decide_on_pages_with_an_article_too():
    links = [(f"l{k}", 40, True, False, 1) for k in range(8)]
    prose = [("word " * 60, 2, True, False, 2)] * 8
    outer, aside = [("word " * 60, 2, False, False, 3)] * 8, [("See more", 6, False, True, 4)] * 20
    found = htmltext.regions([*links, *prose, *aside, *outer])
    assert found[:6] == [False] * 6 and all(found[8:16]) and not any(found[17:35]) and all(found[37:])
    assert htmltext.regions([*links, *prose, *aside, *outer], sigma=8.0) != found
    assert htmltext.regions([("word " * 60, 2, True, False, 5)] * 8 + prose + aside + outer)[:8] == [True] * 8


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000 + "</i>" * 20_000, "<ul><li>" * 5_000 + "</td>" * 20_000])
def test_deep_pages_take_no_squares(page):
    began = time.perf_counter()
    htmltext.main_text(page)
    assert time.perf_counter() - began < 5


def test_smoothing_and_clusters():
    assert htmltext.smooth([3.0] * 5) == pytest.approx([3.0] * 5)
    assert 2 < htmltext.threshold([1.0, 1.1, 0.9, 9.0, 10.0]) < 9


def notices(text):
    return [(n["licence"], text[n["start"] : n["end"]], n["exact"]) for n in licences.Scanner().scan(text)]


def test_notices_and_spans():
    text = "Some prose here.\nReleased under the MIT License.\nMore prose.\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.\nthe end"
    assert notices(text) == [("MIT", "under the MIT License", True), ("GPL-3.0", "under the GNU General Public License, version 3", True), ("CC-BY-NC-4.0", "under CC BY-NC 4.0", True)]


def test_every_wording_finds_itself():
    for licence, wording in licences.TEMPLATES:
        found = notices("intro\n\n\n\n" + wording.replace(licences.ANY, "The Authors") + "\n\n\n\noutro")
        assert licence in [f[0] for f in found], licence


@pytest.mark.parametrize("width", [60, 66, 72, 80])
@pytest.mark.parametrize("mark", ["", "    ", "# ", " * "])
def test_wrapped_wordings_are_found_whole(width, mark):
    scanner = licences.Scanner()
    for licence, wording in licences.TEMPLATES:
        lines = textwrap.wrap(wording.replace(licences.ANY, "The Authors"), width, break_on_hyphens=False)
        found = scanner.scan("intro\n\n" + "\n".join(mark + line for line in lines) + "\n\noutro")
        assert licence in [n["licence"] for n in found], licence
        if len(lines) > 2:
            assert len(found) == 1 and found[0]["exact"], licence


@pytest.mark.parametrize("width", [30, 72, 78, 120])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_all_wordings_are_exact_at_any_width(width, mark):
    scanner = licences.Scanner()
    for licence, wording in [*licences.TEMPLATES, *licences.whole_licences()]:
        lines = textwrap.wrap(wording.replace(licences.ANY, "The Authors"), width, break_on_hyphens=False, break_long_words=False)
        found = scanner.scan("intro\n\n" + "\n".join(mark + line for line in lines) + "\n\noutro")
        assert (licence, True) in [(n["licence"], n["exact"]) for n in found], licence


def test_whole_licences_with_other_words():
    assert len(licences.whole_licences()) == 7
    scanner = licences.Scanner()
    for licence, wording in licences.whole_licences():
        words = wording.split(" ")
        changed = " ".join("other" if k % 97 == 50 else w for k, w in enumerate(words))
        found = scanner.scan("code();\n" * 50 + changed + "\nthe end. Released under the MIT License.")
        assert [n["licence"] for n in found if n["similarity"] >= 0.9][:1] == [licence] and not found[0]["exact"] and "other" in found[0]["extra"], licence
        assert found[-1]["licence"] == "MIT" and found[-1]["exact"]


def test_long_blocks_and_stray_words():
    one = licences.TEMPLATES[0][1]
    text = f"the rights of the software\n{one}\nthe software and the rights to use, copy\n" * 20
    found = licences.Scanner().scan(text)
    assert [text[n["start"] : n["end"] + 1] for n in found] == [one] * 20 and all(n["exact"] for n in found)


def test_changed_wording_is_told():
    wording = licences.TEMPLATES[0][1]
    found = licences.Scanner().scan(wording.replace("free of charge", "at no charge"))
    assert len(found) == 1 and found[0]["licence"] == "MIT" and not found[0]["exact"] and {"free", "of"} & set(found[0]["missing"])
    assert not licences.Scanner().scan("You may ask for permission, and a licence is not given. No warranty.")


def test_scan_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "word " * 50_000 + "\nunder the ISC License")], "doc_id long, text string")
    out = collections.Counter((r.doc_id, tuple(n.licence for n in r.notices)) for r in licences.scan(docs).collect())
    assert out == {(1, ()): 1, (2, ()): 1, (3, ("MIT",)): 2, (None, ("ISC",)): 1}
    assert licences.scan(docs.limit(0)).count() == 0
    again = licences.scan(docs.selectExpr("*", "'own' AS notices", "doc_id AS licence"))
    assert again.columns == ["doc_id", "licence", "notices"] and collections.Counter((r.doc_id, tuple(n.licence for n in r.notices)) for r in again.collect()) == out


def test_fast_look_for_triggers_misses_none(spark, sf_dir):
    texts = [r.text or "" for r in table(spark, sf_dir, "documents", "text").collect()]
    texts += ["LICENSE", "Licence", "l\u0131cense", "l\u0130cense", "licen\u017fe", "AS-IS", "as\nis", "(C)", "\u00a9", "CC BY", "cc\n0", "Cc0", "PermiSSion  is", "permission", "public_domain", "creative", "SPDX", "redistributed", "warranty", "basic", "\u00df"]
    for text in texts:
        assert licences.trigger_places(text) == [m.start() for m in licences.TRIGGER.finditer(text)], text[:80]


def test_ties_go_to_the_first_template():
    one = licences.Scanner([("first", "under the same license of words"), ("second", "under the same license of words")])
    assert [n["licence"] for n in one.scan("here under the same license of words.")] == ["first"]


def test_notices_of_the_tables(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents", "doc_id", "text").collect()}
    lines = re.compile(r"^(?:Licensed under CC BY-NC 4\.0|This work is licensed under the GNU General Public License, version 3|Licensed under the Apache License, Version 2\.0|Released under the MIT License)\.$", re.M)
    out = {r.doc_id: r for r in queries.op4_licences(spark, sf_dir).collect()}
    assert {i: r.n_exact for i, r in out.items()} == {i: len(lines.findall(t)) for i, t in docs.items()}


def archive(spark, rows, folder, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, folder, **options)
    captures = warc.assemble(warc.read(spark, folder))
    return warc.resolve_revisits(captures, captures["metadata.fields"]["captureId"].cast("long")).collect()


def test_round_trip_of_odd_pages(spark, tmp_path):
    odd = ["", "a\r\n\r\nb", "\r\n\r\n", "WARC/1.1\r\n\r\n", "é" * 70_000, "end\r\n", "\n", "x" * 300_000]
    rows = [(k, f"http://a.example/{k}", h) for k, h in enumerate(odd)] + [(100 + k, None, h) for k, h in enumerate(odd)] + [(200, "u\r\nv", None), (0, "http://a.example/0", "")]
    out = {int(r.metadata.fields["captureId"]): r for r in archive(spark, rows, f"{tmp_path}/w")}
    assert len(out) == 17
    for k, h in enumerate(odd):
        r = out[k]
        assert r.response.type == "response" and bytes(r.response.payload) == h.encode() and r.response.intact and r.refers_to is None and r.response.target_uri == f"http://a.example/{k}"
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert out[100 + k].response.type == "revisit" and out[100 + k].refers_to == k and out[100 + k].metadata.fields["payloadBytes"] == str(len(h.encode()))
        assert r.request.record_id and r.request.content_type == "application/http;msgtype=request"
    assert out[200].refers_to == 0 and out[200].response.target_uri == "u%0D%0Av"


def test_repeated_rows_are_one_capture(spark, tmp_path):
    out = archive(spark, [(0, "u", ""), (0, "u", ""), (100, "v", ""), (0, "u", "x"), (None, "n", "y"), (None, "n", "y")], f"{tmp_path}/w")
    found = [((r.metadata.fields.get("captureId")), r.response.type, r.refers_to) for r in out]
    assert sorted(found, key=str) == sorted([("0", "response", None), ("0", "response", None), ("100", "revisit", 0), (None, "response", None)], key=str)


def test_long_records_of_many_pieces_take_no_squares():
    block = b"short paragraph\r\n\r\n" * 1_000_000
    stream = warc.RecordStream(payload=True)
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Type: text/plain\r\nContent-Length: %d" % len(block)
    began = time.perf_counter()
    found = [r for piece in (head + b"\r\n\r\n" + block + b"\r\n\r\n" + head).split(b"\r\n\r\n") for r in stream.add(piece)]
    assert time.perf_counter() - began < 10 and len(found) == 1 and found[0][-1] == block


def test_revisits_of_a_hot_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 1)
    rows = [(k, "u", None if k % 3 else f"page {k}") for k in range(90)] + [(100 + k, "v", f"page {3 * k}") for k in range(20)]
    wide = spark.createDataFrame([(*r, "own", 5, 6) for r in rows], "page_id long, url string, html string, refers_to string, digest int, first int")
    warc.write(wide, f"{tmp_path}/w")
    captures = warc.assemble(warc.read(spark, f"{tmp_path}/w"))
    out = warc.resolve_revisits(captures, captures["metadata.fields"]["captureId"].cast("long")).collect()
    found = sorted((int(r.metadata.fields["captureId"]), r.refers_to) for r in out)
    assert found == sorted([(k, None if k % 3 == 0 or k == 1 else 1) for k in range(90)] + [(100 + k, 3 * k) for k in range(20)])


def test_small_payloads_are_responses(spark, tmp_path):
    out = archive(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], f"{tmp_path}/w", least=4)
    assert sorted((int(r.metadata.fields["captureId"]), r.response.type) for r in out) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert archive(spark, [], f"{tmp_path}/none") == []


def test_archives_of_other_writers(spark, tmp_path):
    """One gzip member for each record, more fields, a record without partners."""
    records = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n",
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\xff\xfe\r\n",
        b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <r>\r\nContent-Type: application/warc-fields\r\nContent-Length: 7\r\n\r\nvia: y\n",
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    found = warc.read(spark, str(tmp_path))
    assert sorted(r.type for r in found.collect()) == ["metadata", "response", "warcinfo"]
    row = warc.assemble(found).first()
    assert bytes(row.response.payload) == b"\xff\xfe\r\n" and row.request is None and row.metadata.record_id == "<m>"


def test_captures_agree_with_sql(spark, sf_dir):
    got = queries.op8_warc(spark, sf_dir).toPandas()
    wanted = run_sql(sf_dir, queries.OP8_SQL)
    for df in (got, wanted):
        df["refers_to"] = df["refers_to"].map(lambda x: None if x != x or x is None else int(x)).astype(str)
    same(got, wanted)


def records_of(spark, folder, body):
    (folder / "a.warc.gz").write_bytes(gzip.compress(body))
    return warc.read(spark, str(folder)).collect()


def test_spellings_of_other_writers(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore"
    body = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID:  <a>\r\nContent-type:application/http; \r\n\tmsgtype=response\r\nCONTENT-LENGTH:%d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    body += b"WARC/1.0\r\nWARC-Type: metadata\r\nwarc-concurrent-to:<a>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nk:v\r\nx: y\r\n\r\n"
    found = {r.type: r for r in records_of(spark, tmp_path, body)}
    assert found.keys() == {"response", "metadata"} and bytes(found["response"].payload) == b"body\r\n\r\nmore" and found["response"].record_id == "<a>"
    assert found["response"].content_type == "application/http; msgtype=response" and found["response"].intact
    assert found["metadata"].fields == {"k": "v", "x": "y"} and found["metadata"].concurrent_to == "<a>"


@pytest.mark.parametrize("cut", [1, 50, 150, 190])
def test_cut_files_give_what_there_is(spark, tmp_path, cut):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 100 + b"\r\n\r\n" + b"y" * 20
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    whole = b"".join(head % (k, len(block)) + block + b"\r\n\r\n" for k in range(2))
    found = {r.record_id: r for r in records_of(spark, tmp_path, whole[: -4 - cut])}
    assert found["<0>"].intact and found["<0>"].payload_bytes == 124
    assert len(found) == 2 and not found["<1>"].intact and (cut > 140 or found["<1>"].payload_bytes == 124 - cut)


def test_records_without_a_length_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="without Content-Length"):
        records_of(spark, tmp_path, b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")


def test_planted_revisits(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k // 3}" if k % 10 else None) for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op8_warc(spark, str(tmp_path)).toPandas()
    assert (got.record_type == "revisit").sum() == 60 - len({h for *_, h in rows})
    same(got, run_sql(str(tmp_path), queries.OP8_SQL.replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")))
