"""Main text, URL filters, WARC archives: against brute force, and at the edges."""

import base64
import hashlib
import random
import re
import struct
import time
from html import unescape

import pytest
import zstandard

from meterstone.llm import html_extract, queries, shared, url_filter, warc

SCHEMA = (
    "page_id long, url string, html string, text string, host string, path string, rule string, digest string, kind string"
)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "r", "d", "k") for r in rows], SCHEMA)


# Main text


def page(title, body, nav="Home Shop", extra="", foot="Imprint"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='<p>no</p>';</script><style>p{{}}</style></head><body><header><a href=/>Site {title}</a></header><nav><ul><li><a href=/a>{nav}</a></li></ul></nav><!-- note --><div class='ad-box'>Buy {title}</div><article><h1>{title}</h1>{body}<p class=tail>Read more on these pages</p></article><div id=comments><p>Nice {title}</p></div><aside>See {title}</aside><form><label>Mail {title}</label></form>{extra}<footer>{foot} {title}</footer></body></html>"


def test_extract_by_wrapper(spark):
    rows, want = [], {}
    for n in range(8):
        body = f"<p>Paragraph  {n} &amp; more&nbsp;text<br>second\nline <b>bold {n}</b>ly.</p><ul><li>item {n}</li><li>last</li></ul>"
        rows.append((n, "http://one.example.com/x", page(f"Title {n}", body)))
        want[n] = f"Title {n} Paragraph {n} & more text second line bold {n}ly. item {n} last"
    rows += [(20, "http://alone.example.org/", page("Only", "<p>One page, one host")), (21, None, None), (22, "no url", ""), (23, "http://one.example.com/y", "plain <i>text</i> only"), (0, *rows[0][1:]), (24, "http://two.example.net/", "<div>a < b &lt; c <p>unclosed <b>x<p>y</div><a href=#>link only</a>")]
    want |= {20: "Only One page, one host Read more on these pages", 21: "", 22: "", 24: "a < b < c unclosed x y"}
    got = html_extract.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]], r["page_id"]
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_marked_inline_tags_stay_in_their_sentence(spark):
    body = lambda n: f"<p>See <a class='ext' id=l{n} href=x>the words {n}</a> now, <b class=label>Note</b> this {n}.<span class=share>Share {n}</span></p>"
    rows = [(n, "http://one.example.com/x", page(f"Title {n}", body(n))) for n in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {n: f"Title {n} See the words {n} now, Note this {n}." for n in range(6)}


def test_copies_of_a_page_are_no_template(spark):
    table = "<table><tr><td>Only here</td></tr></table><blockquote>And this</blockquote>"
    rows = [(n, "http://one.example.com/x", page("Copy", f"<p>The same.</p>{table}")) for n in range(5)]
    rows += [(n, "http://one.example.com/y", page(f"Title {n}", f"<p>Paragraph {n}.</p>")) for n in range(5, 9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {n: "Copy The same. Only here And this" if n < 5 else f"Title {n} Paragraph {n}." for n in range(9)}


def test_a_second_layout_without_article_keeps_its_text(spark):
    rows = [(n, "http://one.example.com/x", page(f"Title {n}", f"<p>Paragraph {n}.</p>")) for n in range(5)]
    rows += [(n, "http://one.example.com/y", f"<body><nav>Menu</nav><div class=content><p>Other text {n}</p></div><footer>Imprint</footer></body>") for n in range(5, 12)]
    rows += [(12, "http://one.example.com/z", "plain <i>text</i> only")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {n: f"Title {n} Paragraph {n}." if n < 5 else f"Other text {n}" if n < 12 else "plain text only" for n in range(13)}


def test_extract_joins_wrappers_that_are_too_large_to_send(spark, monkeypatch):
    rows = [(n, f"http://h{n % 3}.example.com/", page(f"T{n}", f"<p>Text {n}.</p>")) for n in range(9)]
    a = sorted(map(tuple, html_extract.extract(pages(spark, rows)).collect()))
    monkeypatch.setattr(html_extract, "MOST_SENT", 0)
    assert sorted(map(tuple, html_extract.extract(pages(spark, rows)).collect())) == a


@pytest.mark.parametrize("html", ["<" * 2000, "<a " * 2000, "<a b='" * 500, "<div>" * 3000 + "deep", "</p></div></b>", "<!--", "<script>", "<p>" * 500 + "x", "&#x110000;&bogus;&amp", "<td><li><p></td>z"])
def test_parse_any_text(html):
    outline = html_extract.Outline(html_extract.parse(html))
    assert outline.skeleton() and len(outline.slots()) == len(outline.places)
    html_extract.text_of(outline, set(range(len(outline.places))))


def shape(key, children):
    made = html_extract.Shape(key)
    made.children = children
    return made


def test_tree_matching_is_optimal():
    r = random.Random(3)

    def tree(d=0):
        return shape(r.choice("abc"), [tree(d + 1) for _ in range(r.randint(0, 3) if d < 2 else 0)])

    def brute(a, b):
        if not a or not b:
            return 0
        best = max(brute(a[1:], b), brute(a, b[1:]))
        same = a[0].key == b[0].key
        return max(best, 1 + brute(a[0].children, b[0].children) + brute(a[1:], b[1:])) if same else best

    def alike(a, b):  # lists of equal keys are paired in order
        return [x.key for x in a.children] == [x.key for x in b.children]

    for _ in range(300):
        a, b = tree(), tree()
        pairs = html_extract.matched(a, b)
        if not any(alike(x, y) and x.children for x, y in pairs):
            assert len(pairs) - 1 <= brute(a.children, b.children)
        deep = [alike(x, y) for _, x in html_extract.preorder(a) for _, y in html_extract.preorder(b) if x.children]
        if not any(deep):
            assert len(pairs) - 1 == brute(a.children, b.children)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_deep_and_irregular_pages_end():
    """Levels that hold a paragraph in one page and none in the other, and no level too deep to be told apart."""
    began = time.time()
    for levels in (10, 60, 2000):
        one = html_extract.Outline(html_extract.parse("<div><p>x</p>" * levels))
        two = html_extract.Outline(html_extract.parse("<div>" * levels))
        wrapper = html_extract.Wrapper()
        for page in (one, two):
            wrapper.add(page.skeleton(), [[1, h, h, c, k, t, 5] for h, c, k, t in page.slots()])
        assert wrapper.decisions()
    wide = html_extract.Outline(html_extract.parse("<p>a</p><div>b</div>" * 3000))
    assert len(html_extract.matched(wide.places[0][1], one.places[0][1])) >= 1
    assert time.time() - began < 10


def texts_of(spark, pages_):
    rows = [(n, "http://one.example.com/", html) for n, html in enumerate(pages_)]
    return [r["text"] for r in html_extract.extract(pages(spark, rows)).orderBy("page_id").collect()]


def test_depth_and_marks(spark):
    for n in (20, 70, 3000):
        assert texts_of(spark, ["<div>" * n + "<p>article</p><nav>MENU here</nav>"]) == ["article"]
    with_sidebar = "<nav>a</nav><div class='content with-sidebar'><h1>Title</h1><p>Some text that is long</p></div>"
    header = "<article><div class='entry-header'><h1>Title</h1></div><p>All of it</p><div class='search-theory'><p>On search</p></div></article>"
    form = "<form id=page><div><h1>Title</h1><p>A page that stands in a form as a whole</p></div></form>"
    assert texts_of(spark, [with_sidebar]) == ["Title Some text that is long"]
    assert texts_of(spark, [header]) == ["Title All of it On search"]
    assert texts_of(spark, [form]) == ["Title A page that stands in a form as a whole"]
    beside = "<div class=x1><h1>Title</h1></div><div class=x2><p>A text that is much longer than its own title is</p></div><div class=x3>aside</div>"
    assert texts_of(spark, [f"<body>{beside}</body>"]) == ["Title A text that is much longer than its own title is"]


def nameless(n, classes):
    """A page whose tags and classes say nothing: a menu, a notice that is longer than most articles, an advert, the article,
    comments."""
    r = random.Random(n)
    words = lambda k: " ".join(f"w{r.randrange(5000)}" for _ in range(k))
    notice = " ".join(f"notice{i}" for i in range(60))
    body = [words(3), *(words(r.choice((4, 15, 40, 80))) for _ in range(r.randint(1, 4)))]
    parts = [
        "".join(f"<a href=x>{words(1)}</a> " for _ in range(8)), f"<p>{notice}</p>", words(6),
        f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:]), words(5),
    ]
    attrs = [f" class=k{i}z" if classes else "" for i in range(5)]
    return "<body>" + "".join(f"<div{a}>{p}</div>" for a, p in zip(attrs, parts)) + "</body>", " ".join(body)


@pytest.mark.parametrize("classes", [True, False])
def test_the_wrapper_decides_where_names_say_nothing(spark, classes):
    made = [nameless(n, classes) for n in range(40)]
    assert texts_of(spark, [p for p, _ in made]) == [t for _, t in made]
    alone = [(n, f"http://h{n}.example.com/", p) for n, (p, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, alone)).collect()}
    assert sum(got[n] == t for n, (_, t) in enumerate(made)) < 20  # without the other pages of the host


def test_wrappers_are_aligned_group_by_group(spark, monkeypatch):
    rows = []
    for n in range(60):
        html, _ = nameless(n, True)
        rows.append((n, "http://one.example.com/", html.replace("<h1>", f"<i{n % 20}>x</i{n % 20}><h1>")))
    whole = sorted(map(tuple, html_extract.extract(pages(spark, rows)).collect()))
    monkeypatch.setattr(html_extract, "FAN", 4)
    assert sorted(map(tuple, html_extract.extract(pages(spark, rows)).collect())) == whole


def test_query_against_a_plain_reading_of_the_tables_pages(spark):
    """The given pages mark their articles: read by one expression, these are the texts."""
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        found = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", found[1])) if found else ""
        want[r["page_id"]] = " ".join(unescape(plain).split())
    got = {r["page_id"]: r["text"] for r in queries.op1_html_extract(spark, sf).collect()}
    assert got == want and len(got) > 20


# URL filters


def brute_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in queries.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(str(r)))
        return host, path, str(best), best.verdict
    hit = next((p.verdict for p in url_filter.DEFAULT_PATTERNS if re.search(p.regex(), (url or "").lower())), "allow")
    return host, path, None, hit


URLS = [None, "", "nothing", "http://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://a.b.www.example.com/en/x?q#f", "http://example.com", "http://example.com?x=/en/", "http://x.net/fr/", "http://x.net/frx", "ftp://net/es/", "http://x.org/wp-admin/a", "http://x.org/xwp-admin/a", "http://x.org/a?b=1&share=fb", "http://x.org/f.EXE", "http://x.casino/", "http://x.org/casino/?a=b", "http://x://y.com/", "http://com/", "http://x.org/login", "http://x.org/login2", "http://best-casino.org/", "https://www.casino-win.example.org/de/1", "http://m.adult-x.org/", "http://cheap-pills.org/", "http://u:p@x.com:80/", "http://é.com/ü"]


def test_urls_against_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], "h"), (None, "http://x.net/es/", "h")]
    got = url_filter.filter_urls(pages(spark, rows), queries.HOST_RULES).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *brute_verdict(u))) for i, u, _ in rows)
    assert url_filter.filter_urls(pages(spark, []), queries.HOST_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.PatternRule("block", "/common/rare/"), url_filter.PatternRule("block", "||ads.*/track^")]
    rules += [url_filter.HostRule("block", "shop.example.com", "/en/rare"), url_filter.HostRule("allow", "é", "")]
    counts = {"common": 9, "rare": 1, "ads": 5, "track": 7, "shop": 4, "example": 50, "com": 90, "en": 60}
    index = url_filter.build_index(list(enumerate(rules)), counts)
    assert {t: [n for n, _ in some] for t, some in index.items()} == {"rare": [0], "ads": [1], "shop": [2], url_filter.ANY: [3]}
    with pytest.raises(ValueError):
        url_filter.build_index([(0, url_filter.PatternRule("block", "*any*"))], {})


def test_only_fetched_rules_run():
    tried = []

    class Watched(url_filter.HostRule):
        def fits(self, host, path):
            tried.append(str(self))
            return super().fits(host, path)

    rules = [Watched("block", f"h{i}.example.com", "/") for i in range(5000)]
    counts = dict.fromkeys(["example", "com"], 9)
    matcher = url_filter.Matcher(url_filter.build_index(list(enumerate(rules)), counts))
    best, _ = matcher.best("http://a.h77.example.com/x", "a.h77.example.com", "/x", None, None)
    assert str(best[1]) == "h77.example.com/" and tried == ["h77.example.com/"]


def test_blocks_of_rules_and_many_host_rules(spark, monkeypatch):
    r = random.Random(17)
    hosts = ["a.com", "b.a.com", "com", "c.b.a.com", "x-y.net", "net"]
    some = [url_filter.HostRule(r.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/en", "/en/", "/a/B")]
    urls = [f"http://{h}{p}" for h in [*hosts, "za.com", "q.x-y.net"] for p in ("", "/", "/en/x", "/enx", "/a/B/c", "/a/b")]
    rows = [(n, u, "h") for n, u in enumerate(urls)]
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.filter_urls(pages(spark, rows), some).collect()}
    for n, u in enumerate(urls):
        host, path = (u[7:].split("/", 1) + [""])[0], u[7 + len(u[7:].split("/", 1)[0]) :]
        best = max((x for x in some if x.fits(host, path)), key=lambda x: len(str(x)), default=None)
        assert got[n] == ((str(best), best.verdict) if best else (None, "allow")), u
    monkeypatch.setattr(url_filter, "BLOCK_RULES", 5)
    again = url_filter.filter_urls(pages(spark, rows), some).collect()
    assert {x["page_id"]: (x["rule"], x["verdict"]) for x in again} == got


# WARC


def make(n, kind="response", payload=b"<p>" + b"x" * 200):
    return warc.record(n, f"http://x/{n}", payload, hashlib.sha256(payload).hexdigest(), kind, 1 if kind == "revisit" else None)


def test_archive_round_trip_and_faults():
    records = [make(n, payload=f"<p>{n}</p>".encode() * 20) for n in range(300)] + [make(1000, "revisit")]
    frames = list(warc.archive_frames(iter(records), 128))
    starts = [i for i, f in enumerate(frames) if struct.unpack_from("<I", f)[0] == warc.DICTIONARY_MAGIC]
    assert starts == [0, 129, 258]
    one = b"".join(f + warc.EMPTY_FRAME for f in frames[:129])
    got = list(warc.read_archive(one))
    assert [r["page_id"] for r in got] == list(range(128)) and got[5]["payload"] == b"<p>5</p>" * 20
    last = list(warc.read_archive(b"".join(frames[258:])))[-1]
    assert last["record_type"] == "revisit" and last["refers_to"] == 1 and last["payload_bytes"] == 203
    words = frames[0][8:]
    packed = zstandard.ZstdCompressor().compress(words)
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + frames[1]
    assert len(list(warc.read_archive(again))) == 1
    bare = zstandard.ZstdCompressor().compress(records[0])
    assert len(list(warc.read_archive(bare))) == 1
    streamed = zstandard.ZstdCompressor().compressobj()  # a writer that doesn't know the size beforehand
    assert len(list(warc.read_archive(streamed.compress(records[0]) + streamed.flush()))) == 1
    for bad in (one[:-3], one[:5000] + b"\0" + one[5001:], b"junk" + one, frames[1] + frames[0], frames[0] + zstandard.ZstdCompressor().compress(records[0] + records[1])):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(bad))
    assert list(warc.read_archive(b"")) == [] and list(warc.archive_frames(iter([]))) == []


@pytest.mark.parametrize("change", [(b"Content-Length", b"Content-Lengxh"), (b"WARC/1.1", b"WARC/9.9"), (b"<p>x", b"<p>y"), (b"WARC-Type: response", b"WARC-Type: revisit"), (b"\r\n\r\n<p>", b"\r\n<p>"), (b"WARC-Date: ", b"WARC-Date ")])
def test_bad_records(change):
    warc.parse(make(1))
    with pytest.raises(warc.ArchiveError):
        warc.parse(make(1).replace(*change))


def foreign(kind, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "WARC-Date: 2020-02-02T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    info = warc.parse(foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"))
    assert info["record_type"] == "warcinfo" and info["payload"] == b"software: x\r\n" and info["page_id"] is None
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nodd line\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    kind = "application/http; msgtype=response"
    got = warc.parse(foreign("response", http, Content_Type=kind, WARC_Payload_Digest=f"sha1:{sha1}", WARC_Target_URI="http://x/"))
    assert got["payload"] == body and got["payload_bytes"] == len(body) and got["url"] == "http://x/"
    assert got["payload_digest"] == hashlib.sha256(body).hexdigest() and got["record_id"] == "urn:uuid:1-2"
    assert warc.parse(foreign("response", http, Content_Type=kind, WARC_Payload_Digest="blake3:ab"))["payload"] == body
    with pytest.raises(warc.ArchiveError):
        warc.parse(foreign("response", http + b"!", Content_Type=kind, WARC_Payload_Digest=f"sha1:{sha1}"))
    again = foreign("revisit", b"", WARC_Profile="p", WARC_Refers_To="<urn:uuid:9>", WARC_Payload_Digest=f"sha1:{sha1}")
    got = warc.parse(again)
    assert got["payload"] is None and got["refers_to_id"] == "urn:uuid:9" and got["payload_digest"] is None
    assert warc.parse(foreign("resource", body, Content_Type="text/html"))["payload"] == body
    two = "<urn:uuid:3>\r\nWARC-Concurrent-To: <urn:uuid:4>"
    assert warc.parse(foreign("metadata", b"", WARC_Concurrent_To=two))["record_type"] == "metadata"


def test_archives_are_bounded_by_bytes(spark):
    r = random.Random(18)
    noise = lambda n: bytes(r.choices(range(33, 127), k=n)).decode()
    records = [make(n, payload=noise(3000).encode()) for n in range(40)] + [make(99, payload=noise(30_000).encode())]
    frames = list(warc.archive_frames(iter(records), 16, 12_000, fill=True))
    archives = [frames[i : i + 17] for i in range(0, len(frames), 17)]
    assert all(struct.unpack_from("<I", a[0])[0] == warc.DICTIONARY_MAGIC for a in archives)
    assert all(sum(map(len, a[1:])) <= 12_000 or sum(map(bool, a[1:])) == 1 for a in archives)
    got = [x["page_id"] for a in archives for x in warc.read_archive(warc.EMPTY_FRAME.join(a))]
    assert got == [*range(40), 99]
    rows = [(n, f"http://x/{n}", noise(5000)) for n in range(30)]
    path = shared.shared_path(spark, "warc-test")
    warc.write_archives(warc.with_revisits(pages(spark, rows).coalesce(1)), path, 16, 20_000)
    assert spark.read.format("binaryFile").load(path).count() >= 4
    back = {x["page_id"]: x["payload"].decode() for x in warc.read_archives(spark, path).collect()}
    assert back == {n: html for n, _, html in rows}


def test_warc_query(spark):
    long, html = "y" * 100, "z" * 99
    rows = [(3, "http://a/", long), (1, "http://b/", long), (2, "http://ü/ x\r\n", long), (5, None, html), (4, "u", html), (6, "v", None), (7, "w", ""), (1, "http://b/", long), (None, "n", long), (None, "n", "ü" * 60), (None, "n", "ü" * 60)]
    got = {(r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, rows)).collect()}
    assert got == {(3, "http://a/", 100, "revisit", 1), (1, "http://b/", 100, "response", None), (2, "http://ü/ x\r\n", 100, "revisit", 1), (5, None, 99, "response", None), (4, "u", 99, "response", None), (6, "v", 0, "response", None), (7, "w", 0, "response", None), (None, "n", 100, "revisit", 1), (None, "n", 120, "response", None)}
    assert warc.round_trip(pages(spark, rows)).count() == len(rows)
    assert warc.round_trip(pages(spark, [])).count() == 0
