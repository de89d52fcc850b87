"""Operators on pages against brute force, and on odd rows."""

import gzip
import hashlib
import random

import pytest
from llm_data import prose, vocabulary
from pyarrow import fs

from seriesloom.llm import urls, warc, wrappers
from seriesloom.llm.queries import RULES

PAGES = "page_id long, url string, html string, host string, path string, size long, code long"


@pytest.fixture(scope="module")
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "h", "p", 1, 2) for r in rows], PAGES)

    return build


# --- archives -------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [97, 4000, 1 << 23])
def test_archives_come_back_whole_for_any_range(pages, size):
    dice, known = random.Random(2), vocabulary()
    big = prose(dice, known, 400)
    rows = [(i, f"http://a.net/{i}", prose(dice, known, dice.randint(0, 300))) for i in range(60)]
    rows += [(100, "http://a.net/ä\n b", big), (101, None, big), (99, "x", big), (None, "n", big), (102, "u", None), (103, "u", ""), (104, "u", "")]
    files = warc.write_archives(pages(rows).repartition(3), warc.archive_folder(pages(rows)))
    got = warc.read_archives(files, range_bytes=size).collect()
    want = []
    for i, _, t in rows:
        body = (t or "").encode()
        again = len(body) >= 1000 and body == big.encode() and i != 101
        want.append((i, "revisit" if again else "response", 101 if again else None, len(body), hashlib.sha1(body).hexdigest(), b"" if again else body))
    have = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert {r["url"] for r in got if r["page_id"] == 100} == {"http://a.net/ä%0A%20b"}


def test_archives_are_gzip_members_others_can_read(pages, tmp_path):
    rows = [(i, "http://a.net/", f"<p>{i}</p>") for i in range(5)]
    files = warc.write_archives(pages(rows).coalesce(1), f"file://{tmp_path}/warc").collect()
    store, name = fs.FileSystem.from_uri(files[0]["path"])
    data = gzip.decompress(store.open_input_file(name).read())
    assert data.count(b"WARC/1.1\r\n") == 5 and store.get_file_info(name).size == files[0]["size"]


def test_magic_inside_a_member_is_no_record(tmp_path):
    inner = gzip.compress(b"not a record") + b"\x1f\x8b\x08 noise"
    data = warc.record(1, "u", inner * 50, "response", None) + warc.record(2, "u", b"x", "response", None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    store, name = fs.FileSystem.from_uri(f"file://{path}")
    for size in (50, 300, 10_000):
        found = []
        for begin in range(0, len(data), size):
            with store.open_input_file(name) as stream:
                found += [warc.parse(d).payload for _, d in warc.members(stream, len(data), begin, min(len(data), begin + size))]
        assert found == [inner * 50, b"x"]


def foreign(kind, block, **head):
    """A record as another program may write it."""
    lines = "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_archives_of_other_writers_come_back_whole(spark, tmp_path, size):
    body = b"<p>one</p>\r\n\r\n<p>two</p>"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    ask = b"GET / HTTP/1.1\r\nHost: a.net\r\n\r\n"
    sha, other = hashlib.sha1(body), "ab" * 20
    kinds = "application/http; msgtype="
    data = b"".join(
        [
            foreign("warcinfo", b"software: x\r\n", Content_Length=13, WARC_Record_ID="<urn:uuid:1>", Content_Type="application/warc-fields"),
            foreign("request", ask, content_length=len(ask), WARC_Record_ID="<urn:uuid:2>", Content_Type=kinds + "request"),
            foreign("response", http, CONTENT_LENGTH=len(http), WARC_Target_URI="http://a.net/", Content_Type=kinds + "response", WARC_Record_ID="<urn:uuid:3>"),
            foreign("revisit", b"", Content_Length=0, WARC_Refers_To="<urn:uuid:3>", WARC_Payload_Digest=f"sha1:{other.upper()}"),
            foreign("revisit", b"", Content_Length=0, WARC_Payload_Digest="md5:00"),
            foreign("resource", b"plain", WARC_Target_URI="ftp://b.net/", Content_Type="text/plain"),
            warc.record(7, "http://c.net/", b"own", "response", None),
            foreign("conversion", b"", Content_Length="none"),
        ]
    )
    (tmp_path / "other.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz", len(data))], warc.FILES)
    got = warc.read_archives(files, range_bytes=size).orderBy("at").collect()
    hexed = lambda b: hashlib.sha1(b).hexdigest()
    assert [(r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in got] == [
        ("warcinfo", 13, hexed(b"software: x\r\n")),
        ("request", 0, hexed(b"")),
        ("response", len(body), sha.hexdigest()),
        ("revisit", None, other),
        ("revisit", None, None),
        ("resource", 5, hexed(b"plain")),
        ("response", 3, hexed(b"own")),
        ("conversion", 0, hexed(b"")),
    ]
    assert [r["page_id"] for r in got] == [None] * 6 + [7, None]
    assert got[2]["url"] == "http://a.net/" and bytes(got[2]["payload"]) == body
    assert got[3]["refers_to_id"] == got[2]["record_id"] == "<urn:uuid:3>" and got[3]["refers_to"] is None


def test_no_pages_no_records(pages):
    files = warc.write_archives(pages([]), warc.archive_folder(pages([])))
    assert warc.read_archives(files).count() == 0


# --- urls -----------------------------------------------------------------------------------

URLS = [
    "http://www.Example.com/en/1?q#f",
    "https://example.com/en/x",
    "https://example.com/fr",
    "http://badexample.com/en/1",
    "http://a.b.net/es/",
    "http://net/fr/2",
    "http://b.net",
    "http://b.net?x=/es/",
    "no scheme/com/",
    "",
    None,
    "://x.org/p://q",
    "http://user@h.com:80/p#a/b",
]


def plain_match(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_rules_are_those_of_a_plain_loop(spark, pages):
    df = pages([(i, u, None) for i, u in enumerate(URLS)]).select("page_id", "url")
    none = spark.createDataFrame([], "a string, b string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.rule_table(df, RULES), none).collect()}
    assert got == {i: plain_match(u) for i, u in enumerate(URLS)}
    assert urls.judge(df.where("false"), urls.rule_table(df, RULES), none).count() == 0
    assert {r["rule"] for r in urls.judge(df, urls.rule_table(df, []), none).collect()} == {None}


def test_blocks_reach_aliases_and_allow_has_precedence(pages):
    canonical = '<html><head><LINK href="{}" rel=\'Canonical\'></head></html>'
    refresh = "<meta http-equiv=refresh content=\"0; url={}\">"
    rows = [
        (1, "http://one.org/a", canonical.format("http://two.org/b")),
        (2, "http://two.org/b#top", refresh.format("//net/es/3")),
        (3, "http://three.org/x/y", refresh.format("../c")),
        (4, "http://four.org/x", canonical.format("/blocked")),
        (5, "http://four.org/blocked", refresh.format("http://www.example.com/en/ok")),
        (6, "http://five.net/es/6", canonical.format("http://four.org/x")),
        (7, "http://six.org/", "<!-- " + canonical.format("http://net/es/3") + " --><script>'<link rel=canonical href=http://net/es/3>'</script>"),
        (8, "HTTP://One.org/a", None),
        (9, "http://seven.org/", canonical.format("mailto:x") + canonical.format("")),
    ]
    df = pages(rows)
    edges = urls.link_edges(df)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df.select("page_id", "url"), urls.rule_table(df, RULES), edges).collect()}
    assert got[1] == (None, "block") and got[2] == (None, "block") and got[8] == (None, "block")
    assert got[3] == (None, "allow") and got[7] == (None, "allow") and got[9] == (None, "allow")
    # The component of 4, 5, 6 has a blocked and an explicitly allowed url: only the blocked one itself is.
    assert got[4] == (None, "allow") and got[5] == (None, "allow") and got[6] == ("net/es/", "block")


# --- main text ------------------------------------------------------------------------------

CASES = [
    ("<p>a<p>b<div class=ad>x</div><ul><li><a href=1>k</a></ul>c<br>d &amp; e</p>f<script>x</p>", "a\nb\nc d & ef"),
    ("<body><header><h1>S</h1></header><main><h1>T</h1><p>x &nbsp;\n y</p><div id='comments'><p>c</div></main>z", "T\nx y"),
    ("<article><header><h1>T</h1></header><p>one<!-- <p>no --> two<aside>s</aside><footer>f</footer>three</article>", "T\none two\nthree"),
    ("<nav><a>1</a></nav><p>hi &#39;x&#39; &lt;b&gt;</p><form>q<input></form><p>tail <b>x", "hi 'x' <b>\ntail x"),
    ("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>t<dd>d</dl>", "1\n2\n3\nt\nd"),
    ("<p>cut <a href='x", "cut"),
    ("<p title='a > b'>quoted</p><style>p{}</style>< 5 & 6", "quoted\n< 5 & 6"),
    ("<p hidden>no</p><p style='display: none'>no</p><div role=banner>no</div><p>yes", "yes"),
    ("plain text", "plain text"),
    ("<script>var a = '<p>no</p>';", ""),
    ("</p></div><p>a</b></p>", "a"),
    ("", ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text_of_a_page(html, text):
    assert wrappers.main_text(html) == text


def test_templates_of_a_host_go_and_what_varies_stays(pages):
    dice, known = random.Random(7), vocabulary()
    body = "<html><body><div><p>Welcome to our site, all of you</p></div><div class=c><h1>{}</h1><p>{}</p>{}</div><div><p>Made by the team of the site</p></div></body></html>"
    rows, want = [], {}
    for i in range(40):
        host = "one.org" if i < 25 else "two.org"
        head, text, more = prose(dice, known, 5), prose(dice, known, 30), [prose(dice, known, 20) for _ in range(i % 4)]
        rows.append((i, f"http://{host}/{i}", body.format(head, text, "".join(f"<p>{m}</p>" for m in more))))
        want[i] = "\n".join([head, text, *more])
    rows += [(90, "http://alone.org/", "<p>Welcome to our site</p>"), (91, None, "<p>no url"), (92, "http://one.org/x", None), (93, "http://one.org/y", "")]
    rows += [(94, "http://one.org/1", rows[1][2])]
    want |= {90: "Welcome to our site", 91: "no url", 92: "", 93: "", 94: want[1]}
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows).repartition(3)).collect()}
    assert got == want
    assert wrappers.extract(pages([])).count() == 0


def test_templates_inside_an_article_go_and_what_varies_stays(pages):
    dice, known = random.Random(8), vocabulary()
    body = "<body><article><h1>{}</h1><div class=note>First seen in the paper</div>{}<p>{}</p></article></body>"
    rows, want = [], {}
    for i in range(24):
        text, last = [prose(dice, known, 25) for _ in range(1 + i % 3)], "the same line" if i % 2 else prose(dice, known, 6)
        rows.append((i, f"http://one.org/{i}", body.format(f"head {i}", "".join(f"<p>{t}</p>" for t in text), last)))
        want[i] = "\n".join([f"head {i}", *text, last])
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows).repartition(3)).collect()}
    assert got == want


def test_each_layout_of_a_host_has_its_templates(pages):
    dice, known = random.Random(9), vocabulary()
    rows, want = [], {}
    for i in range(60):
        kind = "abcdef"[i % 6]
        text = prose(dice, known, 25)
        rows.append((i, f"http://one.org/{i}", f"<body><div class={kind}><p>Words of layout {kind}</p></div><div class={kind}{kind}><p>{text}</p></div></body>"))
        want[i] = text
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows).repartition(3)).collect()}
    assert got == want


def test_a_host_of_two_pages_has_two_references(pages):
    rows = [(2 * k + i, f"http://h{k}.org/{i}", f"<body><p>At the top of the site</p><div><p>text {k} and {i} only, and some more words of page {i}</p></div></body>") for k in range(12) for i in (0, 1)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages(rows)).collect()}
    assert got == {2 * k + i: f"text {k} and {i} only, and some more words of page {i}" for k in range(12) for i in (0, 1)}


def test_copies_of_an_article_are_no_template(pages):
    text = "<body><div><p>{}</p><p>the same words in every copy of this text</p></div></body>"
    rows = [(i, f"http://one.org/{i}", text.format("an article that was copied " * 3)) for i in range(8)]
    got = {r["text"] for r in wrappers.extract(pages(rows)).collect()}
    assert got == {"an article that was copied an article that was copied an article that was copied\nthe same words in every copy of this text"}


def test_simple_tree_matching_pairs_the_most_nodes():
    a = wrappers.Page("<div><p>a</p><ul><li>1</li><li>2</li></ul><p>z</p></div>")
    b = wrappers.Page("<div><p>new</p><p>a</p><ul><li>1</li><li>3</li></ul><p>y</p></div>")
    assert [(x.text, y.text) for x, y in sorted(wrappers.Matching(a, b).pairs, key=lambda p: p[0].text)] == [
        ("1", "1"),
        ("2", "3"),
        ("a", "a"),
        ("z", "y"),
    ]


def test_wide_lists_are_paired_like_others(monkeypatch):
    dice = random.Random(5)
    cell = lambda: "".join(f"<td>{dice.choice('abcde')}</td>" for _ in range(dice.choice([1, 3, 3])))
    kinds = [lambda: f"<li>{dice.choice('abcd')}</li>", lambda: f"<tr>{cell()}</tr>", lambda: dice.choice("xyz") + "<hr>", lambda: "<div><p>a</p>b</div>"]
    pages = ["<ul>" + "".join(dice.choice(kinds)() for _ in range(dice.randint(0, 60))) + "</ul>" for _ in range(24)]

    def pairs():
        out = []
        for a, b in zip(pages[::2], pages[1::2], strict=True):
            one, two = wrappers.Page(a), wrappers.Page(b)
            place = {id(t): (k, i) for k, p in enumerate((one, two)) for i, t in enumerate(p.texts)}
            out.append(sorted((place[id(x)], place[id(y)]) for x, y in wrappers.Matching(one, two).pairs))
        return out

    wanted = pairs()
    monkeypatch.setattr(wrappers, "WIDEST", 0)
    for alike in (1, 4, 1000):
        monkeypatch.setattr(wrappers, "ALIKE", alike)
        assert pairs() == wanted
