"""WARC derivatives, token rollups, HTML extraction and the pipeline."""

import collections
import gzip
import random

import pytest
from pyspark.sql import functions as F

from canonflow.llm import html_extract, queries, token_rollup, warc
from canonflow.llm.html_tree import read_page
from canonflow.llm.state import new_folder

from . import test_texts
from .conftest import HARD, prose


# WARC


def test_warc(spark, tmp_path):
    html = "<html><head><title> A &amp; B </title><script>x</script></head><body><p>One<p>Two <a href='/u'>é</a></body></html>"
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nServer: s\r\n\r\n" + html.encode("latin-1")
    rows = [("<r1>", "http://x/", "2024", content), ("<r2>", None, None, None), (None, "u", "d", b"no http"), ("<r1>", "http://x/", "2024", content)]
    found = warc.build_derivatives(spark.createDataFrame([(*r, "x") for r in rows], warc.RESPONSE + ", type string"))
    out = sorted(found.collect(), key=lambda r: (r.refers_to or "", r.type))
    assert len(out) == 8 and {(r.refers_to, r.type) for r in out} == {(i, t) for i in ("<r1>", "<r2>", None) for t in ("metadata", "conversion")}
    text = next(r for r in out if r.refers_to == "<r1>" and r.type == "conversion")
    about = next(r for r in out if r.refers_to == "<r1>" and r.type == "metadata")
    assert bytes(text.content).decode() == "One\nTwo é" and text.block_digest == warc.digest("One\nTwo é".encode()) and text.payload_digest == about.payload_digest == warc.digest(html.encode("latin-1"))
    for line in ("source-status: HTTP/1.1 200 OK", "source-server: s", "title: A & B", "outlink: /u"):
        assert line in bytes(about.content).decode()
    assert len({r.record_id for r in out}) == 6
    for compress in (True, False):
        path = tmp_path / f"{compress}.warc"
        path.write_bytes(b"".join(warc.record_bytes(r.asDict(), compress) for r in out))
        again = warc.read_warc(spark, str(path)).collect()
        assert collections.Counter(map(str, again)) == collections.Counter(map(str, out))
    assert warc.build_derivatives(spark.createDataFrame([], warc.RESPONSE)).collect() == []


def test_source_headers(spark, tmp_path):
    heads = [("Date", "Mon, 01 Jan 2024 00:00:00 GMT"), ("Content-Type", "text/html; charset=utf-8"), ("Link", "</a>; rel=next"), ("Set-Cookie", "a=1"), ("X-Robots-Tag", "noindex,\r\n nofollow"), ("Set-Cookie", "b=2"), ("X-Empty", ""), ("Location", "http://x/é"), ("Link", "</b>; rel=prev")]
    content = ("HTTP/1.1 301 Moved\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n<p>x").encode("latin-1")
    path = tmp_path / "a.warc"
    path.write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-IP-Address: 10.0.0.1\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(content), content))
    want = [f"source-{k.lower()}: {v}".replace("\r\n", "") for k, v in heads]
    warcs = ["source-warc-type: response", "source-warc-record-id: <r>", "source-warc-ip-address: 10.0.0.1", "source-warc-concurrent-to: <a>", "source-warc-concurrent-to: <b>", "source-warc-content-type: application/http", f"source-warc-content-length: {len(content)}"]
    for own in (False, True):
        found = warc.build_derivatives(warc.read_warc(spark, str(path), warc_headers=own)).where("type = 'metadata'").collect()
        lines = bytes(found[0].content).decode().split("\r\n")
        assert lines[0] == "source-status: HTTP/1.1 301 Moved" and lines[1 : 1 + len(want)] == want
        assert lines[1 + len(want) :][: len(warcs)] == warcs if own else not any(x.startswith("source-warc") for x in lines)


def derived(content, **more):
    out = {r[1]: r for r in warc.derive("<r>", "u", "d", content, **more)}
    return bytes(out["conversion"][-1]).decode() if "conversion" in out else None, bytes(out["metadata"][-1]).decode(), out


def test_hostile_responses():
    page = "<title>T</title><p>Caf\u00e9</p>"
    head = lambda *h: ("HTTP/1.1 200 OK\r\n" + "".join(x + "\r\n" for x in h) + "\r\n").encode()
    for odd in ("undefined", "idna", "rot13", "hex", "no-such", "punycode;", ""):
        assert derived(head(f"Content-Type: text/html; charset={odd}") + page.encode())[0] is not None
    assert derived(head("Content-Type: text/html; Charset=ISO-8859-1") + page.encode("latin-1"))[0] == "Caf\u00e9"
    assert derived(head("Content-Type: text/html") + ('<meta charset="windows-1252">' + page).encode("cp1252"))[0] == "Caf\u00e9"
    assert derived(head() + b"\xff\xfe" + page.encode("utf-16-le"))[0] == "Caf\u00e9"
    # bare line feeds, chunks and codings
    text, about, _ = derived(b"HTTP/1.1 200 OK\nServer: s\nContent-Type: text/html\n\n" + page.encode())
    assert text == "Caf\u00e9" and "source-status: HTTP/1.1 200 OK\r\nsource-server: s\r\n" in about
    body = page.encode() * 50
    chunks = b"".join(b"%x;x=y\r\n%s\r\n" % (len(body[k : k + 100]), body[k : k + 100]) for k in range(0, len(body), 100)) + b"0\r\n\r\n"
    text, _, out = derived(head("Transfer-Encoding: chunked") + chunks)
    assert text == "\n".join(["Caf\u00e9"] * 50) and out["metadata"][7] == warc.digest(body)
    import zlib

    import zstandard

    raw = zlib.compressobj(wbits=-15)
    packed = {"gzip": gzip.compress(body), "x-gzip": body, "deflate": zlib.compress(body), "Deflate": raw.compress(body) + raw.flush(), "identity": body, "zstd": zstandard.compress(body)}
    for coding, data in packed.items():
        assert derived(head(f"Content-Encoding: {coding}") + data)[0] == text
    assert derived(head("Content-Encoding: deflate, gzip") + gzip.compress(zlib.compress(body)))[0] == text
    assert text.startswith(derived(head("Content-Encoding: gzip") + gzip.compress(body)[:-30])[0][:20])
    assert derived(head("Content-Encoding: br") + b"\x01\x02")[0] is None
    # types
    assert derived(head("Content-Type: image/png") + b"\x89PNG\r\n\0")[0] is None and "source-content-type: image/png" in derived(head("Content-Type: image/png") + b"x")[1]
    assert derived(head("Content-Type: text/plain") + b"a <b> c\n d")[0] == "a <b> c\n d" and derived(head("Content-Type: application/ld+json") + b"{}")[0] == "{}"
    assert derived(b"\x89PNG\0\0")[0] is None and derived(b"")[0] == "" and derived(None)[0] == ""
    stated = derived(head() + body, payload_digest="sha256:abc")[2]
    assert stated["conversion"][7] == stated["metadata"][7] == "sha256:abc"


def test_damaged_files():
    record = lambda n: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % n
    bad = b"WARC/1.1\r\nWARC-Record-ID: <x>\r\nContent-Length: many\r\n\r\nabc\r\n\r\n"
    ids = lambda data: [r["record_id"] for r in warc.parse_records(data)]
    assert ids(record(1) + bad + record(2)) == ["<1>", "<2>"] and ids(record(1) + record(2)[:-6]) == ["<1>"]
    packed = gzip.compress(record(1)) + gzip.compress(record(2))
    assert ids(packed[:-20]) == ["<1>"] and ids(packed + b"junk")[:2] == ["<1>", "<2>"]
    out = warc.record_bytes({"type": "metadata", "record_id": "<m>", "date": "d", "refers_to": "<r>", "target_uri": "u", "block_digest": None, "payload_digest": None, "content_type": None, "content": b""}, False)
    assert b"WARC-Refers-To: <r>\r\nWARC-Refers-To-Target-URI: u\r\nWARC-Refers-To-Date: d\r\n" in out


def test_derivatives_by_force(spark, sf_dir):
    """Every record of the query against one made another way."""
    import base64
    import hashlib
    import re
    import uuid
    import zlib
    from html import unescape

    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    spaced = lambda x: " ".join(unescape(x).split())
    want = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        h = hashlib.md5(f"{r.page_id}:{r.url}".encode()).hexdigest()
        source = f"<urn:uuid:{uuid.UUID(h)}>"
        payload = (r.html or "").encode()
        shown = re.sub(r"<!--.*?-->|<(script|style|title)>.*?</\1>", "", r.html or "", flags=re.DOTALL)
        blocks = re.split(r"</?(?!b>|i>|a>|a |br>|em>|strong>)[a-z][^>]*>", re.sub(r"<br>", " ", shown))
        text = "\n".join(t for b in blocks if (t := spaced(re.sub(r"<[^>]*>", "", b))))
        title = re.search(r"<title>(.*?)</title>", r.html or "", re.DOTALL)
        links = re.findall(r'<a href="([^"]*)"', shown)
        about = [("source-status", "HTTP/1.1 200 OK"), ("source-content-type", "text/html; charset=utf-8"), ("source-payload-digest", sha(payload)), ("source-length", len(payload)), ("title", spaced(title[1]) if title else ""), ("text-digest", sha(text.encode())), *[("outlink", unescape(x)) for x in links]]
        for kind, form, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about if v != "")), ("conversion", "text/plain; charset=utf-8", text)):
            block = block.encode()
            want.append((f"<urn:uuid:{uuid.uuid5(warc.SPACE, f'{kind}:{source}')}>", kind, source, r.url, queries.CRAWL_DATE, form, sha(block), sha(payload), len(block), zlib.crc32(block)))
    assert sorted(map(tuple, queries.op1_warc_derivatives(spark, sf_dir).collect())) == sorted(want)


# token rollups


def change(op, source, n, old=None, version="v1", old_version=None):
    return (op, source, "en", version, n, old_version, old)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_records_in_a_file():
    body = b"WARC/1.0 is a word of this body\r\n\r\n" * 3
    plain = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: a:\r\n  b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    empty = b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\n\r\n\r\n"
    for data in (plain + empty + plain, gzip.compress(plain) + gzip.compress(empty) + gzip.compress(plain)):
        found = list(warc.parse_records(data))
        assert [(r["type"], r["target_uri"], r["content"]) for r in found] == [("resource", "a: b", body), ("metadata", None, b""), ("resource", "a: b", body)]
    assert list(warc.parse_records(b"")) == []


def test_rollup(spark):
    path = new_folder(spark, "rollup")
    rollup = token_rollup.TokenRollup(spark, path)
    frame = lambda rows: spark.createDataFrame([(*r, "extra") for r in rows], token_rollup.CHANGES + ", n_docs string")
    assert totals(rollup) == {}
    first = frame([change("insert", "a", 5), change("insert", "a", 7), change("insert", None, None), change("insert", "b", 3)])
    assert rollup.apply("1", first) and not rollup.apply("1", first)
    assert totals(rollup) == {("a", "en", "v1"): (2, 12), (None, "en", "v1"): (1, 0), ("b", "en", "v1"): (1, 3)}
    assert rollup.apply("2", frame([change("delete", "b", 3), change("revise", "a", 9, 5, "v2", "v1"), change("revise", "a", 8, 7)]))
    assert rollup.apply("empty", frame([]))
    assert totals(token_rollup.TokenRollup(spark, path)) == {("a", "en", "v1"): (1, 8), ("a", "en", "v2"): (1, 9), (None, "en", "v1"): (1, 0)}
    token_rollup.deltas(first).write.parquet(f"{path}/deltas/3-lost")  # a writer that died before its marker
    assert totals(rollup)[("a", "en", "v1")] == (1, 8)
    with pytest.raises(Exception, match="unknown operation"):
        rollup.apply("4", frame([change("upsert", "a", 1)]))
    with pytest.raises(ValueError):
        rollup.apply("../x", first)


def test_rollup_markers(spark):
    """A commit is whole or not at all, and snapshots count what they hold once."""
    path = new_folder(spark, "rollup")
    rollup = token_rollup.TokenRollup(spark, path)
    frame = lambda *rows: spark.createDataFrame(list(rows), token_rollup.CHANGES)
    assert not rollup.compact()
    rollup.fs.create(rollup._path("commits/1.json")).close()  # of a writer that died
    assert rollup.committed() == [] and rollup.totals().collect() == []
    assert rollup.apply("1", frame(change("insert", "a", 5))) and rollup.committed() == ["1"]
    assert not rollup._mark("commits/1.json", {"batch": "1", "folder": "elsewhere"}) and totals(rollup) == {("a", "en", "v1"): (1, 5)}
    want = 1
    for k in range(2, 6):
        assert rollup.compact() and not rollup.compact()
        assert rollup.apply(str(k), frame(change("insert", "a", 5))) and not rollup.apply("1", frame(change("insert", "a", 5)))
        want += 1
        assert totals(token_rollup.TokenRollup(spark, path)) == {("a", "en", "v1"): (want, 5 * want)}
    held = [s.getPath().getName() for s in rollup.fs.listStatus(rollup._path("deltas"))]
    assert sorted(x.split("-")[0] for x in held) == ["4", "5"]  # the last snapshot's and what came after
    rollup._mark(f"snapshots/{rollup.snapshot()['number'] + 1}.json", rollup.snapshot() | {"number": rollup.snapshot()["number"] + 1})
    assert rollup.compact() and totals(rollup) == {("a", "en", "v1"): (5, 25)}


def test_rollup_by_force(spark):
    rng = random.Random(3)
    rollup, want = token_rollup.TokenRollup(spark, new_folder(spark, "rollup")), collections.defaultdict(lambda: [0, 0])
    live = []
    for batch in range(3):
        rows = []
        for _ in range(60):
            if live and rng.random() < 0.5:
                s, v, n = live.pop(rng.randrange(len(live)))
                want[s, "en", v][0] -= 1
                want[s, "en", v][1] -= n
                if rng.random() < 0.5:
                    rows.append(change("delete", s, n, version=v))
                    continue
                m, u = rng.randrange(9), rng.choice(["v1", "v2"])
                rows.append(change("revise", s, m, n, u, v))
            else:
                s, m, u = rng.choice("ab"), rng.randrange(9), "v1"
                rows.append(change("insert", s, m))
            live.append((s, u, m))
            want[s, "en", u][0] += 1
            want[s, "en", u][1] += m
        rollup.apply(str(batch), spark.createDataFrame(rows, token_rollup.CHANGES))
        if batch == 1:
            rollup.compact()
    assert totals(rollup) == {k: tuple(v) for k, v in want.items() if any(v)}


def test_token_counts_by_force(spark, sf_dir):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoding = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want, seen = collections.defaultdict(lambda: [0, 0]), set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            want[r.source, r.lang, "byte_bpe"][0] += 1
            want[r.source, r.lang, "byte_bpe"][1] += len(encoding.encode_ordinary(r.text))
    found = queries.op3_token_counts(spark, sf_dir).collect()
    assert {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in found} == dict(want)


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy, buy, buy this, now, at once.</div>
<div id="cookie-notice"><p>We use cookies, and more cookies, to make, well, cookies.</p></div>
<article><header>Site header</header><h1>The   Title</h1><p><b>First, para&shy;graph &amp; more.<br>Same block.<p>Second &lt;p&gt;, with <i>in</i>line &eacute;.</p>
<aside>Side, bar, text, here.</aside><ul><li>One<li>Two</ul><form><p>Name, please</p></form><div class="comments"><p>A reader, who says, many, things.</p></div><p>Last.</article>
<footer>&copy; me, you, us</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The Title\nFirst, para­graph & more. Same block.\nSecond <p>, with inline é.\nOne\nTwo\nLast."
    body = "<body><div class=menu><a href=x>a</a></div><div class='post-body'><p>One, two, three, four.</p><p>Five, six.</p></div><div class=sidebar><p>No, no, no, no, no, no.</p></div></body>"
    assert html_extract.main_text(body) == "One, two, three, four.\nFive, six."
    assert html_extract.main_text("<article><h1>H</h1><p>x</p></article>") == "H\nx"
    assert html_extract.main_text("<article><p>cut &am") == "cut &am"
    assert html_extract.main_text("plain text, no tags at all") == "plain text, no tags at all"
    for empty in (None, "", "<nav>x</nav>", "<script>x", "<!-- x", "<a href='"):
        assert html_extract.main_text(empty) == ""
    assert html_extract.main_text("<article>" + "<p>a, b</p>" * 5000 + "</article>").count("\n") == 4999
    assert html_extract.main_text("<div>" * 3000 + "<p>deep</p>") == "deep"


TEXT, JUNK = "A sentence, with commas, of the article.", "Out, out, out, this, is, no, part, of, the, article, at, all, whatever, its, length."
SHAPES = {
    f'<div id="content"><section><p>{TEXT}</p><p>{TEXT}</p></section><section><h2>H</h2><p>Short.</p></section></div><div class="footer">{JUNK}</div>': [TEXT, TEXT, "H", "Short."],
    f"<article><header><h1>T</h1><p>{JUNK}</p></header><p>{TEXT}</p><footer>{JUNK}</footer></article>": ["T", TEXT],
    f'<main><article><p>{TEXT}</p></article><article class="comment"><p>{JUNK * 5}</p></article></main>': [TEXT],
    f'<div class="layout has-sidebar"><div class="content-area"><h1>T</h1><p>{TEXT}</p></div><div class="sidebar"><p>{JUNK}</p></div></div>': ["T", TEXT],
    f'<article><p>{TEXT}</p><div class="sponsored-content"><p>{JUNK}</p></div><div class="footer-content">{JUNK}</div><label>{JUNK}</label><p>Short.</p></article>': [TEXT, "Short."],
    f"<div><div><h1>T</h1><p>{TEXT}</p></div><div><ul><li><a href=a>{JUNK}</a></li></ul></div></div>": ["T", TEXT],
    f"<div><div><div><p>{TEXT}</p></div></div><div><div><p>{TEXT}</p></div></div><div><p>Short.</p></div></div>": [TEXT, TEXT, "Short."],
    f"<main><article><h2>A</h2><p>{TEXT}</p></article><article><h2>B</h2><p>Short, and, more.</p></article></main>": ["A", TEXT, "B", "Short, and, more."],
}


def test_page_shapes():
    for html, blocks in SHAPES.items():
        assert html_extract.main_text(html).split("\n") == blocks


#: What stays: sections and headings whose ids speak of something else, tags that never end, odd quotes and comments, formulas.
STAYS = {
    f'<article><h2 id="related-work">Related work</h2><p>{TEXT}</p><section id="discussion"><h2 id="side-effects">Effects</h2><p id="comment-on-method">{TEXT}</p></section></article>': ["Related work", TEXT, "Effects", TEXT],
    f"<article><p title=it's>Hello don't stop</p><p>{TEXT}</p></article>": ["Hello don't stop", TEXT],
    f"<article><p>one<!--> two</p><p>{TEXT}<!---> end</p></article>": ["one two", f"{TEXT} end"],
    f"<article><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p></article>": [f"{TEXT} x=2."],
    f"<article><video src=a><p>{TEXT}</p><object data=b><p>Short.</p></article>": [TEXT, "Short."],
    f'<article><p>{TEXT} <span class="ad">Buy <span>now</span>!</span>And on.</p><ins class="adsbygoogle">{JUNK}</ins><p><a class=skip-link href=x>Top</a> <span class="ad">unclosed<p>{TEXT}</p></article>': [f"{TEXT} And on.", "Top", TEXT],
    f'<div class="post"><div class="entry-header"><h1>T</h1></div><div class="entry-content"><p>{TEXT}</p><pre><span class="comment"># of code</span></pre></div></div>': ["T", TEXT, "# of code"],
    f'<article><p class="notice">{JUNK}</p><p>{TEXT}</p><div id="cookie-notice">{JUNK}</div><section id="comments"><p>{JUNK}</p></section><p id="ads">Of adverts.</p></article>': [TEXT, "Of adverts."],
    f'<article><p>a < b and 1<2, a<b>c</b></p><p a"b\'c=d>{TEXT}</p><p><a href="x>unclosed quote</a></p></article>'.replace('href="x', "href='x"): ["a < b and 1<2, ac", TEXT, "unclosed quote"],
    f"<article><p>{TEXT}</p><![CDATA[x]]><?php echo 1 ?></><p>End.</p></article>": [TEXT, "End."],
}


def test_what_stays():
    for html, blocks in STAYS.items():
        assert html_extract.main_text(html).split("\n") == blocks


def test_hostile_pages():
    """Markup that never ends, or nests without end, takes time in proportion to its length."""
    import time

    n = 1 << 20
    for part in ("<p ", "<", "<a href='", '<p a="', "<!--", "<svg>", "<svg ", "</svg", "<script", "<title>", "<div>x", "<p><b>", "</section>", "<li>x<ul>", "<td><table>", "&#", "<![CDATA[", "<span class=ad>", "<center>", "<p>a, b<div>"):
        start = time.perf_counter()
        html_extract.main_text("<article><p>a, b</p>" + part * (n // len(part)))
        assert time.perf_counter() - start < 10, part


def test_pages_by_force(spark, sf_dir):
    """The pages of the tables are a heading and paragraphs in an article; read another way."""
    import re
    from html import unescape

    found = {r.page_id: r for r in queries.op5_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", article)))
        want = "\n".join(t for p in parts if (t := " ".join(unescape(p).split())))
        assert (found[r.page_id].text, found[r.page_id].n_chars) == (want, len(want))


def test_extract_table(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", "", "z")]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")).collect()
    assert [bool(r.main_text) for r in out] == [True, False, False] and out[0].page_id == 1
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, html string")).collect() == []
    assert read_page("<title>x</title>a").title == "x"


# pipeline


def test_pipeline_by_force(spark, tmp_path):
    import corpus_pipeline

    item = prose(70, 40)
    clean = [prose(k, 60) for k in range(20)]
    near = prose(0, 60).replace("alpha", "alpha,", 1)
    texts = [*HARD[:5], *clean, clean[3], near, prose(300, 30) + " " + item, prose(301, 80) + ' token = "0123456789abcdef0123456789abcdef".', prose(302, 40) + "\nAll rights reserved.", "a b c d e f g h " * 9]
    rows = [(k, t, "en", "s", len(t or ""), "more") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, secrets string").drop("secrets").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    state = {k: t for k, t in enumerate(texts)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == before.columns
        got = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        ids = sorted(state)
        if name == "quality rules":
            want = {k: t.replace("\nAll rights reserved.", "") for k, t in state.items() if k >= 5 and k != len(texts) - 1}
        elif name == "n-gram Jaccard join":
            found = test_texts.components_by_force([state[k] for k in ids])
            want = {k: state[k] for i, k in enumerate(ids) if found[i][1] == i}
            assert len(want) == len(state) - 2
        elif name == "benchmark decontamination":
            found = test_texts.contamination_by_force([state[k] for k in ids], [(1, item)])
            want = {k: state[k] for i, k in enumerate(ids) if not found[i][4]}
            assert len(want) == len(state) - 1
        else:
            want = {k: t if "token" not in t else t[: t.index("token")] + '[SECRET]".' for k, t in state.items()}
        assert got == want
        state = want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(state) and sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_pipeline_takes_nulls(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    odd = docs.withColumns({"doc_id": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "text": F.when(F.col("doc_id") % 3 != 0, F.col("text")), "lang": F.lit(None).cast("string"), "kept": F.lit("clash")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.keep(stage(spark, odd, sf_dir), "t")
        assert odd.columns == [*docs.columns, "kept"]
