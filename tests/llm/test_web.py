import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopstar.llm import queries, queries_sql, urlfilter, warc
from tests.llm.conftest import SF

PAGES = "page_id long, url string, html string, host string, rule string, content string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def rules(spark, rows=queries.URL_RULES):
    return spark.createDataFrame(rows, "host string, path string, decision string")


def judge(spark, rows, **kw):
    out = urlfilter.judge(pages(spark, rows), rules(spark), **kw).collect()
    return {r["page_id"]: (r["rule"], r["verdict"]) for r in out}


def plain(url):
    """Host, path, rule and the rule's verdict in plain Python."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, d) for h, p, d in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_op10_rules_match_plain_python(llm):
    urls = {r["page_id"]: r["url"] for r in llm.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_url_filter(llm, SF).collect():
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_blocks_reach_aliases_and_allow_takes_precedence(llm):
    canonical = '<html><link rel="canonical" href="{}"></html>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    got = judge(llm, [
        (1, "http://a.example.org/x", canonical.format("http://news.net/es/1")),        # alias of a blocked url that is no page
        (2, "http://b.example.org/y", refresh.format("http://a.example.org/x#frag")),   # over two edges
        (3, "https://www.example.com/en/1", canonical.format("http://news.net/es/1")),  # allow rule of its own
        (4, "http://c.example.org/", canonical.format("http://d.example.org/")),        # no block in its component
        (5, "http://e.example.org/p", canonical.format("/q")),                          # relative link
        (6, "http://e.example.org/q", refresh.format("//news.net/es/1")),
        (7, "http://news.net/es/1?x", None), (8, None, canonical.format("http://news.net/es/1")), (9, "no scheme", ""), (9, "no scheme", "")])
    assert [got[i][1] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["block", "block", "allow", "allow", "block", "block", "block", "allow", "allow"]
    assert got[3][0] == "www.example.com/en/" and got[1][0] is None


def test_relative_links_and_all_tags(llm):
    base = "http://h.org/a/b/c.html?x=1"
    for link, want in (("next.html", "http://h.org/a/b/next.html"), ("../d", "http://h.org/a/d"), ("./", "http://h.org/a/b/"), ("..", "http://h.org/a/"),
                       ("../../../up", "http://h.org/up"), ("?p=1", "http://h.org/a/b/c.html?p=1"), ("s/../t?q=a/../b", "http://h.org/a/b/t?q=a/../b"),
                       ("/x/./y/../z", "http://h.org/x/z"), ("//g.org/v", "http://g.org/v"), ("https://g.org/v", "https://g.org/v"),
                       ("mailto:a@h.org", None), ("#top", None)):
        got = llm.createDataFrame([(link, base)], "l string, u string").select(urlfilter._resolve(F.col("l"), F.col("u"))).first()[0]
        assert got == want, link
    bare = llm.createDataFrame([("n.html", "http://h.org")], "l string, u string").select(urlfilter._resolve(F.col("l"), F.col("u"))).first()[0]
    assert bare == "http://h.org/n.html"
    canonical = '<link rel="canonical" href="{}">'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [(1, "http://news.net/es/old", refresh.format("../new.html")),  # a block by rule reaches its target
            (2, "http://news.net/new.html", ""),
            (3, "http://other.org/a", canonical.format("http://other.org/b") + canonical.format("http://news.net/es/1")),  # the second tag
            (4, "http://other.org/q", refresh.format("c") + refresh.format("http://news.net/es/2")),
            (5, "http://other.org/c", ""), (6, "http://other.org/d", canonical.format("mailto:x@news.net"))]
    verdicts = {k: v[1] for k, v in judge(llm, rows).items()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


TAGGED = [
    ("data-href", '<link data-href="http://u.org/" rel="canonical" href="http://n.net/es/1">', "block"),
    ("rel words", '<LINK REL="Alternate  CANONICAL" href=http://n.net/es/2>', "block"),
    ("other rel", '<link rel="xcanonical" href="http://n.net/es/2">', "allow"),
    ("quoted >", '<link title="a>b" rel=canonical href=\'http://n.net/es/3\'/>', "block"),
    ("numeric", '<link rel="canonical" href="http&#58;//n.net/es&#x2F;q?a=1&#38;b=2&amp;c">', "block"),
    ("base", '<base target="_top"><base href="http://n.net/es/"><base href="http://other.org/"><link rel=canonical href="x.html">', "block"),
    ("relative base", '<base href="//n.net/es/z/"><meta http-equiv="refresh" content="5; url=../x">', "block"),
    ("comment", '<!-- <link rel="canonical" href="http://n.net/es/1"> --><p>canonical</p>', "allow"),
    ("open comment", '<!-- <link rel="canonical" href="http://n.net/es/1">', "allow"),
    ("script", '<script>var a = \'<link rel="canonical" href="http://n.net/es/1">\';</script >', "allow"),
    ("refresh forms", '<meta content=\'0;URL="http://n.net/es/5"\' http-equiv=" Refresh ">', "block"),
    ("refresh bare", '<meta http-equiv=refresh content="3, http://n.net/es/6">', "block"),
    ("refresh only", '<meta http-equiv=refresh content="3">', "allow"),
    ("not refresh", '<meta http-equiv="content-type" content="0;url=http://n.net/es/6">', "allow"),
    ("linked", '<linked rel="canonical" href="http://n.net/es/1">', "allow"),
    ("no value", '<link rel canonical href="http://n.net/es/1">', "allow"),
    ("first wins", '<link rel=canonical href="http://a.org/" href="http://n.net/es/1">', "allow"),
    ("bad reference", '<link rel=canonical href="http://n.net/es/&#xD800;&#9999999;&#x41">', "block"),
    ("dots", '<base href="http://n.net/es/"><link rel=canonical href="../fr2/./7"><link rel=canonical href="../../..">', "allow"),
    ("long", "<p>" + "x " * 50_000 + '<link rel="canonical" href="http://n.net/es/8">' + "<link " + 'a="1" ' * 5000 + ">", "block"),
    ("empty", "", "allow"),
]


def test_tags_by_attributes_and_the_oracle_on_them(llm):
    rows = [(i, f"http://t{i}.org/d/p.html", html) for i, (_, html, _) in enumerate(TAGGED)] + [(99, None, None), (100, "http://n.net/es/7", "")]
    got = {r.page_id: r for r in urlfilter.judge(pages(llm, rows), rules(llm)).collect()}
    for i, (name, _, verdict) in enumerate(TAGGED):
        assert got[i].verdict == verdict, name
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    cursor = con.execute(queries.oracle_sql()["op10_url_filter"])
    names = [d[0] for d in cursor.description]
    assert {r[names.index("page_id")]: {c: v for c, v in zip(names, r)} for r in cursor.fetchall()} == {
        i: {c: r[c] for c in names} for i, r in got.items()}


def test_redirect_table_and_long_chains(llm):
    rows = [(i, f"http://h{i}.example.org/p", None) for i in range(40)]
    chain = [(f"http://h{i}.example.org/p", f"http://h{i + 1}.example.org/p") for i in range(39)] + [("http://h39.example.org/p", "http://z.net/fr/"), (None, "x")]
    got = judge(llm, rows, redirects=llm.createDataFrame(chain, "from_url string, to_url string"))
    assert {v for _, v in got.values()} == {"block"}


@pytest.mark.parametrize("limit", [10_000, 1])
def test_rules_join_either_way(llm, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "RULES_LIMIT", limit)
    urls = ["http://EXAMPLE.com/en/", "ftp://x.www.example.com/en/a?b", "http://example.com/en", "http://xnet/es/", "https://net/es/#q", "http://com", "http://com/",
            "http://a.b.net/fr/x://y", "://com/", "http:///en/"]
    got = judge(llm, list(zip(range(len(urls)), urls, [None] * len(urls))))
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert got[i] == (rule, verdict or "allow"), u


def test_url_filter_empty(llm):
    assert urlfilter.judge(pages(llm, []), rules(llm)).count() == 0
    assert judge(llm, [(None, "http://a.net/es/", None)]) == {None: ("net/es/", "block")}


HTML = ('<html lang="de"><head><title>A &amp;\n B</title><style>p{}</style></head><body><!-- no --><script>var a="<p>";</script>'
        '<h1>Kopf</h1><p>eins&nbsp;zwei<br>drei &lt;4&gt;</p><a href="/x">link</a></body></html>')


def test_warc_derivatives_link_to_their_response(llm):
    source = warc.responses(pages(llm, [(1, "http://a/", HTML), (2, None, None), (None, "http://b/", ""), (1, "http://a/", HTML)]))
    responses = source.collect()
    out = warc.derive(source).collect()
    assert len(out) == 8 and source.count() == 4
    first = [r for r in out if r["target_uri"] == "http://a/"]
    by = {r["record_type"]: r for r in first}
    assert by["conversion"]["content"] == "Kopf\neins zwei\ndrei <4>\nlink"
    meta = dict(line.split(": ", 1) for line in by["metadata"]["content"].strip().split("\r\n"))
    assert meta["title"] == "A &amp; B" and meta["language"] == "de" and meta["outlinks"] == "1" and meta["source-http-status"] == "200"
    payload = next(r for r in responses if r["target_uri"] == "http://a/")
    assert {r["refers_to"] for r in first} == {payload["record_id"]} and {r["source_digest"] for r in first} == {payload["payload_digest"]}
    assert meta["source-payload-digest"] == payload["payload_digest"]
    assert len({r["record_id"] for r in first}) == 2 and {r["content_length"] for r in first} == {len(r["content"].encode()) for r in first}
    empty = [r for r in out if r["page_id"] == 2 and r["record_type"] == "conversion"][0]
    assert empty["content"] == "" and empty["target_uri"] is None
    assert warc.derive(warc.responses(pages(llm, []))).count() == 0


REFERENCES = ["&#65;&#x42;&#X63; &#38;lt; &amp;#65; &#8364;&#x1F600; a&#160;b", "&#0; &#xD800; &#9999999; &#; &#x; &#12", None, "", "no reference", "&#39;&#39;"]


def test_conversions_decode_references_as_the_oracle_does(llm):
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(REFERENCES)]
    out = warc.derive(warc.responses(pages(llm, rows)))
    text = {r["page_id"]: r["content"] for r in out.where("record_type = 'conversion'").collect()}
    assert text[0] == "ABc &lt; &#65; \u20ac\U0001f600 a b" and text[1] == REFERENCES[1] and text[2] == text[3] == "" and text[5] == "''"
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    names = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries_sql.SQL['op6_warc_derivatives']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.select(*names).collect())


def test_metadata_keeps_every_header_line(llm):
    source = warc.responses(pages(llm, [(1, "http://a/", "<p>x")]))
    head = "HTTP/1.1 301 Moved\r\nServer: s: 1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2;\r\n  folded\r\nno colon\r\n: no name\r\n"
    content = warc.derive(source.withColumn("http_head", F.lit(head))).where("record_type = 'metadata'").first()["content"]
    want = ["source-http-status: 301", "source-server: s: 1", "source-set-cookie: a=1", "source-set-cookie: b=2;", "  folded",
            "source-header-line: no colon", "source-header-line: : no name"]
    assert content.split("\r\n")[:7] == want
    plain = warc.derive(source.withColumn("http_head", F.lit("HTTP/1.1 200 OK\r\n"))).where("record_type = 'metadata'").first()["content"]
    assert plain.startswith("source-http-status: 200\r\nsource-payload-digest: ")


def test_warc_files_round_trip(llm, scratch_dir):
    records = queries.op6_warc_derivatives(llm, SF)
    warc.write_warc(records, f"{scratch_dir}/out", records_per_file=100)
    back = warc.read_warc(llm, f"{scratch_dir}/out/*.gz")
    cols = [*warc.HEADERS, "content"]
    want = records.select(cols)
    assert back.count() == want.count() and back.exceptAll(want).count() == 0
    sums = back.select((F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)) == F.col("block_digest")).alias("ok"))
    assert sums.where("not ok").count() == 0


def test_every_page_has_both_records(llm):
    out = queries.op6_warc_derivatives(llm, SF)
    n = llm.read.parquet(f"{SF}/pages.parquet").count()
    assert {(r["record_type"], r["count"]) for r in out.groupBy("record_type").count().collect()} == {("metadata", n), ("conversion", n)}
    assert out.where("content like '%<p>%' and record_type = 'conversion'").count() == 0
