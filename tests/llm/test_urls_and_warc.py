"""URL filter and WARC archives."""

import hashlib
import zlib
from base64 import b32encode
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
import pytest

from tidemark.llm import url_filter, warc
from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import Rule, filter_urls
from tidemark.llm.workspace import Workspace

PAGES = "page_id long, url string, html string, rule int"


def judged(spark, rows, rules=URL_RULES):
    return {r["page_id"]: r for r in filter_urls(spark.createDataFrame([(*r, 1) for r in rows], PAGES), rules).collect()}


def test_hosts_paths_and_longest_rules(spark):
    urls = [
        "HTTP://A.Example.NET/en/1?x#y", "https://example.net/x", "https://net", "https://badnet/x", "https://b.example.com/de/", "https://example.com/fr/", "https://x.org/fr/a#b",
        "https://x.org/FR/a", "no scheme", None, "https://example.net:80/x", "https://h?q/en/", "a://b://c/d",
    ]
    got = judged(spark, [(k, u, None) for k, u in enumerate(urls)])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(got.items())] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/x", "net/", "block"), ("net", "", None, "allow"), ("badnet", "/x", None, "allow"),
        ("b.example.com", "/de/", "example.com/de/", "block"), ("example.com", "/fr/", None, "allow"), ("x.org", "/fr/a", "org/fr/", "allow"),
        ("x.org", "/FR/a", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.net:80", "/x", None, "allow"), ("h", "", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]


def test_aliases_inherit_blocks_unless_one_is_allowed(spark):
    canonical = "<head><LINK href='{}' rel=\"canonical\"></head>".format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "https://a.test/1", canonical("https://bad.net/x")),
        (2, "https://b.test/2#top", refresh("https://a.test/1")),
        (3, "https://c.test/3", refresh("https://bad2.net/?a=1&amp;b=2")),
        (4, "https://d.test/4", canonical("https://c.test/3") + refresh("https://ok.org/fr/1")),
        (5, "https://e.test/5", canonical("/6")),
        (6, "https://e.test/6", None),
        (7, "https://f.test/a/b", canonical("c")),
        (8, "https://f.test/a/c", canonical("https://bad.net/y")),
        (9, "https://b.test/2", ""),
        (10, "https://bad.net/x", canonical("https://ok.org/fr/1")),
        (11, "https://g.test/", '<link rel="stylesheet" href="https://bad.net/z">'),
    ]
    got = judged(spark, [*rows, rows[0]])
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "block", 11: "allow"}
    without = judged(spark, [r for r in rows if r[0] not in (4, 10)])
    assert {k for k, r in without.items() if r["verdict"] == "block"} == {1, 2, 3, 7, 8, 9}
    assert without[1]["alias_group"] == without[9]["alias_group"] and without[11]["alias_group"] is None
    assert judged(spark, []) == {}


def test_many_rules(spark):
    rules = [Rule("block", f"h{k}.test", f"/{k}/") for k in range(3000)] + [Rule("allow", "h5.test", "/5/ok/")]
    got = judged(spark, [(1, "https://x.h5.test/5/a", None), (2, "https://h5.test/5/ok/a", None), (3, "https://h5.test/6/", None)], rules)
    assert [got[k]["verdict"] for k in (1, 2, 3)] == ["block", "allow", "allow"]


PAYLOADS = [(5, "https://x/1", "same"), (2, "https://x/2", "same"), (9, None, "same"), (3, "https://x/é \r\nX: y", "ünï\r\n\r\nWARC/1.1"), (4, "u", ""), (7, "u", None), (8, "u", "z" * 300_000), (None, "u", "same"), (2, "https://x/2", "same")]


@pytest.mark.parametrize("least", [0, 4, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAYLOADS], "page_id long, url string, html string, payload_bytes int").repartition(3)
    first = {}
    for i, _, text in PAYLOADS:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    wanted = []
    for i, _, text in PAYLOADS:
        data = (text or "").encode()
        revisit = len(data) >= least and first[text or ""] != i
        wanted.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[text or ""] if revisit else None))
    got = [tuple(r) for r in warc.warc_round_trip(pages, least).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_normalised_members_stand_alone(spark):
    pages = spark.createDataFrame([(k, f"https://x/{k}", f"page {k} " * 50) for k in range(40)], "page_id long, url string, html string").repartition(2)
    ws = Workspace(spark, "t")
    raw = warc.write_monolithic(pages, ws)
    for r in raw.collect():
        stream = zlib.decompressobj(31)
        stream.decompress(open(r["file"].removeprefix("file://"), "rb").read())
        assert stream.eof and not stream.unused_data
    for r in warc.normalise(raw, ws).collect():
        path = r["file"].removeprefix("file://")
        index = pa.ipc.open_file(f"{path}.cdx").read_all().to_pylist()
        data = open(path, "rb").read()
        assert len(index) == r["n_records"] and sum(e["length"] for e in index) == len(data)
        for e in index:
            whole = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31)
            assert whole.startswith(b"WARC/1.1") and e["record_id"].encode() in whole
        assert b"".join(warc.inflate([data])) == b"".join(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index)


def test_a_cut_archive_is_an_error():
    whole = warc.record(1, "u", b"x", None, False)
    assert [w for _, w in warc.split_records([whole[:9], whole[9:], whole])] == [whole, whole]
    with pytest.raises(ValueError):
        list(warc.split_records([whole[:-9]]))


def test_no_pages(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_targets_are_resolved_as_urljoin_does(spark):
    bases = ["http://b.com", "http://b.com/", "http://b.com/p", "https://b.com/p/q", "http://b.com/p/q/", "http://b.com/i?a=1", "http://b.com/i/j?x=/y/../z", "http://b.com:80/a/b/c"]
    targets = ["x", "./x", "../x", "../../x", "../../../x", "x/../y", "/x", "/x/./y/../z", "/..", "..", ".", "./", "../", "?a=2", "x?b=../c", "//o.org/k", "http://o.org/k/l", "#f", "x#f", "/x?q#f", "a/b/", "..x", "x..", "mailto:a@b", ""]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "base string, target string").select("base", "target", url_filter.absolute("target", "base").alias("url")).collect()
    assert [(r.base, r.target, r.url) for r in got] == [(b, t, urldefrag(urljoin(b, t)).url) for b, t in rows]


def test_blocks_reach_aliases_by_relative_links(spark):
    page = lambda target: f'<link rel="canonical" href="{target}">'
    pages = [(1, "http://m.org/p/q", page("../x")), (2, "http://m.org/x", page("//bad.net/k")), (3, "http://c.com/i?a=1", page("?a=2")), (4, "http://c.com/i?a=2", '<meta http-equiv="refresh" content="0; url=http://bad.net/z">'), (5, "http://c.com/?a=2", None)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), [url_filter.Rule("block", "net", "/")])
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_case_of_scheme_and_host_makes_no_other_url(spark):
    pages = [
        (1, "http://www.b.org/fr", '<link rel="canonical" href="HTTP://A.Net/x#top">'),
        (2, "http://www.b.org/y", '<link rel="canonical" href="HTTPS://Me:Pw@C.example/Q?R=S">'),
        (3, "http://a.net/x", None),
        (4, "https://Me:Pw@c.example/Q?R=S", '<link rel="canonical" href="http://bad.net/">'),
        (5, "HTTP://WWW.b.ORG/y", ""),
        (6, "http://www.b.org/Y", ""),
    ]
    rows = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), [Rule("block", "net", "/")]).collect()}
    assert {k: r["verdict"] for k, r in rows.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}
    assert rows[1]["alias_group"] == rows[3]["alias_group"] == "http://a.net/x"
    assert rows[2]["alias_group"] == rows[4]["alias_group"] == rows[5]["alias_group"] == "http://bad.net/" and rows[6]["alias_group"] is None
