from collections import Counter
from urllib.parse import urlsplit

import pytest

from reqsight.llm import common, exact_dedup, url_filter
from tests.llm.brute import sha
from tests.llm.conftest import by_key, edge_rows


def brute_groups(rows, digest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, sha(t or "")))
    return by_key(out)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_exact_groups(edge, broadcast_rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(common, "HEAVY_KEYS", 1)
    want = brute_groups([r[:2] for r in edge_rows()])
    got = exact_dedup.exact_groups(edge, digest_all=True).collect()
    assert by_key(tuple(r) for r in got) == want
    lazy = exact_dedup.exact_groups(edge).collect()
    assert by_key(tuple(r)[:4] for r in lazy) == [w[:4] for w in want]
    assert {r.text_sha256 for r in lazy if r.group_size > 1} <= {w[4] for w in want}
    # texts alone by length or prefix are never hashed in full
    assert all(r.text_sha256 is None for r in lazy if r.doc_id in (9, 36 + 6))


def test_drop_duplicates_keeps_one_row_per_text(edge):
    got = exact_dedup.drop_duplicates(edge)
    assert got.columns == edge.columns
    rows = [tuple(r) for r in got.collect()]
    assert Counter(r[1] or "" for r in rows) == Counter({(t or ""): 1 for t in {r[1] or "" for r in edge_rows()}})
    best = {}
    for r in edge_rows():
        if r[0] is not None:
            best[r[1] or ""] = max(r[0], best.get(r[1] or "", -1))
    assert all(r[0] == best.get(r[1] or "") for r in rows)


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing, digest_all=True).count() == 0
    assert exact_dedup.drop_duplicates(nothing).count() == 0


URLS = [None, "", "no scheme", "http://", "http://Net/", "http://a.NET", "https://x.example.net/en/1?q=/de/", "http://example.net/en",
        "http://example.net/EN/", "http://www.example.com/de/x#y", "http://example.com/den", "http://notexample.com/de/", "ftp://org/fr/",
        "http://a.b.c.org/fr/x://y", "x http://q.net/?a#b", "http://u\n.net/\n", "http://.net/", "http://net./", "http://" + "a." * 5000 + "net/" + "b/" * 20000,
        "http://same.net/a", "http://same.net/a"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, "http://q.org/fr/", "h", "p")],
                                  "page_id bigint, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = by_key((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == by_key([(i, *brute_url(u)) for i, u in enumerate(URLS)] + [(None, *brute_url("http://q.org/fr/"))])
    assert urlsplit(URLS[6]).path == "/en/1"
    none = url_filter.judge_urls(pages, spark.createDataFrame([], rules.schema)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == len(got)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_rule_paths_need_no_slash_and_conflicts_block(spark):
    pages = spark.createDataFrame([(1, "http://a.x/english"), (2, "http://a.x/other")], "page_id bigint, url string")
    rules = spark.createDataFrame([("A.x", "/en", "allow"), ("a.x", "/en", "block"), ("x", "", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: ("a.x/en", "block"), 2: ("x", "allow")}
