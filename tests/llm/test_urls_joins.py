"""The URL filter gives the same rows whichever of its joins are broadcast, beside columns of clashing names."""

import re

import pytest

from quarryline.llm import urls

RULES = [("com", "/", "allow", True), ("example.com", "/en/", "block", True), ("spam.org", "", "block", False), ("bad.net", "/a/b", "block", False), ("x.example.com", "/en/a", "allow", True)]
URLS = ["https://example.com/en/", "http://x.example.com/en/a?q=1", "http://y.x.Example.com/en/b#f", "ftp://spam.org", "http://notspam.org/", "http://a.spam.org/" + "p/" * 20_000, None, "", "no scheme", "://", "http://com", "http://com/", "https://example.com/en/", "http://me@spam.org:80/", "http://spam.org./x", "http://spam.org:80@other.org/", "http://bad.net/.//a/./b", "http://bad.net/a/b", "http://bad.net/a./b"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :].split("#")[0].split("?")[0]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    host = host.lower()
    bare = re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", host.rpartition("@")[2]))
    forms = {True: (host, path), False: (bare, re.sub(r"/(\.?/)+", "/", path))}
    on = lambda h, p, own, at: (own == h or own.endswith("." + h)) and at.startswith(p)
    fits = [(named, len(h + p), h + p, v) for h, p, v, named in RULES if on(h, p, *forms[named])]
    named, _, key, verdict = max(fits, default=(False, 0, None, "allow"))
    return host, path, key if named else None, verdict


@pytest.mark.parametrize("filter_bytes, list_rows, hit_bytes", [(1 << 20, 100, 1 << 20), (1 << 20, 0, 1 << 20), (0, 0, 0), (1 << 20, 100, 0)])
def test_every_join(spark, filter_bytes, list_rows, hit_bytes):
    pages = spark.createDataFrame([(k, u, "mine", "other", 7, "own") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string, verdict int, best string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string, named boolean")
    got = urls.judge(pages, rules, filter_bytes=filter_bytes, list_rows=list_rows, hit_bytes=hit_bytes)
    assert got.columns == ["page_id", "url", "best", "host", "path", "rule", "verdict"]
    rows = sorted(got.select("page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r) for r in rows] == [(k, *plain(u)) for k, u in enumerate(URLS)]


def test_long_lists_shuffle_possible_hits_alone(spark):
    """The filter stays a broadcast where the list is too long for one."""
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string, named boolean")
    plan = _written_plan(spark, lambda: urls.judge(pages, rules, list_rows=0))
    assert "BroadcastHashJoin [_block" in plan and "SortMergeJoin [named" in plan and "SortMergeJoin [_block" not in plan


def test_one_url_in_most_rows_is_dealt(spark):
    """Beyond the broadcast, rows of one url, and rows without one, meet their verdict in 16 tasks and not in one."""
    pages = spark.range(4000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'http://spam.org/' ELSE concat('http://h', id, '.com/') END AS url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string, named boolean")
    got = urls.judge(pages, rules, hit_bytes=0)
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["url"] is None, r["verdict"]): r["count"] for r in got.where("page_id % 3 < 2").groupBy("url", "verdict").count().collect()} == {(True, "allow"): 1334, (False, "block"): 1333}


def _written_plan(spark, call):
    """The plan of the table of hits, which the operator writes."""
    seen, write = [], urls.materialise

    def keep(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    urls.materialise = keep
    try:
        call()
    finally:
        urls.materialise = write
    return seen[0]
