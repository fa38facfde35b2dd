import base64
import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paracorpus.llm import arc_to_warc as A
from paracorpus.llm import host_reputation as H
from paracorpus.llm.tool_calls import call_levels, canonical_json, link_tool_calls


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (1, "http://a b.org/x\n", "<p>é</p>"), (2, "http://a/", None), (3, None, ""), (4, "http://b/", "<p>é</p>"), (5, "http://c/", "\r\n\r\nURL 1 2 3 4\nWARC/1.0\r\n\r\n"),
    (7, "http://d/%20", "<p>é</p>"), (7, "http://d/%20", "<p>é</p>"), (9, "", "x" * 100_000), (None, "http://n/", "only null"), (None, "http://n/", "<p>é</p>"),
]


def test_pages_through_arc_and_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("row", F.lit("x"))
    records = A.read_arc(A.write_arc(pages, "page_id", "url", "html"))
    assert Counter(r.uri for r in records.collect()) == Counter(u or "" for _, u, _ in PAGES)
    path = f"file://{tmp_path}/warc"
    A.write_warc(A.to_warc(records), path)
    twice = A.convert(A.write_arc(pages, "page_id", "url", "html"))
    assert Counter(r.record for r in twice.collect()) == Counter(r.record for r in A.to_warc(records).collect())
    found = Counter(map(tuple, A.describe_records(A.read_warc(spark, path)).collect()))
    want, first = Counter(), {}
    for i, _, html in PAGES:
        body = (html or "").encode()
        if i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, html in PAGES:
        body = (html or "").encode()
        revisit = i is not None and i > first[body]
        want[i, len(body), digest(body), "revisit" if revisit else "response", first[body] if revisit else None] += 1
    assert found == want


def test_the_smallest_page_occurs_more_than_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "w", "x"), (4, "v", "x"), (5, "v", "x"), (5, "v", "x")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    A.write_warc(A.convert(A.write_arc(pages, "page_id", "url", "html")), path)
    found = A.describe_records(A.read_warc(spark, path)).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == [(1, "response", None)] * 3 + [(4, "revisit", 1)] + [(5, "revisit", 1)] * 2


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    A.write_warc(A.to_warc(A.read_arc(A.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html"))), path)
    assert A.describe_records(A.read_warc(spark, path)).count() == 0


def test_arc_is_cut_by_declared_lengths():
    blocks = [b"HTTP/1.0 200 OK\r\n\r\nhttp://x 1 2 text/html 5\n", b"\n\n", b""]
    for version in (1, 2):
        content = A.arc_archive("f.arc", version, [("http://x", "1.2.3.4", "20010203040506", "text/html", b) for b in blocks])
        found = list(A.arc_records(content))
        assert [r["block"] for r in found] == blocks and found[0]["Archive-date"] == "20010203040506"
        with pytest.raises(ValueError):
            list(A.arc_records(content.replace(b"text/html 2\n", b"text/html 99\n").replace(b" 2\n\n\n", b" 99\n\n\n")))
    assert list(A.arc_records(b"")) == []


def test_warc_of_dates_and_small_payloads(spark):
    rows = [("u", "1.1.1.1", "2001020304", "text/html", b"HTTP/1.0 200 OK\r\nX-Row: 5\r\n\r\n", 2, "D", b"ab"), ("u", "1.1.1.1", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nX-Row: 6\r\n\r\n", 2, "D", b"ab")]
    records = spark.createDataFrame(rows, A.RECORDS)
    texts = "".join(r.record for r in A.to_warc(records).collect())
    assert "1970-01-01T00:00:00Z" in texts and "2001-02-03T04:05:06Z" in texts and "WARC-Type: revisit" in texts
    assert "revisit" not in "".join(r.record for r in A.to_warc(records, least_bytes=3).collect())


def test_warc_files_compressed_or_not():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for content in (one * 2, gzip.compress(one * 2), gzip.compress(one) * 2):
        assert [b for _, b in A.warc_records(content)] == [b"abc"] * 2


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"), ("http://example.net/de/", "example.net", "/de/", "net/"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/"), ("x://net", "net", "", None), ("http://net?a=/", "net", "", None),
    ("http://a.org/fr/x", "a.org", "/fr/x", "org/fr/"), ("http://forg/fr/", "forg", "/fr/", None), ("http://É.com#/de/", "É.com", "", None),
    (None, "", "", None), ("no scheme", "", "", None), ("http:///de/", "", "/de/", None), ("a://b://c/d", "b:", "//c/d", None),
])
def test_urls_and_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    (r,) = H.judge_urls(pages, spark.createDataFrame([], "page_id long, good int"), RULES).collect()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    if rule:
        assert r.verdict == {h + p: v for h, p, v in RULES}[rule]


def test_posteriors_shrink_towards_the_domain(spark):
    hosts = [("a.good.com", 200, 190), ("b.good.com", 200, 180), ("new.good.com", 0, 0), ("a.bad.com", 200, 20), ("b.bad.com", 200, 30), ("new.bad.com", 0, 0), ("one.bad.com", 1, 1), ("", 0, 0)]
    found = {r.host: r for r in H.host_posteriors(spark.createDataFrame(hosts, "host string, n long, good long")).collect()}
    assert len(found) == len(hosts)
    assert found["new.good.com"].posterior_mean > 0.7 > 0.4 > found["new.bad.com"].posterior_mean
    assert found["new.bad.com"].posterior_mean < found["one.bad.com"].posterior_mean < 1
    assert all(r.posterior_low <= r.posterior_mean for r in found.values())
    assert found["a.good.com"].posterior_low > 0.85 > found["new.good.com"].posterior_low


def test_judged_pages_keep_every_row(spark):
    pages = [(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://a.com/"), (2, None)]
    outcomes = [(1, 1), (2, None), (9, 0)]
    found = H.judge_urls(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("x")), spark.createDataFrame(outcomes, "page_id long, good int"), []).collect()
    assert len(found) == 4 and {r.host: r.labelled_pages for r in found} == {"a.com": 2, "": 0}
    assert H.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, good int"), RULES).count() == 0


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, parent_id string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False), "c": ("array", False)}, "g": {}}


def test_levels_of_chains_and_cycles(spark):
    chain = [(1, f"c{i}", i, "g", "{}", f"c{i - 1}" if i else None) for i in range(70)]
    cycle = [(2, "x", 0, "g", "{}", "y"), (2, "y", 1, "g", "{}", "x"), (2, "z", 2, "g", "{}", "y"), (2, "own", 3, "g", "{}", "own"), (2, "gone", 4, "g", "{}", "nowhere"), (3, "c5", 0, "g", "{}", "c4")]
    found = {(r.conv_id, r.call_id): r.level for r in call_levels(spark.createDataFrame(chain + cycle, CALLS)).collect()}
    assert [found[1, f"c{i}"] for i in range(70)] == list(range(70))
    assert [found[2, x] for x in ("x", "y", "z", "own", "gone")] == [None, None, None, None, 0] and found[3, "c5"] == 0


@pytest.mark.parametrize("arguments,name,errors", [
    ('{"a": 1}', "f", ""), ('{"b": 2}', "f", "kind:b,missing:a"), ('{"a": 1.5, "z": null}', "f", "kind:a,unknown:z"), ("[1]", "f", "not_object"),
    ("{", "f", "bad_json"), (None, "f", "bad_json"), ('{"a":1,"a":2}', "f", "bad_json"), ("{}", "h", "unknown_tool"), ("{}", None, "unknown_tool"), ("{}", "g", ""), ('{"a": 3, "c": [1, {"x": 2}]}', "f", ""),
])
def test_arguments(spark, arguments, name, errors):
    calls = spark.createDataFrame([(1, "i", 0, name, arguments, None)], CALLS)
    (r,) = link_tool_calls(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert (r.errors, r.status) == (errors, "invalid" if errors else "unanswered")


def test_linking_of_all_cases(spark):
    calls = [(1, "a", 0, "g", "{}", None), (1, "a", 5, "g", "{}", None), (1, "b", 2, "g", "{}", "a"), (1, None, 3, "g", "{}", None), (None, "a", 3, "g", "{}", None), (1, "late", 9, "g", "{}", "b")]
    results = [(1, "a", 1, "é\n\"x\""), (1, "a", 4, "again"), (1, "late", 8, None), (1, "nobody", 7, "?"), (2, "a", 1, "other"), (1, None, 1, "n")]
    found = link_tool_calls(spark.createDataFrame(calls, CALLS).withColumn("level", F.lit(9)), spark.createDataFrame(results, RESULTS).withColumn("name", F.lit("x")), SCHEMAS).collect()
    states = Counter((r.conv_id, r.call_id, r.status, r.level) for r in found)
    assert states == Counter([
        (1, "a", "ok", 0), (1, "a", "ok", 0), (1, "a", "duplicate", None), (1, "b", "unanswered", 1), (1, None, "unanswered", None), (None, "a", "unanswered", None),
        (1, "late", "early", 2), (1, "nobody", "orphan", None), (2, "a", "orphan", None), (1, None, "orphan", None),
    ])
    assert '{"arguments":{},"call_id":"a","name":"g","result":"é\\n\\"x\\""}' in {r.record for r in found}
    assert link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_canonical_json(spark):
    texts = [('{ "b" : [1, {"d": 2, "c": null}], "a": "x" }', '{"a":"x","b":[1,{"c":null,"d":2}]}'), ("nonsense", None), (None, None)]
    for text, want in texts:
        assert spark.createDataFrame([(text,)], "t string").select(canonical_json(F.col("t"))).first()[0] == want


def test_repeated_pages_count_each_row_once(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x"), (2, "http://a.b/y"), (3, "http://c.d/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (1, 1), (3, 1), (3, 0), (2, None)], "page_id long, good int")
    found = H.judge_urls(pages, outcomes, []).collect()
    assert sorted((r.page_id, r.labelled_pages, r.good_pages) for r in found) == [(1, 2, 2), (1, 2, 2), (2, 2, 2), (3, 1, 0)]
