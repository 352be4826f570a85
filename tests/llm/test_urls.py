import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from hushwin.llm import urls
from hushwin.llm.queries import ORACLE, op3_host_reputation
from hushwin.llm.suffixes import suffix_and_domain
from tests.conftest import SF001
from tests.llm.cases import rows


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com/en/", "https://a.example.com/en/x",
        "https://a.www.example.com/en/x", "http://badexample.com/en/x", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/1#y", "http://com/", "http://com",
        "http://x.org?u=http://y.com/", "http://x.org#a", "http://ÄX.org/ü", "http://a.com:80/x", "http://a\nb.com/x\ny?z", "a://b://c.com/", "http://x.net/de/1"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://q.org/", None, None)] * 2, "page_id long, url string, host string, n string")
    outcomes = spark.createDataFrame([(21, 1), (1, None), (None, 1)], "page_id long, bad int")
    got = rows(urls.judge(pages, outcomes))
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is None:
            continue
        assert (r["host"], r["path"]) == parse(URLS[r["page_id"]])
        rule, verdict = ruled(r["host"], r["path"])
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict)
        assert r["verdict"] in ("allow", "block")
    assert rows(urls.judge(pages.limit(0), outcomes)) == []
    assert {r["verdict"] for r in rows(urls.judge(pages, outcomes.limit(0))) if r["rule"] is None} == {"allow"}


def test_a_bad_host_is_blocked_and_others_are_shrunk(spark):
    pages, out = [], []
    for h, bad, n in (("spam.org", 60, 60), ("fine.org", 2, 60), ("small.org", 1, 1), ("other.org", 0, 40)):
        for i in range(n):
            pages.append((len(pages), f"http://{h}/{i}"))
            out.append((len(out), int(i < bad)))
    judged = rows(urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(out, "page_id long, bad int")))
    by = {r["host"]: (r["verdict"], r["bad_rate"]) for r in judged}
    assert by["spam.org"][0] == "block" and {by[h][0] for h in ("fine.org", "small.org", "other.org")} == {"allow"}
    assert 0 < by["other.org"][1] < by["fine.org"][1] < by["small.org"][1] < 1


def test_query(spark):
    assert op3_host_reputation(spark, SF001).count() == spark.read.parquet(f"{SF001}/pages.parquet").count()


def test_registered_domains():
    for host, suffix, domain in (
            ("www.example.com", "com", "example.com"), ("com", "com", "com"), ("", "", ""), ("localhost", "localhost", "localhost"), ("a.b.unlisted", "unlisted", "b.unlisted"),
            ("news.bbc.co.uk", "co.uk", "bbc.co.uk"), ("x.com.au", "com.au", "x.com.au"), ("z.y.github.io", "github.io", "y.github.io"), ("co.uk", "co.uk", "co.uk"),
            ("a.b.c.ck", "c.ck", "b.c.ck"), ("a.www.ck", "ck", "www.ck"), ("a.city.kobe.jp", "kobe.jp", "city.kobe.jp"), ("c.b.a.kobe.jp", "a.kobe.jp", "b.a.kobe.jp"),
            ("a.b.公司.cn", "公司.cn", "b.公司.cn"), ("a.b.xn--55qx5d.cn", "xn--55qx5d.cn", "b.xn--55qx5d.cn"),
            ("www.x.co.uk:8080", "co.uk", "x.co.uk"), ("me:pw@a.x.co.uk.", "co.uk", "x.co.uk"), ("host:8080", "host", "host"), ("x.com:", "com", "x.com"),
            ("10.0.0.1", "[ip]", "10.0.0.1"), ("10.0.0.1:80", "[ip]", "10.0.0.1"), ("[::1]:80", "[ip]", "[::1]"), ("[::1]", "[ip]", "[::1]")):
        assert suffix_and_domain(host) == (suffix, domain), host


def test_a_new_host_inherits_its_own_registrant(spark):
    pages, out = [], []
    for host, bad, n in (("a.spam.co.uk", 60, 60), ("b.spam.co.uk:8080", 60, 60), ("www.fine.co.uk", 0, 60), ("10.0.0.1", 40, 40), ("10.9.0.1", 0, 40)):
        for i in range(n):
            pages.append((len(pages), f"http://{host}/{i}"))
            out.append((len(out), int(i < bad)))
    pages += [(-1, "http://new.spam.co.uk/"), (-2, "http://new.fine.co.uk/"), (-3, "http://10.0.0.1:81/"), (-4, "http://new.other.co.uk/")]
    judged = rows(urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(out, "page_id long, bad int")))
    assert len(judged) == len(pages)
    rate = {r["page_id"]: r["bad_rate"] for r in judged}
    assert rate[-1] > 0.7 and rate[-2] < 0.3 and rate[-3] > 0.7 and rate[-2] < rate[-4] < rate[-1]
    assert {r["host"] for r in judged if r["page_id"] in (-3, 60)} == {"10.0.0.1:81", "b.spam.co.uk:8080"}


def test_sql_takes_suffixes_by_the_list(spark):
    """The query's SQL over hosts with listed suffixes, ports, users and addresses."""
    hosts = ["www.a.co.uk", "b.a.co.uk:8080", "c.co.uk", "x.github.io", "y.x.github.io", "a.b.c.ck", "a.www.ck", "c.b.a.kobe.jp", "a.city.kobe.jp", "a.b.公司.cn",
             "a.b.xn--55qx5d.cn", "me:pw@a.co.uk.", "10.0.0.1", "10.0.0.1:80", "[::1]:80", "localhost", "co.uk", "x.y.unlisted", "0x1f", "", "a.com:", "h:http"]
    pages, labels = [], []
    for k, host in enumerate(hosts):
        for i in range(7 + k % 3):
            pages.append((len(pages), f"http://{host}/{i}"))
            labels.append((len(labels), int((i * (k % 4)) % 3 > 0), int(i % 5 == 1)))
    pages += [(len(pages), None), (len(pages) + 1, "no scheme")]
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p for p, _ in pages], "url": [u for _, u in pages]}))
    con.register("labels", pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}))
    want = con.execute(ORACLE["op3_host_reputation"]).fetchall()
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), outcomes).drop("bad_rate").collect()
    assert len({r.verdict for r in got}) == 2
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
