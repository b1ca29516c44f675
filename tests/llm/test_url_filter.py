import random
import re

import pytest

from siltstone.llm import url_filter
from siltstone.llm.url_filter import canonical_key, rule_prefix
from pyspark.sql import functions as F

RULE = "rule_id long, pattern string, action string"


def key(url: str | None) -> str | None:
    """The canonical key, written on its own."""
    if url is None:
        return None
    url = url.translate({9: None, 10: None, 13: None}).strip(" ")
    bare = re.sub(r"#.*$", "", re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "", url), flags=re.S)
    plain = lambda x: re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if re.fullmatch(r"[A-Za-z0-9._~-]", chr(int(m[1], 16))) else m[0].upper(), x)
    host, rest = map(plain, re.match(r"([^/?]*)(.*)$", bare, re.S).groups())
    host = re.sub(r"^www\.", "", re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", host)).lower()))
    path, mark, query = (rest if rest.startswith("/") else "/" + rest).partition("?")
    done, parts = [], path.split("/")[1:]
    for i, x in enumerate(parts):
        if x == "..":
            done[-1:] = []
        elif x != ".":
            done.append(x)
        if x in (".", "..") and i == len(parts) - 1:
            done.append("")
    query = re.sub(r"([?&])utm_[^=&]*=[^&]*", r"\1", mark + query)
    query = re.sub(r"[?&]+$", "", re.sub(r"\?&", "?", re.sub(r"&+", "&", query)))
    return ",".join(reversed(host.split("."))) + ",)/" + "/".join(done) + query if host else None


def brute(url: str | None, rules: list[tuple]) -> tuple:
    k = key(url)
    best = None
    for rule_id, pattern, action in rules:
        p = key(pattern)
        if p is None or rule_id is None or action is None:
            continue
        p = p if "/" in pattern else p.split(")")[0]
        if k is not None and k.startswith(p) and (best is None or (len(p), rule_id) > best[:2]):
            best = (len(p), rule_id, action)
    return k, *(best[1:] if best else (None, "none"))


def pages(spark, urls, slices=4):
    return spark.createDataFrame(spark.sparkContext.parallelize([(i, u, "x", 1) for i, u in enumerate(urls)], slices), "page_id long, url string, key string, pid int")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    hosts = ["example.com", "a.example.com", "b.a.example.com", "example.org", "xexample.com", "com", "shop.example.org"]
    paths = ["", "/", "/a", "/a/b", "/a/bc", "/a/b?x=1&utm_source=q", "?q", "/%F0", "/é", "/a#frag", "/x/../a/b", "/%61/%62", "/a/./b", "/a/..", "/../..", "/a/b/%2e%2E", "/a\n/b", "/%zz%", "/a%2fb", "/?..", "//a"]
    url = lambda: rng.choice(["http://", "https://WWW.", "", "ftp://me:pw@"]) + rng.choice(hosts) + rng.choice(["", ":80", "."]) + rng.choice(paths) + str(rng.choice(["", "1", "zz"]))
    urls = [url() for _ in range(1500)]
    rules = [(i, rng.choice(hosts) + rng.choice(["", "/", "/a", "/a/b", "/a/b1", "/é"]), rng.choice(["block", "allow"])) for i in range(40)]
    found = {r.page_id: (r.key, r.rule_id, r.action) for r in url_filter.filter_urls(pages(spark, urls), spark.createDataFrame(rules, RULE)).collect()}
    assert found == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_keys_and_prefixes(spark):
    row = spark.range(1).select(canonical_key(F.lit("https://www.Shop.example.com:443/a?utm_source=x")).alias("k"), rule_prefix(F.lit("example.com")).alias("host"), rule_prefix(F.lit("example.com/a")).alias("path")).first()
    assert tuple(row) == ("com,example,shop,)/a", "com,example,", "com,example,)/a")


@pytest.mark.parametrize(
    "url,wanted",
    [
        ("http://example.com/en/a\nb", "com,example,)/en/ab"),
        ("http://example.com/x/../en/1", "com,example,)/en/1"),
        ("http://example.com/%65n/1", "com,example,)/en/1"),
        ("http://example.com/en/\u2028#x\u2028y", "com,example,)/en/\u2028"),
        ("//example.com/en/", "com,example,)/en/"),
        ("http://ex%61mple.com", "com,example,)/"),
        ("https://Bücher.example.com/", "com,example,xn--bcher-kva,)/"),
        ("https://xn--bcher-kva.example.com", "com,example,xn--bcher-kva,)/"),
        ("http://example.com/a/b/../../../c/.", "com,example,)/c/"),
    ],
)
def test_ways_round_a_rule(spark, url, wanted):
    assert spark.createDataFrame([(url,)], "url string").select(canonical_key(F.col("url"))).first()[0] == wanted


def test_production_rules_nest_on_the_whole_table(spark):
    from oracle import SF_DIR

    found = url_filter.op3_url_filter(spark, SF_DIR.replace("sf0.001", "sf0.01")).collect()
    assert len({r.rule_id for r in found}) >= 10 and {r.action for r in found} == {"none", "block", "allow", "review"}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url").collect()}
    assert all((r.key, r.rule_id, r.action) == brute(urls[r.page_id], url_filter.RULES) for r in found)


def test_ids_that_are_no_numbers_are_refused(spark):
    p = spark.createDataFrame([("x", "example.com")], "page_id string, url string")
    with pytest.raises(TypeError, match="page_id"):
        url_filter.filter_urls(p, spark.createDataFrame([(1, "example.com", "block")], RULE))


def test_edges(spark):
    urls = [None, "", "   ", "/only/a/path", "http://", "example.com", "example.com", "EXAMPLE.com/" + "x" * 50_000]
    rules = [(1, "example.com", "block"), (2, "www.example.com", "allow"), (3, None, "block"), (None, "example.com/x", "block"), (4, "", "block"), (5, "example.com/x", None)]
    rules_df = spark.createDataFrame(rules, RULE)
    p = pages(spark, urls).union(pages(spark, ["example.com"]).selectExpr("cast(null as long)", "url", "key", "pid"))
    found = url_filter.filter_urls(p, rules_df).collect()
    assert len(found) == len(urls) + 1
    assert all((r.key, r.rule_id, r.action) == ((None, None, "none") if r.page_id is not None and r.page_id < 5 else (r.key, 2, "allow")) for r in found)
    assert url_filter.filter_urls(p.limit(0), rules_df).collect() == []
    assert {r.action for r in url_filter.filter_urls(p, rules_df.limit(0)).collect()} == {"none"}


def test_one_hot_host_is_split_over_ranges(spark):
    urls = [f"hot.example.com/{i % 7}" for i in range(3000)]
    rules = [(1, "hot.example.com", "block"), (2, "hot.example.com/3", "allow")]
    found = url_filter.filter_urls(pages(spark, urls), spark.createDataFrame(rules, RULE)).collect()
    assert all(r.action == ("allow" if r.page_id % 7 == 3 else "block") for r in found) and len(found) == 3000
