"""URL filters as a sort-merge range join of canonical keys with rule intervals.

A URL's canonical key is its host with the labels reversed, each followed by a comma, then ")" and the path:
https://www.Shop.example.com:443/b/../%61?utm_source=x -> "com,example,shop,)/a". A rule on a host covers the host and
its subdomains, a rule on a host and path the paths that begin so; either is a prefix of keys, that is the
interval from the prefix up to its successor. Prefix intervals nest or are disjoint. Keys and rules are
range-partitioned alike; a rule goes to each range that its interval meets. In each partition a sorted
sweep keeps the stack of rules that are active; the top one, the most specific, decides for a whole stretch of URLs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._scratch import Scratch, doc_id, partitions

#: Families of spam hosts, and the suffixes that each is found under.
FAMILIES = ("cheap-pills", "casino-win", "free-bets", "ads-track", "adult", "adult-x", "spam-farm")
SUFFIXES = ("example.com", "example.net", "example.org")
#: (pattern, action) beside them: what is let through of a blocked host, what is blocked again in that, paths of all hosts of a suffix.
NESTED = [
    *((f"{f}.{s}/en", "allow") for f in ("spam-farm", "ads-track") for s in SUFFIXES),
    *((f"{f}.{s}/en/{d}", "block") for f in ("spam-farm", "ads-track") for s in SUFFIXES for d in (1, 7)),
    *((f"m.{f}.{s}", "allow") for f in ("free-bets", "casino-win") for s in SUFFIXES),
    *((f"m.{f}.{s}/{x}/", "block") for f in ("free-bets", "casino-win") for s in SUFFIXES for x in ("de", "es")),
    *((f"blog.{s}", "review") for s in SUFFIXES),
    *((f"{s}/fr/", "block") for s in SUFFIXES),
    ("example.net", "review"), ("example.net/es/", "block"), ("org", "review"),
]
#: (rule_id, pattern, action): the production list. A pattern is a host, or a host and the beginning of a path.
RULES = [(i, p, a) for i, (p, a) in enumerate([*((f"{f}.{s}", "block") for f in FAMILIES for s in SUFFIXES), *NESTED], 1)]

#: Keys sampled for each range when range bounds are chosen.
SAMPLES_PER_RANGE = 40


def _decoded(x: Column) -> Column:
    """Percent-encoded letters, digits, "-", ".", "_" and "~" as they are; other codes in capitals."""

    def piece(p: Column, i: Column) -> Column:
        char = F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int"))
        rest = F.substring(p, F.lit(3), F.length(p))
        known = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), known).otherwise(F.concat(F.lit("%"), p))

    return F.when(x.contains("%"), F.array_join(F.transform(F.split(x, "%"), piece), "")).otherwise(x)


def _without_dots(path: Column) -> Column:
    """A path that begins with "/" without its "." and ".." segments."""
    segments = F.split(path, "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x))
    walked = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.lit(""), step)
    open_ = path.rlike(r"/\.\.?$") | (walked == "")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.when(open_, F.concat(walked, F.lit("/"))).otherwise(walked)).otherwise(path)


def canonical_key(url: Column) -> Column:
    """The key of a URL; null where there is no host.

    Line breaks, tabs, scheme, user, port, a leading www., fragment and utm_ parameters go; codes of plain characters are decoded, dot segments of the
    path resolved, the host lower-cased, and in its ASCII form if it has other characters.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(url, r"[\t\r\n]", "")), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", ""), r"(?s)#.*$", "")
    host = _decoded(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")
    host = F.when(host.rlike(r"[^\x00-\x7f]"), F.coalesce(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)), host)).otherwise(host)
    rest = _decoded(F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1))
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    path, query = F.regexp_extract(rest, r"(?s)^([^?]*)", 1), F.regexp_extract(rest, r"(?s)^[^?]*(.*)$", 1)
    query = F.regexp_replace(query, r"([?&])utm_[^=&]*=[^&]*", "$1")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, r"&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",)"), _without_dots(path), query)
    return F.when(host != "", key)


def rule_prefix(pattern: Column) -> Column:
    """The prefix of keys that a pattern covers."""
    key = canonical_key(pattern)
    return F.when(F.regexp_replace(pattern, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "").contains("/"), key).otherwise(F.regexp_extract(key, r"^([^)]*)", 1))


def _place(bounds: list[bytes]):
    """The number of bounds at or below each key, by one binary search over a whole batch."""
    edges = np.array([*bounds, None], object)[:-1]

    def of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(edges, np.array([*(x.encode() for x in k), None], object)[:-1], "right").astype(np.int32))

    return F.pandas_udf(of, "int")


SWEPT = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("rule_id", pa.int64()), ("action", pa.string())])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pid, key, kind, id, action) in order, rules before URLs of the same key; for each URL the top of the stack.

    Python takes a step for each rule and for each end of one's interval, not for each URL.
    """
    stack: list[tuple[str, int, str]] = []
    part = None
    for batch in batches:
        pids, kinds = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        keys, n = batch.column(1), batch.num_rows
        turns = np.flatnonzero((kinds == 0) | np.concatenate([[True], pids[1:] != pids[:-1]])) if n else np.zeros(0, np.int64)
        for at, end in zip(turns, np.append(turns[1:], n)):
            if pids[at] != part:
                stack, part = [], pids[at]
            if kinds[at] == 0:
                key = keys[at].as_py()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                stack.append((key, batch.column(3)[at].as_py(), batch.column(4)[at].as_py()))
                at += 1
            while at < end:
                past = end
                if stack:
                    under = pc.starts_with(keys.slice(at, end - at), stack[-1][0]).to_numpy(zero_copy_only=False)
                    past = at + (len(under) if under.all() else int(np.argmin(under)))
                if past == at:
                    stack.pop()
                    continue
                rule, action = stack[-1][1:] if stack else (None, "none")
                m = past - at
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(at, m), keys.slice(at, m), pa.array([rule] * m, pa.int64()), pa.array([action] * m, pa.string())], schema=SWEPT)
                at = past


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, key, rule_id, action) for each row of pages(page_id, url) by the most specific of rules(rule_id, pattern, action).

    action is that of the rule, or "none" (with a null rule_id) where no rule covers the key, the URL is null or has no host (key is
    then null). Of rules with the same prefix the one with the greatest rule_id counts. Rules without a host,
    or with a null in any column, cover nothing. Repeated rows each have a result; a null page_id is kept. An empty URL has no host; a very long one is keyed
    whole. No pages give no rows; no rules give "none" everywhere. Only the named columns are read, so others may have any name; page_id and rule_id are whole numbers, else it is a TypeError.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    scratch = Scratch(spark, "urls")
    keyed = scratch.write(pages.select(doc_id(pages, "page_id").alias("page_id"), canonical_key(F.col("url")).alias("key")), "keyed")
    prefixes = scratch.write(rules.select(doc_id(rules, "rule_id").alias("rule_id"), rule_prefix(F.col("pattern")).alias("prefix"), F.col("action").cast("string")), "rules")
    prefixes = prefixes.where("prefix <> '' and rule_id is not null and action is not null")
    last = Window.partitionBy("prefix").orderBy(F.desc("rule_id"), "action")
    prefixes = prefixes.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")

    # Bounds from a bounded sample of keys, as a range partitioning takes it; equal keys are split by a salt of page_id.
    salted = keyed.where("key is not null").withColumn("place", F.concat("key", F.lit("\x00"), F.lpad(F.hex(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20))), 5, "0")))
    sample = [r.place.encode() for r in salted.orderBy(F.xxhash64("page_id", "key")).select("place").limit(n * SAMPLES_PER_RANGE).collect()]
    sample = sorted(set(sample))
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if len(sample) > n else []
    place = _place(bounds)

    urls = salted.select(place("place").alias("pid"), "key", F.lit(1).alias("kind"), F.col("page_id").alias("id"), F.lit(None).cast("string").alias("action"))
    first, past = place("prefix"), place(F.concat("prefix", F.lit("\U0010ffff")))
    spans = prefixes.select("rule_id", "prefix", "action", first.alias("a"), past.alias("b"))
    copies = spans.select(F.explode(F.sequence("a", "b")).alias("pid"), F.col("prefix").alias("key"), F.lit(0).alias("kind"), F.col("rule_id").alias("id"), "action")
    swept = urls.unionByName(copies).repartitionById(n, F.col("pid")).sortWithinPartitions("pid", "key", "kind").mapInArrow(_sweep, "page_id long, key string, rule_id long, action string")
    hostless = keyed.where("key is null").select("page_id", "key", F.lit(None).cast("long").alias("rule_id"), F.lit("none").alias("action"))
    return swept.unionByName(hostless)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "rule_id long, pattern string, action string"))


def _sql_decoded(x: str) -> str:
    char = "chr(CAST('0x' || substr(p, 1, 2) AS INTEGER))"
    known = rf"CASE WHEN regexp_full_match({char}, '[A-Za-z0-9._~-]') THEN {char} || substr(p, 3) ELSE '%' || upper(substr(p, 1, 2)) || substr(p, 3) END"
    return rf"array_to_string(list_transform(string_split({x}, '%'), lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9A-Fa-f]{{2}}') THEN {known} ELSE '%' || p END), '')"


def _sql_keys(name: str, source: str, columns: str, url: str) -> str:
    """CTEs up to one called name: columns of source and the key of url. Hosts beyond ASCII, of which the tables have none, stay as they are."""
    steps = [
        rf"*, regexp_replace(regexp_replace(trim(regexp_replace({url}, '[\t\r\n]', '', 'g')), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '(?s)#.*$', '') AS bare",
        f"*, {_sql_decoded("regexp_extract(bare, '^([^/?]*)', 1)")} AS host0, {_sql_decoded("regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1)")} AS rest0",
        r"*, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(host0, '(?s)^.*@', ''), ':[0-9]*$', '')), '\.+$', ''), '^www\.', '') AS host, CASE WHEN starts_with(rest0, '/') THEN rest0 ELSE '/' || rest0 END AS rest",
        r"*, regexp_extract(rest, '(?s)^([^?]*)', 1) AS path, regexp_replace(regexp_extract(rest, '(?s)^[^?]*(.*)$', 1), '([?&])utm_[^=&]*=[^&]*', '\1', 'g') AS query",
        "*, list_reduce(list_concat([''], string_split(path, '/')[2:]), lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END) AS walked",
        rf"{columns}, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ',)' || CASE WHEN regexp_matches(path, '/\.\.?(/|$)') THEN walked || CASE WHEN regexp_matches(path, '/\.\.?$') OR walked = '' THEN '/' ELSE '' END ELSE path END || regexp_replace(regexp_replace(regexp_replace(query, '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', '') END AS key",
    ]
    names = [*(f"{name}{i}" for i in range(1, len(steps))), name]
    return ",\n".join(f"{n} AS (SELECT {step} FROM {before})" for n, step, before in zip(names, steps, [source, *names]))


OP3_SQL = f"""
WITH rules(rule_id, pattern, action) AS (VALUES {", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)}),
{_sql_keys("ruled", "rules", "rule_id, pattern, action", "pattern")},
prefixes AS (SELECT rule_id, action, CASE WHEN contains(pattern, '/') THEN key ELSE regexp_extract(key, '^([^)]*)', 1) END AS prefix FROM ruled),
{_sql_keys("keyed", "pages", "page_id", "url")},
matched AS (
  SELECT k.page_id, k.key, p.rule_id, p.action, row_number() OVER (PARTITION BY k.page_id, k.key ORDER BY length(p.prefix) DESC, p.rule_id DESC) AS n
  FROM keyed k LEFT JOIN prefixes p ON starts_with(k.key, p.prefix))
SELECT page_id, key, CAST(rule_id AS BIGINT) AS rule_id, coalesce(action, 'none') AS action FROM matched WHERE n = 1
"""
