"""URL filter: prefix rules and a list of URLs behind one blocked Bloom filter.

Entries are keys: a rule's host and path, or the canonical form of a listed
URL. Their filter has `BLOCKS` blocks of 256 bits, four lanes of 64; a key sets
two bits in every lane of one block. It is a table with a row for each block in
use, `BLOCKS` rows of five longs at most whatever the list holds, and so may be
broadcast. A page asks for the canonical form of its URL and for every ending
of its host with every beginning of its path that has as many labels and
characters as some rule; keys that the filter turns away go no further. An exact
hash join of the rest with the entries removes false positives. A list far
beyond the filter's size fills it: then more keys reach the join, which alone
decides.

A rule fits its host and all subdomains where the path starts with the rule's;
the longest rule wins, of equally long ones that with the longer host. Without
a rule the verdict is block for a listed URL, else allow. Of entries for the
same rule, one that blocks wins.

Canonical form: host without `www.` and default port, path without closing
slashes, query fields in order without `utm_` and `ref` fields, no fragment.

Nulls: a null URL, or one without `://`, has empty host and path, no rule and
is allowed; null entries list nothing. Equal rows are judged alike, one result
each. Very long URLs are read whole. An empty table gives an empty result, empty
rules or lists fit nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, table

BLOCKS = 1 << 16
LANES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of op12: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words of host names whose pages make up the list of op12.
UNWANTED = ("casino", "pills", "bets", "spam", "ads", "adult")


def lower(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, UPPER, LOWER)


def with_address(df: DataFrame) -> DataFrame:
    """df plus host, path and query (from its ?, without fragment) of the column url."""
    df = df.withColumn("rest", F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end"))
    df = df.withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0)).withColumn("rest", F.expr("substring(rest, length(host) + 1)"))
    df = df.withColumn("path", F.regexp_extract("rest", r"^[^?#]*", 0)).withColumn("rest", F.expr("substring(rest, length(path) + 1)"))
    return df.withColumn("query", F.regexp_extract("rest", r"^\?([^#]*)", 1)).withColumn("host", lower(F.col("host"))).drop("rest")


def canonical(host: Column, path: Column, query: Column) -> Column:
    """The form that spellings of one URL share; null for an empty host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)\z", "")
    fields = F.filter(F.split(query, "&"), lambda f: (f != "") & ~F.startswith(f, F.lit("utm_")) & (f != "ref") & ~F.startswith(f, F.lit("ref=")))
    rest = F.array_join(F.array_sort(fields), "&")
    return F.when(name != "", F.concat(name, F.rtrim(path, F.lit("/")), F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise("")))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """host, path, verdict of rules given as plain values."""
    empty = spark.range(0).selectExpr("'' as host", "'' as path", "'' as verdict")
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows)) if rules else empty


def filter_bits(key: Column) -> list[Column]:
    """The block of a key and its mask in each lane."""
    bits = F.xxhash64(key, F.lit(1))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, at).bitwiseAND(63).cast("int"))
    return [F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int").alias("block"), *[one(12 * i).bitwiseOR(one(12 * i + 6)).alias(f"lane{i}") for i in range(LANES)]]


def bloom(entries: DataFrame) -> DataFrame:
    """The filter of the column key: a row for each block in use."""
    return entries.select(*filter_bits(F.col("key"))).groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def possible(keys: DataFrame, filter_table: DataFrame) -> DataFrame:
    """Rows of keys that the filter lets pass; it is of bounded size."""
    have = keys.columns
    block, *lanes = filter_bits(F.col("key"))
    asked = keys.select(*have, block, *[m.alias(f"mask{i}") for i, m in enumerate(lanes)])
    fits = asked["block"] == filter_table["block"]
    for i in range(LANES):
        fits &= F.col(f"lane{i}").bitwiseAND(F.col(f"mask{i}")) == F.col(f"mask{i}")
    return asked.join(F.broadcast(filter_table), fits).select(*have)


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url, listed of every page; rules: host, path, verdict, listed: url."""
    rules = pick(rules, "host", "path", "verdict").filter("host is not null and path is not null and verdict is not null").withColumn("host", lower(F.col("host")))
    by_rule = rules.select(F.concat(F.lit("r "), "host", "path").alias("key"), "host", "path", "verdict").groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))
    urls = with_address(pick(listed, "url")).select(F.concat(F.lit("u "), canonical(F.col("host"), F.col("path"), F.col("query"))).alias("key")).filter("key is not null").distinct()
    entries = by_rule.unionByName(urls, allowMissingColumns=True)
    shape = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"), F.collect_set(F.length("path")).alias("lengths"))

    rows = with_address(pick(pages, "page_id", "url"))
    rows = rows.select("page_id", "host", "path", canonical(F.col("host"), F.col("path"), F.col("query")).alias("canonical_url"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "urls")
    asked = rows.join(F.broadcast(shape), F.lit(True))  # one row
    ends = F.when((F.col("labels") > 0) & (F.col("host") != ""), F.transform(F.sequence(F.lit(1), F.least(F.col("labels"), F.size(F.split("host", r"\.")))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))).otherwise(F.array().cast("array<string>"))
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.call_function("left", F.col("path"), n))
    keys = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(F.lit("r "), e, s))))
    keys = F.concat(keys, F.filter(F.array(F.concat(F.lit("u "), "canonical_url")), lambda k: k.isNotNull()))
    hits = possible(asked.select("row", F.explode(keys).alias("key")), bloom(entries)).join(entries, "key")
    rule = F.concat("host", "path")
    found = hits.groupBy("row").agg(
        F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), rule.alias("rule"), "verdict"))).alias("best"),
        F.max(F.col("verdict").isNull()).alias("listed"),
    )
    isin = F.coalesce("listed", F.lit(False))
    return rows.join(found, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(isin, "block").otherwise("allow")).alias("verdict"), "canonical_url", isin.alias("listed"))


def unwanted_urls(pages: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """url of the pages that have one of the words in the name of their host."""
    return with_address(pick(pages, "url")).filter(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words)))).select("url")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, rules_table(spark, RULES), unwanted_urls(pages))


SQL = """
with a as (select row_number() over () as r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select r, page_id, regexp_extract(rest, '^[^/?#]*') as raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) as rest from a),
c as (select r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^?#]*') as path, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^?#]*')) + 1), '^\\?([^#]*)', 1) as query from b),
d as (select *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') as name,
 array_to_string(list_sort(list_filter(string_split(query, '&'), lambda f: f <> '' and not starts_with(f, 'utm_') and f <> 'ref' and not starts_with(f, 'ref='))), '&') as fields from c),
e as (select *, case when name <> '' then name || rtrim(path, '/') || case when fields <> '' then '?' || fields else '' end end as canonical_url from d),
u as (select distinct canonical_url from e where canonical_url is not null and len(list_intersect(string_split_regex(host, '[.-]'), ['casino', 'pills', 'bets', 'spam', 'ads', 'adult'])) > 0),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (select r, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v from e join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r)
select page_id, host, path, rule, coalesce(v, case when u.canonical_url is not null then 'block' else 'allow' end) as verdict, e.canonical_url, u.canonical_url is not null as listed
from e left join f using (r) left join u on u.canonical_url = e.canonical_url
"""
