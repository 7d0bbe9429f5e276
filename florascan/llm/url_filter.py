"""URL filter: host and path rules first, then a blocked Bloom filter in front of an exact join with listed URLs.

Every listed canonical URL sets eight bits in one 256-bit block. The filter is a table of at most ``n_blocks`` rows
(block, four words), so what is broadcast has a bound that does not depend on the list. Rows whose bits are all set
are possible hits; only they take part in the exact join, which removes the false positives. All of it is built from
Spark's own functions.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, is never listed and is
allowed. Repeated rows are judged one by one. Columns of the input named like an output column are replaced. An empty
list or an empty table gives "allow" for every row left to the method, or no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florascan.llm.common import hidden

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., then the path without slashes at its end; empty where the host is."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))
    )


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _words(key: Column) -> list[Column]:
    """Two bits in each of the block's four words."""
    bits = F.xxhash64(key, F.lit("bits"))
    at = [F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(8)]
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, at[2 * w]).bitwiseOR(F.call_function("shiftleft", one, at[2 * w + 1])) for w in range(4)]


def blocked_bloom(listed: DataFrame, key: str, n_blocks: int = 16384) -> DataFrame:
    """(block, w0..w3): at most n_blocks rows of 36 bytes, however long the list is."""
    words = [w.alias(f"w{k}") for k, w in enumerate(_words(F.col(key)))]
    rows = listed.select(_block(F.col(key), n_blocks).alias("block"), *words)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    url: str = "url",
    listed_url: str = "canonical_url",
    n_blocks: int = 16384,
) -> DataFrame:
    """pages with host, path, canonical_url, rule, possible_hit, listed and verdict (a rule's, else block if listed)."""
    out = ("host", "path", "canonical_url", "rule", "possible_hit", "listed", "verdict")
    source = F.col(f"`{url}`")
    base = pages.withColumn("__url", source)
    base = hidden(base, *out)
    host, path = host_and_path(F.col("__url"))
    base = base.withColumns({"host": host, "path": path})
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "__says": says, "canonical_url": canonical(F.col("host"), F.col("path"))})

    keys = listed.select(F.col(listed_url).alias("__key")).filter("__key <> ''").distinct()
    bloom = blocked_bloom(keys, "__key", n_blocks).select(F.col("block").alias("__block"), *[F.col(f"w{k}").alias(f"__w{k}") for k in range(4)])
    here = F.col("canonical_url")
    hit = F.lit(True)
    for k, word in enumerate(_words(here)):
        hit = hit & (F.col(f"__w{k}").bitwiseAND(word) == word)
    probed = base.withColumn("__at", _block(here, n_blocks)).join(F.broadcast(bloom), F.col("__at") == F.col("__block"), "left")
    probed = probed.withColumn("possible_hit", F.coalesce(hit, F.lit(False)) & (here != ""))

    # Rows that cannot be listed get keys of their own: no canonical URL has a "?", and they spread over all tasks.
    spread = F.concat(F.lit("?"), F.xxhash64("__url", F.monotonically_increasing_id()).cast("string"))
    probed = probed.withColumn("__join", F.when(F.col("possible_hit"), here).otherwise(spread))
    joined = probed.join(keys, F.col("__join") == F.col("__key"), "left")
    joined = joined.withColumn("listed", F.col("__key").isNotNull())
    verdict = F.coalesce(F.col("__says"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    hide = ["__url", "__says", "__at", "__block", "__join", "__key", *[f"__w{k}" for k in range(4)]]
    return joined.withColumn("verdict", verdict).drop(*hide)


#: Fixed values of the query: its rules, and the words that mark a host as listed.
QUERY_RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LISTED_HOST = "adult|casino|bets|spam"


def listed_pages(pages: DataFrame, url: str = "url", pattern: str = LISTED_HOST) -> DataFrame:
    """The block list of the query: canonical URLs of all pages whose host has one of the words."""
    host, path = host_and_path(F.col(url))
    return pages.select(host.alias("host"), path.alias("path")).filter(F.col("host").rlike(pattern)).select(canonical(F.col("host"), F.col("path")).alias("canonical_url"))


def op10_url_filter(spark, sf_dir):
    from florascan.llm.common import table

    pages = table(spark, sf_dir, "pages")
    judged = filter_urls(pages, listed_pages(pages), QUERY_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


OP10_SQL = r"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
part as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
ruled as (select *, case
    when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
  case when host = '' then '' else regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') end as canonical_url from part),
list as (select distinct canonical_url from ruled where regexp_matches(host, 'adult|casino|bets|spam') and canonical_url <> '')
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when canonical_url in (select canonical_url from list) then 'block' else 'allow' end as verdict,
  canonical_url, canonical_url in (select canonical_url from list) as listed
from ruled
"""
