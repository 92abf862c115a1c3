"""URL filters: path rules, then a blocked Bloom filter of listed canonical URLs with an exact join behind it.

Only DataFrame functions are used. Cases: a null url, or one without "://", has an empty host and path and no
canonical form, fits no rule and is never listed; repeated rows are judged row by row; an empty list blocks
nothing; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: rule, verdict; a rule is a host and the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: 512-bit blocks of eight words; one bit in each word for an entry.
BITS_PER_ENTRY, WORDS = 16, 8
#: A filter up to this size is broadcast; a larger one is joined by its block number.
BROADCAST_BYTES = 32 << 20
#: A page is listed if its markup has one of these terms as a word.
LISTED_TERMS = r"[ >](spam|idiot|moron|worthless|pathetic|stupid|clown)[ .,<]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: str = "host", path: str = "path", url: str = "url") -> Column:
    """One form of all spellings of a page's address; null where there is no host.

    Host without user, default port, closing dots and a leading www.; path with escapes decoded (as it stands if
    that isn't UTF-8), without empty, . and .. segments and closing slashes; scheme and query don't count.
    """
    port = F.when(F.startswith(F.lower(url), F.lit("https:")), F.lit(":443")).otherwise(":80")
    bare = F.regexp_replace(host, r"^[^@]*@", "")
    bare = F.regexp_replace(bare, F.concat(port, F.lit("$")), F.lit(""))
    bare = F.regexp_replace(F.rtrim(bare, F.lit(".")), r"^www\.", "")
    plain = F.coalesce(F.try_url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), F.col(path))
    step = lambda got, x: F.when(x == "..", F.regexp_replace(got, r"/[^/]*$", "")).when((x == ".") | (x == ""), got).otherwise(F.concat(got, F.lit("/"), x))
    return F.when(bare != "", F.concat(bare, F.aggregate(F.split(plain, "/"), F.lit(""), step)))


def match_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    rule = kind = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(f"/{path}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        kind = F.when(fits, what) if kind is None else kind.when(fits, what)
    return (rule, kind) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("canonical"), F.lit(n))


def _bits() -> list[Column]:
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(canonical, {i + 1}), 64) as int))").alias(f"bits{i}") for i in range(WORDS)]


def bloom_filter(listed: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """A row of eight words for each block that has an entry, and the number of blocks."""
    n = max(1, n_entries * BITS_PER_ENTRY // (64 * WORDS))
    rows = listed.select(_block(n).alias("block"), *_bits())
    return rows.groupBy("block").agg(*(F.bit_or(f"bits{i}").alias(f"word{i}") for i in range(WORDS))), n


def in_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """urls with `possible` (the filter's answer) and `is_listed` (the exact one), by column `canonical`.

    Only possible hits go to the exact join; all else passes. The keys of that join are hot only where many
    pages share a listed URL, and that side Spark may split.
    """
    listed = cut_lineage(listed.select("canonical").where("canonical is not null").distinct())
    words, n = bloom_filter(listed, listed.count())
    if n * WORDS * 8 <= BROADCAST_BYTES:
        words = F.broadcast(words)
    # rows without a canonical form get keys of their own, which no block has
    none = -1 - F.pmod(F.xxhash64(*urls.columns), F.lit(1 << 20))
    rows = urls.withColumn("block", F.when(F.col("canonical").isNotNull(), _block(n)).otherwise(none)).join(words, "block", "left")
    bits = [F.col(f"word{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits())]
    rows = rows.select(*urls.columns, F.coalesce(reduce(Column.__and__, bits), F.lit(False)).alias("possible"))
    exact = rows.where("possible").join(listed.withColumn("is_listed", F.lit(True)), "canonical", "left").select(*rows.columns, F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    return exact.unionByName(rows.where("not possible").withColumn("is_listed", F.lit(False)))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, canonical, rule, possible, is_listed and verdict of every page.

    `listed` has the column canonical. A rule's verdict comes first; else a listed URL is blocked.
    """
    rule, kind = match_rule(rules)
    df = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    df = df.withColumn("canonical", canonical()).withColumn("rule", rule).withColumn("kind", kind).drop("url")
    df = in_list(df, listed)
    return df.withColumn("verdict", F.coalesce("kind", F.when(F.col("is_listed"), "block").otherwise("allow"))).drop("kind")


def abusive(pages: DataFrame, terms: str = LISTED_TERMS) -> DataFrame:
    """The canonical URLs of pages whose markup has a listed term."""
    found = pages.where(F.col("html").rlike(terms))
    return found.select("url", host_of("url").alias("host"), path_of("url").alias("path")).select(canonical().alias("canonical"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, abusive(pages)).select("page_id", "host", "path", "rule", "verdict", "is_listed")


_FIT = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{{{i}}}'"
    for i, (r, _) in enumerate(sorted(RULES, key=lambda r: -len(r[0])))
)
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0]))
OP10_SQL = f"""
WITH s AS (
  SELECT page_id, html, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
p AS (SELECT page_id, html, url, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host, path FROM h),
b AS (SELECT *, regexp_replace(rtrim(regexp_replace(regexp_replace(host, '^[^@]*@', ''), CASE WHEN starts_with(lower(url), 'https:') THEN ':443$' ELSE ':80$' END, ''), '.'), '^www\\.', '') AS bare,
      list_prepend('', string_split(coalesce(try(url_decode(path)), path), '/')) AS segments FROM p),
c AS (SELECT page_id, html, host, path, CASE WHEN bare <> '' THEN bare || list_reduce(segments, lambda got, x: CASE WHEN x = '..' THEN regexp_replace(got, '/[^/]*$', '')
      WHEN x IN ('.', '') THEN got ELSE got || '/' || x END) END AS canonical FROM b),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(html, '{LISTED_TERMS}')),
r AS (SELECT c.*, CASE {_FIT.format(*(r for r, _ in _BY_LENGTH))} END AS rule, CASE {_FIT.format(*(v for _, v in _BY_LENGTH))} END AS kind,
      (canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l)) AS is_listed FROM c)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN is_listed THEN 'block' ELSE 'allow' END) AS verdict, is_listed FROM r
"""
