"""URL filter: a blocked Bloom filter before an exact hash join.

Listed canonical URLs set a few bits each in one small block. A looked-up URL touches only its own block; those whose
bits are all set are possible hits, and an equi-join with the list removes the false ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt.llm.common import table

#: A block is this many 64-bit words; each key sets one bit in every word.
BLOCK_WORDS = 4
#: Listed keys a block is sized for: 256 bits for 16 keys, 16 bits a key.
KEYS_PER_BLOCK = 16
#: Largest filter, in blocks, that is sent to every task (16 MB); a larger one is joined by block number.
BROADCAST_BLOCKS = 1 << 19
#: Bounds the exponent of the block count, so that block numbers stay whole longs.
MOST_BLOCKS = 1 << 40


@dataclass(frozen=True)
class Rule:
    """A host, with its subdomains, and the start of a path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that decide before the list does.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Site names whose pages make up the list that the registered query filters by.
LISTED_SITES = ("spam-farm", "cheap-pills", "adult-x")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    bare = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    cut = F.instr(bare, "/")
    host = F.when(cut > 0, F.substring(bare, F.lit(1), cut - 1)).otherwise(bare)
    path = F.when(cut > 0, F.substring(bare, cut, F.length(bare))).otherwise(F.lit(""))
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: no scheme, query, fragment or leading ``www.``/``m.``, no trailing slash or
    ``.html``; null for an empty host."""
    bare = F.regexp_replace(host, r"\A(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(/|\.html)\z", "")))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and action; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [(F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
                    F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action")))) for r in ordered]
    return F.coalesce(*fits)


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and its bit in each of the block's words."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bits = [F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BLOCK_WORDS)]
    return F.pmod(first, F.lit(blocks)), bits


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``key``: one row per block in use, with its words. Partial sums make it cheap for hot keys."""
    block, bits = _place(F.col("key"), blocks)
    marked = keys.select(block.alias("block"), *[_one(bit).alias(f"w{i}") for i, bit in enumerate(bits)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])


def possible(urls: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``urls`` whose ``key`` may be listed."""
    block, bits = _place(F.col("key"), blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    held = urls.withColumn("block", block).join(bloom, "block")
    words = [F.col(f"w{i}").bitwiseAND(_one(bit)) != 0 for i, bit in enumerate(bits)]
    return held.where(reduce(lambda a, b: a & b, words)).select(*urls.columns)


def listed_keys(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct keys of ``urls`` that ``listed`` holds; both have ``key``. Exact: the Bloom filter only spares the
    join what cannot match. Null keys match nothing, an empty list matches nothing."""
    listed = listed.where(F.col("key").isNotNull()).select("key").distinct()
    blocks = min(MOST_BLOCKS, max(1, -(-listed.count() // KEYS_PER_BLOCK)))
    wanted = urls.where(F.col("key").isNotNull()).select("key")
    return possible(wanted, build_filter(listed, blocks), blocks).distinct().join(listed, "key", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, listed, verdict.

    A rule that fits decides; else pages whose canonical URL is in ``listed`` (column ``key``) are blocked and the rest
    allowed. Null URLs and those without ``://`` have empty host and path and are allowed; very long ones are judged whole.
    Repeated pages and null ids are judged each; other columns are ignored; an empty table gives no rows, an empty list blocks nothing.
    """
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    rows = split.select("*", canonical(F.col("host"), F.col("path")).alias("key"), found["name"].alias("rule"),
                        found["action"].alias("action"))
    hits = listed_keys(rows, listed).withColumn("listed", F.lit(True))
    return rows.join(hits, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("action", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"))


def listed_from(pages: DataFrame, sites: tuple[str, ...] = LISTED_SITES) -> DataFrame:
    """Canonical URLs, as ``key``, of the pages of some sites: a host with one of the names as a label."""
    host, path = split_url(F.col("url"))
    split = pages.select(host.alias("host"), path.alias("path"))
    labels = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, sites)))
    return split.where(labels).select(canonical(F.col("host"), F.col("path")).alias("key"))


def op10_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages, by the rules and the pages of listed sites."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_from(pages))


OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN regexp_extract(substr(url, strpos(url, '://') + 3), '\A([^?#]*)', 1, 's') END AS bare
  FROM pages),
split AS (
  SELECT page_id,
         coalesce(translate(CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, 1, strpos(bare, '/') - 1) ELSE bare END,
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, strpos(bare, '/')) ELSE '' END, '') AS path
  FROM cut),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                               ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '\A(www|m)\.', '') || regexp_replace(path, '(/|\.html)\z', '') END AS k
  FROM split),
listed AS (
  SELECT DISTINCT k FROM keyed
  WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'adult-x'])),
places AS (SELECT DISTINCT host, path FROM split),
fit AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, host, path, rule, listed.k IS NOT NULL AS listed,
       coalesce(action, CASE WHEN listed.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN fit USING (host, path) LEFT JOIN listed USING (k)
"""
