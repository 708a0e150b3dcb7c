"""URL filters in DataFrame functions: path rules first, then a blocked Bloom filter before an exact join.

The listed canonical URLs are hashed into a Bloom filter of 512-bit blocks, eight bits of each URL in one block, one in
each of its eight 64-bit lanes. Its size is a parameter, so it may be broadcast whatever the list's length. What passes
it is joined exactly with the list; the filter's false positives fall out there, so its fill changes cost only.

Defined cases: a null url or one without ``://`` has an empty host and path, is on no list and is allowed. Repeated urls are
judged each by itself. An empty list allows all that no rule blocks. Null entries of the list are left out. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
#: Blocks of 64 bytes: 1 MB in all.
BLOCKS = 1 << 14
#: Parts into which the rows of one listed URL are split.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains where the path starts with ``path``; the longest rule wins."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the query (fixed values).
RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Words of a host's labels, and parameters of a query, that put a page's canonical URL on the list that ``listed_of`` makes.
LISTED_WORDS = ("casino", "bets", "pills", "ads")
LISTED_PARAMETERS = ("utm_source", "ref")


def _lower(column: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, by position only."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def canonical(host: Column, path: Column) -> Column:
    """What listed and judged urls are compared by: no scheme, query, fragment, ``www.``/``m.``, ``.html`` or closing slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name)):  # later ones, the longest, win
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """Block of a key and its bit in each lane."""
    low, high = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    places = [F.shiftrightunsigned(high, 6 * lane).bitwiseAND(F.lit(63).cast("long")).cast("int") for lane in range(LANES)]
    return low, [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def bloom(listed: DataFrame, blocks: int = BLOCKS, column: str = "canonical") -> DataFrame:
    """``block, lanes``: the filter of a list, at most ``blocks`` rows; combined before the shuffle."""
    low, bits = _bits(F.col(column))
    rows = listed.where(F.col(column).isNotNull()).select(F.pmod(low, F.lit(blocks)).alias("block"), *(b.alias(f"lane{i}") for i, b in enumerate(bits)))
    return rows.groupBy("block").agg(*(F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)))


def with_possible(rows: DataFrame, filter_rows: DataFrame, blocks: int = BLOCKS, column: str = "canonical") -> DataFrame:
    """``rows`` with ``possible``: whether all bits of the key are set in its block of the filter."""
    low, bits = _bits(F.col(column))
    # The filter has at most ``blocks`` rows of 72 bytes, whatever the list's length.
    hit = rows.withColumn("_block", F.pmod(low, F.lit(blocks))).join(F.broadcast(filter_rows.withColumnRenamed("block", "_block")), "_block", "left")
    held = F.lit(True)
    for i, bit in enumerate(bits):
        held = held & (F.col(f"lane{i}").bitwiseAND(bit) != 0)
    return hit.select(*rows.columns, F.coalesce(held, F.lit(False)).alias("possible"))


def listed_of(pages: DataFrame, words: Sequence[str] = LISTED_WORDS, parameters: Sequence[str] = LISTED_PARAMETERS, url_col: str = "url") -> DataFrame:
    """A list of canonical URLs: pages on hosts with one of the words, and pages met through a tracking link.

    The same page without the link's parameters, or on another scheme, has the same canonical URL and so is listed too.
    """
    host, path = parsed(F.col(url_col))
    bad = F.regexp_like(host, F.lit(rf"(^|[.-])({'|'.join(words)})([.-]|$)")) | F.regexp_like(F.col(url_col), F.lit(rf"[?&]({'|'.join(parameters)})="))
    return pages.where(bad & (host != "")).select(canonical(host, path).alias("canonical")).distinct()


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, blocks: int = BLOCKS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row.

    ``verdict`` is the rule's, else block where the exact join finds the canonical URL on the list, else allow. Possible hits are
    reduced to distinct keys for the join with the list. The listed ones among them are joined back to the rows salted, so a
    url may fill any share of the rows; rows that the filter cleared are spread by their id.
    """
    host, path = parsed(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    open_ = F.col("ruled").isNull() & (F.col("host") != "")
    rows = rows.withColumn("canonical", F.when(open_, canonical(F.col("host"), F.col("path"))))
    listed = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    tested = with_possible(rows, bloom(listed, blocks), blocks)
    found = tested.where("possible").select("canonical").distinct().join(listed.hint("shuffle_hash"), "canonical")
    found = found.select(F.col("canonical").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("hit"))
    spread = F.xxhash64(F.col("page_id"), F.col("path"))
    tested = tested.withColumn("key", F.when(F.col("possible"), F.col("canonical"))).withColumn("salt", F.when(F.col("possible"), F.pmod(spread, F.lit(SALTS))).otherwise(spread))
    hit = F.coalesce("hit", F.lit(False))
    return tested.join(found, ["key", "salt"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), hit.alias("listed"))
