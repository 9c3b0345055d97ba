"""URL filter: a blocked Bloom filter of listed canonical keys, then an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import LOWER, UPPER

#: One block is 8 longs: 512 bits. A key sets one bit in each long of its block.
LONGS = 8


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path after it up to
    `?`, `#` or the end. Both are empty where there is no `://` or the url is null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))



def bloom_blocks(keys: DataFrame, key_col: str, n_blocks: int) -> DataFrame:
    """(block, b0..b7): the filter of the keys as one row per block in use; its size follows the number of keys."""
    bits = [F.bit_or(m).alias(f"b{k}") for k, m in enumerate(bit_columns(F.col(key_col)))]
    return keys.groupBy(F.pmod(F.xxhash64(key_col), F.lit(n_blocks)).alias("block")).agg(*bits)


def bit_columns(key: Column) -> list[Column]:
    """The bit that a key sets in each long of its block."""
    second = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int") for k in range(LONGS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of `pages`.

    rules: (verdict, host, path). A rule fits its host and every subdomain of it where the url's path starts with the
    rule's; the longest rule (host and path together) wins, then the one with the longer path, then `block` before `allow`.
    `rule` is host and path of that rule or null; `verdict` is the rule's, or `default` where no rule fits.

    Every url gives the keys a rule could have: its host and the parts after each dot, with its path cut to each length that
    rules have. A key asks the one block of the filter that its hash names (a join on the block number); keys whose bits are
    all set go on to the hash join on the key itself, which removes false positives. Spark broadcasts the filter and the
    rules while they are below its limit and shuffles on block and key beyond that; the best rule of a page is a maximum
    before and after that shuffle, so a host that holds a third of the pages is no hot key.

    Null or unparsable urls have an empty host and path, no rule and the default verdict. Rows whose id is null or repeated
    keep their own rows; repeated rules count once; other columns are ignored; an empty rule table leaves the default.
    """
    host, path = canonical_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    listed = (rules.select(F.lower("verdict").alias("r_verdict"), F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
              .where("r_host is not null and r_host <> ''").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
              .withColumn("key", F.concat_ws("\n", "r_host", "r_path")))
    facts = listed.agg(F.count("*"), F.collect_set(F.length("r_path"))).first()
    n_blocks, lengths = max(1, -(-facts[0] * 16 // (64 * LONGS))), sorted(facts[1])
    blocks = bloom_blocks(listed, "key", n_blocks)

    # one row per different host and path: pages that share them are judged once
    places = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cuts = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    keys = places.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(cuts).alias("cut"))
    keys = keys.select("host", "path", F.concat_ws("\n", "suffix", "cut").alias("key"))
    asked = keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).join(blocks, "block")
    possible = asked
    for k, mask in enumerate(bit_columns(F.col("key"))):
        possible = possible.where(F.col(f"b{k}").bitwiseAND(mask) != 0)
    hits = possible.select("host", "path", "key").join(listed, "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_path").alias("deep"), F.col("r_verdict").alias("verdict"),
        F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
