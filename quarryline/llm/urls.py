"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join (operator 8, native).

A rule has a host and a path: it fits that host and its subdomains where the url's path starts
with the rule's. Its key is host + path. A url's candidate keys are its host's suffixes with its
path's prefixes of the lengths that occur in the list. Named rules meet the url as it stands, the
method's own list its canonical form: the host without user, port and final dots, the path with
single slashes and without ``.`` segments. Candidates probe the filter (256-bit blocks
of four 64-bit words, one bit in each); possible hits join the list exactly, the longest key wins.
DataFrame functions alone.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule;
repeated rows keep a row each; an empty list gives every url the default; other columns are ignored,
but those of the names host, path, rule and verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import BROADCAST_ROWS, join_groups, materialise, read

#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Hosts that the method itself lists as spam, where no rule fits.
LISTED = [f"{name}.example.{top}" for name in ("cheap-pills", "spam-farm") for top in ("com", "net", "org")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS_PER_BLOCK = 16
#: A block of the filter (its number and four words) and the size up to which the filter is broadcast: some 20 million keys.
BLOCK_BYTES, FILTER_BYTES = 48, 64 << 20
#: Size up to which the different urls with a hit are broadcast.
HIT_BYTES = 4 << 20
ADDED = ["host", "path", "rule", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))
    return host, F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """The forms that the method's own list is held against; ``host`` is lower-cased already."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return bare, F.regexp_replace(path, r"/(\.?/)+", "/")


def _candidates(host: str, path: str, named: bool, lengths: list[int]) -> Column:
    """Keys of the host's suffixes with the path's prefixes of these lengths, and which rules they are for."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.array(*[F.when(F.length(path) >= k, F.concat(s, F.substring(path, 1, k))) for k in lengths])))
    return F.transform(F.array_compact(keys), lambda k: F.struct(F.lit(named).alias("named"), k.alias("key")))


def _probe(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each of the block's four words."""
    h = F.xxhash64(key)
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(4)]


def blocked_bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter's blocks that hold a key: block, w0 to w3."""
    block, bits = _probe(column, blocks)
    return keys.select(block.alias("block"), *[b.alias(f"b{j}") for j, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"b{j}").alias(f"w{j}") for j in range(4)])


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", filter_bytes: int = FILTER_BYTES, list_rows: int = BROADCAST_ROWS, hit_bytes: int = HIT_BYTES) -> DataFrame:
    """urls with ``host``, ``path``, ``rule`` and ``verdict``.

    rules: host, path, verdict, named (false: its verdict counts, but it gives no ``rule``, and any
    named rule goes before it; its host and path are in canonical form). The list is broadcast up to ``list_rows``
    rows; the filter, a few bytes a key, up to ``filter_bytes``, so that with longer lists only the possible hits are
    shuffled. Different urls with a hit go back to their rows by broadcast up to ``hit_bytes``, by a salted shuffle beyond.
    """
    n = rules.count()
    small = (lambda df: F.broadcast(df)) if n <= list_rows else (lambda df: df.hint("merge"))
    listed = rules.select("named", F.concat("host", "path").alias("key"), "verdict").dropDuplicates(["named", "key"])
    lengths = rules.select("named", F.length("path").alias("n")).distinct().collect()  # one for each length of a path
    host, path = host_and_path(F.col(url))
    parsed = urls.withColumns({"host": host, "path": path})
    bare, clean = canonical(F.col("host"), F.col("path"))
    forms = parsed.where("host != ''").select("host", "path", bare.alias("c_host"), clean.alias("c_path"))
    kinds = [(h, p, named, sorted(r["n"] for r in lengths if r["named"] == named)) for h, p, named in (("host", "path", True), ("c_host", "c_path", False))]
    keys = [_candidates(*kind) for kind in kinds if kind[3]]
    exploded = forms.select("host", "path", F.explode(F.concat(*keys)).alias("c")).select("host", "path", "c.named", "c.key") if keys else forms.select("host", "path", F.lit(True).alias("named"), F.lit("").alias("key")).limit(0)
    blocks = max(1, n // KEYS_PER_BLOCK + 1)
    block, bits = _probe("key", blocks)
    probed = exploded.withColumns({"_block": block} | {f"_b{j}": b for j, b in enumerate(bits)})
    bloom = blocked_bloom(listed, "key", blocks)
    possible = probed.join(F.broadcast(bloom) if blocks * BLOCK_BYTES <= filter_bytes else bloom.hint("merge"), F.col("_block") == F.col("block"))
    for j in range(4):
        possible = possible.where(F.col(f"_b{j}").bitwiseAND(F.col(f"w{j}")) != 0)
    hits = possible.select("host", "path", "named", "key").join(small(listed), ["named", "key"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct("named", F.length("key").alias("n"), "key", "verdict")).alias("_best"))
    best = materialise(best, "url-hits")
    # One url, or none at all, may stand in most rows: rows are dealt by their number, not by url alone.
    size = best.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("_best.key") + 64)).first()[0] or 0
    joined = join_groups(parsed, best, ["host", "path"], F.monotonically_increasing_id(), most=BROADCAST_ROWS if size <= hit_bytes else 0)
    return joined.select(*[c for c in urls.columns if c not in ADDED], "host", "path", F.when(F.col("_best.named"), F.col("_best.key")).alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(h, p, v, True) for h, p, v in RULES] + [(h, "", "block", False) for h in LISTED]
    return spark.createDataFrame(rows, "host string, path string, verdict string, named boolean")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that fits best and the verdict."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES) + ", " + ", ".join(f"('{h}', '', 'block', false)" for h in LISTED)
#: DuckDB: every rule against every different host and path.
OP8_SQL = rf"""
WITH rules(host, path, verdict, named) AS (VALUES {_VALUES}),
p AS (SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
d AS (SELECT host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS c_host,
  regexp_replace(path, '/(\.?/)+', '/', 'g') AS c_path FROM (SELECT DISTINCT host, path FROM u WHERE host != '')),
h AS (SELECT *, unnest([true, false]) AS named FROM d),
f AS (SELECT h.host, h.path, r.host || r.path AS rule, r.verdict, r.named,
  row_number() OVER (PARTITION BY h.host, h.path ORDER BY r.named DESC, length(r.host || r.path) DESC) AS k
  FROM h JOIN rules r ON r.named = h.named
    AND (CASE WHEN h.named THEN h.host ELSE h.c_host END = r.host OR ends_with(CASE WHEN h.named THEN h.host ELSE h.c_host END, '.' || r.host))
    AND starts_with(CASE WHEN h.named THEN h.path ELSE h.c_path END, r.path))
SELECT u.page_id, u.host, u.path, CASE WHEN f.named THEN f.rule END AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path AND f.k = 1
"""
