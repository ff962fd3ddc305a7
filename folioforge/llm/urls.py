"""URL filters: a sort-merge range join of reversed-host keys with rule intervals, by a sweep with a stack."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.sources.files import table

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends every label of a key; it sorts before any character of a host name, so subdomains follow their domain directly.
END, AFTER = "\x01", "\x02"
#: Rows of a range, and the most keys that are looked at to place the ranges' bounds. Neither changes the result.
RANGE_ROWS = 250_000
SAMPLE_KEYS = 200_000


def host_of(url: Column) -> Column:
    """What stands after the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a mark: every subdomain's key begins with its domain's."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), END), F.lit(END))


_ROWS = "bucket int, key string, kind int, page_id long, host string, path string, verdict string"


def _deal(cuts: list[str], rules: bool):
    """Give each url its range, and each rule a copy for every range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if rules:
                pick, bucket = [], []
                for row, key in enumerate(keys):
                    own = range(bisect_right(cuts, key), bisect_right(cuts, key[: -len(END)] + AFTER) + 1)
                    pick.extend([row] * len(own))
                    bucket.extend(own)
                batch = batch.take(pa.array(pick, pa.int64()))
            else:
                places = zip(keys, batch.column("path").to_pylist(), batch.column("salt").to_pylist(), strict=True)
                bucket = [bisect_right(cuts, f"{k}\x00{p}\x00{s}") for k, p, s in places]
            kind = pa.array([0 if rules else 1] * len(bucket), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), batch.column("key"), kind, *(batch.column(c) for c in ("page_id", "host", "path", "verdict"))], ["bucket", "key", "kind", "page_id", "host", "path", "verdict"])

    return run


class _Domain:
    """Rules of one host, by path, with the lengths that paths have."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != "block":
            self.paths[path] = verdict
        if len(path) not in self.lengths:
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


def _sweep(default: str):
    """Walk a range in key order with the stack of domains whose interval holds the current key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Domain] = []
        now = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "kind", "page_id", "host", "path", "verdict")), strict=True):
                bucket, key, kind, page_id, host, path, verdict = row
                if bucket != now:
                    now, stack = bucket, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1].key != key:
                        stack.append(_Domain(key, host))
                    stack[-1].add(path, verdict)
                    continue
                best = None
                for domain in stack:
                    if (host == domain.host or host.endswith("." + domain.host)) and (found := domain.longest(path)) is not None:
                        size = (len(domain.host) + len(found), len(domain.host))
                        if best is None or size > best[0]:
                            best = (size, domain.host + found, domain.paths[found])
                for column, value in zip(out, (page_id, host, path, best and best[1], best[2] if best else default), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Verdict for every row of `pages` (`page_id`, `url`) under `rules` (`verdict`, `host`, `path`).

    A rule fits its host and all subdomains if the path starts with the rule's.  Of fitting rules the
    longest (host and path, then host) wins, block before allow; without one the verdict is `default`
    and the rule null.  Result: page_id, host, path, rule, verdict.

    A domain's subdomains are one interval of reversed-host keys.  Urls and rules are dealt to ranges
    of keys, a rule to each that its interval meets, and each range is swept in order with a stack of
    nested domains.  The place in a range counts path and row as well, so a host with any share of the
    rows is split over ranges.  A null url, or one without `://`, has an empty host and path; a null
    page_id stays null; repeated rows are judged each; rules with a null or empty host are ignored, a
    null path counts as `/`; a url of any length is judged whole; empty tables give no rows, or defaults;
    other columns are dropped.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.hex(F.xxhash64("page_id", "url")).alias("salt"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("verdict", F.lit(None).cast("string"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // range_rows))
    sample = urls.select(F.concat_ws("\x00", "key", "path", "salt").alias("at"), "salt").orderBy("salt").limit(min(20 * ranges, SAMPLE_KEYS))
    drawn = sorted(r["at"] for r in sample.collect())
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    known = rules.where("host <> ''").select(F.lit(None).cast("long").alias("page_id"), F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict")
    events = urls.mapInArrow(_deal(cuts, False), _ROWS).unionByName(known.withColumn("key", host_key(F.col("host"))).mapInArrow(_deal(cuts, True), _ROWS))
    swept = events.repartition(ranges, "bucket").sortWithinPartitions("bucket", "key", "kind", "path", "verdict")
    return swept.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return judge_urls(table(spark, f"{sf_dir}/pages.parquet"), spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)"))


SQL = rf"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS k
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND f.k = 1
"""
