"""Allow and block rules for URLs: a trie over reversed host labels and path segments, broadcast, longest match first.

A rule is a host and a path. It fits the host itself and all its subdomains if the path of the URL starts with the
rule's path. Of all rules that fit, the one with the longest host + path decides; of equally long ones the longer
host, and block before allow. Without a rule the default verdict holds.

The trie is broadcast while there are at most MAX_BROADCAST_RULES rules (about 200 bytes each). Longer lists are
joined instead: every URL gives its host suffixes and path folders as keys.

Defined results: a null URL, or one without "://", has an empty host and path and gets the default verdict. Rows
that repeat are judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

MAX_BROADCAST_RULES = 200_000
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")


class Trie:
    """Host labels from the right, then whole path segments; the last segment of a rule may be the start of a URL's."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_FOLD).split(".") if host else []):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("paths", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(last, ("", ""))[1] != "block":
                ends[last] = (host.translate(_FOLD) + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, size = None, (-1, -1)
        segments, node, depth = path.split("/"), self.root, 0
        labels = host.split(".")
        while True:
            under = node
            for i, segment in enumerate(segments):
                for n in range(len(segment) + 1) if (ends := under.get("ends")) else ():
                    found = ends.get(segment[:n])
                    if found and (len(found[0]), depth) > size:
                        best, size = found, (len(found[0]), depth)
                under = under.get("paths", {}).get(segment) if i + 1 < len(segments) else None
                if under is None:
                    break
            if depth == len(labels) or (node := node.get("hosts", {}).get(labels[-1 - depth])) is None:
                return best
            depth += 1


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_FOLD), path


def url_columns(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host and path as Spark columns."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.substring_index(F.col(url), "://", 1))
    tail = F.expr(f"substring(`{url}`, length({'`' + url + '`'}) - length(`{url}`) + locate('://', `{url}`) + 3)")
    tail = F.when(rest.isNotNull(), tail)
    return F.coalesce(F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of each row."""
    if len(rules) > MAX_BROADCAST_RULES:
        return _joined(pages, rules, key, url, default)
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(x) for x in batch.column(1).to_pylist()]
            found = [trie.value.find(*x) if x != ("", "") else None for x in parts]
            cols = [[x[0] for x in parts], [x[1] for x in parts], [x and x[0] for x in found], [x[1] if x else default for x in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in cols)], names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _joined(pages: DataFrame, rules: list[Rule], key: str, url: str, default: str) -> DataFrame:
    """The same for lists of any length: keys are (host suffix, folder), then the rest of the path is compared."""
    spark = pages.sparkSession
    host, path = url_columns(url)
    r = spark.createDataFrame([(v, h.translate(_FOLD), p, p[: p.rfind("/") + 1], p[p.rfind("/") + 1 :]) for v, h, p in rules], "v string, h string, p string, folder string, last string")
    p = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    keys = p.withColumn("h", F.explode(F.expr("array_append(transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i)), '')"))).dropDuplicates(["row", "h"])
    keys = keys.withColumn("folder", F.explode(F.expr("transform(sequence(0, size(split(path, '/')) - 1), i -> if(i = 0, '', concat(substring_index(path, '/', i), '/')))")))
    hits = keys.join(r, ["h", "folder"]).filter(F.expr("startswith(path, p)") & ((F.col("host") != "") | (F.col("path") != "")))
    best = hits.groupBy("row").agg(F.max(F.struct(F.expr("char_length(h) + char_length(p)"), F.expr("if(h = '', 0, size(split(h, '[.]')))"), "v", F.concat("h", "p").alias("rule"))).alias("best"))
    out = p.join(best, "row", "left")
    return out.select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict; allow where no rule fits."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


OP9_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), found AS (
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for v, h, p in RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict
FROM found
"""
