"""URL filtering by a sort-merge range join of reversed-host keys with nested host rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialise


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without a ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels of a host from last to first, each with a point after it: a domain's key starts all of its hosts'."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Nest:
    """The rules of one host that are active, by path; paths are looked up by each length that occurs."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: tuple[str, str]) -> None:
        if path not in self.paths:
            self.paths[path] = rule
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((self.paths[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


def _sweep(default: str):
    """Merge rules and urls, sorted by part and key: rules open on a stack, urls ask what is open."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            page, rule, verdict, host_, path_ = [], [], [], [], []
            columns = [batch.column(n).to_pylist() for n in ("part", "key", "kind", "page_id", "host", "path", "rule", "verdict")]
            for p, key, kind, page_id, host, path, own_rule, own_verdict in zip(*columns, strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1].key):  # nested intervals: the innermost ends first
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Nest(key))
                    stack[-1].add(path, (own_rule, own_verdict))
                    continue
                fits = [f for n in stack if (f := n.longest(path))]
                found = max(fits, key=lambda f: len(f[0])) if fits else (None, default)
                page.append(page_id)
                host_.append(host)
                path_.append(path)
                rule.append(found[0])
                verdict.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(page, batch.schema.field("page_id").type), *(pa.array(x, pa.string()) for x in (host_, path_, rule, verdict))],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return each


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    rows_per_part: int = 100_000,
    max_parts: int = 4096,
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` holds (verdict, host, path). A rule fits its host and all subdomains when the url's path starts with
    the rule's; the longest host and path together wins, ``rule`` names it, and ``default`` is the verdict where
    none fits. A host's key is its labels reversed, so a rule covers an interval of keys, and intervals nest. Urls
    are ranged by key and cut into parts at about every ``rows_per_part`` rows; a rule is dealt to each part that its
    interval meets; then one sorted sweep over each part keeps the stack of open rules. A key of very many urls is
    spread over several parts by a hash that follows it in the order.

    Null urls and such without ``://`` have an empty host and path and fit no rule, and so do urls without a path
    where all rules ask for one. Repeated rows each get their row. Of rules for one host and path the first counts
    (in a table: the smallest verdict). Empty tables give an empty result; extra columns are ignored.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(
            [(v, h, p, i) for i, (v, h, p) in enumerate(rules)], "verdict string, host string, path string, place int"
        )
    else:
        rules = rules.select("verdict", "host", "path", F.lit(0).alias("place"))
    rules = rules.where("host <> ''").withColumn("key", host_key(F.col("host")))
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col("url")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    urls = urls.withColumns({"key": host_key(F.col("host")), "salt": F.xxhash64("page_id", "path")})
    urls = materialise(urls)
    bounds = _bounds(urls, rows_per_part, max_parts)
    urls = urls.mapInArrow(
        _parts(bounds), f"page_id {kind}, host string, path string, key string, salt long, part int, last int"
    ).withColumns({"kind": F.lit(1), "place": F.lit(0), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    rules = rules.select(
        F.lit(None).cast(kind).alias("page_id"), "host", "path", "key", F.lit(None).cast("long").alias("salt"), "place",
        F.concat("host", "path").alias("rule"), "verdict",
    ).mapInArrow(
        _parts(bounds),
        f"page_id {kind}, host string, path string, key string, salt long, place int, rule string, verdict string, part int, last int",
    )
    rules = rules.withColumns({"part": F.explode(F.sequence("part", "last")), "kind": F.lit(0)})
    names = ["part", "key", "kind", "place", "salt", "page_id", "host", "path", "rule", "verdict"]
    events = urls.select(names).unionByName(rules.select(names))
    dealt = events.repartition("part").sortWithinPartitions("part", "key", "kind", "place", "verdict", "salt")
    found = dealt.mapInArrow(
        _sweep(default), f"page_id {kind}, host string, path string, rule string, verdict string"
    )
    return found.withColumnRenamed("page_id", id_col)


def _bounds(urls: DataFrame, rows_per_part: int, max_parts: int, per_cut: int = 20) -> list[tuple[str, int]]:
    """Where to cut the order of urls so that parts are about even: from a hash sample of ``per_cut`` rows a cut.

    The sample decides balance only; every url and rule is placed by the bounds whatever they are. It is bounded by
    ``max_parts``; parts beyond that grow, which costs no memory, as a part is sorted by Spark and swept in a stream.
    """
    rows = urls.count()
    parts = min(max_parts, -(-rows // rows_per_part))
    if parts <= 1:
        return []
    most = 1 << 40
    drawn = urls.where(F.pmod(F.xxhash64("salt", F.lit("cut")), F.lit(most)) < int(min(1.0, per_cut * parts / rows) * most))
    places = sorted((r["key"], r["salt"]) for r in drawn.select("key", "salt").collect())
    step = len(places) / parts
    return sorted({places[int(i * step)] for i in range(1, parts)}) if places else []


def _parts(bounds: list[tuple[str, int]]):
    """Adds ``part`` and ``last``: for a url the part of its place, for a rule (no salt) all that its interval meets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, last = [], []
            for key, salt in zip(batch["key"].to_pylist(), batch["salt"].to_pylist(), strict=True):
                if salt is not None:
                    part.append(bisect_right(bounds, (key, salt)))
                    last.append(part[-1])
                else:
                    part.append(bisect_right(bounds, (key, -(2**63))))
                    last.append(bisect_left(bounds, (key[:-1] + "/", -(2**63))))  # "/" comes after the closing point
            columns = [*batch.columns, pa.array(part, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "last"])

    return each


RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
r AS (SELECT page_id, CASE WHEN p = 0 THEN '' ELSE substr(url, p + 3) END AS rest FROM u),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT h.page_id, max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.page_id)
SELECT h.page_id, host, path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
