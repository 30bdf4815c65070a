"""URL filters: allow and block rules by host and path, the longest match wins.

The rules are compiled into a trie over reversed host labels; each host node has a trie over path segments whose
nodes keep the rules that end there by the start of the next segment. A trie of at most ``BLOCK_RULES`` rules is
broadcast; a longer list is cut into blocks that the urls pass one after another, and the longest match of all holds.

Defined cases: a null url, or one without ``://``, has an empty host and path, and no rule fits an empty host; the
host keeps a port or user part as written; a rule without a host fits nothing; of equal rules the first by action (allow
before block) holds; an empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import table

Rule = tuple[str, str, str]  # action, host, path
#: Rules of a block: at under 1 kB each in the trie, a broadcast stays under about 200 MB.
BLOCK_RULES = 200_000


class Trie:
    """Nodes are dicts: host labels, then path segments; ``""`` never occurs as a label key."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for action, host, path in sorted((rule for rule in rules if rule[1]), reverse=True):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("path", {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", {})[last] = (action, f"{host}{path}", len(host))

    def match(self, host: str, path: str) -> tuple[str, str, int] | None:
        """Action, name and length of the host of the rule with the longest host, then the longest path."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            best = self._path(node.get("path"), segments) or best
        return best

    @staticmethod
    def _path(node: dict | None, segments: list[str]) -> tuple[str, str, int] | None:
        best = None
        for segment in segments:
            if node is None:
                break
            if ends := node.get("ends"):
                for n in range(min(len(segment), max(map(len, ends))), -1, -1):
                    if segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
            node = node.get("segments", {}).get(segment)
        return best


def _parsed(pages: DataFrame, url: str) -> DataFrame:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) for each row; ``default`` is the verdict where no rule fits."""
    rows = _parsed(pages.select(F.col(key), F.col(url)), url).select(F.col(key).alias("key"), "host", "path", F.lit(None).cast(MATCH).alias("match"))
    for n in range(0, len(rules), block_rules):
        rows = _judged(rows, rows.sparkSession.sparkContext.broadcast(Trie(rules[n : n + block_rules])))
    return rows.select(F.col("key").alias(key), "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.action", F.lit(default)).alias("verdict"))


MATCH = T.StructType([T.StructField("action", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("host_length", T.IntegerType())])
_MATCH = pa.struct([("action", pa.string()), ("rule", pa.string()), ("host_length", pa.int32())])


def _longer(found: tuple[str, str, int] | None, before: dict | None) -> dict | None:
    """The longer of a trie's match and that of the blocks before: by host, then path; of equal ones allow."""
    mine = found and {"action": found[0], "rule": found[1], "host_length": found[2]}
    return max((x for x in (before, mine) if x), key=lambda x: (x["host_length"], len(x["rule"]), x["action"] == "allow"), default=None)


def _judged(rows: DataFrame, trie) -> DataFrame:  # noqa: ANN001
    """One pass of all urls over one block of rules."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, before = (batch.column(n).to_pylist() for n in (1, 2, 3))
            found = [_longer(trie.value.match(h, p), b) for h, p, b in zip(host, path, before)]
            yield batch.set_column(3, pa.field("match", _MATCH), pa.array(found, _MATCH))

    return rows.mapInArrow(judge, rows.schema)


#: The rules of the query.
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


OP9_SQL = """
WITH r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(action, rhost, rpath)),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
    FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
