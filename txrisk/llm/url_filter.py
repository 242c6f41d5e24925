"""Allow and block lists for urls: a broadcast trie over reversed host labels and path segments.

A rule is (verdict, host, path prefix). It fits its host and every subdomain if the url's path
starts with the rule's path. Of the fitting rules the longest (host and path characters) wins; at
equal length the longer host, then ``block``. Urls without a fitting rule get ``default``.

Null urls and urls without ``://`` have an empty host and path and so get the default. Repeated
urls are judged alike; other columns are carried along, columns called host, path, rule or verdict
are replaced. An empty table gives an empty table.
"""

import sys

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])

MAX_RULES = 200_000  # what one broadcast may hold; more rules are an error, not a slow surprise
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class RuleTrie:
    """Host labels from the right, then path segments; the last segment of a rule is a prefix."""

    def __init__(self, rules, max_rules=MAX_RULES):
        rules = list(rules)
        if len(rules) > max_rules:
            raise ValueError(f"{len(rules)} rules are more than the {max_rules} that fit a broadcast")
        self.root = _host_node()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block") or not host or not path.startswith("/"):
                raise ValueError(f"not a rule: {(verdict, host, path)}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node["labels"].setdefault(label, _host_node())
            *whole, part = path.split("/")
            place = node["paths"]
            for segment in whole:
                place = place["segments"].setdefault(segment, _path_node())
            found = place["parts"].get(part)
            if found is None or verdict == "block":
                place["parts"][part] = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
            place["lengths"] = sorted({len(p) for p in place["parts"]}, reverse=True)

    def match(self, host, path):
        """(rule, verdict) of the longest fitting rule, or (None, None)."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            place = node["paths"]
            for segment in segments:
                for length in place["lengths"]:
                    found = place["parts"].get(segment[:length]) if length <= len(segment) else None
                    if found and (best is None or found > best):
                        best = found
                place = place["segments"].get(segment)
                if place is None:
                    break
        return best[3:] if best else (None, None)


def _host_node():
    return {"labels": {}, "paths": _path_node()}


def _path_node():
    return {"segments": {}, "parts": {}, "lengths": []}


def host_of(url):
    """What follows the first ``://`` up to a slash, question mark, hash or the end; A-Z lowered."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def judge_urls(pages, rules, url_column="url", default="allow", max_rules=MAX_RULES):
    """``pages`` with host, path, rule and verdict; one narrow pass, no shuffle."""
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules, max_rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        found = [match(host, path) for host, path in zip(hosts, paths)]
        return pd.DataFrame({
            "rule": pd.Series([f[0] for f in found], dtype=object),
            "verdict": pd.Series([f[1] or default for f in found], dtype=object),
        })

    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(f"`{url_column}`")
    parsed = pages.select(*[F.col(f"`{c}`") for c in others], host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judge("host", "path")
    return parsed.withColumn("__judged", judged).select(
        *[F.col(f"`{c}`") for c in others], "host", "path",
        F.col("__judged.rule").alias("rule"), F.col("__judged.verdict").alias("verdict"),
    )
