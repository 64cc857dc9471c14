"""URL filter: a trie over reversed host labels and, at each host, over path segments.

The rules become one small trie that is broadcast with the task closure, so a table of any
size is judged in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are refused: the trie is broadcast, so its size must have a bound (about 200 bytes a rule).
MAX_RULES = 200_000


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules: a host with all its subdomains, and the path that a url's path has to start with.
DEFAULT_RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


class _Node:
    __slots__ = ("kids", "paths")

    def __init__(self):
        self.kids: dict[str, _Node] = {}
        self.paths: _Path | None = None


class _Path:
    """A node of the path trie: whole segments below, rules that end here, rules that end inside the next segment."""

    __slots__ = ("kids", "rule", "tails")

    def __init__(self):
        self.kids: dict[str, _Path] = {}
        self.rule: Rule | None = None
        self.tails: list[Rule] = []


class UrlTrie:
    """Longest match: the deepest host that has a fitting path, and there the longest path.

    A rule that is given twice counts once; of rules for the same host and path with both
    verdicts, block holds.
    """

    def __init__(self, rules: Sequence[Rule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the trie is broadcast and takes at most {MAX_RULES}")
        self.root = _Node()
        for r in rules:
            if r.verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {r.verdict!r}")
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.kids.setdefault(label, _Node())
            at = node.paths = node.paths or _Path()
            *whole, tail = r.path.split("/")
            for segment in whole:
                at = at.kids.setdefault(segment, _Path())
            if tail:
                same = [x for x in at.tails if x.path == r.path]
                if not same or (r.verdict == "block" and same[0].verdict == "allow"):
                    at.tails = sorted([x for x in at.tails if x.path != r.path] + [r], key=lambda x: -len(x.path))
            elif at.rule is None or r.verdict == "block":
                at.rule = r

    def find(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.kids.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._in_path(node.paths, segments) or best
        return best

    @staticmethod
    def _in_path(at: _Path, segments: list[str]) -> Rule | None:
        best = None
        for k, segment in enumerate(segments):
            best = at.rule or best
            for r in at.tails:
                if segment.startswith(r.path.rpartition("/")[2]):
                    best = r
                    break
            at = at.kids.get(segment) if k < len(segments) - 1 else None
            if at is None:
                break
        return best


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lowered; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, key: str, url: str = "url", rules: Sequence[Rule] = DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict), a row for each input row.

    A null url, or one without ://, has an empty host and path, fits no rule and gets the
    default verdict, as does every url without a fitting rule. Repeated rows stay; other input
    columns, whatever their names, are not read.
    """
    trie = UrlTrie(rules)

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r.name if r else None for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    parts = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return parts.withColumn("_", judged("host", "path")).select(key, "host", "path", "_.rule", "_.verdict")
