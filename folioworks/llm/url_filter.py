"""Allow and block pages by URL rules that are found through their rarest token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules travel with every task; a longer list has to be split by the caller.
MOST_RULES = 200_000

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains, ``path`` is what the path starts with."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        end = "" if self.path else r"(?:/|\Z)"
        return r"\A(?:[^/]*\.)?" + re.escape(self.host) + re.escape(self.path) + end

    def tokens(self) -> set[str]:
        """Tokens that every URL that fits has, whole: the last one of a path may go on, so it counts only if closed."""
        found = set(_TOKEN.findall(self.host))
        closed = re.sub(r"[A-Za-z0-9]+\Z", "", self.path)
        return found | set(_TOKEN.findall(closed.lower()))


@dataclass(frozen=True)
class Pattern:
    """A rule of the filter's own: a literal word (letters, digits, inner hyphens) in the host or the path."""

    word: str
    verdict: str

    @property
    def name(self) -> str:
        return self.word

    def regex(self) -> str:
        return r"(?<![A-Za-z0-9])(?i:" + re.escape(self.word) + r")(?![A-Za-z0-9])"

    def tokens(self) -> set[str]:
        return set(_TOKEN.findall(self.word.lower()))


def split_url(url):
    """Host (lower case) and path columns of a URL column; both empty without ``://`` or for NULL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[Rule], patterns: list[Pattern], default: str = "allow") -> DataFrame:
    """A verdict for every page.

    Every rule is filed under that of its literal tokens that is rarest in the URLs at hand (counted over all pages,
    ties by code point); rules without a token are filed apart and always tried. The distinct tokens of a URL fetch
    its candidate rules, and only those run their regular expression. The longest of the ``rules`` that fit decides
    (ties: block, then the smaller name); else the ``patterns``, block before allow; else ``default``.

    Returns page_id, host, path, rule (NULL if none fits), verdict for every row of ``pages``. A NULL URL or one
    without ``://`` has an empty host and path and gets ``default``. Repeated rows and ids stay; other columns are
    not read. No row moves between tasks: the rules are a bounded list, the counts are one row per token of a rule.
    """
    if len(rules) + len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    wanted = {t for r in [*rules, *patterns] for t in r.tokens()}
    seen = split.select("host", "path").mapInArrow(_counter(wanted), "token string, n long")
    frequency = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    index = indexed([*rules, *patterns], frequency)
    schema = "page_id long, host string, path string, rule string, verdict string"
    kind = dict(split.dtypes)["page_id"]
    return split.mapInArrow(_judge(index, default), schema.replace("page_id long", f"page_id {kind}"))


def indexed(rules: list, frequency: dict[str, int]) -> dict[str, list]:
    """Rules by their rarest token; under the empty token those that have none."""
    index = defaultdict(list)
    for rule in rules:
        rarest = min(rule.tokens(), key=lambda t: (frequency.get(t, 0), t), default="")
        index[rarest].append(rule)
    return dict(index)


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall(f"{host}{path}".lower()))


def _counter(wanted: set[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(wanted, 0)
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for token in url_tokens(host, path) & wanted:
                    totals[token] += 1
        some = {t: n for t, n in totals.items() if n}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], ["token", "n"]
        )

    return count


def decide(host: str, path: str, index: dict[str, list], compiled: dict, default: str) -> tuple[str | None, str]:
    best, own = None, None
    url = host + path
    for token in (url_tokens(host, path) & index.keys()) | ({""} & index.keys()):
        for rule in index[token]:
            if not compiled[rule].search(url):
                continue
            rank = (-len(rule.name), rule.verdict != "block", rule.name)
            if isinstance(rule, Pattern):
                own = rule.verdict if own != "block" else own
            elif best is None or rank < best[0]:
                best = rank, rule
    if best:
        return best[1].name, best[1].verdict
    return None, own or default


def _judge(index: dict[str, list], default: str):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r: re.compile(r.regex()) for found in index.values() for r in found}
        for batch in batches:
            found = [
                decide(host, path, index, compiled, default)
                for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return judge
