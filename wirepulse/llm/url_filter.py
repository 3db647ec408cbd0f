"""Allow and block lists of URL prefixes: the longest rule that fits decides.

A rule is (verdict, host, path). It fits its host and all subdomains when the URL's path starts
with the rule's path; an empty rule path fits any path. The rules form a trie over the labels of the
host from the right and then over the path's segments. Every rule met on the walk fits; the one with
the longest text wins, and of equally long ones a block.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
# Up to this many rules the trie is sent to every executor (about 300 bytes a rule); longer lists
# are joined.
MAX_TRIE_RULES = 500_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _segments(path: str) -> list[str]:
    """Pieces that keep their slash: ``/en/a`` is ``/``, ``en/``, ``a``."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + parts[-1:] * bool(parts[-1])


def _better(new: tuple[str, str], old: tuple[str, str] | None) -> bool:
    return old is None or (len(new[0]), new[1] == BLOCK) > (len(old[0]), old[1] == BLOCK)


class UrlTrie:
    """Nested dictionaries: ``("h", label)`` and ``("s", segment)`` lead down, ``"paths"`` from a host
    to its path nodes; a node holds ``"rule"`` and, for rules that end inside a segment, ``"heads"``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            node = node.setdefault("paths", {})
            pieces = _segments(path)
            head = pieces.pop() if pieces and not pieces[-1].endswith("/") else None
            for piece in pieces:
                node = node.setdefault(("s", piece), {})
            entry = (host + path, verdict)
            if head is not None:
                heads = node.setdefault("heads", {})
                if _better(entry, heads.get(head)):
                    heads[head] = entry
            elif _better(entry, node.get("rule")):
                node["rule"] = entry

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule text, verdict) of the longest rule that fits."""
        best = None
        node, pieces = self.root, _segments(path)
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            found = self._along(node.get("paths"), pieces)
            if found and _better(found, best):
                best = found
        return best

    @staticmethod
    def _along(node: dict | None, pieces: list[str]) -> tuple[str, str] | None:
        best, depth = None, 0
        while node is not None:
            if "rule" in node and _better(node["rule"], best):
                best = node["rule"]
            if depth == len(pieces):
                break
            piece = pieces[depth]
            heads = node.get("heads")
            if heads:
                for n in range(len(piece), 0, -1):
                    if piece[:n] in heads:
                        if _better(heads[piece[:n]], best):
                            best = heads[piece[:n]]
                        break
            node, depth = node.get(("s", piece)), depth + 1
        return best


def filter_urls(
    df: DataFrame,
    rules: DataFrame | Iterable[tuple[str, str, str]],
    url: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """``df`` with host, path, rule (text or null) and verdict; columns of these names are replaced.

    ``rules`` is a list of (verdict, host, path), or a table with these columns for lists beyond
    ``MAX_TRIE_RULES``. Null URLs and URLs without ``://`` have an empty host and path, fit no rule
    and get ``default``. Repeated rows are judged alike; an empty table stays empty.
    """
    parsed = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if isinstance(rules, DataFrame):
        head = rules.select("verdict", "host", "path").take(MAX_TRIE_RULES + 1)
        if len(head) > MAX_TRIE_RULES:
            return _joined(parsed, rules, default)
        rules = [tuple(r) for r in head]
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    judged = parsed.withColumn("_judged", judge("host", "path"))
    return judged.withColumns(
        {"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}
    ).drop("_judged")


def _joined(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule lists of any length: each distinct (host, path) meets the rules of its host
    suffixes by an equi-join."""
    labels = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    texts = rules.select(
        F.col("host").alias("_suffix"), F.col("path").alias("_prefix"), F.col("verdict").alias("_v")
    ).distinct()
    pairs = parsed.select("host", "path").distinct().withColumn("_suffix", F.explode(suffix))
    fits = pairs.join(texts, "_suffix").filter(F.col("path").startswith(F.col("_prefix")))
    text = F.concat("_suffix", "_prefix")
    rank = F.struct(F.length(text), F.col("_v") == BLOCK)
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(text.alias("r"), "_v"), rank).alias("_b"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.withColumns(
        {"rule": F.col("_b.r"), "verdict": F.coalesce("_b._v", F.lit(default))}
    ).select(*[c for c in parsed.columns if c not in ("rule", "verdict")], "rule", "verdict")
