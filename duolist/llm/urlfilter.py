"""URL filters: a trie over reversed host labels, then path segments, with the longest match deciding between allow and block."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duolist.llm.common import Batches

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rules that are sent to every task; lists beyond that are refused, since each worker holds all of them.
MOST_RULES = 1_000_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host is what follows the first :// up to /, ? or #, its A-Z lowered; the path goes on up to ? or #."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    return (rest, "")[0].translate(_LOWER) if at < 0 else rest[:at].translate(_LOWER), "" if at < 0 else rest[at:]


class HostTrie:
    """Labels of hosts from the last to the first; a node of a rule's host holds a trie of path segments.

    A path rule ends in a segment that may be cut short: /en/7 fits /en/7 and /en/71, /en/ fits whatever lies below /en/.
    """

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for rule in sorted(set(rules), key=lambda r: r.verdict):  # of equal rules with both verdicts, block stays
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            paths = node.setdefault(None, {})  # no label is None
            *whole, last = rule.path.split("/")
            for segment in whole:
                paths = paths.setdefault(segment, {})
            paths.setdefault(None, {})[last] = rule

    def find(self, host: str, path: str) -> Rule | None:
        """The fitting rule with the most host labels and, among those, the longest path."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._path(node.get(None), segments) or best
        return best

    @staticmethod
    def _path(paths: dict | None, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            if paths is None:
                break
            ends = paths.get(None)
            if ends:
                best = next((ends[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in ends), best)
            paths = paths.get(segment)
        return best


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    The longest fitting rule gives the verdict, `otherwise` where none fits (rule is then null). A null url or one without ://
    has an empty host and path and fits no rule unless a rule's host is empty. Repeated rows and null ids stay; other columns
    aren't read; an empty table gives an empty table.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than the {MOST_RULES} that are sent to every task")
    shared = pages.sparkSession.sparkContext.broadcast(HostTrie(rules))

    def run(batches: Batches) -> Batches:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.find(*p) for p in parts]
            columns = [batch.column(0), *(pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], [r and r.host + r.path for r in found], [r.verdict if r else otherwise for r in found]))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
