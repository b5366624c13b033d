"""URL filter: many glob rules run at once over each canonical URL, as one bit-parallel automaton."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

ONE = np.uint64(1)


class GlobAutomaton:
    """All globs packed side by side into the bits of a few 64-bit words (Shift-And).

    Each glob has a start bit and one bit per literal byte. ``*`` stands for any bytes, ``~`` for any but ``/``
    (a run inside the host): the bit before it keeps itself alive on those bytes. One shift, one AND with
    the byte's mask and one OR with the loops advance every glob by one byte of the URL.
    """

    def __init__(self, globs: Sequence[str]):
        bits = sum(1 + len(g.encode().replace(b"*", b"").replace(b"~", b"")) for g in globs)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros((256, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for glob in globs:
            self.start[at // 64] |= ONE << np.uint64(at % 64)
            for byte in glob.encode():
                if byte in b"*~":
                    runs_on = np.arange(256) != ord("/") if byte == ord("~") else np.ones(256, dtype=bool)
                    self.loop[runs_on, at // 64] |= ONE << np.uint64(at % 64)
                else:
                    at += 1
                    self.step[byte, at // 64] |= ONE << np.uint64(at % 64)
            self.final.append((at // 64, ONE << np.uint64(at % 64)))
            at += 1

    def match(self, urls: Sequence[str]) -> np.ndarray:
        """Boolean matrix (url, glob). Longest URLs first, so that each step works on those not yet at their end."""
        texts = [u.encode("utf-8", "surrogatepass") for u in urls]
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        state = np.tile(self.start, (len(texts), 1))
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            byte = data[first[:live] + step]
            now = state[:live]
            moved = now << ONE
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        found = np.empty((len(texts), len(self.final)), dtype=bool)
        for glob, (word, bit) in enumerate(self.final):
            found[order, glob] = (state[:, word] & bit) != 0
        return found


@functools.lru_cache(maxsize=8)
def automaton(globs: tuple[str, ...]) -> GlobAutomaton:
    """One automaton per rule set and Python worker."""
    return GlobAutomaton(globs)


def rule_globs(rule: str) -> tuple[str, str]:
    """A rule like ``example.com/en/`` (host, then path prefix): the host itself and its subdomains."""
    return f"{rule}*", f"~.{rule}*"


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or a URL without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], blocked_globs: Sequence[str] = (), url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) for every row.

    ``rules`` are (verdict, rule); the longest rule that fits a URL decides. Where none fits, a URL that matches
    one of ``blocked_globs`` (over host and path) is blocked, any other is allowed. Null urls and urls without
    ``://`` have an empty host and path and so fit no rule. Input columns with those names are replaced.
    Equal rules: the first counts. The work is local to each row: no shuffle; only the rules are sent to the tasks.
    """
    rules = sorted(dict((rule, verdict) for verdict, rule in reversed(list(rules))).items(), key=lambda r: (-len(r[0]), r[0]))
    globs = [g for rule, _ in rules for g in rule_globs(rule)] + list(blocked_globs)
    n = len(rules)

    @F.pandas_udf("int")
    def decide(canonical: pd.Series) -> pd.Series:
        """Index of the longest fitting rule; -1: none, and blocked by a glob; -2: none."""
        hits = automaton(tuple(globs)).match(canonical.tolist())
        by_rule = hits[:, : 2 * n].reshape(len(hits), n, 2).any(axis=2)
        fallback = np.where(hits[:, 2 * n :].any(axis=1), -1, -2)
        return pd.Series(np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), fallback) if n else fallback, dtype="int32")

    host, path = host_and_path(url)
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("__rule", decide(F.concat("host", "path")))
    names = F.array(*[F.lit(rule) for rule, _ in rules]).cast("array<string>")
    verdicts = F.array(*[F.lit(verdict) for _, verdict in rules]).cast("array<string>")
    fits = F.col("__rule") >= 0
    return rows.withColumns(
        {
            "rule": F.when(fits, F.get(names, "__rule")),
            "verdict": F.when(fits, F.get(verdicts, "__rule")).when(F.col("__rule") == -1, "block").otherwise("allow"),
        }
    ).drop("__rule")
