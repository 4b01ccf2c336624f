"""URL filters by a bit-parallel wildcard automaton.

All rules are glob patterns over the canonical URL (host in lower case, then the path), packed side by
side into 64-bit words. A Shift-And step per byte moves the states of all patterns of all URLs of a
batch at once; a star is a state that keeps itself alive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_arrow, type_of

ANY, HOST = -1, -2  # stars: over any byte; over the bytes of a host, which end at "/"
ONE = -3  # a question mark


@dataclass(frozen=True)
class Rule:
    """action: allow or block. name: what is reported. patterns: each a tuple of byte values and ANY,
    HOST or ONE. rank: the largest rank among the rules that fit wins; earlier rules win ties."""

    action: str
    name: str
    patterns: tuple[tuple[int, ...], ...]
    rank: int


def host_rule(action: str, rule: str) -> Rule:
    """host/path: the host and its subdomains, with paths that start so. Longer rules win."""
    body = tuple(rule.encode()) + (ANY,)
    return Rule(action, rule, (body, (HOST, ord("."), *body)), len(rule))


def glob_rule(action: str, glob: str) -> Rule:
    """A glob over host and path with * and ?; it ranks below every host rule."""
    marks = {ord("*"): ANY, ord("?"): ONE}
    return Rule(action, glob, (tuple(marks.get(b, b) for b in glob.encode()),), 0)


class Automaton:
    """The patterns of all rules as masks of several words: bit i of a pattern stands for i elements read."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        plan, size = [], 0
        for p in patterns:
            plan.append(size)
            size += 1 + sum(c not in (ANY, HOST) for c in p)
        self.words = max(1, -(-size // 64))
        step, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.final = np.zeros(self.words, np.uint64), []
        for p, at in zip(patterns, plan, strict=True):
            self.start[at >> 6] |= np.uint64(1 << (at & 63))
            for c in p:
                if c in (ANY, HOST):
                    for b in range(256):
                        if c == ANY or b != 0x2F:
                            stay[b, at >> 6] |= np.uint64(1 << (at & 63))
                    continue
                at += 1
                for b in range(256) if c == ONE else (c,):
                    step[b, at >> 6] |= np.uint64(1 << (at & 63))
            self.final.append(at)
        self.step, self.stay = step, stay

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns): which patterns fit each text as a whole."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        state = np.tile(self.start, (len(texts), 1))
        bytes_of = [np.frombuffer(texts[i], np.uint8) for i in order]
        longest, block = (int(lengths[0]) if len(texts) else 0), 256
        for low in range(0, longest, block):  # a block of columns at a time: a long URL costs its own bytes only
            alive = int(np.searchsorted(-lengths, -low, side="left"))
            grid = np.zeros((alive, block), np.uint8)
            for r in range(alive):
                part = bytes_of[r][low : low + block]
                grid[r, : len(part)] = part
            for j in range(min(block, longest - low)):
                k = int(np.searchsorted(-lengths, -(low + j), side="left"))
                if not k:
                    break
                d, c = state[:k], grid[:k, j]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:k] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.zeros((len(texts), len(self.final)), bool)
        for p, at in enumerate(self.final):
            out[order, p] = (state[:, at >> 6] >> np.uint64(at & 63)) & np.uint64(1)
        return out


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL: id_col, host, path, rule (the name of the fitting rule of the largest rank, else
    null), verdict (that rule's action, else default).

    Defined cases: a null URL, or one without ://, has an empty host and path and gets the default unless
    a pattern fits the empty text; repeated rows are judged each; an empty table gives no rows; other
    columns are ignored. A narrow pass: no shuffle. The rules, a parameter, go to each task.
    """
    of = [r for r, rule in enumerate(rules) for _ in rule.patterns]
    automaton = Automaton([p for rule in rules for p in rule.patterns])
    order = sorted(range(len(rules)), key=lambda r: -rules[r].rank)

    def judge(batch: pa.RecordBatch) -> dict:
        host, path = batch.column("host"), batch.column("path")
        urls = [(h + p).encode() for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
        fits = automaton.matches(urls)
        best = np.full(len(urls), -1)
        for r in reversed(order):
            best[fits[:, [i for i, x in enumerate(of) if x == r]].any(1)] = r
        return {
            id_col: batch.column(id_col),
            "host": host,
            "path": path,
            "rule": [rules[r].name if r >= 0 else None for r in best],
            "verdict": [rules[r].action if r >= 0 else default for r in best],
        }

    url = F.col(url_col)
    canonical = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    return map_arrow(canonical, judge, f"`{id_col}` {type_of(pages, id_col)}, host string, path string, rule string, verdict string")
