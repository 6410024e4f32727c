"""URL filters: all glob rules at once by a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, map_pandas

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over host + path that block a URL no host rule fits. * stays within a path segment, ** crosses '/', ? is one character.
BLOCK_GLOBS = (
    "ad.**", "ads.**", "ads-**", "adserver**", "*.ads.**", "*-ads.**", "track.**", "tracker.**", "tracking.**", "*-track.**", "*-tracker.**", "pixel.**",
    "**/ads/**", "**/adserver/**", "**/banner/**", "**/popunder/**", "**doubleclick.**",
)
#: Bytes of one batch's matrices (URLs x length, URLs x words of states).
CELLS = 1 << 22


@dataclass(frozen=True)
class Automaton:
    """States of all patterns packed into words of 64 bits.

    State i of a pattern means: its first i literals have been read. step[c] has
    the states that byte c advances, stay[c] those that a wildcard keeps on c."""

    start: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    final: np.ndarray

    @staticmethod
    def compile(globs: list[str]) -> Automaton:
        states = start = 0
        step, stay, final = [0] * 256, [0] * 256, []
        for glob in globs:
            start |= 1 << states
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    crosses = raw[i : i + 2] == b"**"
                    for c in range(256):
                        if crosses or c != 0x2F:
                            stay[c] |= 1 << states
                    i += 1 + crosses
                    continue
                for c in range(256) if raw[i : i + 1] == b"?" else (raw[i],):
                    if raw[i : i + 1] != b"?" or c != 0x2F:
                        step[c] |= 1 << states
                states, i = states + 1, i + 1
            final.append(states)
            states += 1
        words = max(1, -(-states // 64))
        pack = lambda x: [(x >> (64 * w)) & (2**64 - 1) for w in range(words)]
        return Automaton(np.array(pack(start), np.uint64), np.array([pack(x) for x in step], np.uint64), np.array([pack(x) for x in stay], np.uint64), np.array(final, np.int64))

    def match(self, strings: list[bytes]) -> np.ndarray:
        """Boolean matrix: string x pattern."""
        out = np.zeros((len(strings), len(self.final)), bool)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, CELLS // max(1, len(strings[order[at]]), 8 * len(self.start)))]
            out[rows] = self._run([strings[i] for i in rows])
            at += len(rows)
        return out

    def _run(self, strings: list[bytes]) -> np.ndarray:
        """strings: longest first."""
        lengths = np.array([len(s) for s in strings])
        state = np.tile(self.start, (len(strings), 1))
        width = int(lengths[0]) if len(lengths) else 0
        text = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        for j in range(width):
            live = int(np.searchsorted(-lengths, -j, "left"))
            s, c = state[:live], text[:live, j]
            moved = s & self.step[c]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            state[:live] = shifted | (s & self.stay[c])
        return (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in host), path


def rules_of(rules: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """Host rules of a table (verdict, host, path), for filter_urls. The automaton is in every worker's memory, about 4 KB a state word, so a table of rules is small."""
    return tuple((r["verdict"], r["host"], r["path"] or "/") for r in rules.select("verdict", "host", "path").where("host is not null").distinct().orderBy("host", "path", "verdict").collect())


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict and the block globs that match, for each row of pages.

    Host rules become two globs each (the host, and "*." before it); of those that
    fit, the longest gives rule and verdict, an earlier one first among equals.
    Without any, rule is null and a matching block glob decides, else allow.
    A null, empty or malformed URL has empty host and path, and no rule, so it is allowed. Very long URLs are read whole; repeated rows are judged alike.
    Other columns of pages, whatever their names, are left out; an empty table gives no rows. Rows are neither joined nor moved."""
    bound_batches(pages.sparkSession)
    ranked = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    globs = [g for _, h, p in ranked for g in (f"{h}{p}**", f"*.{h}{p}**")]
    automaton, own = Automaton.compile([*globs, *block_globs]), len(ranked)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [split_url(u) for u in b["url"]]
            found = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
            fits = found[:, 0 : 2 * own : 2] | found[:, 1 : 2 * own : 2]
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
            other = found[:, 2 * own :]
            yield pd.DataFrame({
                "page_id": b["page_id"],
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [None if k < 0 else ranked[k][1] + ranked[k][2] for k in first],
                "verdict": [ranked[k][0] if k >= 0 else ("block" if any(o) else "allow") for k, o in zip(first, other, strict=True)],
                "globs": [[block_globs[i] for i in np.flatnonzero(o)] for o in other],
            })

    return pages.select(F.col("page_id").cast("long"), "url").transform(map_pandas, judge, "page_id long, host string, path string, rule string, verdict string, globs array<string>")
