"""URL filters: glob rules run as one bit-parallel wildcard automaton.

All patterns are packed end to end into multiword bit masks.  A pattern of m literals takes m + 1 bits, one for
each matched prefix; ``*`` and ``**`` are self-loops of a prefix.  One step per byte of the canonical URL,
D = ((D << 1) & B[byte]) | (D & S[byte]), advances every pattern at once, for a whole column of URLs.

Canonical URL: ``.`` + host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) + path
(then up to ``?``, ``#`` or the end).  ``*`` stays inside a path component, ``**`` doesn't, ``\\`` quotes.

Rows: a null url, or one without ``://``, has an empty host and path, no rule fits, the default verdict holds.
Urls of any length are stepped through whole.  Each row is judged by itself, so repeated rows, ties and empty
tables need nothing special.  Only the url and the columns in ``keep`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEME_REST = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        quoted = "".join("\\" + c if c in "*?\\" else c for c in "." + self.host + self.path)
        return f"*{quoted}**"


class Automaton:
    """Shift-And masks of many glob patterns, matched against whole byte strings."""

    def __init__(self, globs: list[str]):
        prefixes: list[list[tuple[object, str]]] = []
        for g in globs:
            prefixes.append(self._parse(g.encode()))
        bits = sum(len(p) for p in prefixes)
        self.words = max(1, -(-bits // 64))
        self.step, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.final = np.zeros(self.words, np.uint64), []
        at = 0
        for p in prefixes:
            for k, (literal, loop) in enumerate(p):
                word, bit = divmod(at, 64)
                one = np.uint64(1 << bit)
                if k == 0:
                    self.start[word] |= one
                elif literal is None:
                    self.step[np.arange(256) != ord("/"), word] |= one
                else:
                    self.step[literal, word] |= one
                if loop == "*":
                    self.stay[np.arange(256) != ord("/"), word] |= one
                elif loop == "**":
                    self.stay[:, word] |= one
                at += 1
            self.final.append(divmod(at - 1, 64))

    @staticmethod
    def _parse(glob: bytes) -> list[tuple[object, str]]:
        """(byte that leads to this prefix, or None for any; its self-loop) for each prefix, the empty one first."""
        out: list[tuple[object, str]] = [(-1, "")]
        i = 0
        while i < len(glob):
            c = glob[i : i + 1]
            if c == b"*":
                wide = glob[i : i + 2] == b"**"
                out[-1] = (out[-1][0], "**" if wide or out[-1][1] == "**" else "*")
                i += 1 + wide
                continue
            if c == b"\\" and i + 1 < len(glob):
                i += 1
                c = glob[i : i + 1]
                out.append((c[0], ""))
            else:
                out.append((None if c == b"?" else c[0], ""))
            i += 1
        return out

    def run(self, subjects: list[bytes]) -> np.ndarray:
        """bool (subjects, patterns): which patterns match which whole subject."""
        out = np.zeros((len(subjects), len(self.final)), bool)
        order = sorted(range(len(subjects)), key=lambda i: -len(subjects[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(subjects[order[at]]))
            block = order[at : at + max(1, min(8192, 4_000_000 // longest))]
            at += len(block)
            out[block] = self._block([subjects[i] for i in block], longest)
        return out

    def _block(self, subjects: list[bytes], longest: int) -> np.ndarray:
        n = len(subjects)
        chars = np.zeros((longest, n), np.uint8)
        lengths = np.array([len(s) for s in subjects])
        for k, s in enumerate(subjects):
            chars[: len(s), k] = np.frombuffer(s, np.uint8)
        d = np.broadcast_to(self.start, (n, self.words)).copy()
        for t in range(longest):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # subjects are sorted: the longest come first
            if not live:
                break
            c, now = chars[t, :live], d[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:live] = (moved & self.step[c]) | (now & self.stay[c])
        return np.stack([(d[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in self.final], axis=1).astype(bool) if self.final else np.zeros((n, 0), bool)


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, ``host, path, rule, verdict``: of the rules that fit, the longest decides, else ``default``.

    Rules of equal length are taken in the order given.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([r.glob for r in ranked])
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def decide(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        fits = automaton.run([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in zip(host, path)])
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if len(ranked) else np.zeros(len(host), int)
        return pd.DataFrame({"rule": names[first], "verdict": verdicts[first]})

    subject = F.coalesce(F.col(url).cast("string"), F.lit(""))
    parts = pages.select(*keep, F.translate(F.regexp_extract(subject, SCHEME_REST, 1), UPPER, LOWER).alias("host"), F.regexp_extract(subject, SCHEME_REST, 2).alias("path"))
    return parts.withColumn("judged", decide("host", "path")).select(*keep, "host", "path", "judged.rule", "judged.verdict")
