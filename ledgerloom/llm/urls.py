"""URL filters: a bit-parallel automaton for all glob rules at once.

Rules become states in multiword Shift-And masks; a batch of canonical URLs is read one character
position at a time, every URL and every rule in the same few numpy operations. In a glob * stands
for any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict); a rule holds for its host and all subdomains, the longest wins.
# fixed values
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Globs over host and path that block a URL which no rule fits; everything else is allowed.
# fixed values
BLOCKED = ("*spam*", "*cheap-pills*", "*free-bets*", "*casino*", "*adult*", "*/wp-login*", "*/track/*.gif")


#: Stands between host and path where the automaton reads them; no UTF-8 text has this byte.
END_OF_HOST = b"\xff"


class Globs:
    """The automaton of some globs over bytes.

    A state is "this many characters of the glob have matched"; state bits of all globs lie one after
    the other in 64-bit words. A star keeps its state.
    """

    def __init__(self, globs: tuple[bytes, ...]):
        self.n = len(globs)
        bits, self.ends = 0, []
        stay, begin, move = [], [], {}
        for g in globs:
            begin.append(bits)
            state = bits
            for c in g:
                if c == 42:
                    stay.append(state)
                else:
                    move.setdefault(c, []).append(state + 1)
                    state += 1
            self.ends.append(state)
            bits = state + 1
        self.words = -(-bits // 64) or 1
        self.begin, self.stay = self._mask(begin), self._mask(stay)
        self.move = np.zeros((256, self.words), np.uint64)
        for c, states in move.items():
            self.move[c] = self._mask(states)

    def _mask(self, states: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for s in states:
            out[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        return out

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Whether url i matches glob k, as a table."""
        out = np.zeros((len(urls), self.n), bool)
        length = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-length, kind="stable")  # those still being read come first
        raw = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        start = np.concatenate([[0], np.cumsum(length[order])[:-1]]) if len(urls) else length
        state = np.tile(self.begin, (len(urls), 1))
        for at in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length[order], -at, side="left"))
            now = state[:live]
            char = raw[start[:live] + at]
            step = now << np.uint64(1)
            step[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (step & self.move[char]) | (now & self.stay)
        for k, s in enumerate(self.ends):
            out[order, k] = (state[:, s // 64] >> np.uint64(s % 64)) & np.uint64(1) == 1
        return out


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host in lower case (A-Z) and path; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def judge_urls(pages: DataFrame, rules: tuple = RULES, blocked: tuple = BLOCKED) -> DataFrame:
    """A row per input row: page_id, host, path, rule (null if none fits) and verdict.

    The longest fitting rule decides, else the globs: block if any matches, else allow. A null url
    or one without :// has an empty host and path, so no rule. Rows with the same page_id each
    give a row. Other columns are ignored; an empty table gives no rows.
    """
    names = [h + p for h, p, _ in rules]
    globs = tuple(start + h.encode() + END_OF_HOST + p.encode() + b"*" for h, p, _ in rules for start in (b"", b"*.")) + tuple(g.encode() for g in blocked)
    by_length = sorted(range(len(rules)), key=lambda k: -len(names[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Globs(globs)
        for batch in batches:
            urls = [h.encode("utf-8", "surrogatepass") + END_OF_HOST + p.encode("utf-8", "surrogatepass") for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            hit = automaton.match(urls)
            rule: list[str | None] = [None] * len(urls)
            verdict = np.where(hit[:, 2 * len(rules) :].any(axis=1), "block", "allow").tolist()
            fits = hit[:, : 2 * len(rules)].reshape(len(urls), len(rules), 2).any(axis=2)
            for i in np.flatnonzero(fits.any(axis=1)).tolist():
                k = next(k for k in by_length if fits[i, k])
                rule[i], verdict[i] = names[k], rules[k][2]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = split_url(F.col("url"))
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).na.fill("", ["host", "path"])
    return ready.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
