"""Secret scans behind a trigram inverted index.

Every batch of documents becomes an index segment: postings from trigrams to the segment's
documents, for the trigrams that some rule's query names. A rule's Boolean query is derived from its
regular expression; it unites and intersects postings, and only documents it leaves are searched.
A rule without a mandatory trigram searches every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds as listed: pattern, group whose length counts, least length.
# fixed values
BASE = {
    "assign": (rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (rb"AKIA[A-Z0-9]+", 0, 16),
    "hex": (rb"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ that are long enough
}
#: Kinds that the index adds: well-known token formats.
# fixed values
ADDED = {
    "github": (rb"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (rb"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "stripe": (rb"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    "google": (rb"AIza[A-Za-z0-9_-]{35}", 0, 39),
    "jwt": (rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "key_block": (rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 26),
}
RULES = BASE | ADDED
SEGMENT_BYTES, SEGMENT_DOCS, MOST_STRINGS = 1 << 20, 4096, 32

# A query is None (every document), a trigram, ("and", queries) or ("or", queries).


def _all(queries: list) -> object:
    found = [q for q in queries if q is not None]
    return None if not found else found[0] if len(found) == 1 else ("and", found)


def _any(queries: list) -> object:
    if not queries or any(q is None for q in queries):
        return None
    return queries[0] if len(queries) == 1 else ("or", queries)


def _grams(strings: set[str]) -> object:
    """Of the strings that can stand at some place: one must, with all its trigrams."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes: list) -> object:
    """The query of a sequence. Strings that can end here are carried until they are too many or unknown text follows."""
    found, ends = [], {""}

    def cut() -> None:
        nonlocal ends
        found.append(_grams(ends))
        ends = {""}

    for op, arg in nodes:
        if op is sre.LITERAL:
            choices = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            choices = {chr(a).lower() for _, a in arg}
        elif op is sre.MAX_REPEAT and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL and arg[0] == 0:
            choices = {"", chr(arg[2][0][1]).lower()}
        elif op is sre.SUBPATTERN:
            inner = list(arg[3])
            exact = _strings(inner)
            if exact is None:
                cut()
                found.append(_walk(inner))
                continue
            choices = exact
        elif op is sre.BRANCH:
            exact = _strings([(op, arg)])
            if exact is None:
                cut()
                found.append(_any([_walk(list(b)) for b in arg[1]]))
                continue
            choices = exact
        else:
            cut()
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found.append(_walk(list(arg[2])))
            continue
        if len(ends) * len(choices) > MOST_STRINGS:
            cut()
        ends = {a + b for a in ends for b in choices}
    cut()
    return _all(found)


def _strings(nodes: list) -> set[str] | None:
    """All strings that a sequence matches, in lower case; None if they are many or unbounded."""
    out = {""}
    for op, arg in nodes:
        if op is sre.LITERAL:
            more = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            inner = _strings(list(arg[2]))
            more = None if inner is None else inner | {""}
        elif op is sre.SUBPATTERN:
            more = _strings(list(arg[3]))
        elif op is sre.BRANCH:
            each = [_strings(list(b)) for b in arg[1]]
            more = None if any(e is None for e in each) else set().union(*each)
        else:
            more = None
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: bytes) -> object:
    """The Boolean query that every text with a match satisfies, over lower-cased trigrams."""
    return _walk(list(_parser.parse(pattern.decode("latin-1"))))


def trigrams_of(query: object) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """Postings of one batch of texts, for the given trigrams."""

    def __init__(self, texts: list[bytes], trigrams: list[str]):
        self.n = len(texts)
        raw = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0\0", np.uint8).astype(np.uint32)
        code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        known = np.zeros(1 << 24, np.uint8)
        wanted = {(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]): t for t in trigrams}
        known[list(wanted)] = 1
        at = np.flatnonzero(known[code])
        bounds = np.cumsum([len(t) + 2 for t in texts])
        owner, code = np.searchsorted(bounds, at, side="right"), code[at]
        self.postings = {t: np.unique(owner[code == c]) for c, t in wanted.items()}

    def find(self, query: object) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(query, np.zeros(0, np.int64))
        kind, parts = query
        lists = sorted((self.find(q) for q in parts), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if kind == "and" else np.union1d(out, more)
        return out


def code_points(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code points."""
    if raw.isascii() or not spans:
        return spans
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return [(k, int(before[a]), int(before[b])) for k, a, b in spans]


def segments(texts: list[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and (size + len(raw) > SEGMENT_BYTES or len(held) >= SEGMENT_DOCS):
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def search(texts: list[bytes], rules: dict, queries: dict) -> list[list[tuple[str, int, int]]]:
    """Spans of each text of a segment, by start, then as the rules are listed."""
    segment = Segment(texts, sorted(set().union(*map(trigrams_of, queries.values()))))
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for kind, (pattern, group, least) in rules.items():
        compiled = re.compile(pattern)
        for i in segment.find(queries[kind]).tolist():
            for m in compiled.finditer(texts[i]):
                if m.end(group) - m.start(group) >= least:
                    found[i].append((kind, m.start(), m.end()))
    order = {k: n for n, k in enumerate(rules)}
    return [code_points(raw, sorted(s, key=lambda x: (x[1], order[x[0]]))) for raw, s in zip(texts, found)]


def secret_spans(docs: DataFrame, rules: dict = RULES) -> DataFrame:
    """A row per input row: doc_id and spans, an array of (kind, start, end) in code points, end exclusive.

    Spans of one kind are leftmost and don't overlap; kinds may overlap each other. Null and empty
    texts have no spans. Rows with the same doc_id each give a row. Other columns are ignored; an
    empty table gives no rows.
    """
    queries = {kind: trigram_query(rule[0]) for kind, rule in rules.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for texts in segments(batch.column("text").to_pylist()):
                rows += [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in search(texts, rules, queries)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, spans)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
