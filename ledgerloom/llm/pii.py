"""Personal data by weak supervision.

Four base kinds are found by their formats and always stay. Everything that looks a little like personal
data is a candidate for a further span: numbers of account length, national and bank identifiers, addresses
that are spelled out or handles, and pairs of capitalised words. Labelers that don't decide candidacy vote on each:
regular expressions and checksums, gazetteers, and the words and base spans around. Spark counts the patterns of
votes in the whole corpus, expectation-maximisation estimates each labeler's reliability per kind from the
counts, and a logistic span classifier learns the resulting probabilities from features of the span and its
surroundings. Both see counts per pattern alone, whose number is bounded by labelers and features, not by the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .secrets import code_points

BASE = ("email", "ip", "card", "phone")
ADDED = ("id", "account", "contact", "name")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is only tried from its start: a match always takes a run to its end
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")

#: What may be a span, by kind.
_CANDIDATES = {
    "id": re.compile(rb"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9-])"),
    "account": re.compile(rb"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){8,18}(?![0-9A-Za-z-])"),
    "contact": re.compile(rb"(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9._%+-]{2,30}\x20?[\[(\x20]at[\])\x20]\x20?[A-Za-z0-9-]{2,30}(?:\x20?[\[(\x20]dot[\])\x20]\x20?|\.)[A-Za-z]{2,10}(?![A-Za-z0-9])|@[A-Za-z_][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.]))"),
    "name": re.compile(rb"(?<![A-Za-z])[A-Z][a-z]{1,15}(?=( [A-Z][a-z]{1,15})(?![A-Za-z]))"),  # every pair, also those that share a word
}
# fixed values: common given names, mail hosts, frequent words that aren't names, and words that announce personal data or something else
GIVEN = frozenset(
    b"""Adam Ahmed Alice Ana Andrea Andrew Anna Anne Antonio Barbara Ben Carlos Carmen Charles Charlotte Christian Claire Clara Daniel David Elena
    Elizabeth Emily Emma Erik Eva Fatima Francisco George Hans Helen Henry Ines Isabel Jack James Jan Jane Jean Jennifer Jessica Joan John Jorge Jose
    Joseph Juan Julia Karen Karl Klaus Laura Lena Lily Linda Lisa Louis Lucas Lucia Luis Manuel Marco Maria Marie Mark Martin Mary Michael Miguel
    Mohammed Nancy Nicolas Nina Oliver Olivia Omar Pablo Patricia Paul Pedro Peter Pierre Rafael Richard Robert Rosa Sam Sandra Sara Sarah Sofia
    Sophie Stefan Susan Thomas Victor Walter William""".split()
)
HOSTS = frozenset(b"gmail googlemail yahoo hotmail outlook icloud aol proton protonmail gmx web mail example".split())
COMMON = frozenset(
    b"""The Of And To In Is That For It As Was With Be By On Not He His But At Are This Have From Or Had An They Which One You Were All Her She There Would
    Their We Him Been Has When Who Will No More If Out So Der Die Das Und Ein Eine Den Von Zu Mit Sich Auf Ist Im Dem Nicht Les La Le De Des Du Un Une Et En
    Que Qui Dans Pour Par Sur Pas Plus El Los Las Del Y Se Con Una Su Al Lo Como New United South North West East San Public General License Version""".split()
)
CUES = frozenset(b"name named mr mrs ms dr contact call tel phone mail email born ssn passport account acct iban card number patient customer client signed dear sincerely regards nombre nom kontakt telefon konto".split())
OTHERS = frozenset(b"version order invoice page section chapter street city university river isbn issn figure license look looking available arrive hash id commit sha part item sku ticket".split())
_WORDS = re.compile(rb"[A-Za-z]+")
_GROUPS = re.compile(rb"[0-9]+|(?:[0-9]{3,4}[\x20-])+[0-9]{1,4}")
LABELERS = ("format", "checksum", "gazetteer", "cue", "other", "neighbour", "embedding")
#: Bytes within which another span of personal data speaks for a candidate.
NEAR = 200
FEATURES = ("long", "digits_only", "grouped", "cue", "other", "sentence", "line_start", "shouting", "many_in_text", "repeated", "near", "closed")
#: Probability from which on the classifier adds a span, and labelers that must be for it at least.
THRESHOLD, AGREE = 0.9, 2
FOR, AGAINST, NONE = 1, 0, 2
#: How each labeler votes (against, for, none) on false and on true candidates before any corpus is seen, and the number of candidates that this
#: counts for. Known rates stand here: a tenth of all numbers pass a checksum, and most false candidates have no personal data around.
START = {
    "format": ((0.35, 0.45, 0.20), (0.10, 0.80, 0.10)),
    "checksum": ((0.60, 0.10, 0.30), (0.20, 0.60, 0.20)),
    "gazetteer": ((0.35, 0.05, 0.60), (0.05, 0.35, 0.60)),
    "cue": ((0.01, 0.09, 0.90), (0.01, 0.44, 0.55)),
    "other": ((0.24, 0.01, 0.75), (0.03, 0.01, 0.96)),
    "neighbour": ((0.60, 0.10, 0.30), (0.20, 0.50, 0.30)),
    "embedding": ((0.29, 0.01, 0.70), (0.04, 0.01, 0.95)),
}
WEIGHT, PRIOR = 20.0, 0.3


def luhn(digits: list[int]) -> bool:
    return sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Byte spans of the base kinds, by kind, then start; of a kind leftmost and without overlap."""
    out = []
    done, at = 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and raw[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = raw.find(b"@", max(at + 1, done))
    if _DIGIT.search(raw):
        for m in _IP.finditer(raw):
            if all(len(g := x.lstrip(b"0")) <= 3 and int(g or b"0") <= 255 for x in m.groups()):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(raw):
            if m.end() - m.start() >= 16:
                digits = [c - 48 for c in m[0] if c >= 48]
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(raw):
            if 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def mod97(text: bytes) -> bool:
    """The check digits of an international bank account number."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1


def _own_votes(kind: str, text: bytes) -> tuple[int, int, int]:
    """The votes that follow from a candidate alone: format, checksum, gazetteer."""
    digits = [c - 48 for c in text if 48 <= c <= 57]
    if kind == "id":
        if text[:1].isalpha():
            good = 15 <= len(text) <= 34
            return (FOR if good else AGAINST), (FOR if good and mod97(text) else AGAINST), NONE
        good = text[:3] not in (b"000", b"666") and text[:1] != b"9" and text[4:6] != b"00" and text[7:] != b"0000"
        return (FOR if good else AGAINST), NONE, NONE
    if kind == "account":
        sized = len(digits) in (9, 10, 12) or 15 <= len(digits) <= 19
        checked = (FOR if luhn(digits) else AGAINST) if len(digits) >= 12 else NONE
        return (FOR if sized and _GROUPS.fullmatch(text) else AGAINST), checked, (AGAINST if len(set(digits)) <= 2 else NONE)
    if kind == "contact":
        if text[:1] == b"@":
            return NONE, NONE, NONE
        marked = any(c in b"[(" for c in text)
        host = _WORDS.findall(text.lower().split(b"at", 1)[1])
        return (FOR if marked else NONE), NONE, (FOR if any(w in HOSTS for w in host) else NONE)
    one, two = text.split(b" ")
    return (AGAINST if one == two else NONE), NONE, (AGAINST if one in COMMON or two in COMMON else FOR if one in GIVEN else NONE)


def candidates(raw: bytes, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, tuple[int, ...], int, bool]]:
    """(kind, start, end, a vote of each labeler, feature bits, whether no base span overlaps) of a text with the given base spans, by kind, then start."""
    begins, ends = sorted(a for _, a, _ in base), sorted(b for _, _, b in base)
    digits = _DIGIT.search(raw) is not None
    for kind, pattern in _CANDIDATES.items():
        if kind in ("id", "account") and not digits or kind == "contact" and b"at" not in raw and b"@" not in raw:
            continue
        found = [(m.start(), m.end(pattern.groups)) for m in pattern.finditer(raw)]
        many = Counter(raw[a:b] for a, b in found)
        for a, b in found:
            text = raw[a:b]
            before, after = raw[max(0, a - 60) : a], raw[b : b + 1]
            words = [w.lower() for w in _WORDS.findall(before)[-3:]]
            cue, other = any(w in CUES for w in words), any(w in OTHERS for w in words)
            later, earlier = bisect_left(begins, b), bisect_right(ends, a)  # those that overlap don't speak for the span
            away = len(base) - later + earlier
            near = later < len(base) and begins[later] - b <= NEAR or earlier > 0 and a - ends[earlier - 1] <= NEAR
            last, stripped = before[-1:], before.rstrip()[-1:]
            glued = last not in (b"", b" ", b"\n", b"\t", b"(", b":", b",") and last < b"\x80" or after in (b"=", b"_", b"/", b"#", b"<", b"{", b'"')
            votes = (*_own_votes(kind, text), FOR if cue else NONE, AGAINST if other else NONE, FOR if near else NONE if away else AGAINST, AGAINST if glued else NONE)
            shouts = bool(words) and _WORDS.findall(before)[-1].isupper()
            seen = (len(text) >= 14, text.isdigit(), b" " in text or b"-" in text, cue, other, not stripped or stripped in b".!?", last in (b"", b"\n"), shouts, away >= 3, many[text] > 1, near, after in (b"", b" ", b".", b",", b"\n", b")", b";"))
            yield kind, a, b, votes, sum(s << i for i, s in enumerate(seen)), away == len(base)


@dataclass
class Model:
    """Per kind: P(vote | truth) of each labeler as [truth, labeler, vote], the share of true candidates, and the classifier's weights."""

    reliability: dict[str, np.ndarray]
    prior: dict[str, float]
    weights: dict[str, np.ndarray]

    def probability(self, kind: str, bits: int) -> float:
        return float(1 / (1 + np.exp(-(_row(bits) @ self.weights[kind]))))


def _row(bits: int) -> np.ndarray:
    return np.array([1.0, *((bits >> i) & 1 for i in range(len(FEATURES)))])


def start() -> np.ndarray:
    """START as [truth, labeler, vote]."""
    return np.array([START[name] for name in LABELERS]).transpose(1, 0, 2)


def posterior(votes: np.ndarray, rates: np.ndarray, prior: float) -> np.ndarray:
    """P(true | votes), the labelers taken as independent given the truth."""
    like = np.log(rates[:, np.arange(len(LABELERS)), votes]).sum(axis=2)
    return 1 / (1 + (1 - prior) / prior * np.exp(like[0] - like[1]))


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over patterns of votes, each seen n times: rates and prior, drawn to the start by WEIGHT candidates."""
    first, rates, prior = start(), start(), PRIOR
    for _ in range(rounds if len(n) else 0):
        true = posterior(votes, rates, prior)
        for t, w in ((0, n * (1 - true)), (1, n * true)):
            for vote in range(3):
                rates[t, :, vote] = ((w[:, None] * (votes == vote)).sum(axis=0) + WEIGHT * first[t, :, vote]) / (w.sum() + WEIGHT)
        prior = float(((n * true).sum() + WEIGHT * PRIOR) / (n.sum() + WEIGHT))
    return rates, prior


def classify(bits: np.ndarray, n: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifier, by Newton's method over patterns of features, each seen n times with true of them true."""
    x = np.array([_row(int(b)) for b in bits]).reshape(-1, len(FEATURES) + 1)
    w = np.zeros(len(FEATURES) + 1)
    w[0] = -2.0
    for _ in range(30 if len(n) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (true - n * p) - w)
    return w


_SPAN = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
_FOUND = pa.list_(pa.struct([*_SPAN, ("votes", pa.string()), ("bits", pa.int64()), ("free", pa.bool_())]))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row: base spans, and candidates with their votes, feature bits and whether no base span overlaps. The one scan of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                base = base_spans(raw)
                more = list(candidates(raw, base))
                at = code_points(raw, base + [c[:3] for c in more])
                rest = [(None, None, None)] * len(base) + [("".join(map(str, votes)), bits, free) for *_, votes, bits, free in more]
                rows.append([dict(zip(("kind", "start", "end", "votes", "bits", "free"), x + y)) for x, y in zip(at, rest)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _FOUND)], ["doc_id", "spans"])

    fields = "kind:string,start:long,end:long,votes:string,bits:long,free:boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans array<struct<{fields}>>")


def learn(docs: DataFrame, found: DataFrame | None = None) -> Model:
    """The span classifier of a corpus; found: its marked() rows, if they are at hand.

    Patterns of votes reach the driver (at most 3 ** labelers a kind), then patterns of features with the sum of their
    candidates' probabilities (at most 2 ** features a kind); neither grows with the corpus.
    """
    each = (marked(docs) if found is None else found).select(F.explode("spans").alias("s")).select("s.*").where("votes is not null")
    counts = cut(each.groupBy("kind", "votes", "bits").agg(F.count("*").alias("n")))
    patterns = sorted(map(tuple, counts.groupBy("kind", "votes").agg(F.sum("n")).collect()))
    model, rows = Model({}, {}, {}), []
    for kind in ADDED:
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes = np.array([list(map(int, v)) for v, _ in own], np.int64).reshape(-1, len(LABELERS))
        n = np.array([c for _, c in own], np.float64)
        model.reliability[kind], model.prior[kind] = estimate(votes, n)
        rows += [(kind, v, float(p)) for (v, _), p in zip(own, posterior(votes, model.reliability[kind], model.prior[kind]))]
    true = docs.sparkSession.createDataFrame(rows, "kind string, votes string, true double")
    seen = counts.join(F.broadcast(true), ["kind", "votes"]).groupBy("kind", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("true")).alias("true"))
    seen = sorted(map(tuple, seen.collect()))
    for kind in ADDED:
        own = [x[1:] for x in seen if x[0] == kind]
        model.weights[kind] = classify(*(np.array([x[i] for x in own], np.float64) for i in range(3)))
    return model


def pii_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per input row: doc_id and spans, an array of (kind, start, end) in code points, end exclusive.

    Spans stand by kind (email, ip, card, phone, id, account, contact, name), then start. A candidate is added if the
    classifier gives it THRESHOLD or more, AGREE labelers at least and more than are against it are for it, and no base
    span overlaps it. Null and empty texts have none. Rows with the same doc_id each give a row. Other columns are
    ignored; an empty table gives no rows, and a corpus without candidates only base spans. Without a model
    one is learned from the same rows, so which spans are added to a text depends on the rest of the corpus as well. Texts are scanned
    once; what is found in them is kept in the shared folder.
    """
    found = cut(marked(docs))
    model = model or learn(docs, found)
    sure = {kind: frozenset(bits for bits in range(1 << len(FEATURES)) if model.probability(kind, bits) >= THRESHOLD) for kind in ADDED}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stays(s: dict) -> bool:
            if s["votes"] is None:
                return True
            agree = s["votes"].count(str(FOR))
            return s["free"] and s["bits"] in sure[s["kind"]] and agree >= max(AGREE, s["votes"].count(str(AGAINST)) + 1)

        for batch in batches:
            rows = [[{k: s[k] for k, _ in _SPAN} for s in spans if stays(s)] for spans in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.struct(_SPAN)))], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
