"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

A candidate is a run of 20 or more characters of [A-Za-z0-9+/_-] with the = that end it. Its parts are the run itself, its
pieces between marks and the stretches of it that gain most under one of the encodings; all parts of all runs, short or
long, go through the same battery. The encoding of a part is the smallest alphabet that holds it, and three tests ask
twice: does the part look like a random string of that encoding, and how often does ordinary text look like that?

* chi-squared uniformity: a random string doesn't differ from equal shares of all characters of its alphabet; text
  leaves the rare letters, digits and marks nearly empty;
* runs (changes between lower case, upper case, digits and marks): a random string changes class as often as the sizes
  of the classes say; text hardly does;
* serial correlation: neighbouring codes of a random string are uncorrelated; in text vowels and consonants take turns,
  so neighbours are seldom alike.

A part that a test rejects as random (it counts, repeats, or uses few characters) is no candidate. The others get three
p-values under "ordinary text", each an exact binomial tail of the part's own length, so a short string needs a stronger
signal. Fisher's method combines them, and the number of parts tried in the run multiplies the result. Of parts that
overlap the least probable one stands, so a key in a long run is masked without the ordinary rest. Within a document the
candidates are accepted by the Benjamini-Hochberg rule with weights that grow with length: at most `rate` of the
accepted are expected to be text. Strings of digits alone are not tested: numbers are ordinary at any length. Letters of
one case alone are, but runs say nothing of them, so they need about twice the length of other strings.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RATE = 3e-3
KINDS = ("assign", "access", "hex", "random")
#: Patterns of the base, as fixed: ASCII letters of the key in either case, group 2 of six characters or more.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}=*")
_LOWER, _UPPER, _DIGITS, _MARKS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-"
#: The encodings, smallest alphabet first. Of the four marks an encoding has two, so the last one counts 64 characters.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "letters": _LOWER,
    "LETTERS": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _LOWER + _UPPER,
    "base64": _DIGITS + _LOWER + _UPPER + _MARKS,
}
#: The fourteen letters that make up most of text in European languages; of its letters and digits, text has at most
#: TEXT_RARE others (rare letters, digits), and a number has at most NUMBER_LETTERS letters. Text changes class at most
#: at TEXT_CHANGES of its places, and at most TEXT_ALIKE of its pairs of letters are both vowels or both consonants.
COMMON, VOWELS = "etaoinsrhldcum", "aeiouy"
TEXT_RARE, NUMBER_LETTERS, TEXT_CHANGES, TEXT_ALIKE = 0.17, 0.1, 0.12, 0.43
#: Random strings are rejected as such at this many standard deviations in any test: about once in a thousand.
REJECTED = 3.5
#: A part has so many characters. A stretch is taken with at most EDGE alphanumeric ones more on either side: the ends of
#: a secret can look like text.
LEAST, EDGE = 16, 8
_EDGE = re.compile(r"[A-Za-z0-9]*")
_PIECE = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST)


def _table(of: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(c) for c in of]] = True
    return out


_CLASS = np.select([_table(_LOWER), _table(_UPPER), _table(_DIGITS)], [0, 1, 2], 3).astype(np.int8)
_LETTER, _DIGIT, _VOWEL = _table(_LOWER + _UPPER), _table(_DIGITS), _table(VOWELS + VOWELS.upper())
_RARE = ~_table(COMMON + COMMON.upper())


def _classes(codes: np.ndarray) -> np.ndarray:
    """Lower case, upper case, digit or mark; the capital that begins a word in lower case counts as lower case."""
    out = _CLASS[codes]
    out[:-1][(out[:-1] == 1) & (out[1:] == 0)] = 0
    return out


class _Encoding:
    """What a random string of an alphabet does: shares of rare characters, changes of class, alike neighbours."""

    def __init__(self, alphabet: str):
        codes = np.array([ord(c) for c in alphabet if c not in _MARKS])
        self.mask, self.size = _table(alphabet), min(len(alphabet), 64)
        self.place = np.zeros(128)
        self.place[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.rare = float(_RARE[codes].mean())
        share = [float((_CLASS[codes] == c).mean()) for c in range(3)]
        marked = 1 - len(codes) / self.size
        # A letter in upper case before one in lower case has its class: the change is between the places before it.
        seen = {(x, y): 0.0 for x in range(3) for y in range(3)}
        for x, y, z in itertools.product(range(3), repeat=3):
            first, second = 0 if (x, y) == (1, 0) else x, 0 if (y, z) == (1, 0) else y
            seen[first, second] += share[x] * share[y] * share[z] * (1 - marked)
            seen[0 if (x, y) == (1, 0) else x, y] += share[x] * share[y] * share[z] * marked
        self.changes = sum(p for (x, y), p in seen.items() if x != y)
        letters = codes[_LETTER[codes]]
        vowels = _VOWEL[letters].mean()
        self.alike = float(vowels**2 + (1 - vowels) ** 2)


_ENCODED = {name: _Encoding(alphabet) for name, alphabet in ENCODINGS.items()}


def _binomial_tail(n: int, k: int, p: float) -> float:
    """P(X >= k) for X binomial."""
    if k <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(log, default=-math.inf)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log)) if log else 0.0


def encoding(text: str) -> str | None:
    """The smallest alphabet that holds all characters of a text but the = at its end."""
    body = text.rstrip("=")
    if not body or not body.isascii():
        return None
    codes = np.frombuffer(body.encode("ascii"), np.uint8)
    return next((name for name, e in _ENCODED.items() if e.mask[codes].all()), None)


def _neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character but the first: is it beside a letter or digit, of another class; a letter beside one, alike?"""
    classes, alnum = _classes(codes), _CLASS[codes] < 3
    places, pairs = alnum[1:] & alnum[:-1], _LETTER[codes[1:]] & _LETTER[codes[:-1]]
    return places, places & (classes[1:] != classes[:-1]), pairs, pairs & (_VOWEL[codes[1:]] == _VOWEL[codes[:-1]])


def text_p_value(text: str) -> float | None:
    """How probable it is that ordinary text of this length looks as random as text does: small for random strings.

    None if there is nothing to test: an unknown alphabet, digits only, fewer than 16 characters, or a string that a test
    rejects as a random one of its encoding.
    """
    kind = encoding(text)
    body = text.rstrip("=")
    if kind is None or len(body) < LEAST or body.isdigit():
        return None
    e, codes = _ENCODED[kind], np.frombuffer(body.encode("ascii"), np.uint8)
    counts = np.unique(codes, return_counts=True)[1]
    chi = float((counts**2).sum()) * e.size / len(codes) - len(codes)
    if chi - (e.size - 1) > 1.3 * REJECTED * math.sqrt(2 * (e.size - 1)):
        return None
    places, changed, pairs, alike = _neighbours(codes)
    n, tries, changes = int((_CLASS[codes] < 3).sum()), int(places.sum()), int(changed.sum())
    if abs(changes - tries * e.changes) > REJECTED * math.sqrt(tries * e.changes * (1 - e.changes)) + 0.5:
        return None
    off = e.place[codes] - e.place[codes].mean()
    if abs(float((off[1:] * off[:-1]).sum() / (off * off).sum())) * math.sqrt(len(codes)) > REJECTED:
        return None
    # Text is words with a few other characters, or a number with a few letters: the likelier of both.
    rare, letters = int((_RARE[codes] & (_CLASS[codes] < 3)).sum()), int(_LETTER[codes].sum())
    p_values = [max(_binomial_tail(n, rare, TEXT_RARE), _binomial_tail(n, letters, NUMBER_LETTERS))]
    if e.changes:
        p_values.append(_binomial_tail(tries, changes, TEXT_CHANGES))
    if 2 * int(pairs.sum()) >= n:
        p_values.append(_binomial_tail(int(pairs.sum()), int(alike.sum()), TEXT_ALIKE))
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)  # chi-squared with two degrees of freedom for each test
    return min(1.0, math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(p_values))))


def stretches(run: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a run that are likelier in an encoding than in text, by the rates of the tests.

    For each encoding the stretch of the greatest gain is taken, then those to its left and right.
    """
    codes = np.frombuffer(run.encode("ascii"), np.uint8)
    rare, alnum = _RARE[codes], _CLASS[codes] < 3
    places, changed, pairs, alike = (np.concatenate([[False], x]) for x in _neighbours(codes))
    found = set()
    for e in _ENCODED.values():
        inside = e.mask[codes]
        if inside.sum() < LEAST:
            continue
        gain = np.where(alnum, np.where(rare, math.log(e.rare / TEXT_RARE), math.log((1 - e.rare) / (1 - TEXT_RARE))), 0.0)
        if e.changes:
            gain += np.where(places, np.where(changed, math.log(e.changes / TEXT_CHANGES), math.log((1 - e.changes) / (1 - TEXT_CHANGES))), 0.0)
        gain += np.where(pairs, np.where(alike, math.log(e.alike / TEXT_ALIKE), math.log((1 - e.alike) / (1 - TEXT_ALIKE))), 0.0)
        gain = np.where(inside, gain, -1e6)
        todo = [(0, len(codes))]
        while todo:
            a, b = todo.pop()
            if b - a < LEAST:
                continue
            total = np.concatenate([[0.0], np.cumsum(gain[a:b])])
            rise = total - np.minimum.accumulate(total)
            end = int(rise.argmax())
            if rise[end] < math.log(len(codes)):
                continue
            start = int(np.flatnonzero(rise[:end] == 0)[-1])
            todo += [(a, a + start), (a + end, b)]
            found.add((a + start, a + end))
    return sorted(found)


def _grown(body: str, a: int, b: int) -> tuple[int, int]:
    """A stretch without marks at its ends, and with the alphanumeric characters beside it, EDGE at most."""
    part = body[a:b]
    a, b = a + len(part) - len(part.lstrip(_MARKS)), b - len(part) + len(part.rstrip(_MARKS))
    return a - len(_EDGE.match(body[max(0, a - EDGE) : a][::-1])[0]), b + len(_EDGE.match(body[b : b + EDGE])[0])


def run_tests(run: str) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of the parts of a run that may be secret, disjoint, by start.

    Of parts that overlap the one with the smallest p-value stands, of equal ones the longest.
    """
    body = run.rstrip("=")
    parts = {(0, len(body))} | {m.span() for m in _PIECE.finditer(body)}
    parts |= {_grown(body, a, b) for a, b in stretches(body)}
    parts = {(a, b) for a, b in parts if b - a >= LEAST}
    tested = [(p, a, b) for a, b in parts if (p := text_p_value(body[a:b])) is not None]
    out: list[tuple[int, int, float]] = []
    for p, a, b in sorted(tested, key=lambda t: (t[0], t[1] - t[2], t[1])):
        if all(b <= s or e <= a for s, e, _ in out):
            out.append((a, b, min(1.0, p * len(parts))))
    return sorted((a, len(run) if b == len(body) else b, p) for a, b, p in out)


def accepted(p_values: list[float], lengths: list[int], rate: float) -> list[int]:
    """Weighted Benjamini-Hochberg: positions of the accepted, weights in proportion to log2 of the length."""
    if not p_values:
        return []
    weights = [math.log2(n) for n in lengths]
    mean = sum(weights) / len(weights)
    ranked = sorted((p * mean / w, i) for i, (p, w) in enumerate(zip(p_values, weights, strict=True)))
    last = max((k for k, (q, _) in enumerate(ranked, 1) if q <= rate * k / len(ranked)), default=0)
    return sorted(i for _, i in ranked[:last])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(text: str, rate: float = RATE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans of the base, and those with what the tests add outside of them."""
    base = base_spans(text)
    tested = [(m.start() + a, m.start() + b, p) for m in CANDIDATE.finditer(text) for a, b, p in run_tests(m[0])]
    extra = [tested[i] for i in accepted([t[2] for t in tested], [t[1] - t[0] for t in tested], rate)]
    added = [(a, b, "random") for a, b, _ in extra if not any(a < e and s < b for s, e, _ in base)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def masked(text: str, rate: float = RATE, mask: str = "[SECRET]") -> str:
    """text with every span replaced; spans that overlap are replaced together."""
    out, at = [], 0
    for start, end, _ in all_spans(text, rate)[1]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def without_secrets(text: str, rate: float = RATE) -> Column:
    """A text column with its secrets masked; null stays null."""

    @F.pandas_udf("string")
    def mask(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None else masked(x, rate))

    return mask(text)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row of docs (doc_id, text).

    spans holds kind:start:end in code points, the end exclusive, by start. A null text is empty; a text without
    spans has the digest of the empty string and empty spans. Long texts are scanned whole. A null doc_id stays null,
    repeated rows give repeated answers, an empty table gives an empty result, other columns are not read. Rows are
    independent, so nothing is shuffled and no key can be hot.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, spans = all_spans(text.as_py(), rate)
                kinds = [k for *_, k in spans]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            assign, access, hexes, random, digest, spans = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(assign, pa.int64()), pa.array(access, pa.int64()), pa.array(hexes, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(random, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return common.id_and_text(docs).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
