"""Quality rules, line first: rules judge single lines, failing lines go, and a document that loses too much goes too."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Fixed by the contract of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
#: A document goes if its lines that pass hold less than this share of its word characters.
MIN_LEFT = 0.5

_STRIP = " \t\n\x0b\x0c\r"
_SEPARATORS = frozenset("| > » › · • / ::".split())
_NAVIGATION = frozenset("home about contact login logout register menu search sitemap next previous prev back top share print faq help archive categories tags rss".split())
_BOILERPLATE = re.compile(r"all rights reserved|cookie|privacy policy|terms of (?:use|service)|lorem ipsum|javascript|subscribe|sign up|log in|click here|read more|powered by|page not found|add to cart", re.IGNORECASE)
_END = (".", "!", "?", "…", ":", ";", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]", ",")
_MARKED = re.compile(r"[^\w\s]{2,}$")
_ELLIPSIS = re.compile(r"^[\w'’-]*[\"')\]”’]*(?:\.{2,}|[.,!?;:]+[\"')\]”’»]+)$")


def punctuation_fails(words: list[str]) -> bool:
    """Few letters, words that mostly end in heaps of marks, shouting, or a short line without an end."""
    n = len(words)
    text = " ".join(words)
    letters = sum(map(str.isalpha, text))
    if letters < 0.5 * (len(text) - n + 1):
        return True
    heaped = sum(1 for w in words if _MARKED.search(w) and not _ELLIPSIS.match(w))
    if heaped > 0.3 * n:
        return True
    if n >= 5 and sum(map(str.isupper, text)) > 0.7 * letters:
        return True
    return n < 3 and not text.endswith(_END)


def navigation_fails(words: list[str]) -> bool:
    """Separators between entries, or a short line of menu words."""
    n = len(words)
    separators = sum(w in _SEPARATORS for w in words)
    if separators >= 2 and separators > 0.2 * n:
        return True
    menu = sum(w.strip(".,:;!?").lower() in _NAVIGATION for w in words)
    return menu >= 3 and menu > 0.4 * n


def boilerplate_fails(words: list[str]) -> bool:
    """A short line with a phrase that sites repeat on every page, or one word over and over."""
    n = len(words)
    if n <= 30 and _BOILERPLATE.search(" ".join(words)):
        return True
    return n >= 10 and (len(set(words)) < 0.2 * n or sum(a == b for a, b in zip(words, words[1:], strict=False)) > 0.3 * n)


def kept_share(text: str) -> tuple[float, int]:
    """Share of word characters in the lines that pass, and how many lines fail. A line that was there before fails."""
    left = total = failed = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        size = sum(map(len, words))
        total += size
        if line in seen or punctuation_fails(words) or navigation_fails(words) or boilerplate_fails(words):
            failed += 1
        else:
            left += size
        seen.add(line)
    return (left / total if total else 0.0), failed


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more. Windows are named exactly, by doubling names of shorter ones."""
    n = len(words)
    if n <= WINDOW:
        return 0
    names: dict[bytes, int] = {}
    name = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if len(names) == n:
        return 0
    width = 1
    while width < WINDOW:
        pairs = name[:-width] * (int(name.max()) + 1) + name[width:]
        found, name = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            return 0
        width *= 2
    twice = np.flatnonzero(np.bincount(name)[name] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_STRIP)]
    return len(words), len(text) - sum(map(text.count, _STRIP)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "kept_share": pa.float64(), "n_failed_lines": pa.int64()}


def quality_rules(docs: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, kept_share and n_failed_lines of every row of docs (doc_id, text).

    A null or empty text has no words and fails the base. A text is one row's work, whatever its length. A null doc_id
    stays null, repeated rows give repeated answers, an empty table gives an empty result, other columns are not read.
    Nothing is shuffled, so no source or group of copies can be hot.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                counts = base(text := value.as_py())
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED_PERCENT * counts[0]
                share, lines = kept_share(text)
                rows.append((*counts, failed, not failed and share >= min_left, share, lines))
            columns = zip(*rows, strict=True) if rows else ((),) * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True))], ["doc_id", *_FIELDS])

    return common.id_and_text(docs).mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_share double, n_failed_lines long")
