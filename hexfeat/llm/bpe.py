"""Byte-level BPE inside a task: one encoder for each Python worker, and the joins of the concatenation tree.

The pre-tokenizer of the vocabulary cuts text before it merges bytes. Some of its cuts follow from two neighbouring
characters alone, whatever stands around them (`certain`): there the encoding of a text is the encoding of its left part
followed by that of its right part. Between two certain cuts lies a run of one kind (letters, digits, marks or blanks).
Inside such a run an encoding is right exactly if every two neighbouring tokens are what their own text is encoded to;
so a window that is encoded anew and begins and ends with the tokens that already stood there joins both sides exactly.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata

import numpy as np

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: A blank behind a space, or a space at the end: there a space doesn't surely start a new pre-token.
_LOOSE_SPACE = re.compile("[ ](?:[\\s᠎​﻿]|$)")
#: Strings in each of the two generations that an encoder remembers, and characters encoded at once.
REMEMBERED, AT_ONCE = 200_000, 1_000_000
#: The published pattern of this vocabulary's pre-tokenizer (fixed).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these characters the Unicode tables of two regex engines could differ.
_RARE = re.compile("[^\0-ɏ]")


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts as `tokenizers` does with add_special_tokens=False, remembering the words it has met.

    A new word of common characters is merged by tiktoken with the ranks of the same vocabulary, which gives the same
    ids at less cost for short strings; all others, and texts whose spaces don't surely start a word, go to `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        marks = _byte_marks()
        self.pieces = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = token.encode() if token in self.special else bytes(marks[c] for c in token)
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        import tiktoken

        ranks = {p: i for i, p in enumerate(self.pieces) if p.decode("utf-8", "replace") not in self.special}
        self.merge = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def direct(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without memory."""
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        part: list[str] = []
        n = 0
        for text in texts:
            part.append(text)
            n += len(text)
            if n >= AT_ONCE:
                out += self._encode(part)
                part, n = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            self.before, self.words = self.words, {}
        out: list[bytes | list[str]] = []
        needed: set[str] = set()
        for text in texts:
            if _LOOSE_SPACE.search(text) or any(s in text for s in self.special):
                out += self.direct([text])
            else:  # each space begins a pre-token
                head, *rest = text.split(" ")
                words = ["\0" + head, *rest]
                needed.update(words)
                out.append(words)
        rare = []
        for word in needed.difference(self.words):
            if (ids := self.before.get(word)) is None:
                if _RARE.search(word):
                    rare.append(word)
                    continue
                ids = _packed(self.merge(word[1:] if word[:1] == "\0" else " " + word))
            self.words[word] = ids
        self.words.update(zip(rare, self.direct([w[1:] if w[:1] == "\0" else " " + w for w in rare]), strict=True))
        known = self.words.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(known, x)) for x in out]

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_marks() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _kind(c: str) -> str:
    if c.isspace():
        return " "
    main = unicodedata.category(c)[0]
    return main if main in "LN" else "P"


def certain(a: str, b: str) -> bool:
    """Whether the pre-tokenizer cuts between the characters a and b wherever they stand side by side.

    Categories are taken from Python's Unicode tables; characters beyond Latin-1 that aren't letters there are not
    trusted, since the tokenizer's tables can be of another version.
    """
    if max(a, b) > "ɏ":
        return False
    x, y = _kind(a), _kind(b)
    if x == " ":  # how a run of blanks is cut depends on what follows it
        return False
    return y == " " or (x != y and a != "'")


def _cut(text: str, at: int, special: list[str]) -> bool:
    """Whether text can be cut at `at`: surely, and not within a special string."""
    return certain(text[at - 1], text[at]) and not any(x in text[max(0, at - len(x) + 1) : at + len(x) - 1] for x in special)


def _back(text: str, at: int, special: list[str]) -> int:
    """The last cut at or before `at`, or 0."""
    while at > 0 and not _cut(text, at, special):
        at -= 1
    return at


def _ahead(text: str, at: int, special: list[str]) -> int:
    """The first cut at or behind `at`, or the end."""
    while at < len(text) and not _cut(text, at, special):
        at += 1
    return at


MARGIN, DIRECT, WINDOW = 16, 4096, 8


class Piece:
    """A text, its ids, and the byte at which each of them starts."""

    def __init__(self, text: str, ids: np.ndarray, sizes: np.ndarray):
        self.text, self.ids = text, ids
        self.starts = np.concatenate([[0], np.cumsum(sizes[ids])])


def join(left: Piece, right: Piece, enc: Encoder) -> Piece:
    """The encoding of both texts in a row: only a window around the join is encoded anew."""
    near = left.text[-DIRECT - MARGIN :]
    p = _back(near, max(0, len(near) - MARGIN), enc.special)
    p_sure = p > 0 or len(near) == len(left.text)
    ahead = right.text[: DIRECT + MARGIN]
    q = _ahead(ahead, min(len(ahead), MARGIN), enc.special)
    q_sure = q < len(ahead) or len(ahead) == len(right.text)
    if p_sure and q_sure:
        a, b = len(left.text) - len(near) + p, q
        mid = enc.direct([left.text[a:] + right.text[:b]])[0]
        keep = np.searchsorted(left.starts, len(left.text[:a].encode()))
        skip = np.searchsorted(right.starts, len(right.text[:b].encode()))
        ids = np.concatenate([left.ids[:keep], np.frombuffer(mid, "<u4"), right.ids[skip:]])
        return Piece(left.text + right.text, ids, enc.sizes)
    return _join_run(left, right, enc)


def _join_run(left: Piece, right: Piece, enc: Encoder) -> Piece:
    """The same inside a long run without a certain cut: the window grows until it begins and ends with tokens that stood there."""
    a_bytes, b_bytes = left.text.encode(), right.text.encode()
    width = WINDOW
    while True:
        i, j = max(0, len(left.ids) - width), min(len(right.ids), width)
        while i > 0 and (len(a_bytes) - left.starts[i] < MARGIN or a_bytes[left.starts[i]] & 0xC0 == 0x80):
            i -= 1
        while j < len(right.ids) and (right.starts[j] < MARGIN or b_bytes[right.starts[j]] & 0xC0 == 0x80):
            j += 1
        text = (a_bytes[left.starts[i] :] + b_bytes[: right.starts[j]]).decode()
        mid = np.frombuffer(enc.direct([text])[0], "<u4")
        if (i == 0 or mid[0] == left.ids[i]) and (j == len(right.ids) or mid[-1] == right.ids[j - 1]):
            return Piece(left.text + right.text, np.concatenate([left.ids[:i], mid, right.ids[j:]]), enc.sizes)
        width *= 2


def concatenated(pieces: list[Piece], enc: Encoder) -> Piece:
    """The pieces joined two by two, level by level."""
    while len(pieces) > 1:
        pieces = [join(pieces[i], pieces[i + 1], enc) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]
