import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hexfeat.llm import bpe, packing, tree_bpe


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encode_decode_as_the_library(docs, texts, reference):
    want = []
    for i, t in texts:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for leaf in (tree_bpe.LEAF, 700):
        got = [tuple(r) for r in tree_bpe.encode_decode(docs, leaf=leaf).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_joins_are_exact_wherever_a_text_is_cut(reference):
    enc, rng = bpe.encoder(bpe.tokenizer_path()), random.Random(1)
    parts = ["abc", "XYZ", "012", "  ", "\n", "\t", ".,!", "'s", "'", "é", "ß", "語", "<|endoftext|>", "a" * 7, " ", " ", "😀", " the"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 60))) for _ in range(400)]
    cases += ["".join(rng.choice(kind) for _ in range(9000)) for kind in ("abcdefghij", "0123456789", "!.,;'#", "  ", "\n \t", "éèàß", "語漢字")]
    for s in cases:
        k = rng.randint(1, max(1, len(s) // 3))
        pieces = [bpe.Piece(s[i : i + k], np.frombuffer(enc.encode([s[i : i + k]])[0], "<u4"), enc.sizes) for i in range(0, len(s), k)]
        assert bpe.concatenated(pieces, enc).ids.tolist() == reference.encode(s, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(docs, texts, reference):
    rows = packing.harmonic_pack(docs).collect()
    want = defaultdict(int)
    for i, t in texts:
        want[i] += len(reference.encode(t or "", add_special_tokens=False).ids) + 1
    got, places = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    padded = 0
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padded += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padded < 0.02 * sum(want.values())
    ids = dict((i, reference.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts if i in (10, 12))
    for r in rows:
        if r.doc_id in ids:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_cuts_fill_their_classes():
    for rest in range(1024):
        pieces = packing.cuts(rest)
        assert sum(n for n, _ in pieces) == rest
        assert all(1024 // (k + 1) < n <= 1024 // k for n, k in pieces)


def test_empty(empty):
    assert packing.harmonic_pack(empty).count() == 0 and tree_bpe.encode_decode(empty).count() == 0
