"""The encoder by runs of three letters: a table of runs gives what single digests give, and few digests are taken."""

from __future__ import annotations

import hashlib
import random
import sys

import numpy as np

from framelake.operators import enrich as K


def direct(text, dim):
    v = np.zeros(dim)
    text = f" {text} "
    for i in range(len(text) - 2):
        h = int.from_bytes(hashlib.sha256(text[i : i + 3].encode("utf-8", "surrogatepass")).digest()[:8], "little")
        v[(h >> 1) % dim] += 1 if h & 1 else -1
    return v / max(float(np.linalg.norm(v)), 1e-12)


def test_encoder_equals_single_digests():
    """More letters than have a number, surrogates, the last code point, a text of one letter, bytes."""
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([32, 97, 98, rng.randrange(97, 123), rng.randrange(0x80, 0x3000), 0x10FFFF, 0xD800])) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["a", "  ", "\x00\x00\x00", b"caf\xe9 \x00", None, "", *texts[:5]]
    for dim in (64, 7):
        got = K.hash_encoder(dim)(texts)
        for text, v in zip(texts, got, strict=True):
            if not text:
                assert v is None
            else:
                assert np.array_equal(v, direct(text.decode("latin-1") if isinstance(text, bytes) else text, dim))


def test_runs_of_a_text_go_through_a_table():
    """A long text is not looked up run by run."""
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call" and frame.f_code.co_name == "place"

    encode, text = K.hash_encoder(), "the cat and the hat " * 5_000
    before = sys.getprofile()
    sys.setprofile(count)
    try:
        v = encode([text])[0]
    finally:
        sys.setprofile(before)
    assert 0 < calls < 100 and abs(float(np.linalg.norm(v)) - 1) < 1e-12
