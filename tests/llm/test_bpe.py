import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from cases import awkward, documents

from tabwright.llm import bpe

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(ranks, reference):
    """Random bytes, repeated letters, syllables and joined tokens, each as one piece."""
    encoder = bpe.Encoder(ranks, public.PATTERN)
    rng = random.Random(3)
    vocabulary = sorted(ranks)
    texts = ["a" * n for n in range(1, 70)] + ["ab" * n for n in range(1, 40)]
    for _ in range(3000):
        texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñß") for _ in range(rng.randrange(1, 30))))
        texts.append("".join(rng.choice(["tion", "the", "en", "sch", "ción", "re", "ing", " ", "9", "--"]) for _ in range(rng.randrange(1, 12))))
        texts.append(b"".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))).decode(errors="replace"))
    for text in texts:
        assert encoder.encode(text) == reference.encode_ordinary(text), repr(text)


def test_a_small_memory_changes_nothing(ranks, reference):
    encoder = bpe.Encoder(ranks, public.PATTERN, memory=(20, 30))
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join("".join(rng.choice("thereoing") for _ in range(rng.randrange(1, 9))) for _ in range(20))
        assert encoder.encode(text) == reference.encode_ordinary(text)
    assert len(encoder.after_space) <= 21


def test_blanks_and_odd_characters(ranks, reference):
    encoder = bpe.Encoder(ranks, public.PATTERN)
    rng = random.Random(4)
    signs = [" ", "  ", "\n", "\t", "\r\n", "a", "Z", "'s", "'", "1", "½", "_", "!", "\x1c", "\x85", "\xa0", " ", "​", "　", "é", "é", "\U0001f600", "中", "﻿"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 15)))
        assert encoder.encode(text) == reference.encode_ordinary(text), repr(text)


def test_emission_is_early(ranks):
    """Lookahead is bounded: no live prefix holds more than a few tokens back."""
    machine = bpe.Transducer(ranks, bpe.split_tokens(ranks))
    list(machine.encode(("thereoftheingtionen" * 400).encode()))
    assert max(sum(map(len, live[-1][1])) for _, live in machine.keys) < 200
    assert len(machine.keys) < 2000


def test_streaming_decode_in_any_cut():
    text = "aé中\U0001f600z" * 50
    raw = text.encode()
    rng = random.Random(1)
    for _ in range(50):
        stream, out, at = bpe.Utf8Stream(), [], 0
        while at < len(raw):
            to = at + rng.randrange(1, 9)
            out.append(stream.feed(raw[at:to]))
            at = to
        assert "".join(out) + stream.feed(b"", True) == text


def test_documents(spark, reference):
    rows = awkward()
    got = bpe.tokenize(documents(spark, rows).repartition(5), PATH, public.PATTERN).collect()
    assert len(got) == len(rows)
    expected = sorted((i if i is not None else -1, hashlib.sha256((t or "").encode()).hexdigest(), tuple(reference.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded_sha256, tuple(r.ids)) for r in got) == expected
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.tokenize(documents(spark, []), PATH, public.PATTERN).count() == 0
