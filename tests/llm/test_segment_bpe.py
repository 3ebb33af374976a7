import hashlib
import json
import random

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import regex
import tiktoken
from cases import awkward, documents
from tokenizers import Tokenizer

from tabwright.llm import pieces as P
from tabwright.llm import segment_bpe as S
from tabwright.llm.common import text_bytes

PATH = public.path("byte_bpe_50k.json")
SIGNS = [" ", "  ", "\n", "\t", "\r\n", "a", "Z", "'s", "'", "'re", "'ll", "'v", "'d", "t", "s", "1", "½", "_", "!", "\x1c", "\x85", "\xa0", "​", "　", "é", "é", "\U0001f600", "中", "﻿", "՘", "<|endoftext|>", "<|endof", "text|>", "the", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def classes(library):
    return P.pre_tokenizer_classes(library.pre_tokenizer)


@pytest.fixture(scope="module")
def encoder(classes):
    with open(PATH, encoding="utf-8") as f:
        return S.make_encoder(f.read(), classes)


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeghitnorst") for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    return out + ["a" * i for i in range(0, 400, 3)] + ["ab" * i for i in range(100)] + ["x" * 5000, "thereof" * 800]


def test_classes_are_those_of_the_libraries(library, classes):
    assert np.array_equal(classes, P.rank_file_classes())
    rng = random.Random(1)
    for c in rng.sample([*range(0x80, 0xD800), *range(0xE000, 0x110000)], 3000) + [0x558, 0x88F, 0x208F, 0x3000]:
        text = "a" + chr(c) + "1" + chr(c) + "!" + chr(c)
        data, offsets = text_bytes(pa.array([text]))
        cuts = P.byte_level_cuts(data, offsets, classes)
        chars = [len(data[:x].tobytes().decode()) for x in cuts]
        assert [tuple(x) for _, x in library.pre_tokenizer.pre_tokenize_str(text)] == list(zip(chars[:-1], chars[1:], strict=True)), hex(c)


def test_borders_equal_the_pattern(classes):
    texts = [t.replace("՘", "") for t in odd_texts(2, 5000)]
    data, offsets = text_bytes(pa.array(texts))
    assert np.array_equal(P.byte_level_cuts(data, offsets, classes), P.pattern_cuts(data, offsets, regex.compile(P.BYTE_LEVEL)))


def test_ids_equal_the_library(library, encoder):
    encode, tokens = encoder
    texts = odd_texts(3, 5000)
    ids, at = encode.encode_column(pa.array(texts))
    raw, ends = P.gather(tokens, ids, at)
    for i, text in enumerate(texts):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert bytes(raw[ends[i] : ends[i + 1]]).decode() == library.decode(mine, skip_special_tokens=False) == text


def test_a_small_memory_changes_nothing(library, classes, encoder):
    small = P.SliceEncoder(encoder[0].cutter, encoder[0].learn, memory=5)
    for text in odd_texts(4, 200):
        ids, _ = small.encode_column(pa.array([text, None, text]))
        assert ids.tolist() == 2 * library.encode(text, add_special_tokens=False).ids


def test_the_root_is_the_leftmost_lowest_rank():
    """Trees of one piece and of rows against merging by search, on a made vocabulary."""
    rng = random.Random(5)
    letters = {b: c for c, b in S.byte_letters().items()}
    vocab = {c: i for i, c in enumerate(letters.values())}
    merges = []
    while len(merges) < 60:
        a, b = rng.choice([t for t in vocab if set(t) <= set("abc")]), rng.choice([t for t in vocab if set(t) <= set("abc")])
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": []}
    v = S.Vocabulary(json.dumps(spec))
    rank = {tuple(m): i for i, m in enumerate(merges)}
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 150))) for _ in range(400)]
    for piece, packed in zip(pieces, S.encode_pieces(v, [p.encode() for p in pieces]), strict=True):
        parts = list(piece)
        while len(parts) > 1:
            best, i = min((rank.get((parts[i], parts[i + 1]), 999), i) for i in range(len(parts) - 1))
            if best == 999:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        expected = [vocab[p] for p in parts]
        assert np.frombuffer(packed, np.int32).tolist() == expected
        assert S.PieceTree(v, piece.encode()).encode() == expected


def test_documents(spark, library):
    rows = awkward() + [(90, "<|endoftext|> in a text  \n two", "en", "s"), (91, "  <|endoftext|>", "en", "s")]
    got = S.tokenize(documents(spark, rows).repartition(5), PATH).collect()
    expected = sorted((i if i is not None else -1, hashlib.sha256((t or "").encode()).hexdigest(), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded_sha256, r.ids) for r in got) == expected
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert S.tokenize(documents(spark, []), PATH).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
            S.Vocabulary(f.read())


def test_tiktoken_knows_the_same_characters(classes):
    only = tiktoken.Encoding("classes", pat_str=r"\s", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert bytes(only.encode_ordinary("a՘ \x1c\x85　b")).decode() == " \x85　"
