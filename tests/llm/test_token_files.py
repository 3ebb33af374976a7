import zlib

import numpy as np
import public_tokenizers as public
import pytest
from cases import awkward, documents
from tokenizers import Tokenizer

from tabwright.llm import token_files as T

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("part_bytes", [64 << 20, 60_000])
def test_files_hold_what_the_library_says(spark, library, part_bytes):
    rows = awkward() + [(90, "<|endoftext|> in a text  \n two", "en", "s"), (91, " lead", "en", "s"), (92, "a \n b\x1c c", "en", "s")]
    got = sorted(T.read(T.write(documents(spark, rows).repartition(3), PATH, part_bytes=part_bytes)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: -1 if i is None else i)
    by = {}
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        by.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in by[r.doc_id]
        start += r.n_tokens


def test_empty_table(spark):
    assert T.read(T.write(documents(spark, []), PATH)).count() == 0


def test_words_equal_whole_texts(library):
    import random

    rng, encoder = random.Random(2), T.WordEncoder(library.to_str(), "<u2")
    signs = [" ", "  ", "\n", "\t", "a", "Z", "'s", "1", "½", "!", "\x1c", "\x85", "\xa0", " ", "​", "é", "\U0001f600", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 15))) for _ in range(4000)]
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u2")[:-1].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
