"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly when every two neighbours stay apart, that is when
no merge across their seam comes before the merges that hide it. So the encoding of each prefix of a piece is
the encoding of a shorter prefix and one more token. A state holds the prefixes from which a token may still
be under way, with their encodings since the last emission; reading a byte moves all of them. What they have
in common can no longer change and is emitted, so lookahead is bounded by the longest token. States and moves
are made when first met and kept in a table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import slices, table
from tabwright.llm.pieces import SLICE_BYTES, Cutter, SliceEncoder, gather, rank_file_classes

#: A memory of pieces is begun anew beyond so many entries, that of moves and seams beyond this many: about 400 MB in
#: a worker. ``SMALL`` takes 150 MB where a worker also has other things to hold.
WORDS, MOVES = 400_000, 1_000_000
SMALL = (100_000, 200_000)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def split_tokens(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes] | None]:
    """The two parts that merge into each token last; ``None`` for single bytes. Tokens that merges never make are left out."""
    made: dict[bytes, tuple[bytes, bytes] | None] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
        if len(token) == 1:
            made[token] = None
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            made[token] = (parts[0], parts[1])
    return made


class Transducer:
    def __init__(self, ranks: dict[bytes, int], made: dict[bytes, tuple[bytes, bytes] | None], most: int = MOVES):
        self.ranks, self.made, self.most = ranks, made, most
        # a tree of the tokens' bytes: node and byte as one number to the next node, each node's token, whether more follows
        self.steps: dict[int, int] = {}
        self.token: list[bytes | None] = [None]
        for token in made:
            node = 0
            for byte in token:
                at = node << 8 | byte
                after = self.steps.get(at)
                if after is None:
                    after = self.steps[at] = len(self.token)
                    self.token.append(None)
                node = after
            self.token[node] = token
        self.more = bytearray(len(self.token))
        for at in self.steps:
            self.more[at >> 8] = 1
        self.seams: dict[tuple[bytes, bytes], bool] = {}
        self.right: dict[bytes, list] = {}
        self.left: dict[bytes, list] = {}
        self._clear()

    def _clear(self) -> None:
        #: a state: the last emitted token, and for each live prefix the node of the bytes since and its tokens since
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        #: (state, byte) as one number to the next state and what is emitted
        self.moves: dict[int, tuple[int, tuple]] = {}
        self._state((None, ((0, ()),)))

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
        return found

    def _edge(self, token: bytes, side: int, memory: dict) -> list[tuple[bytes, int]]:
        """Pieces at one end of a token from whole to single byte, each with the rank of the merge that hides it."""
        if (out := memory.get(token)) is None:
            out, hidden, part = [], 1 << 60, token
            while True:
                out.append((part, hidden))
                if self.made[part] is None:
                    break
                hidden, part = self.ranks[part], self.made[part][side]
            memory[token] = out
        return out

    def apart(self, first: bytes, second: bytes) -> bool:
        """Whether the two tokens stay as they are side by side."""
        if (known := self.seams.get((first, second))) is not None:
            return known
        if len(self.seams) > self.most:
            self.seams.clear()
        self.seams[first, second] = ok = self._stay(first, second)
        return ok

    def _stay(self, first: bytes, second: bytes) -> bool:
        rank = self.ranks.get
        left = self._edge(second, 0, self.left)
        for a, a_hidden in self._edge(first, 1, self.right):
            for b, b_hidden in left:
                # equal ranks merge from the left: the merge inside the first token wins, that inside the second loses
                merge = rank(a + b)
                if merge is not None and merge < a_hidden and merge <= b_hidden:
                    return False
        return True

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        last, live = self.keys[state]
        steps, token, more, seams = self.steps, self.token, self.more, self.seams
        going, done = [], None
        for node, tokens in live:
            node = steps.get(node << 8 | byte)
            if node is None:
                continue
            if done is None and (made := token[node]) is not None:
                before = tokens[-1] if tokens else last
                if before is None or (seams[before, made] if (before, made) in seams else self.apart(before, made)):
                    done = (*tokens, made)
            if more[node]:
                going.append((node, tokens))
        # what all live prefixes and the new one have in common is certain
        n = len(done)
        for _, tokens in going:
            n = min(n, len(tokens))
            while tokens[:n] != done[:n]:
                n -= 1
            if not n:
                break
        going.append((0, done))
        sure = done[:n]
        if n:
            last, going = sure[-1], [(node, tokens[n:]) for node, tokens in going]
        # the last token matters only to a prefix that ends with it
        for _, tokens in going:
            if not tokens:
                break
        else:
            last = None
        return self._state((last, tuple(going))), sure

    def encode(self, piece: bytes) -> list[bytes]:
        """Tokens of one piece, each emitted as soon as it is certain."""
        if len(self.moves) > self.most:
            self._clear()
        state, moves, out = 0, self.moves, []
        for byte in piece:
            at = state << 8 | byte
            move = moves.get(at)
            if move is None:
                move = moves[at] = self._move(state, byte)
            state, sure = move
            if sure:
                out += sure
        out += self.keys[state][1][-1][1]
        return out


class Encoder(SliceEncoder):
    """Texts to ids. Pieces met before are looked up, new ones go through the transducer unless they are a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, made: dict | None = None, memory: tuple[int, int] = (WORDS, MOVES), classes: np.ndarray | None = None):
        self.ranks = ranks
        self.transducer = Transducer(ranks, made or split_tokens(ranks), memory[1])
        classes = rank_file_classes() if classes is None else classes
        super().__init__(Cutter(pattern, classes), self._learn, memory[0])
        #: what is remembered; nearly all of it are words after a space
        self.after_space = self.known

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        rank, encode, out = self.ranks, self.transducer.encode, []
        for piece in pieces:
            whole = rank.get(piece)
            ids = [whole] if whole is not None else map(rank.__getitem__, encode(piece))
            out.append(array("i", ids).tobytes())
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text]))[0].tolist()


class Utf8Stream:
    """Feeds bytes in any cut to a UTF-8 state machine; characters that are whole come out at once."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes, end: bool = False) -> str:
        return self.machine.decode(raw, end)


def decode_stream(raw: memoryview, block: int = 1 << 16) -> Iterator[str]:
    """Text of the bytes of a stream of tokens, block by block."""
    stream = Utf8Stream()
    for at in range(0, len(raw), block):
        yield stream.feed(bytes(raw[at : at + block]))
    yield stream.feed(b"", True)


def _run(spark, path: str, pattern: str, with_ids: bool, memory: tuple[int, int]):
    # the vocabulary file is at most a few MB; it is read here, so the workers need no copy of it
    with open(path, "rb") as f:
        ranks = read_ranks(f.read())
    # a worker unpickles a broadcast value once and keeps it, so the encoder made from it serves all its tasks
    shared = spark.sparkContext.broadcast({"ranks": ranks, "made": split_tokens(ranks), "classes": rank_file_classes().tobytes()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "encoder" not in held:
            ranks = held["ranks"]
            held["encoder"] = Encoder(ranks, pattern, held["made"], memory, np.frombuffer(held["classes"], np.uint8))
            tokens = [b""] * (max(ranks.values(), default=0) + 1)
            for token, i in ranks.items():
                tokens[i] = token
            held["tokens"] = pa.array(tokens, pa.large_binary())
            held["decimal"] = pa.array([b"%d," % i for i in range(len(tokens))], pa.large_binary())
        encoder = held["encoder"]
        # with little memory slices are small too
        for batch in slices(batches, "text", min(SLICE_BYTES, 10 * memory[0])):
            ids, at = encoder.encode_column(batch.column("text"))
            digits, digit_at = gather(held["decimal"], ids, at)
            raw, raw_at = gather(held["tokens"], ids, at)
            id_hash, text_hash = [], []
            for i in range(batch.num_rows):
                # no comma after the last
                id_hash.append(hashlib.sha256(digits[digit_at[i] : max(digit_at[i], digit_at[i + 1] - 1)]).hexdigest())
                decoded = hashlib.sha256()
                for chars in decode_stream(raw[raw_at[i] : raw_at[i + 1]]):
                    decoded.update(chars.encode())
                text_hash.append(decoded.hexdigest())
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.diff(at)),
                "ids_sha256": pa.array(id_hash, pa.string()),
                "decoded_sha256": pa.array(text_hash, pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.LargeListArray.from_arrays(at, pa.array(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            # give back what Arrow keeps of a slice, as workers of several stages share an executor's memory
            del ids, digits, raw, columns
            pa.default_memory_pool().release_unused()

    return run


def tokenize(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, memory: tuple[int, int] = (WORDS, MOVES)) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids.

    ``path`` is a rank file, ``pattern`` cuts texts into pieces. A null text is empty and has no ids. The ids
    are decoded again as a stream; ``decoded_sha256`` is that of the decoded text. ``memory`` bounds what a worker
    remembers (words, moves) and changes no result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_run(docs.sparkSession, path, pattern, with_ids, memory), schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = table(spark, sf_dir, "documents")
    return tokenize(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, with_ids=False)
