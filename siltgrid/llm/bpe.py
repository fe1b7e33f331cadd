"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A byte string is encoded from left to right. Merging is local: the encoding of a prefix that ends
at a token boundary is the prefix of the encoding, and a sequence of tokens is an encoding exactly
if each two neighbours are what merging their joint bytes gives. So each position has one last
token, found among those that end there by testing it against the token before.

The transducer's state holds what the future may depend on: the last bytes that can still begin a
token, and for each position at which a next token may begin, the tokens not yet emitted on the way
there. Tokens that all these ways share are emitted, so output lags the input by a bounded number
of bytes (the longest token's length). States and transitions are built when first met, and the
table is emptied when it holds too many.

Decoding maps ids to bytes as they come, and an incremental UTF-8 machine holds back the bytes of a
character that is not complete yet.

Null texts are empty. Very long matches of the pattern run through the transducer in linear time.
Repeated rows and ids are encoded one by one; a null id stays null. Only the two named columns are
read, so others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: In place of the token before, where a state does not depend on it; -1 stands for none at all.
UNUSED = -2
State = tuple[int, bytes, tuple[tuple[int, tuple[int, ...]], ...]]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Lazily determinised; one instance per worker process."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b))}
        self.pair: dict[tuple[int, int], bool] = {}
        self.most_states = most_states
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # by 256 * state + byte
        self.last: list[tuple[int, ...]] = []
        self.start = self.intern((-1, b"", ((0, ()),)))

    def intern(self, state: State) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            self.last.append(state[2][-1][1])  # what is left to emit if the input ends here
        return found

    def merged(self, text: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        rank, never = self.ranks.get, 1 << 60
        parts = [text[i : i + 1] for i in range(len(text))]
        joint = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while joint and (least := min(joint)) < never:
            at = joint.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(joint):
                joint[at] = rank(parts[at] + parts[at + 1], never)
        return [self.ranks[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in an encoding."""
        found = self.pair.get((a, b))
        if found is None:
            if len(self.pair) > 2_000_000:
                self.pair.clear()
            found = self.pair[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Build the transition from a state on a byte: next state and the tokens to emit."""
        before, tail, ways = self.states[at]
        tail += bytes((byte,))
        end = len(tail)
        for start, pending in ways:
            new = self.ranks.get(tail[start:])
            if new is not None:
                prior = pending[-1] if pending else before
                if prior < 0 or self.fit(prior, new):
                    reached = (end, (*pending, new))
                    break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        live = [w for w in ways if tail[w[0] :] in self.prefixes] + [reached]
        shared = 0
        first = live[0][1]
        if len(live) == 1:
            shared = len(first)
        else:
            for tokens in zip(*[p for _, p in live]):
                if tokens.count(tokens[0]) < len(tokens):
                    break
                shared += 1
        out = first[:shared]
        cut = live[0][0]
        ways = tuple([(s - cut, p[shared:]) for s, p in live])
        # the token before matters only to a way with nothing pending
        before = UNUSED if all([p for _, p in ways]) else out[-1] if out else before
        return self.intern((before, tail[cut:], ways)), out

    def encode(self, text: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self.reset()
        at, out, moves = self.start, [], self.moves
        for byte in text:
            move = moves.get(at << 8 | byte)
            if move is None:
                move = moves[at << 8 | byte] = self.step(at, byte)
            at = move[0]
            if move[1]:
                out += move[1]
        out += self.last[at]
        return out


class Encoder(dict):
    """Texts to ids as little-endian unsigned 32-bit numbers. Holds the encodings of short pieces between blanks; emptied when full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 400_000):
        super().__init__()
        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.most_pieces = most_pieces

    def direct(self, text: str) -> bytes:
        encode = self.transducer.encode
        ids = [i for match in self.find(text) for i in encode(match.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        found = self.direct(" " + piece)
        if len(piece) <= 40:
            if len(self) >= self.most_pieces:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        first, *rest = common.space_pieces(text)
        return self.direct(first) + b"".join(map(self.__getitem__, rest))


class Utf8Machine:
    """Holds back the bytes of an incomplete character. fed() gives all bytes up to the last complete one; ill-formed bytes pass as they are."""

    #: Bytes that a leading byte calls for.
    NEEDS = {b: 1 + (b >= 0xC2) + (b >= 0xE0) + (b >= 0xF0) for b in range(256)} | dict.fromkeys(range(0x80, 0xC2), 1) | dict.fromkeys(range(0xF5, 256), 1)

    def __init__(self) -> None:
        self.held = b""

    def fed(self, data: bytes) -> bytes:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last character begins here
                if self.NEEDS[byte] > back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut]

    def ended(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


def decode_stream(ids: Iterable[np.ndarray], tokens: list[bytes]) -> Iterator[bytes]:
    """Byte strings of whole characters, as blocks of ids come in."""
    machine = Utf8Machine()
    for block in ids:
        yield machine.fed(b"".join(map(tokens.__getitem__, block.tolist())))
    yield machine.ended()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    ranks = read_ranks(path)
    gc.set_threshold(100_000, 20, 20)  # states hold no cycles, and looking for some among them takes long
    tokens = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        tokens[i] = b
    return Encoder(ranks, pattern), tokens


#: Ids that are decoded at a time.
BLOCK = 1 << 16


def digest_round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return counts and digests of both."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, tokens = encoder(path, pattern)
        counts, ids_sha, out_sha = [], [], []
        for value in batch.column(1):
            ids = enc.encode(value.as_buffer().to_pybytes().decode("utf-8", "replace"))
            numbers = np.frombuffer(ids, "<u4")
            back = hashlib.sha256()
            for part in decode_stream((numbers[i : i + BLOCK] for i in range(0, len(numbers), BLOCK)), tokens):
                back.update(part)
            counts.append(len(numbers))
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            out_sha.append(back.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return common.map_batches(common.byte_texts(df, key, text), run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, _ = encoder(path, pattern)
        ids = [np.frombuffer(enc.encode(v.as_buffer().to_pybytes().decode("utf-8", "replace")), "<u4").astype(np.int32) for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return common.map_batches(common.byte_texts(df, key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from arrays of ids; ill-formed UTF-8 becomes U+FFFD, null ids an empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, tokens = encoder(path, pattern)
        texts = [b"".join(decode_stream([np.asarray(v.as_py() or [], np.int64)], tokens)).decode("utf-8", "replace") for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return common.map_batches(df.select(key, ids), run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def op8_transducer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return digest_round_trip(common.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


QUERIES = {"op8_transducer": op8_transducer}
ORACLES: dict[str, str] = {}
