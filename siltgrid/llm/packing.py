"""Best-fit packing by sum of squares.

Documents become ids and an end mark; only a document longer than a sequence is cut, so that all of
its pieces but the first are full. Each piece goes where it makes the sum over gaps g of N(g)^2
smallest, N(g) being the number of open sequences with g places left: the rule prefers to use up
gaps of which there are many and to leave gaps of which there are few; of equal choices the smallest
gap is taken. Pieces come in order of decreasing length, and a new sequence is opened only where no
open one has room: short pieces come last and fill what is left.

Pieces are dealt out evenly over shards of a bounded number of pieces by a running number, whatever
their ids, texts or sources; each shard is packed alone. What a shard leaves open is a few sequences
of the tens of thousands that it fills. Tokens are not shuffled, only lengths and checksums.

A null text is the end mark alone. Repeated rows and ids are packed one by one; a null id stays null. A text
of any length is tokenized whole and cut into as many pieces as it fills. Only the two named columns are
read, so others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs.
SHARD_PIECES = 150_000
#: Pieces between blanks whose ids a worker process keeps; some 200 bytes each.
MEMO_PIECES = 400_000


#: A word of Latin letters, its marks, and the first word of the next line with its marks: the tokenizer always cuts between these.
#: Marks are ASCII without the apostrophe, which takes letters with it.
_WORD, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", r"[!-&(-/:-@\[-`{-~]"
_PARTS = re.compile(f"({_WORD})({_MARKS}*)(?:(\n{_WORD})({_MARKS}*))?")


class PieceMemo(dict):
    """Ids of short pieces between blanks as little-endian unsigned 32-bit numbers; misses are encoded many at a time.

    New words with marks or a line's end are put together from their parts, which are fewer. When half of `most` is full, the pieces become those of before, and those of before go; what is met again comes back from there.
    """

    def __init__(self, path: str, most: int = MEMO_PIECES, together: int = 64):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.together = most, together
        self.before: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        n = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
        self.breaks = np.array([self.tokenizer.id_to_token(i) == "Ċ" for i in range(n)])
        self.specials = [str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, pieces: list[str]) -> None:
        absent = [p for p in pieces if p not in self]
        if len(self) + len(absent) > self.most // 2:
            self.before = dict(self)
            self.clear()
            absent = pieces
        whole, lines, built = set(), set(), []
        for p in absent:
            found = self.before.get(p)
            if found is not None:
                self[p] = found
            elif len(p) <= 64 and p and " " not in p:
                x = None if p.isalpha() else _PARTS.fullmatch(p)
                if x is None:
                    whole.add(p)
                else:
                    word, marks, line, more = x.groups("")
                    built.append((p, word, marks, line, more))
                    for part, new in ((word, whole), (line, lines)):
                        if part and part not in self:
                            found = self.before.get(part)
                            if found is not None:
                                self[part] = found
                            else:
                                new.add(part)
        self.encode_new(sorted(whole), " ", self.opens)
        self.encode_new(sorted(lines), "", self.breaks)
        for p, word, marks, line, more in built:
            a, b = self.get(word), self.get(line) if line else b""
            if a is not None and b is not None:
                self[p] = a + self.mark_ids(marks) + b + self.mark_ids(more)

    def encode_new(self, new: list[str], lead: str, opens: np.ndarray) -> None:
        """Learn pieces in order, as neighbours share merges. A token that `opens` begins each of them, with the lead before it."""
        for i in range(0, len(new), self.together):
            group = new[i : i + self.together]
            ids = self.plain(lead + lead.join(group))
            starts = np.flatnonzero(opens[ids])
            if len(starts) == len(group):  # such a token begins at each piece and nowhere else
                data = ids.tobytes()
                edges = [*(4 * starts).tolist(), len(data)]
                self.update(zip(group, (data[a:b] for a, b in zip(edges, edges[1:]))))

    def mark_ids(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            found = self.marks[marks] = self.plain(marks).tobytes()
        return found

    def __missing__(self, piece: str) -> bytes:
        return self.plain(" " + piece).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a piece that stands in the texts many times is looked up once."""
        # the first piece, and the rest whole, as a list of pieces where blanks do not all stand alone, or None
        first, rest, cut = [], [], []
        for t in texts:
            if any(s in t for s in self.specials):
                head, tail, pieces = t, None, []
            elif common.blanks_alone(t):
                head, blank, tail = t.partition(" ")
                tail, pieces = tail if blank else None, []
            else:
                head, *pieces = common.space_pieces(t)
                tail = None
            first.append(head)
            rest.append(tail)
            cut.append(pieces)
        split = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        coded = pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())]).dictionary_encode()
        pieces, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.learn(pieces)
        found = list(map(self.__getitem__, pieces))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        n = size[codes]
        ends = np.append(0, np.cumsum(n))  # of the pieces in their order in the texts
        data = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(start[codes] - ends[:-1], n)].tobytes()
        count = np.append(pc.list_value_length(split).fill_null(0).to_numpy(), np.array([len(c) for c in cut], np.int64)).astype(np.int64)
        edges = (4 * ends[np.append(0, np.cumsum(count))]).tolist()
        spans = list(zip(edges, edges[1:]))
        return [self.plain(h).tobytes() + data[slice(*a)] + data[slice(*b)] for h, a, b in zip(first, spans, spans[len(texts) :])]


@lru_cache(maxsize=2)
def memo(path: str, most: int) -> PieceMemo:
    return PieceMemo(path, most)


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n ids: all but the first are full."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)] if n > capacity else [0]


def pieces(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, texts_at_once: int = 512, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """(slot, key, piece, start, length, ids_crc32): slot numbers the pieces of a task, from a start of its own."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        slot = TaskContext.get().partitionId() * 7919
        for whole in batches:
            for at in range(0, whole.num_rows, texts_at_once):
                batch = whole.slice(at, texts_at_once)
                found = memo(tokenizer_path, memo_pieces).encode_all([v.as_buffer().to_pybytes().decode("utf-8", "replace") for v in batch.column(1)])
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), found):
                    ids += end
                    starts = cut_points(len(ids) // 4, capacity)
                    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4])):
                        rows.append((slot, doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                        slot += 1
                columns = zip(*rows) if rows else [[]] * 6
                kinds = (pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["slot", key, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[key].dataType.simpleString()
    return common.byte_texts(df, key, text).mapInArrow(common.tidied(run), f"slot long, {key} {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, taken in the given order."""
    count = np.zeros(capacity + 1)  # open sequences by gap
    count[0] = -0.5  # a sequence that is full adds nothing
    spare: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            here = count[size:capacity]
            change = np.where(here > 0, count[: capacity - size] - here, np.inf)  # half the change of the sum, less one
            best = int(change.argmin())
            if change[best] < np.inf:
                gap = size + best
        if gap == capacity:
            number, opened = opened, opened + 1
        else:
            number = spare[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > size:
            spare[gap - size].append(number)
            count[gap - size] += 1
    return sequence, offset


def pack(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place the pieces; cut must be a stored table, for it is read twice."""
    shards = max(1, -(-cut.count() // shard_pieces))
    kind = cut.schema[key].dataType.simpleString()

    def place(group: pa.Table) -> pa.Table:
        length, slot, shard = (group.column(c).to_numpy() for c in ("length", "slot", "shard"))
        order = np.lexsort((slot, -length))
        sequence, offset = sum_of_squares(length[order], capacity)
        rows = group.take(pa.array(order)).select([key, "piece", "start", "length", "ids_crc32"])
        return rows.append_column("sequence_id", pa.array(sequence + (shard[order] << 32))).append_column("offset", pa.array(offset))

    return cut.withColumn("shard", F.pmod("slot", F.lit(shards))).groupBy("shard").applyInArrow(place, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    return pack(common.saved(pieces(df, tokenizer_path, key, text, capacity, end_id, memo_pieces=memo_pieces), "pieces"), key, capacity)


def op1_sum_of_squares(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return pack_documents(common.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), memo_pieces=2 * MEMO_PIECES)


QUERIES = {"op1_sum_of_squares": op1_sum_of_squares}
ORACLES: dict[str, str] = {}
