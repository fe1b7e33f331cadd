"""Language-model scoring with a hashed maximum-entropy model.

A word has a class and a slot in it. The model gives a token the probability of its class, times that
of its slot within the class, times the word's share of the slot's training tokens. Both steps are a
softmax over sums of weights of hashed features of what stands before: the last word, the last two, the
one before the last (a skip) and the last frequent word (a longer skip) for the class; the last word
and the last two, each together with the class, for the slot. A class is a topic and a band of
frequency. Topics are groups of frequent words that follow each other; any other word has the topic of
the frequent words that it mostly follows. The most frequent words of a topic have slots of their own,
so there the softmax tells single words apart; others are dealt over slots by their hash. The mass of
words not seen in training is that of the words seen once (Good-Turing), so probabilities of all known
words and of the one unknown sum to one.

Texts are cut into words once, into stored blocks of local codes and a block's own dictionary. Counts
are summed by word over all training tokens. The most frequent words (at most HOT) are broadcast with
their counts and slots; only the other words of each block are sorted over the cluster and come back to
it, so no run of a common word, no task and no broadcast grows with the corpus. Training goes over all
training tokens: each round's tasks take gradient steps (AdaGrad, mini-batches) from the common weights
over their share of the blocks, and each row of weights is averaged over the tasks that met it, by how
often. Rows of the feature tables grow with the training tokens, up to the size that a task can hold.
Scoring runs over blocks in numpy batches.

A null text is empty: one end token. A null id counts as empty text where it is hashed. Repeated rows
are learned from and scored one by one. A text of any length is in one block, which a longer text makes
as long as itself. Words that follow two topics equally often belong to the one of smaller number. Other
columns are not read. An empty table gives no rows; without a training token
every probability is one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes of a block, about.
BLOCK_BYTES = 8 << 20
#: Words that are broadcast with their counts, at most, and words that topics are made of.
HOT, FREQUENT = 1 << 18, 128
#: Topics; bands of a topic: SINGLE with a slot for each word, one of the next WIDE words, one of the other hot words, one of the rest.
TOPICS, SINGLE, WIDE = 6, 3, 1024
BANDS = SINGLE + 3
SLOTS = 32
CLASSES = TOPICS * BANDS
#: Feature tables of the two steps; rows of each: a power of two, about one for so many training tokens, of so many bits.
CLASS_TABLES, SLOT_TABLES = 4, 2
TOKENS_PER_ROW, LEAST_BITS, MOST_BITS = 1 << 14, 10, 16
ROUNDS, RATE, BATCH = 2, 0.15, 1 << 13
#: Rows of a table that travel together.
CHUNK = 16
END = xxhash.xxh64_intdigest(b"", 0)  # no word is empty
BLOCK = "block long, ids array<{kind}>, held array<boolean>, sizes array<int>, codes binary, words array<long>, trained array<int>"
CODED = "block long, ids array<{kind}>, held array<boolean>, sizes array<int>, codes binary, marks binary, known binary, frequent array<int>"


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stored blocks: documents as codes into the block's list of word hashes."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        seen: dict[bytes, int] = {b"": 0}
        ids, sizes, codes, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            flat = np.array(codes, "<u4")
            held = np.array([held_out(i) for i in ids], bool)
            trained = np.bincount(flat[~np.repeat(held, sizes)], minlength=len(seen))
            words = np.array([END, *(xxhash.xxh64_intdigest(w, 0) for w in list(seen)[1:])], np.uint64).view(np.int64)
            values = [[part << 32 | made], [ids], [held.tolist()], [sizes], [packed(flat)], [words], [trained.astype(np.int32)]]
            kinds = (pa.int64(), pa.list_(id_kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "ids", "held", "sizes", "codes", "words", "trained"])

        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = value.as_buffer().to_pybytes().lower()
                found = [seen.setdefault(w, len(seen)) for w in data.split()]
                codes += found
                codes.append(0)
                ids.append(doc)
                sizes.append(len(found) + 1)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield block()
                    made += 1
                    seen, ids, sizes, codes, size = {b"": 0}, [], [], [], 0
        if ids:
            yield block()

    return common.saved(common.byte_texts(df, key, text).mapInArrow(common.tidied(run), BLOCK.format(kind=kind)), "blocks")


@dataclass
class Counts:
    """Training tokens, distinct words and words seen once; hot words in order with their counts, and numbers of the frequent ones, most frequent first."""

    n: int
    v: int
    once: int
    hot: np.ndarray
    hot_n: np.ndarray
    frequent: np.ndarray

    def places(self, words: np.ndarray) -> np.ndarray:
        """Numbers among the hot words, or -1."""
        if len(self.hot) == 0:
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return np.where(self.hot[at] == words, at, -1)

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Numbers among the frequent words, or -1."""
        of_hot = np.full(len(self.hot) + 1, -1, np.int16)
        of_hot[self.frequent] = np.arange(len(self.frequent))
        return of_hot[self.places(words)]


def count_words(stored: DataFrame) -> Counts:
    """Counts over all training tokens. Bands of counts are taken into the hot words from the top, as many as fit."""
    pairs = stored.select(F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("trained").alias("n"))).alias("x")).select("x.word", "x.n").filter("n > 0")
    totals = common.saved(pairs.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    band = F.floor(F.log2("n") * 4)
    rows = totals.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).orderBy(F.desc("band")).collect()
    taken, least = 0, None
    for r in rows:
        if taken + r["words"] > HOT:
            break
        taken, least = taken + r["words"], r["band"]
    hot = totals.filter(F.lit(False) if least is None else band >= least).select("word", "n").toArrow().sort_by("word")
    common.discard(totals)
    words, n = (hot.column(i).to_numpy() for i in range(2))
    frequent = np.lexsort((words, -n))[:FREQUENT]
    return Counts(sum(r["n"] for r in rows), sum(r["words"] for r in rows), sum(r["once"] for r in rows), words, n, frequent)


class Tokens:
    """A block's tokens: the codes of their words, and where their document starts."""

    def __init__(self, codes: bytes, sizes):
        self.codes = unpacked(codes, "<u4").view("<i4")
        self.sizes = np.asarray(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.start = np.repeat(self.first.astype(np.int32), self.sizes)

    def trained(self, held) -> np.ndarray:
        return np.repeat(~np.asarray(held, bool), self.sizes)

    def before(self, rank: np.ndarray) -> np.ndarray:
        """The rank of the last frequent word of the document so far, or -1."""
        of_token = rank[self.codes]
        n = len(of_token)
        last = np.empty(n, np.int32)
        if n:
            last[0] = -1
            last[1:] = np.maximum.accumulate(np.where(of_token >= 0, np.arange(n, dtype=np.int32), np.int32(-1)))[:-1]
        return np.where(last >= self.start, of_token[last], np.int16(-1))

    def contexts(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the last word, of the last two, and of the one before the last; 1 stands for what is before the text."""
        n = len(self.codes)
        own = marks[self.codes]
        place = np.arange(n, dtype=np.int32) - self.start
        one, two = np.ones(n, np.uint32), np.ones(n, np.uint32)
        one[1:] = np.where(place[1:] >= 1, own[:-1], np.uint32(1))
        two[2:] = np.where(place[2:] >= 2, own[:-2], np.uint32(1))
        return one, (one * np.uint32(0x9E3779B1) + two) * np.uint32(0x85EBCA6B), two


def class_rows(one: np.ndarray, both: np.ndarray, two: np.ndarray, before: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of the feature tables of the first step, one array for each."""
    shift = np.uint32(32 - bits)
    return [(one * np.uint32(0xC2B2AE35) >> shift).astype(np.uint16), (both >> shift).astype(np.uint16), (two * np.uint32(0x27D4EB2F) >> shift).astype(np.uint16), (before + 1).astype(np.uint16)]


def slot_rows(one: np.ndarray, both: np.ndarray, classes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of the feature tables of the second step."""
    shift = np.uint32(32 - bits)
    salt = (classes + 1).astype(np.uint32) * np.uint32(0x165667B1)
    return [((one ^ salt) * np.uint32(0x9E3779B1) >> shift).astype(np.uint16), ((both ^ salt) * np.uint32(0xC2B2AE3D) >> shift).astype(np.uint16)]


def topics(stored: DataFrame, counts: Counts) -> np.ndarray:
    """The topic of each frequent word: groups of words that follow each other, by the leading eigenvectors of their counts."""
    t = len(counts.frequent)
    if t <= TOPICS:
        return np.arange(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(t * t, np.int64)
        for batch in batches:
            for codes, sizes, words, held in zip(*(batch.column(i) for i in range(4))):
                tokens, rank = Tokens(codes.as_py(), sizes.as_py()), counts.ranks(words.values.to_numpy())
                own, before = rank[tokens.codes], tokens.before(rank)
                use = (own >= 0) & (before >= 0) & tokens.trained(held.as_py())
                total += np.bincount(before[use].astype(np.int64) * t + own[use], minlength=t * t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = stored.select("codes", "sizes", "words", "held").mapInArrow(common.tidied(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    m = np.zeros(t * t)
    for r in rows:
        m[r["at"]] = r["n"]
    m = m.reshape(t, t) + m.reshape(t, t).T + 1e-3
    scale = 1 / np.sqrt(m.sum(axis=1))
    vectors = np.linalg.eigh(m * scale[:, None] * scale[None, :])[1][:, -TOPICS:]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12
    middle = vectors[[0]]
    while len(middle) < TOPICS:  # start from words that lie far apart
        middle = np.append(middle, vectors[[int((vectors @ middle.T).max(axis=1).argmin())]], axis=0)
    for _ in range(20):
        label = (vectors @ middle.T).argmax(axis=1)
        middle = np.stack([vectors[label == g].mean(axis=0) if (label == g).any() else middle[g] for g in range(TOPICS)])
    return label


#: Bits of a topic's count in a packed number; larger counts take several rows.
LANE = 10
FULL = (1 << LANE) - 1


def followed(tokens: Tokens, rank: np.ndarray, topic: np.ndarray, held, words: int) -> np.ndarray:
    """How often each of a block's words stood after a frequent word of each topic, in training."""
    before = tokens.before(rank)
    use = (before >= 0) & tokens.trained(held)
    of = topic[before[use]] if len(topic) else 0
    return np.bincount(tokens.codes[use].astype(np.int64) * TOPICS + of, minlength=TOPICS * words).reshape(-1, TOPICS)


def hot_topics(stored: DataFrame, counts: Counts, topic: np.ndarray) -> np.ndarray:
    """The topic of each hot word: the frequent ones have theirs, others that which they mostly follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(counts.hot) + 1, TOPICS), np.int64)
        for batch in batches:
            for codes, sizes, words, held in zip(*(batch.column(i) for i in range(4))):
                hashes = words.values.to_numpy()
                total[counts.places(hashes)] += followed(Tokens(codes.as_py(), sizes.as_py()), counts.ranks(hashes), topic, held.as_py(), len(hashes))
        total = total[:-1].ravel()  # the last row took the other words
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    votes = stored.select("codes", "sizes", "words", "held").mapInArrow(common.tidied(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    best = votes.groupBy(F.floor(F.col("at") / TOPICS).alias("word")).agg(F.max(F.struct("n", -F.col("at"))).getField("col2").alias("at")).toArrow()
    found = np.zeros(len(counts.hot), np.int64)
    found[best.column("word").to_numpy()] = -best.column("at").to_numpy() % TOPICS
    found[counts.frequent] = topic
    return found


def by_hash(words: np.ndarray) -> np.ndarray:
    """Slots of words that have none of their own."""
    return (words.view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def hot_leaves(counts: Counts, topic: np.ndarray) -> np.ndarray:
    """Class and slot, as one number, of each hot word."""
    leaf = np.zeros(len(counts.hot), np.int64)
    for g in range(TOPICS):
        mine = np.flatnonzero(topic == g)
        mine = mine[np.lexsort((counts.hot[mine], -counts.hot_n[mine]))]
        rank = np.arange(len(mine))
        single = rank < SINGLE * SLOTS
        band = np.where(single, rank // SLOTS, np.where(rank < SINGLE * SLOTS + WIDE, SINGLE, SINGLE + 1))
        leaf[mine] = (g * BANDS + band) * SLOTS + np.where(single, rank % SLOTS, by_hash(counts.hot[mine]))
    return leaf


def cold_rows(stored: DataFrame, counts: Counts, topic: np.ndarray) -> DataFrame:
    """(word, block, at, n, lanes): a block's words that are not hot, with their training counts, and how often each followed a word of each topic. Rows with n = -1 only add to lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, sizes, words, held, trained in zip(*(batch.column(i) for i in range(6))):
                hashes, n = words.values.to_numpy(), trained.values.to_numpy().astype(np.int64)
                cold = np.flatnonzero(counts.places(hashes) < 0)
                seen = followed(Tokens(codes.as_py(), sizes.as_py()), counts.ranks(hashes), topic, held.as_py(), len(hashes))[cold]
                times = np.maximum(1, -(-seen.max(axis=1) // FULL)) if len(cold) else cold
                row = np.repeat(np.arange(len(cold)), times)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                part = np.clip(seen[row] - FULL * turn[:, None], 0, FULL).astype(np.int64)
                lanes = sum(part[:, g] << (LANE * g) for g in range(TOPICS))
                at = cold[row]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(np.full(len(at), block.as_py())), pa.array(at), pa.array(np.where(turn == 0, n[at], -1)), pa.array(lanes)], ["word", "block", "at", "n", "lanes"])

    return stored.select("block", "codes", "sizes", "words", "held", "trained").mapInArrow(common.tidied(run), "word long, block long, at long, n long, lanes long")


def known_words(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and leaves (-1: none) of words."""
    return known >> 16, (known & 0x7FFF) - 1


LEAD = 1 << 15  # one row of each word that is not hot stands for it in totals


def with_counts(stored: DataFrame, counts: Counts, topic: np.ndarray, kind: str) -> tuple[DataFrame, np.ndarray]:
    """Stored blocks with each word's training count and leaf, without the words themselves; and the training tokens of each leaf.

    Words that are not hot are sorted over the cluster once; each run of a word gives its count and leaf back to the blocks it came from.
    """
    leaf = hot_leaves(counts, hot_topics(stored, counts, topic))
    sent = stored.sparkSession.sparkContext.broadcast((counts, leaf))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, block, at, n, lanes in common.by_runs(batches, 0):
            new = np.append(True, word[1:] != word[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(np.maximum(n, 0), first)
            votes = np.stack([np.add.reduceat(lanes >> (LANE * g) & FULL, first) for g in range(TOPICS)], axis=1)
            own = (votes.argmax(axis=1) * BANDS + BANDS - 1) * SLOTS + by_hash(word[first])
            known = np.where(total > 0, total << 16 | own + 1, 0)
            run_of = np.cumsum(new) - 1
            live = np.flatnonzero(n >= 0)
            out = known[run_of[live]]
            out[np.flatnonzero(np.append(True, run_of[live][1:] != run_of[live][:-1])) if len(live) else live] |= LEAD
            yield pa.RecordBatch.from_arrays([pa.array(block[live]), pa.array(at[live]), pa.array(out)], ["block", "at", "known"])

    back = cold_rows(stored, counts, topic).repartition("word").sortWithinPartitions("word").mapInArrow(common.tidied(runs), "block long, at long, known long")
    back = back.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("known").alias("known"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, leaf = sent.value
        leaf = np.append(leaf, -1)
        n = np.append(counts.hot_n, 0)
        for batch in batches:
            marks, known, frequent = [], [], []
            for words, at, value in zip(batch.column(5), batch.column(6), batch.column(7)):
                hashes = words.values.to_numpy()
                place = counts.places(hashes)
                found = np.where(place >= 0, n[place] << 16 | leaf[place] + 1, 0)
                if at.is_valid:
                    found[at.values.to_numpy()] = value.values.to_numpy()
                rank = counts.ranks(hashes)
                here = np.flatnonzero(rank >= 0)
                code = np.full(len(counts.frequent), -1, np.int32)
                code[rank[here]] = here
                marks.append(packed((hashes.view(np.uint64) >> np.uint64(32)).astype("<u4")))
                known.append(packed(found.astype("<i8")))
                frequent.append(code)
            rest = [pa.array(marks, pa.binary()), pa.array(known, pa.binary()), pa.array(frequent, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *rest], ["block", "ids", "held", "sizes", "codes", "marks", "known", "frequent"])

    joined = stored.drop("trained").join(back, "block", "left").select("block", "ids", "held", "sizes", "codes", "words", "at", "known")
    coded = common.saved(joined.mapInArrow(common.tidied(merged), CODED.format(kind=kind)), "coded-blocks")
    common.discard(stored)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(CLASSES * SLOTS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                x = unpacked(value.as_py(), "<i8")
                count, at = known_words(x[(x & LEAD > 0) & (x >> 16 > 0)])
                np.add.at(mass, at, count)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mass))), pa.array(mass)], ["leaf", "n"])

    mass = np.bincount(leaf, counts.hot_n, CLASSES * SLOTS).astype(np.int64)
    for r in coded.select("known").mapInArrow(common.tidied(totals), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        mass[r["leaf"]] += r["n"]
    return coded, mass


def segment_sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, taken in the given order; runs begin at `first`. Short runs are summed side by side, long ones alone."""
    size = np.diff(np.append(first, len(order)))
    out = rows[order[first]]
    for k in range(1, 16):
        more = np.flatnonzero((size > k) & (size <= 16))
        if len(more) == 0:
            break
        out[more] += rows[order[first[more] + k]]
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = rows[order[first[i] : first[i] + size[i]]].sum(axis=0)
    return out


class Layer:
    """One softmax: for each value of each hashed feature a row of weights, and a fixed bias."""

    def __init__(self, tables: np.ndarray, bias: np.ndarray):
        self.tables, self.bias = tables.astype(np.float32), bias.astype(np.float32)
        self.squares = np.zeros(tables.shape[:2], np.float32)
        self.met = np.zeros(tables.shape[:2], np.int64)

    def scores(self, rows: list[np.ndarray], given: np.ndarray | None = None) -> np.ndarray:
        """Sums of weights, less the greatest; `given` picks a row of the bias where it has several."""
        out = self.tables[0].take(rows[0], axis=0)
        for table, r in zip(self.tables[1:], rows[1:]):
            out += table.take(r, axis=0)
        out += self.bias if given is None else self.bias.take(given, axis=0)
        out -= out.max(axis=1, keepdims=True)
        return out

    def descend(self, rows: list[np.ndarray], target: np.ndarray, given: np.ndarray | None = None, rate: float = RATE) -> None:
        """AdaGrad steps over mini-batches, with one rate for each row."""
        for a in range(0, len(target), BATCH):
            part = [r[a : a + BATCH] for r in rows]
            slope = self.scores(part, None if given is None else given[a : a + BATCH])
            np.exp(slope, out=slope)
            slope /= slope.sum(axis=1, keepdims=True)
            slope[np.arange(len(slope)), target[a : a + BATCH]] -= 1
            for t, r in enumerate(part):
                order = np.argsort(r, kind="stable")
                ordered = r[order]
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                at, step = ordered[first], segment_sums(slope, order, first)
                self.met[t, at] += np.diff(np.append(first, len(ordered)))
                self.squares[t, at] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                self.tables[t][at] -= step * (rate / np.sqrt(self.squares[t, at] + 1e-2))[:, None]

    def logs(self, rows: list[np.ndarray], target: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms of the targets' probabilities."""
        s = self.scores(rows, given).astype(np.float64)
        return s[np.arange(len(s)), target] - np.log(np.exp(s).sum(axis=1))


def rows_of(tokens: Tokens, marks: bytes, frequent, classes: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature rows of both steps for all tokens of a block."""
    mark = unpacked(marks, "<u4")
    rank = np.full(len(mark), -1, np.int16)
    code = np.asarray(frequent, np.int64)
    rank[code[code >= 0]] = np.flatnonzero(code >= 0)
    one, both, two = tokens.contexts(mark)
    return class_rows(one, both, two, tokens.before(rank), bits), slot_rows(one, both, classes, bits)


def chunk_rows(layers: list[Layer]) -> Iterator[tuple[int, bytes]]:
    """The rows that a task met, in chunks: how often, then their weights."""
    for number, layer in enumerate(layers):
        for t in range(len(layer.tables)):
            met = layer.met[t].reshape(-1, CHUNK)
            for c in np.flatnonzero(met.any(axis=1)).tolist():
                yield number << 40 | t << 32 | c, met[c].astype("<f4").tobytes() + layer.tables[t, c * CHUNK : (c + 1) * CHUNK].astype("<f2").tobytes()


def train(coded: DataFrame, mass: np.ndarray, n: int) -> tuple[list[Layer], int]:
    """Weights of both steps, and the bits of a row's number. Blocks are dealt over the rounds, so that each training token is met once."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) / TOKENS_PER_ROW)), LEAST_BITS, MOST_BITS))
    share = (mass + 1e-3).reshape(CLASSES, SLOTS)
    layers = [
        Layer(np.zeros((CLASS_TABLES, 1 << bits, CLASSES)), np.log(share.sum(axis=1) / share.sum())),
        Layer(np.zeros((SLOT_TABLES, 1 << bits, SLOTS)), np.log(share / share.sum(axis=1, keepdims=True))),
    ]
    spark = coded.sparkSession
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast([(x.tables.astype(np.float16), x.bias) for x in layers])  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [Layer(*x) for x in sent.value]
            for batch in batches:
                for codes, sizes, held, marks, known, frequent in zip(*(batch.column(i) for i in range(6))):
                    tokens = Tokens(codes.as_py(), sizes.as_py())
                    leaf = known_words(unpacked(known.as_py(), "<i8"))[1].astype(np.int32)[tokens.codes]
                    use = np.flatnonzero(tokens.trained(held.as_py()))
                    cls, slot = leaf // SLOTS, leaf % SLOTS
                    for layer, rows, target, given in zip(own, rows_of(tokens, marks.as_py(), frequent.values.to_numpy(), cls, bits), (cls, slot), (None, cls)):
                        layer.descend([r[use] for r in rows], target[use], None if given is None else given[use])
            part, data = zip(*chunk_rows(own)) if any(x.met.any() for x in own) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(data, pa.binary())], ["part", "data"])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                    met = np.frombuffer(data, "<f4", CHUNK).astype(np.float64)
                    found = sums.setdefault(part, [0, 0.0])
                    found[0] = found[0] + met
                    found[1] = found[1] + met[:, None] * np.frombuffer(data, "<f2", offset=4 * CHUNK).reshape(CHUNK, -1)
            means = [met.astype("<f4").tobytes() + (total / np.maximum(met, 1)[:, None]).astype("<f4").tobytes() for met, total in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(means, pa.binary())], ["part", "data"])

        mine = coded.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn).select("codes", "sizes", "held", "marks", "known", "frequent")
        steps = mine.mapInArrow(common.tidied(run), "part long, data binary")
        for r in steps.repartition("part").mapInArrow(common.tidied(averaged), "part long, data binary").collect():
            layer, t, c = layers[r["part"] >> 40], r["part"] >> 32 & 255, r["part"] & 0xFFFFFFFF
            met = np.flatnonzero(np.frombuffer(r["data"], "<f4", CHUNK))
            layer.tables[t, c * CHUNK + met] = np.frombuffer(r["data"], "<f4", offset=4 * CHUNK).reshape(CHUNK, -1)[met]
        sent.unpersist()
    return layers, bits


@dataclass
class Model:
    """All that scoring needs beside a block's own counts and leaves."""

    layers: list[Layer]
    bits: int
    mass: np.ndarray
    n: int
    v: int
    unseen: float

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))

    def logs(self, tokens: Tokens, marks: bytes, frequent, count: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; count and leaf are the tokens' words'."""
        by_class, by_slot = rows_of(tokens, marks, frequent, leaf // SLOTS, self.bits)
        inside = np.log(np.maximum(self.mass, 1))
        out = np.full(len(count), np.log10(self.unseen))
        for a in range(0, len(count), BATCH):
            at = np.flatnonzero(count[a : a + BATCH] > 0) + a
            if len(at):
                cls, slot = np.divmod(leaf[at], SLOTS)
                own = self.layers[0].logs([r[at] for r in by_class], cls) + self.layers[1].logs([r[at] for r in by_slot], slot, cls)
                out[at] = (own + np.log(count[at]) - inside[leaf[at]]) / np.log(10) + np.log10(1 - self.unseen)
        return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model]:
    """The stored blocks of all texts and the model learned from the training ones."""
    stored = blocks(df, key, text)
    counts = count_words(stored)
    coded, mass = with_counts(stored, counts, topics(stored, counts), df.schema[key].dataType.simpleString())
    unseen = (counts.once + 1) / (counts.n + 2) if counts.v else 1.0
    return coded, Model(*train(coded, mass, counts.n), mass, counts.n, counts.v, unseen)


def score(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    coded, model = fit(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for ids, held, sizes, codes, marks, known, frequent in zip(*(batch.column(i) for i in range(7))):
                tokens = Tokens(codes.as_py(), sizes.as_py())
                count, leaf = (x[tokens.codes] for x in known_words(unpacked(known.as_py(), "<i8")))
                own = model.logs(tokens, marks.as_py(), frequent.values.to_numpy(), count, leaf.astype(np.int32))
                sums = [np.add.reduceat(x, tokens.first) for x in ((count > 0).astype(np.int64), model.base(count), own)]
                arrays = [pa.array(ids.as_py(), batch.schema.field(0).type.value_type), pa.array(held.as_py(), pa.bool_()), pa.array(tokens.sizes), pa.array(sums[0]), pa.array(np.full(len(tokens.sizes), model.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = df.schema[key].dataType.simpleString()
    columns = coded.select("ids", "held", "sizes", "codes", "marks", "known", "frequent")
    return columns.mapInArrow(common.tidied(run), f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_maxent(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_maxent": op5_maxent}
ORACLES: dict[str, str] = {}
