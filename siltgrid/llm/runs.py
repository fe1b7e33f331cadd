"""Periodic run detection by the runs theorem.

A run is a stretch of words with smallest period q and at least 2q words that no neighbouring word
extends with that period. The theorem: each run has, under one of two opposite orders of the words,
a root of q words that is the longest Lyndon word at its start. So there are at most two candidates
for each position. The longest Lyndon word at i ends before the next smaller value of the inverse
suffix array (order one) or before the next greater one (order two, with the end mark greatest); it
is the root of a run if the common extension of its two ends, to the right and to the left, makes
twice its length. Extensions are minima of the LCP array between two ranks (a sparse table, of which
one level is held at a time); those to the left come from the index of the reversed words, which is
built for the documents that need it.

Documents of an Arrow batch are indexed together, some tens of thousands of words at a time, each
closed by an end mark that is smaller than all words, and numpy works on all of them at once: ranks
by prefix doubling, on the suffixes that are still tied. A document is never cut; one of any length
is indexed alone, in memory in proportion to its words. No row is shuffled.

A null or empty text has no words and no runs, and its collapsed text is empty. Repeated rows and ids
are judged one by one; null ids stay null. An empty table gives no rows. Only the two named columns
are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Least words of a run.
LEAST = 12
#: Words that are indexed together, but for longer documents.
TOGETHER = 60_000
#: Rounds of pointer jumping before the positions that are left are walked one by one.
JUMPS = 6


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next place with a smaller value, or the number of values."""
    n = len(values)
    height = np.append(values, np.iinfo(values.dtype).min)
    to = np.arange(1, n + 2)
    open_ = np.flatnonzero(height[1:] > height[:-1])
    for _ in range(JUMPS):
        if not len(open_):
            return to[:n]
        to[open_] = to[to[open_]]
        open_ = open_[height[to[open_]] > height[open_]]
    walked, heights = to.tolist(), height.tolist()
    for i in open_[::-1].tolist():  # all places behind i are done, and each is passed once
        j, own = walked[i], heights[i]
        while heights[j] > own:
            j = walked[j]
        walked[i] = j
    return np.array(walked[:n], np.int64)


class SuffixIndex:
    """Suffix array, ranks and LCP of documents laid end to end, each closed by a 0; suffixes are ordered by document first."""

    def __init__(self, text: np.ndarray, doc: np.ndarray) -> None:
        n = len(text)
        bits, doc_bits = max(1, int(text.max()).bit_length()), int(doc[-1]).bit_length()
        width = max(1, (62 - doc_bits) // bits)
        key = doc.astype(np.int64)
        for k in range(width):
            key = key << bits
            key[: max(0, n - k)] |= text[k:]
        order = key.argsort()
        first, tied = self.grouped(key[order])
        rank = np.empty(n, np.int64)
        rank[order] = first
        levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # width, tied places, their ranks
        places = order[tied]
        while len(places):
            own = rank[places]
            levels.append((width, places, own))
            # a tied suffix has no end mark within its width, so the place behind it is in its document
            key = own * n + rank[places + width]
            order = key.argsort()
            places, own = places[order], own[order]
            first, tied = self.grouped(key[order])
            start, _ = self.grouped(own)
            rank[places] = own + first - start
            places, width = places[tied], 2 * width
        self.rank, self.sa = rank, np.empty(n, np.int64)
        self.sa[rank] = np.arange(n)
        self.lcp = self.prefixes(text, doc, levels)

    @staticmethod
    def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted values: the place of the first equal one, and whether there is another."""
        change = values[1:] != values[:-1]
        new, last = np.append(True, change), np.append(change, True)
        return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0)), ~(new & last)

    def prefixes(self, text: np.ndarray, doc: np.ndarray, levels: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Common words of each suffix with the one before it in order; 0 across documents."""
        n = len(text)
        a, b, lcp = self.sa[:-1], self.sa[1:], np.zeros(n, np.int64)
        at = np.zeros(n - 1, np.int64)
        pairs = np.arange(n - 1)
        if levels:
            tied = np.full(n, -1, np.int64)
            tied[levels[0][1]] = levels[0][2]
            pairs = np.flatnonzero((tied[a] >= 0) & (tied[a] == tied[b]))  # others have less than the first width in common
            for width, places, ranks in reversed(levels):
                tied.fill(-1)
                tied[places] = ranks
                x, y = tied[a[pairs] + at[pairs]], tied[b[pairs] + at[pairs]]
                at[pairs[(x >= 0) & (x == y)]] += width
        left = np.flatnonzero(doc[a] == doc[b])
        while len(left):
            same = text[a[left] + at[left]] == text[b[left] + at[left]]  # never past an end mark: there the two differ
            left = left[same]
            at[left] += 1
        lcp[1:] = at
        return lcp

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at x and y (never equal): minima of the LCP array, answered level by level of the sparse table."""
        low = np.minimum(self.rank[x], self.rank[y]) + 1
        high = np.maximum(self.rank[x], self.rank[y]) + 1
        out = np.zeros(len(x), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of log2
        table, k = self.lcp, 0
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
            now = np.flatnonzero(level == k)
            out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k)])
        return out


def runs(text: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least `least` words, by start, then period.

    text: word numbers from 1, documents end to end, each closed by a 0; doc: the document's number at each place.
    """
    empty = np.zeros(0, np.int64)
    n = len(text)
    if not n:
        return empty, empty, empty
    index = SuffixIndex(text, doc)
    places = np.arange(n)
    start = np.concatenate([places, places])
    end = np.concatenate([next_smaller(index.rank), next_smaller(-index.rank)])
    root = end < n
    start, end = start[root], end[root]
    # the leftmost root of a run is followed by its first word; an end mark equals no word
    root = (text[start] == text[end]) & (doc[start] == doc[end])
    start, end = start[root], end[root]
    period = end - start
    right = index.extension(start, end)
    wanted = np.maximum(least, 2 * period)
    short = wanted - period - right
    keep = np.ones(len(start), bool)
    for k in range(1, 5):  # most candidates fall here, before the reversed index is asked
        asks = np.flatnonzero(keep & (short >= k))
        keep[asks] = (start[asks] >= k) & (text[start[asks] - k] == text[end[asks] - k])
    start, end, period, right, wanted = (x[keep] for x in (start, end, period, right, wanted))
    if not len(start):
        return empty, empty, empty
    left = _to_left(text, doc, start, end)
    start, length = start - left, period + right + left
    whole = length >= wanted
    start, length, period = start[whole], length[whole], period[whole]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    return start[new], length[new], period[new]


def _to_left(text: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Common words that end before start and before end, from the index of the reversed documents."""
    ends = np.flatnonzero(text == 0)  # one end mark for each document
    begins = np.append(0, ends[:-1] + 1)
    docs = np.unique(doc[start])
    sizes = ends[docs] - begins[docs]
    to = np.cumsum(sizes + 1) - sizes - 1  # where the reversed document begins
    own = np.repeat(np.arange(len(docs)), sizes + 1)
    offset = np.arange(len(own)) - to[own]
    mark = offset == sizes[own]
    back = np.where(mark, 0, text[np.where(mark, 0, ends[docs][own] - 1 - offset)])
    index = SuffixIndex(back, own)
    at = np.searchsorted(docs, doc[start])
    out = np.zeros(len(start), np.int64)
    inner = np.flatnonzero(start > begins[docs][at])
    turned = (to + ends[docs] - 1)[at[inner]]
    out[inner] = index.extension(turned - (start[inner] - 1), turned - (end[inner] - 1))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, of each run only the first period."""
    if not found:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def _judged(documents: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each document, with starts counted in the document."""
    sizes = np.array([len(words) for words in documents])
    flat = [w for words in documents for w in words]
    begins = np.cumsum(sizes + 1) - sizes - 1
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    text = np.zeros(len(doc), np.int64)
    if flat:
        inner = np.ones(len(doc), bool)
        inner[begins + sizes] = False
        text[inner] = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for s, length, period in zip(*(x.tolist() for x in runs(text, doc, least))):
        out[doc[s]].append((s - int(begins[doc[s]]), length, period))
    return out


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed): runs as an array of (start, length, period) by start, then period, counted in words from 0.

    prepare: what is done to a document's words first, given its id and words.
    """
    kind = df.schema[key].dataType.simpleString()
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(ids: list, documents: list[list[bytes]], key_type: pa.DataType) -> pa.RecordBatch:
        found = _judged(documents, least)
        values = [
            pa.array(ids, key_type),
            pa.array([len(w) for w in documents], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], pa.list_(entry)),
            pa.array([collapsed(w, r) for w, r in zip(documents, found)], pa.binary()).view(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(values, ["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, documents, size = [], [], 0
            for at in range(batch.num_rows):
                words = batch.column(1)[at].as_buffer().to_pybytes().split()
                own = batch.column(0)[at].as_py()
                if prepare is not None:
                    words = prepare(own, words)
                if documents and size + len(words) > TOGETHER:
                    yield rows(ids, documents, batch.schema.field(0).type)
                    ids, documents, size = [], [], 0
                ids.append(own)
                documents.append(words)
                size += len(words) + 1
            if documents:
                yield rows(ids, documents, batch.schema.field(0).type)

    out = common.byte_texts(df, key, text).mapInArrow(common.tidied(run), f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key)


def repeated_tail(own: object, words: list[bytes]) -> list[bytes]:
    """The query's preparation: in documents whose id's CRC-32 is divisible by ten, a stretch repeats to the end. A null id changes nothing."""
    n, h = len(words), 1 if own is None else zlib.crc32(str(own).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_runs_theorem(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(common.table(spark, sf_dir, "documents"), prepare=repeated_tail)
    # greatest length, then least start, then least period
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_runs_theorem": op11_runs_theorem}
ORACLES: dict[str, str] = {}
