"""Suffix-array dedup with a logarithmic index family.

A byte is removed where a string of `least` bytes that covers it also starts earlier: in a document
of smaller id, or earlier in the same one. Every window of `least` bytes picks one anchor inside, the
k-gram of least hash, so equal windows pick equal anchors at equal places, and only the suffixes at
anchors (about one byte in thirty) need indexing. A suffix is filed by the fingerprints of its
anchor and of its reach, which is the text under all windows that picked the anchor.

Each task keeps a logarithmic family of suffix arrays: a batch of documents is sorted into an array
of its own, merge-scanned against the arrays there are, and what has no earlier equal becomes a new
level; levels of equal size merge, so an entry is moved a logarithmic number of times. A reach found
earlier in the family covers all windows of its anchor at once, and neighbouring ones join into one
range: a group of copies shrinks before it is shuffled. The remaining suffixes are sorted over the
cluster by anchor, which merges the tasks' families, and are scanned in the same way.

Where anchors are equal but reaches differ (the ends of a repeat), single windows decide: only there
the text is fetched, and fingerprints of the windows go through a family and a scan as before.
Windows are compared by 64-bit fingerprints at offsets that agree in the anchor, and a document's
own removal by exact byte ranges.

Texts are whole UTF-8 bytes; a null text is empty. Rows without an id take no part in the index and
stay whole. Rows that share an id are documents of their own, told apart by a hash of their text: none of
them is earlier than another, so what they repeat of each other stays, and equal ones are judged alike.
Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST, ANCHOR = 100, 40
#: Names of joined columns, which a table of documents is not expected to have.
RANGES, OWNER, MARK, OWNER_MARK = "__siltgrid_ranges", "__siltgrid_owner", "__siltgrid_mark", "__siltgrid_owner_mark"
_RANDOM = np.random.default_rng(7)
BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes whose windows are cut at once, and the bits that hold a place among them.
STRETCH, PLACE_BITS = 1 << 21, np.uint64(23)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        while have < n:  # doubling
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
    return out


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Spread a number's entropy over its bits."""
    x = x ^ np.uint64(salt)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Prints:
    """Fingerprints of any ranges of a byte string."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Prints._powers[0]) < n:
            Prints._powers = (_powers(BASE, n), _powers(INVERSE, n))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE_VALUES[data] * Prints._powers[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Prints._powers[1][start]

    def all_of_length(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * Prints._powers[1][:n] if n else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of so many neighbours."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchored suffixes of documents that lie side by side: document number, anchor's and reach's fingerprint, first window, windows after it."""
    prints = Prints(data)
    grams = mixed(prints.all_of_length(anchor), 1)
    width = least - anchor + 1
    found = []
    for at in range(0, max(0, len(data) - least + 1), STRETCH):
        part = grams[at : at + STRETCH + width - 1]
        ordered = (part >> PLACE_BITS << PLACE_BITS) | np.arange(len(part), dtype=np.uint64)
        found.append((sliding_least(ordered, width) & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64) + at)
    if not found:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    picked = np.concatenate(found)
    doc = np.searchsorted(ends, np.arange(len(picked)), side="right")
    inside = (doc < len(ends)) & (np.arange(len(picked)) + least <= ends[np.minimum(doc, len(ends) - 1)])
    window = np.flatnonzero(inside)
    picked, doc = picked[window], doc[window]
    new = np.ones(len(window), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    low, high, doc, at = window[first], window[last], doc[first], picked[first]
    reach = mixed(prints.of(low, high + least), 2) ^ mixed(((at - low) << 16 | (high - low)).astype(np.uint64), 3)
    return doc, grams[at], reach, low - starts[doc], high - low


class LevelFamily:
    """Sorted arrays of (print, document, its mark, place), each at least twice as long as the next."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, prints: np.ndarray, docs: np.ndarray, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Take in a batch; tells which of its entries have an equal one earlier, in the batch or in a level.

        Entries are held against the first of their print alone. What that leaves open among rows that share an id is
        for the scan over the cluster.
        """
        order = np.lexsort((places, marks, docs, prints))
        p, d, m, s = (x[order] for x in (prints, docs, marks, places))
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(p) else np.zeros(0, np.int64)
        covered = earlier(d[first], m[first], s[first], d, m, s)
        head = tuple(x[new] for x in (p, d, m, s))
        beaten = np.zeros(len(head[0]), bool)
        for level in self.levels:
            at = np.searchsorted(level[0], head[0])  # a level's equal prints begin with the earliest
            at[at == len(level[0])] = 0
            beaten |= (level[0][at] == head[0]) & earlier(*(x[at] for x in level[1:]), *head[1:])
        covered |= beaten[np.cumsum(new) - 1] if len(p) else False
        if (~beaten).any():
            self.levels.append(tuple(x[~beaten] for x in head))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            later, before = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(before, later)]
            merge = np.lexsort(both[::-1])
            self.levels.append(tuple(x[merge] for x in both))
        out = np.empty(len(p), bool)
        out[order] = covered
        return out


def earlier(doc: np.ndarray, mark: np.ndarray, place: np.ndarray, than_doc: np.ndarray, than_mark: np.ndarray, than_place: np.ndarray) -> np.ndarray:
    """Whether a place comes before another: in a document of smaller id, or in the same document."""
    return (doc < than_doc) | ((doc == than_doc) & (mark == than_mark) & (place < than_place))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that agree in all columns begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def found_before(new: np.ndarray, doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (string, doc, mark, place), with `new` where a string begins: which have it earlier, and which are a document's first."""
    own = new | starts_of(doc, mark)
    first, mine = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (new, own))
    return (doc[first] < doc) | (place[mine] < place), own


def joined_ranges(docs: np.ndarray, marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join window ranges of a document that touch."""
    if len(docs) == 0:
        return docs, marks, low, high
    order = np.lexsort((low, marks, docs))
    docs, marks, low, high = (x[order] for x in (docs, marks, low, high))
    new = starts_of(docs, marks)
    new[1:] |= low[1:] > high[:-1] + 1
    first = np.flatnonzero(new)
    return docs[first], marks[first], low[first], np.maximum.reduceat(high, first)


def side_by_side(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a binary array's values."""
    lengths = np.array([len(v.as_buffer()) for v in texts], np.int64) if len(texts) else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in texts), np.uint8)
    return data, ends - lengths, ends


def in_parts(batch: pa.RecordBatch, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the parts hold few bytes, or one long text."""
    start = size = 0
    for i, v in enumerate(batch.column(1)):
        n = len(v.as_buffer())
        if i > start and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


ROWS = "done boolean, anchor long, reach long, doc long, mark int, low long, more long"
_NAMES = ["done", "anchor", "reach", "doc", "mark", "low", "more"]


def _rows(done: bool, anchor, reach, doc, mark, low, more) -> pa.RecordBatch:
    longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (anchor, reach, doc, low, more)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), done)), *longs[:3], pa.array(np.ascontiguousarray(mark), pa.int32()), *longs[3:]], _NAMES)


def index_tasks(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """Suffixes of the texts (key, text, mark) that have no earlier equal in their task, and window ranges that have one (done)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily()
        for whole in batches:
            for batch in in_parts(whole):
                data, starts, ends = side_by_side(batch.column(1))
                number, anchor, reach, low, more = suffixes(data, starts, ends, least)
                if len(number) == 0:
                    continue
                doc, mark = batch.column(0).to_numpy()[number], batch.column(2).to_numpy()[number]
                covered = family.add(reach, doc, mark, low)
                yield _rows(False, *(x[~covered] for x in (anchor, reach, doc, mark, low, more)))
                d, m, a, b = joined_ranges(*(x[covered] for x in (doc, mark, low, low + more)))
                if len(d):
                    spread = mixed(d.view(np.uint64) ^ a.view(np.uint64), 5)
                    yield _rows(True, spread, spread, d, m, a, b - a)

    return texts.mapInArrow(common.tidied(run), ROWS)


def scan_anchors(rows: DataFrame) -> DataFrame:
    """Merge the tasks' families by anchor: covered ranges are done; first reaches of anchors that have several stay open.

    Rows are taken by reach, so an anchor of any number of reaches is never held as a whole: what waits is its first reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, None  # the last anchor, and rows of its only reach so far
        for done, anchor, reach, doc, mark, low, more in common.by_runs(batches, 2):
            done = done.astype(bool)
            parts = [(doc[done], mark[done], low[done], (low + more)[done])]
            anchor, reach, doc, mark, low, more = (x[~done] for x in (anchor, reach, doc, mark, low, more))
            if len(doc):
                new_anchor = starts_of(anchor)
                new = new_anchor | starts_of(reach)
                covered, own = found_before(new, doc, mark, low)
                parts.append((doc[covered], mark[covered], low[covered], (low + more)[covered]))
                of = np.cumsum(new_anchor) - 1
                several = np.bincount(of, new) > 1
                if at == anchor[0]:
                    several[0] = True
                    if waiting is not None:
                        yield waiting
                        waiting = None
                open_ = own & ~covered
                now = open_ & several[of]
                yield _rows(False, *(x[now] for x in (anchor, reach, doc, mark, low, more)))
                last = open_ & (of == of[-1])
                at, waiting = anchor[-1], None if several[-1] else _rows(False, *(x[last] for x in (anchor, reach, doc, mark, low, more)))
            d, m, a, b = joined_ranges(*(np.concatenate(x) for x in zip(*parts)))
            zero = np.zeros(len(d), np.int64)
            yield _rows(True, zero, zero, d, m, a, b - a)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "reach", "doc", "mark", "low").mapInArrow(common.tidied(run), ROWS)


WINDOWS = "done boolean, print long, doc long, mark int, low long, high long"


def window_rows(texts_with_open: DataFrame, least: int = LEAST) -> DataFrame:
    """(print, doc, mark, low) of the single windows of open suffixes that have no earlier equal in their task; with done, of those that have one."""
    names = ["done", "print", "doc", "mark", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily()
        for whole in batches:
            for batch in in_parts(whole):
                data, starts, _ = side_by_side(batch.column(1))
                flat = batch.column(3)
                counts = np.array([0 if not v.is_valid else len(v) for v in flat], np.int64)
                if not counts.sum():
                    continue
                spans = flat.flatten()
                low, more = (spans.field(i).to_numpy() for i in range(2))
                number = np.repeat(np.arange(len(counts)), counts)
                each = np.repeat(np.arange(len(low)), more + 1)
                step = np.arange(len(each)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                row = number[each]
                doc, mark = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False)[row] for i in (0, 2))
                window = low[each] + step
                at = starts[row] + window
                prints = mixed(Prints(data).of(at, at + least), 4)
                covered = family.add(prints, doc, mark, window)
                open_ = ~covered
                rows = (prints.view(np.int64), doc, mark, window, window)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(open_.sum()), bool)), *(pa.array(x[open_]) for x in rows)], names)
                d, m, a, b = joined_ranges(*(x[covered] for x in (doc, mark, window, window)))
                spread = mixed(d.view(np.uint64) ^ a.view(np.uint64), 6).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(d), bool)), *map(pa.array, (spread, d, m, a, b))], names)

    return texts_with_open.mapInArrow(common.tidied(run), WINDOWS)


def scan_windows(rows: DataFrame) -> DataFrame:
    """Window ranges (doc, mark, low, high) that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, prints, doc, mark, low, high in common.by_runs(batches, 1):
            done = done.astype(bool)
            new = starts_of(prints)
            new[1:] |= done[1:] | done[:-1]
            take = done | found_before(new, doc, mark, low)[0]
            d, m, a, b = joined_ranges(*(x[take] for x in (doc, mark, low, high)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (d, m, a, b))], ["doc", "mark", "low", "high"])

    return rows.repartition("print").sortWithinPartitions("print", "done", "doc", "mark", "low").mapInArrow(common.tidied(run), "doc long, mark int, low long, high long")


def removed_mask(n: int, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """Which of n bytes lie in a window of a range."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(low, n), 1)
    np.add.at(change, np.minimum(high + least, n), -1)
    return np.cumsum(change[:n]) > 0


def marked(df: DataFrame, text: str) -> DataFrame:
    """With MARK, a hash of the text, which tells rows of equal ids apart."""
    return df.withColumn(MARK, F.hash(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


def with_ranges(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """All rows and columns with the window ranges to remove: column RANGES, array of (low, high), null where there are none."""

    def own_texts(rows: DataFrame) -> DataFrame:
        return marked(common.byte_texts(rows, key, text).withColumnRenamed("text", text), text)

    def same(left: DataFrame, right: DataFrame):
        return (left[key] == right[OWNER]) & (left[MARK] == right[OWNER_MARK])

    scanned = common.saved(scan_anchors(index_tasks(own_texts(df.filter(F.col(key).isNotNull())), least)), "suffix-scan")
    names = {"doc": OWNER, "mark": OWNER_MARK}
    open_ = scanned.filter("not done").groupBy("doc", "mark").agg(F.collect_list(F.struct("low", "more")).alias("open")).withColumnsRenamed(names)
    # the same rows, unfiltered, are what the caller's own join moves: Spark then moves them once for both
    own = own_texts(df)
    fetched = own.join(open_, same(own, open_), "left").select(F.col(OWNER).alias("doc"), own[text].alias("text"), F.col(OWNER_MARK).alias("mark"), "open")
    fine = scan_windows(window_rows(fetched, least))
    ranges = scanned.filter("done").select("doc", "mark", "low", (F.col("low") + F.col("more")).alias("high")).unionByName(fine)
    by_doc = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("low", "high")).alias(RANGES)).withColumnsRenamed(names)
    rows = marked(df, text)
    return rows.join(by_doc, same(rows, by_doc), "left").drop(OWNER, OWNER_MARK, MARK)


def _range_arrays(value: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    flat = value.values
    return flat.field(0).to_numpy(), flat.field(1).to_numpy()


def summary(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value, ranges in zip(batch.column(1), batch.column(2)):
            data = value.as_buffer().to_pybytes()
            removed = spans = 0
            if ranges.is_valid:
                gone = removed_mask(len(data), *_range_arrays(ranges), least)
                removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                kept = data
            out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_ranges(common.byte_texts(df, key, text), key, "text", least).select(key, "text", RANGES)
    return common.map_batches(rows, run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows with repeated passages taken out of their texts, all columns kept; bytes that a cut leaves as a broken character are dropped. A text that is left empty stays as an empty text, a null one as null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        out = []
        for value, ranges in zip(batch.column(at), batch.column(batch.num_columns - 1)):
            if not value.is_valid or not ranges.is_valid:
                out.append(value.as_py())
                continue
            data = value.as_buffer().to_pybytes()
            gone = removed_mask(len(data), *_range_arrays(ranges), least)
            out.append(np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(out, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    rows = with_ranges(df, key, text, least)
    return common.map_batches(rows.select(*(rows[c] for c in df.columns), RANGES), run, df.schema)


def op6_log_family(spark, sf_dir: str) -> DataFrame:
    return summary(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_log_family": op6_log_family}
ORACLES: dict[str, str] = {}
