"""SimHash near-duplicates with pivot distance tables.

A fingerprint has bit i set where more than half of the text's shingle hashes have it. Fingerprints
link at few differing bits. Only distinct fingerprints are compared. Links of at most k bits agree
on two of k + 2 blocks, so fingerprints meet in buckets named by two blocks and their values. In a
bucket, each fingerprint has a row of Hamming distances to many reference fingerprints: by the
triangle inequality, a pair whose rows differ by more than k anywhere cannot link and is discarded;
survivors are verified. Large buckets add references from among their own members: members within k
of one are linked to it at once and need no comparing among themselves, so a dense group costs its
size times few references and gives as many links as it has members, never all pairs.

Null texts and texts without a word have fingerprint zero and link like any other. Repeated rows
keep a row each. A row without an id joins the component of its fingerprint, and names none. A text of
any length is read whole. Only the two named columns are read, so others may have any name. An empty
table gives no rows.

`keep_one` takes null, empty and wordless texts for copies of each other: of all of them the row of least
id stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import Forest, components

SEED = 42
WORDS, BITS_APART = 3, 3
LANES = np.uint64(0x0101010101010101)
#: Reference fingerprints that every bucket uses; any numbers do.
REFERENCES = np.random.default_rng(20).integers(0, 1 << 64, 24, dtype=np.uint64)
#: From this size, a bucket takes references from among its own members, at most so many.
LARGE, OWN_REFERENCES = 48, 64
#: Rows compared against all others at a time.
ROWS = 256


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of words joined by a blank, repeats included; of the whole sequence, if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    runs = [joined[a:b] for a, b in zip(starts, ends[size - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: bits set in over half of them."""
    n = len(hashes)
    if n == 0:
        return 0
    if n < 2:
        return int(hashes[0])
    rows = -(-n // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[:n] = hashes
    out = 0
    for k in range(8):  # bits k, k + 8, ... are counted side by side, 255 hashes at most to a byte
        lanes = ((padded >> np.uint64(k)) & LANES).reshape(rows, 255).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * lane + k)
    return out


def fingerprint(text: bytes, size: int = WORDS) -> int:
    return majority(shingle_hashes(text.lower().split(), size))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(v.as_buffer().to_pybytes(), size) for v in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return common.map_batches(common.byte_texts(df, key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, fp long")


def bucket_columns(bits_apart: int, agree: int = 2) -> list:
    """The bucket names of a fingerprint: `agree` of its blocks, of bits_apart + agree, and their values."""
    n = bits_apart + agree
    edges = [64 * i // n for i in range(n + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(n), agree)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(number).alias("blocks"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    return out


def near(table: np.ndarray, prints: np.ndarray, left: np.ndarray, right: np.ndarray, bits_apart: int) -> np.ndarray:
    """Which pairs link: the tables' rows leave them in, and their bits agree."""
    alive = np.arange(len(left))
    for k in range(table.shape[1]):
        column = table[:, k]
        alive = alive[np.abs(column[left[alive]] - column[right[alive]]) <= bits_apart]
    exact = np.bitwise_count(prints[left[alive]] ^ prints[right[alive]]) <= bits_apart
    out = np.zeros(len(left), bool)
    out[alive[exact]] = True
    return out


def link_bucket(prints: np.ndarray, bits_apart: int) -> list[tuple[int, int]]:
    """Positions of links that connect what is connected within the bucket: fewer than it has members."""
    n, links, forest = len(prints), [], Forest()
    table = np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int8)

    def join(a: int, b: int) -> None:
        if forest.join(a, b):
            links.append((a, b))

    if n >= LARGE:
        near_one = np.zeros(n, bool)
        own = []
        while len(own) < OWN_REFERENCES and not near_one.all():
            at = int(np.flatnonzero(~near_one)[0])
            apart = np.bitwise_count(prints ^ prints[at]).astype(np.int8)
            close = np.flatnonzero(apart <= bits_apart)
            for b in close.tolist():
                join(at, b)
            near_one[close] = True
            own.append(apart)
        table = np.concatenate([np.stack(own, axis=1), table], axis=1)
    part = np.array([forest.root(i) for i in range(n)])
    for a in range(0, n, ROWS):
        if len(links) == n - 1:
            break
        block = np.arange(a, min(a + ROWS, n))
        left, right = np.nonzero((part[block][:, None] != part[None, a:]) & (block[:, None] < np.arange(a, n)[None, :]))
        if len(left) == 0:
            continue
        left, right = block[left], right + a
        hit = near(table, prints, left, right, bits_apart)
        for x, y in zip(left[hit].tolist(), right[hit].tolist()):
            join(x, y)
        if hit.any():
            part = np.array([forest.root(i) for i in range(n)])
    return links


def links(distinct: DataFrame, bits_apart: int = BITS_APART, agree: int = 2) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints (fp, rep) that connect all that links connect."""
    buckets = distinct.select("fp", "rep", F.explode(F.array(*bucket_columns(bits_apart, agree))).alias("k")).select("k.blocks", "k.value", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            blocks, value, fp, rep = columns
            new = np.ones(len(fp) + 1, bool)
            new[1:-1] = (blocks[1:] != blocks[:-1]) | (value[1:] != value[:-1])
            edges = np.flatnonzero(new)
            sizes = np.diff(edges)
            prints = fp.view(np.uint64)
            twos = edges[:-1][sizes == 2]
            table = np.bitwise_count(prints[:, None] ^ REFERENCES[None, :8]).astype(np.int8)
            hit = twos[near(table, prints, twos, twos + 1, bits_apart)]
            a, b = rep[hit].tolist(), rep[hit + 1].tolist()
            for start, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for x, y in link_bucket(prints[start : start + n], bits_apart):
                    a.append(int(rep[start + x]))
                    b.append(int(rep[start + y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for columns in common.by_runs(batches, 1):
            yield found(columns)

    return buckets.repartition("blocks", "value").sortWithinPartitions("blocks", "value").mapInArrow(common.tidied(run), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, bits_apart: int = BITS_APART) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) of every row."""
    prints = common.saved(fingerprints(df, key, text, size), "fingerprints")
    distinct = common.saved(prints.groupBy("fp").agg(F.min(key).alias("rep")), "distinct-fingerprints")
    found = components(links(distinct.filter("rep is not null"), bits_apart))
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents are alike from this Jaccard similarity of their sets of five-word shingles.
ALIKE_WORDS, ALIKE = 5, 0.8
#: Bits that fingerprints of documents so alike may differ in (their mean is about ten, and the spread three).
ALIKE_BITS = 20
#: Bits that fingerprints differ in, at most, to meet in buckets, and how many of their blocks agree there.
TABLE_BITS, TABLE_BLOCKS = 8, 3
#: Part of a text's shingles by which it meets others beyond the least that any pair so alike must share.
SPARE = 0.1
#: Members of a meeting up to which all pairs are verified at once; then, up to which each member is first verified against
#: the first near it and the NEAREST before it; beyond, against its reference and its neighbours in the order of distances.
#: What these leave unconnected is verified in a second pass.
FEW, SMALL_MEETING, NEAREST = 32, 2048, 3
#: Words of 64 parity bits of a set.
PARITY = 8


def fingerprint_pairs(sets: DataFrame, bits_apart: int = TABLE_BITS, agree: int = TABLE_BLOCKS) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the texts (sig, fp) whose fingerprints link: they connect all texts that such links connect."""
    prints = common.saved(sets.groupBy("fp").agg(F.min("sig").alias("rep"), F.count("*").alias("texts")), "distinct-fingerprints")
    equal = common.small_side(common.saved(prints.filter("texts > 1").select("fp", "rep"), "equal-fingerprints"))
    same = sets.select("fp", "sig").join(equal, "fp").filter("sig <> rep").select(F.col("rep").alias("a"), F.col("sig").alias("b"))
    near_ones = links(prints, bits_apart, agree).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near_ones.unionByName(same).distinct()


def candidate_pairs(prints: np.ndarray, bits_apart: int) -> list[tuple[int, int]]:
    """Positions of pairs to verify first, by fingerprints."""
    n, pairs = len(prints), set()
    if n <= FEW:
        near_any = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits_apart
        return [(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu(near_any, 1)))]
    if n <= SMALL_MEETING:
        for a in range(1, n, ROWS):
            rows = np.arange(a, min(a + ROWS, n))
            apart = np.bitwise_count(prints[rows][:, None] ^ prints[None, : rows[-1]]).astype(np.int16)
            apart[np.arange(rows[-1])[None, :] >= rows[:, None]] = 99
            near_any = apart <= bits_apart
            for i in np.flatnonzero(near_any.any(axis=1)).tolist():
                best = np.argpartition(apart[i], NEAREST)[:NEAREST] if apart.shape[1] > NEAREST else np.arange(apart.shape[1])
                pairs.add((int(near_any[i].argmax()), int(rows[i])))
                pairs.update((int(j), int(rows[i])) for j in best if near_any[i, j])
        return list(pairs)
    home = np.full(n, -1)
    while len(free := np.flatnonzero(home < 0)):  # each reference takes the free members near it
        apart = np.bitwise_count(prints[free] ^ prints[free[0]]).astype(np.int16)
        mine = free[apart <= bits_apart]
        home[mine] = free[0]
        table = np.bitwise_count(prints[mine][:, None] ^ np.append(prints[free[0]], REFERENCES[:3])[None, :])
        order = mine[np.lexsort(table.T[::-1])]
        pairs.update((int(free[0]), int(x)) for x in mine[1:])
        pairs.update((min(int(x), int(y)), max(int(x), int(y))) for x, y in zip(order, order[1:]))
    return list(pairs)


def least_shared(n, alike: float):
    """Shingles that a text of n shares at least with any text alike."""
    return np.ceil(alike * n - 1e-9).astype(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY words: how often a set hits each bit, odd or even. Sets differ in at least as many shingles as their words do in bits."""
    bits = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def sketches(df: DataFrame, key: str, text: str, size: int, alike: float) -> DataFrame:
    """(key, sig, n, fp, least): a hash of the word sequence, the number of distinct shingles, their fingerprint, and the least of their hashes.

    Of those, two texts alike share the first SPARE of the smaller one's shingles, or one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs, sizes, prints, least = [], [], [], []
        for v in batch.column(1):
            words = v.as_buffer().to_pybytes().lower().split()
            hashes = np.unique(shingle_hashes(words, size))
            n = len(hashes)
            sigs.append(xxhash.xxh64_intdigest(b" ".join(words), 1))
            sizes.append(n)
            prints.append(majority(hashes))
            least.append(hashes[: n - int(least_shared(n, alike)) + max(1, int(SPARE * n))].view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(least, pa.list_(pa.int64()))], [key, "sig", "n", "fp", "least"])

    return common.map_batches(common.byte_texts(df, key, text), run, f"{key} {df.schema[key].dataType.simpleString()}, sig long, n long, fp long, least array<long>")


def shared(hashes: DataFrame) -> DataFrame:
    """(at, sig, n, texts): the rows (at, sig, n), once each, whose hash two texts or more have, and how many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, sig, n in common.by_runs(batches, 0):
            once = np.append(True, (at[1:] != at[:-1]) | (sig[1:] != sig[:-1]))
            at, sig, n = at[once], sig[once], n[once]
            edges = np.flatnonzero(np.append(np.append(True, at[1:] != at[:-1]), True))
            texts = np.repeat(np.diff(edges), np.diff(edges))
            more = texts > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[more], pa.int64()) for c in (at, sig, n, texts)], ["at", "sig", "n", "texts"])

    return hashes.repartition("at").sortWithinPartitions("at", "sig").mapInArrow(common.tidied(run), "at long, sig long, n long, texts long")


def common_sets(df: DataFrame, live: DataFrame, key: str, text: str, size: int, alike: float) -> DataFrame:
    """(sig, n, n_shared, rarest, data, words): of the texts (doc, sig) that others cover far enough, the shingles that others have too.

    rarest: those that, rarest first, any text alike has one of. data: all of them, in order of their hashes.
    """
    own = common.byte_texts(df.filter(F.col(key).isNotNull()), key, text).select(F.col(key).cast("long").alias("doc"), "text")
    texts = own.join(common.small_side(live.select("doc", "sig")), "doc").select("sig", "text")

    def to_hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, sigs, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for sig, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = value.as_buffer().to_pybytes().lower().split()
            if int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 1)).view(np.int64)) == sig:  # rows may share an id
                at.append(np.unique(shingle_hashes(words, size)))
                sigs.append(np.full(len(at[-1]), sig, np.int64))
                sizes.append(np.full(len(at[-1]), len(at[-1]), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).view(np.int64)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sizes))], ["at", "sig", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, n, _, at in common.by_runs(batches, 0):
            edges = np.flatnonzero(np.append(np.append(True, sig[1:] != sig[:-1]), True))
            rows = []
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                spare = end - start - int(least_shared(n[start], alike))
                if spare >= 0:
                    own = at[start:end]
                    rows.append((int(sig[start]), int(n[start]), end - start, own[: spare + 1], np.sort(own).astype("<i8").tobytes(), parity(own.view(np.uint64)).view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["sig", "n", "n_shared", "rarest", "data", "words"])

    counted = shared(common.map_batches(texts, to_hashes, "at long, sig long, n long")).select("sig", "n", "texts", "at")
    return counted.repartition("sig").sortWithinPartitions("sig", "texts", "at").mapInArrow(common.tidied(run), "sig long, n long, n_shared long, rarest array<long>, data binary, words array<long>")


def may_be_alike(n: np.ndarray, n_shared: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, alike: float) -> np.ndarray:
    """Which pairs their sizes and parity words leave in; no pair alike is left out."""
    bits = np.bitwise_count(words[left] ^ words[right]).sum(axis=1, dtype=np.int64)
    most = np.minimum((n_shared[left] + n_shared[right] - bits) // 2, np.minimum(n_shared[left], n_shared[right]))
    return most >= alike * (n[left] + n[right] - most) - 1e-9


#: Members of a meeting up to which it is one task's work.
MEETING_ROWS = 16384


def dealt(members: DataFrame, most: int = MEETING_ROWS) -> DataFrame:
    """The same members; a meeting of more than `most` is cut into blocks, and each two of its blocks, or one with itself, meet in a place of their own.

    Any two members still meet, and no place holds many more than twice `most`.
    """
    blocks = members.groupBy("at").agg(F.ceil(F.count("*") / most).cast("long").alias("blocks")).filter("blocks > 1")
    blocks = common.saved(blocks, "large-meetings")
    block = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = members.join(common.small_side(blocks), "at", "left").withColumn("other", F.explode(others))
    place = F.when(F.col("other") < 0, F.col("at")).otherwise(F.xxhash64("at", F.least(block, "other"), F.greatest(block, "other")))
    return spread.withColumn("at", place).select(*members.columns)


def meetings(members: DataFrame, alike: float, bits_apart: int, rest: bool) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the texts (at, sig, part, n, n_shared, fp, words) that meet at a hash.

    Only pairs whose parts differ: first those of small meetings and, by fingerprints, of large ones; with rest, all of large meetings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()  # many meetings have the same members
        for at, sig, part, n, n_shared, fp, *words in common.by_runs(batches, 0):
            table = np.stack(words, axis=1).view(np.uint64)  # bits of a signed number are counted without its sign
            edges = np.flatnonzero(np.append(np.append(True, at[1:] != at[:-1]), True))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                m = end - start
                if m < 2 or (rest and m <= FEW):
                    continue
                mark = xxhash.xxh128_digest(sig[start:end].tobytes())
                if mark in known:
                    continue
                known.add(mark)
                for low in range(0, m if rest else 1, ROWS):
                    if rest:
                        rows = np.arange(start + low, min(start + low + ROWS, end))
                        left, right = np.nonzero((part[rows][:, None] != part[None, start:end]) & (rows[:, None] < np.arange(start, end)[None, :]))
                        left, right = rows[left], right + start
                    elif m <= FEW:
                        left, right = (x + start for x in np.triu_indices(m, 1))
                    else:
                        left, right = (np.array(x, np.int64) + start for x in zip(*(candidate_pairs(fp[start:end].view(np.uint64), bits_apart) or [(0, 1)])))
                    if not rest:
                        split = part[left] != part[right]
                        left, right = left[split], right[split]
                    for cut in range(0, len(left), 1 << 18):
                        x, y = left[cut : cut + (1 << 18)], right[cut : cut + (1 << 18)]
                        hit = may_be_alike(n, n_shared, table, x, y, alike)
                        a.append(np.minimum(sig[x[hit]], sig[y[hit]]))
                        b.append(np.maximum(sig[x[hit]], sig[y[hit]]))
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    columns = ["at", "sig", "part", "n", "n_shared", "fp", *(F.col("words")[i].alias(f"w{i}") for i in range(PARITY))]
    return members.select(*columns).repartition("at").sortWithinPartitions("at", "sig").mapInArrow(common.tidied(run), "a long, b long").distinct()


#: Members that are held against one text in one task; more are dealt over tasks, each with a copy of that text's set.
HELD = 2048


def verified(sets: DataFrame, pairs: DataFrame, alike: float, held: int = HELD) -> DataFrame:
    """The pairs whose shingle sets are alike: sets of b are held against that of a, a stream for each a."""
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / held).cast("long").alias("parts")).filter("parts > 1")
    heavy = common.saved(heavy, "heavy-leads")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long")))
    asked = pairs.join(common.small_side(heavy), "a", "left").select(F.col("b").alias("sig"), F.col("a").alias("lead"), salt.alias("salt"), F.lit(1).alias("rank"))
    leads = asked.select("lead", "salt").distinct().select(F.col("lead").alias("sig"), "lead", "salt", F.lit(0).alias("rank"))
    streams = asked.unionByName(leads).join(sets.select("sig", "n", "data"), "sig").select("sig", "lead", "salt", "rank", "n", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, own_n = None, np.zeros(0, np.int64), 0
        for batch in batches:
            a, b = [], []
            for sig, lead, salt, rank, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                members = np.frombuffer(data.as_buffer(), "<i8")
                if rank == 0:
                    at, own, own_n = (lead, salt), members.copy(), n
                elif at == (lead, salt):
                    both = len(np.intersect1d(own, members, assume_unique=True))
                    if both and both >= alike * (own_n + n - both) - 1e-9:
                        a.append(lead)
                        b.append(sig)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return streams.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "rank").mapInArrow(common.tidied(run), "a long, b long")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = ALIKE_WORDS, alike: float = ALIKE, bits_apart: int = ALIKE_BITS) -> DataFrame:
    """The rows without near-duplicates: of each group of documents that links connect, the one with the least id.

    Links are exact copies (the same words) and pairs whose Jaccard similarity of shingle sets, counted exactly,
    is at least `alike`. Two texts alike share shingles among so many of any order's first as their sizes tell: by the
    order of hashes, texts that too few others meet go out. Of the rest, fingerprints within TABLE_BITS meet in buckets
    of blocks that agree, and what their tables of distances leave in is verified. As texts alike may have fingerprints
    farther apart, an exact pass completes this, so that no link is lost: texts meet at their rarest shared shingles,
    and pairs that are not in one component yet are verified, in small meetings all, in large ones first those
    that fingerprints within bits_apart name, and then the others. Very large ones are dealt over tasks in blocks.
    Rows that share an id stay or go together; rows without an id stay.
    """
    found = common.saved(sketches(df.filter(F.col(key).isNotNull()), key, text, size, alike), "sketches")
    docs = found.select(F.col(key).cast("long").alias("doc"), "sig", "n", "fp", "least")
    reps = common.saved(docs.groupBy("sig").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "distinct-texts")
    copies = common.saved(docs.select("doc", "sig").join(reps.filter("copies > 1").select("sig", "rep"), "sig").filter("doc <> rep").select("doc", "sig").distinct(), "copies")
    firsts = docs.join(common.small_side(copies), ["doc", "sig"], "left_anti")
    met = shared(firsts.select(F.explode("least").alias("at"), "sig", "n")).groupBy("sig", "n").count()
    live = met.filter(F.col("count") >= F.greatest(F.lit(1), F.floor(F.col("n") * (SPARE * alike) - 1e-9))).select("sig")
    live = common.saved(live.join(firsts.select("doc", "sig", "fp").distinct(), "sig"), "live")
    sets = common.saved(common_sets(df, live, key, text, size, alike).join(common.small_side(live), "sig"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        names = sets.select("sig", "doc")
        a, b = (names.select(F.col("sig").alias(x), F.col("doc").alias(f"doc_{x}")) for x in "ab")
        return verified(sets, pairs, alike).join(a, "a").join(b, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))

    def extended(known: DataFrame | None, pairs: DataFrame) -> DataFrame:
        again = common.saved(linked(common.saved(pairs, "pairs")), "links")
        if known is not None and not again.head():
            return known
        every = again if known is None else known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(again)
        return common.saved(components(every), "components")

    def parted(rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.join(common.small_side(known), F.col("part") == F.col("node"), "left").withColumn("part", F.coalesce("component", "part")).drop("node", "component")

    near_ones = extended(None, fingerprint_pairs(sets))
    members = dealt(parted(sets.withColumn("part", F.col("doc")), near_ones).select(F.explode("rarest").alias("at"), "sig", "part", "n", "n_shared", "fp", "words"))
    first = extended(near_ones, meetings(members, alike, bits_apart, False))
    whole = extended(first, meetings(parted(members, first), alike, bits_apart, True))
    dropped = common.saved(copies.select("doc").unionByName(whole.select(F.col("node").alias("doc"))).distinct(), "dropped")
    common.discard(found, reps, copies, live, sets)
    gone = "__siltgrid_gone"
    return df.join(common.small_side(dropped).withColumnRenamed("doc", gone), df[key] == F.col(gone), "left_anti")


def op4_pivot_tables(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_pivot_tables": op4_pivot_tables}
ORACLES: dict[str, str] = {}
