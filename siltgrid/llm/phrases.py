"""Phrase collocation mining by suffix-sigma.

Texts are lower-cased (A-Z), cut into pieces and words; each word position gives a suffix of its piece,
cut to the longest phrase asked for. Suffixes are shuffled by language and first word, sorted in
reverse lexicographic order, and one stack of open prefixes counts them all in one scan: what leaves the
stack is a phrase with its count. The parts of each phrase are joined to it afterwards.

What makes this hold on large and uneven tables:

* A first scan counts words. A word rarer than the least count can stand in no phrase, so it ends
  suffixes like a piece's end. Tasks know rare words by a bitmap of hashes, of at most 2^27 bits (16 MB);
  a collision only leaves a suffix longer than it need be.
* A task counts equal suffixes before it hands them on, some millions of words at a time.
* Suffixes are dealt by ranges of (language, words): a frequent first word is cut into several ranges by
  what follows it. The bounds come from a bounded sample and decide only who counts what. A prefix that
  a bound cuts is given from both sides, and one sum over (language, phrase) ends the counting.
* Spark sorts, and spills where a range is larger than a task's memory; the stack holds one suffix's prefixes.

A null text is empty; a null language counts as `und`. Repeated rows count as often as they are there.
Texts of any length are read whole, in stretches that end where a piece ends. An empty table gives no
rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_WORDS, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one that holds it has at least COVER per cent of its count.
COVER = 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Piece ends become line feeds, tabs become blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Words that a task counts together, bytes that are cut into words at once, and bytes of a stretch of a long text.
CHUNK_WORDS, AT_ONCE, STRETCH = 1_500_000, 1 << 21, 1 << 20
#: Words of the corpus for a range, the most ranges, words that are read for their bounds, and sampled suffixes for each range.
RANGE_WORDS, MOST_RANGES, SAMPLE_WORDS, SAMPLED = 1_500_000, 20_000, 3_000_000, 40
#: Bits of the bitmap: this many for each frequent word, within the two limits.
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Rows of an Arrow batch that goes back to Spark.
ROWS = 50_000


def stretches(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of some STRETCH bytes, cut where pieces end."""
    at = 0
    while len(text) - at > STRETCH and (cut := text.find(b"\n", at + STRETCH)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Chunk:
    """Tokens of some texts as numbers: 0 ends a piece, others are words of a language."""

    def __init__(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.entries: list[tuple[str, bytes]] = [("", b"")]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        known = self.known.setdefault(lang, {b"\n": 0, b"": -1})
        coded = pc.split_pattern(pa.array(texts, pa.large_binary()), " ").flatten().dictionary_encode()
        own = []
        for word in coded.dictionary.to_pylist():
            number = known.get(word)
            if number is None:
                number = known[word] = len(self.entries)
                self.entries.append((lang, word))
            own.append(number)
        numbers = np.array(own, np.int32)[coded.indices.to_numpy()]
        self.parts.append(numbers[numbers >= 0])
        self.size += len(self.parts[-1])

    def tokens(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(MAX_WORDS, np.int32)])


def chunks(batches: Iterator[pa.RecordBatch], words: int = CHUNK_WORDS) -> Iterator[Chunk]:
    """Chunks of about so many words from batches of (language, text)."""
    chunk, held, waiting = Chunk(), {}, 0
    for batch in batches:
        for at, lang in enumerate(batch.column(0).to_pylist()):
            for stretch in stretches(batch.column(1)[at].as_buffer().to_pybytes().translate(FOLD)):
                held.setdefault(lang, []).append(stretch.replace(b"\n", b" \n ") + b" \n")
                waiting += len(stretch)
                if waiting >= AT_ONCE:
                    for x, y in held.items():
                        chunk.add(x, y)
                    held, waiting = {}, 0
                    if chunk.size >= words:
                        full, chunk = [chunk], Chunk()
                        yield full.pop()  # from now on only who reads it holds it
    for x, y in held.items():
        chunk.add(x, y)
    if chunk.size:
        yield chunk


def texts_of(df: DataFrame, lang: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def strings(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; the null word has the sum over its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            n = np.bincount(np.concatenate(chunk.parts), minlength=len(chunk.entries))
            sums: dict[str, int] = {}
            for a in range(1, len(n), ROWS):
                counts = n[a : a + ROWS].tolist()
                langs, words = zip(*chunk.entries[a : a + ROWS])
                for lang, x in zip(langs, counts):
                    sums[lang] = sums.get(lang, 0) + x
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), strings(list(words)), pa.array(counts, pa.int64())], ["lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.nulls(len(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(common.tidied(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bitmap(words: DataFrame) -> np.ndarray:
    """A bit for the hash of each (lang, word), in 64-bit parts: a power of two of bits, at most MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * words.count()).bit_length()))
    place = F.pmod(F.xxhash64("lang", "word"), F.lit(bits))
    parts = words.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(lang, word), 64) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[parts["at"].to_numpy()] = parts["bits"].to_numpy()
    return out


def frequent(chunk: Chunk, marks: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each of the chunk's entries; the end of a piece is not one."""
    seeds: dict[str, int] = {}
    for lang in chunk.known:
        seeds[lang] = xxhash.xxh64_intdigest(lang.encode(), 42)
    hashes = np.array([xxhash.xxh64_intdigest(word, seeds[lang]) for lang, word in chunk.entries[1:]], np.uint64)
    place = hashes & np.uint64(64 * len(marks) - 1)
    hit = marks.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
    return np.append(False, hit.astype(bool))


def dense(values: np.ndarray) -> np.ndarray:
    """Ranks of values, equal ones sharing a rank: small numbers in the same order."""
    order = values.argsort()
    ranked = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])[: len(values)])
    return out


class Suffixes:
    """A chunk's distinct suffixes of two to max_words frequent words, in byte order, and how often each is there (`n`).

    A suffix is the language in hexadecimal, a line feed, and words that each end with a blank: so all suffixes with a common
    prefix of whole words lie together, and a prefix stands before what is longer. Their bytes are made when asked for.
    """

    def __init__(self, chunk: Chunk, marks: np.ndarray, max_words: int) -> None:
        often = np.flatnonzero(frequent(chunk, marks))
        heads = [chunk.entries[i][0].encode().hex().encode() + b"\n" + chunk.entries[i][1] + b" " for i in often.tolist()]
        order = sorted(range(len(heads)), key=heads.__getitem__)
        number = np.zeros(len(chunk.entries), np.int32)
        number[often[order]] = np.arange(1, len(order) + 1)
        self.head = pa.array([b"", *(heads[i] for i in order)], pa.large_binary())
        self.tail = pa.array([b"", *(chunk.entries[often[i]][1] + b" " for i in order)], pa.large_binary())
        words = number[chunk.tokens()]
        place = np.flatnonzero((words[:-MAX_WORDS] > 0) & (words[1 : 1 - MAX_WORDS] > 0))
        columns = [words[place], words[place + 1]]
        for k in range(2, max_words):
            columns.append(np.where(columns[-1] > 0, words[place + k], 0))
        base = len(order) + 1
        key = dense(columns[0].astype(np.int64) * base + columns[1]) << 32
        if max_words > 2:
            key |= dense(columns[2].astype(np.int64) * base + (columns[3] if max_words > 3 else 0))
        place = key.argsort()
        key = key[place]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        self.columns = [c[place[first]] for c in columns]
        self.n = np.diff(np.append(first, len(key)))

    def __len__(self) -> int:
        return len(self.n)

    def texts(self, a: int, b: int) -> pa.Array:
        words = [(self.tail if k else self.head).take(pa.array(c[a:b])) for k, c in enumerate(self.columns)]
        return pc.binary_join_element_wise(*words, pa.scalar(b"", pa.large_binary()))

    def text(self, i: int) -> bytes:
        return self.texts(i, i + 1)[0].as_py()


def suffixes(texts: DataFrame, marks, bounds, max_words: int) -> DataFrame:
    """(part, suffix, n): suffixes as tasks have counted them, with the number of their range. marks and bounds are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = Suffixes(chunk, marks.value, max_words)
            del chunk
            cuts = [bisect.bisect_left(range(len(found)), b, key=found.text) for b in bounds.value]
            for a in range(0, len(found), ROWS):
                b = min(a + ROWS, len(found))
                part = np.searchsorted(cuts, np.arange(a, b), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), found.texts(a, b).cast(pa.binary()), pa.array(found.n[a:b], pa.int64())], ["part", "suffix", "n"])

    return texts.mapInArrow(common.tidied(run), "part int, suffix binary, n long")


class Stack:
    """Counts all prefixes of two words or more of a range's suffixes, which come in reverse order.

    A prefix leaves when the first suffix without it has come: all that end within a batch at once, while what the batch's last suffix
    holds stays open with its count so far. Rare prefixes are dropped, but for the first and the last of a range at each
    length: only these can have suffixes in another range too.
    """

    def __init__(self, least: int) -> None:
        self.least = least
        self.open: list[tuple[bytes, int]] = []  # prefixes of the last suffix, of one word, two words, ..., each ended by a blank
        self.begun: set[int] = set()  # lengths of which a first prefix has left
        self.done: list[tuple[bytes, int]] = []

    def add(self, suffixes: pa.Array, n: np.ndarray) -> None:
        # what is open goes before the batch, shortest first, each with what its longer ones don't have
        counts = [x for _, x in self.open] + [0]
        texts = pa.concat_arrays([pa.array([prefix for prefix, _ in self.open], suffixes.type), suffixes])
        n = np.append(-np.diff(counts), n)
        words = pc.split_pattern(texts, " ")
        size = words.value_lengths().to_numpy() - 1  # behind the last blank is an empty word
        codes = words.flatten().dictionary_encode().indices.to_numpy()
        begin = np.cumsum(size + 1) - size - 1
        upto = np.append(0, np.cumsum(n))
        new = np.arange(len(size)) == 0
        still: list[tuple[bytes, int]] = []
        for k in range(int(size.max())):
            has = size > k
            code = np.where(has, codes[begin + np.minimum(k, size)], -1)
            new[1:] |= code[1:] != code[:-1]
            start, stop = np.flatnonzero(new), np.append(np.flatnonzero(new[1:]) + 1, len(new))
            start, stop = start[has[start]], stop[has[start]]
            sums = upto[stop] - upto[start]
            prefix = lambda i, k=k: b" ".join(texts[int(i)].as_py().split(b" ")[: k + 1]) + b" "
            if len(stop) and stop[-1] == len(new):
                still.append((prefix(start[-1]), int(sums[-1])))
                start, stop, sums = start[:-1], stop[:-1], sums[:-1]
            if k and len(start):
                wanted = sums >= self.least
                wanted[0] |= k not in self.begun
                self.begun.add(k)
                self.done += [(prefix(start[i]), int(sums[i])) for i in np.flatnonzero(wanted)]
        self.open = still

    def close(self) -> None:
        """The range ends: all that is open leaves. The first word alone has been counted already."""
        self.done += self.open[1:]
        self.open, self.begun = [], set()


def phrase_counts(parts: DataFrame, ranges: int, least: int) -> DataFrame:
    """(lang, phrase, n) of phrases of two words or more with n >= least, from counted suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part = Stack(least), None

        def out() -> pa.RecordBatch:
            split = [prefix[:-1].split(b"\n") for prefix, _ in stack.done]
            values = [strings([bytes.fromhex(lang.decode()) for lang, _ in split]), strings([phrase for _, phrase in split]), pa.array([n for _, n in stack.done], pa.int64())]
            stack.done.clear()
            return pa.RecordBatch.from_arrays(values, ["lang", "phrase", "n"])

        for batch in batches:
            of, suffix, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if of[a] != part:
                        stack.close()
                        part = of[a]
                    stack.add(suffix[a:b], n[a:b])
            yield out()
        stack.close()
        yield out()

    sorted_ = parts.repartition(ranges, "part").sortWithinPartitions(F.desc("suffix"))
    return sorted_.mapInArrow(common.tidied(run), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def cut_score(a: Column, whole: Column) -> Column:
    """floor(SCALE * a / whole) in exact decimals."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(20,0)"), whole.cast("decimal(21,0)"))


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", max_words: int = MAX_WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score."""
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError(f"max_words is between 2 and {MAX_WORDS}")
    spark, texts = df.sparkSession, texts_of(df, lang, text)
    words = common.saved(word_counts(texts).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = words.filter(F.col("word").isNull()).select("lang", F.col("n").alias("total"))
    often = words.filter(F.col("word").isNotNull())
    size = totals.agg(F.sum("total")).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-size // RANGE_WORDS)))
    marks = spark.sparkContext.broadcast(bitmap(often))
    sampled = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, size // SAMPLE_WORDS))) == 0)
    none = spark.sparkContext.broadcast([])
    keys = suffixes(sampled, marks, none, max_words).select(F.substring("suffix", 1, 200).alias("suffix")).distinct().orderBy(F.xxhash64("suffix")).limit(SAMPLED * ranges)
    sample = sorted(bytes(r[0]) for r in keys.collect()) if ranges > 1 else []
    bounds = spark.sparkContext.broadcast(sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)} if sample else ()))
    phrases = common.saved(phrase_counts(suffixes(texts, marks, bounds, max_words), ranges, least), "phrases")
    counts = often.select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases)

    split = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    k = F.col("k")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), k).alias("first"), joined(k + 1, F.size("w") - k).alias("rest"))
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .withColumn("score", cut_score(F.col("a"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # the phrases inside each candidate, with the greatest count among those that hold them
    inner = (
        split.filter(F.size("w") > 2)
        .withColumn("k", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)))
        .select("lang", joined(F.col("at"), k).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    held = F.col("longer").isNotNull() & (F.lit(100) * F.col("longer").cast("decimal(20,0)") >= F.lit(cover) * F.col("a").cast("decimal(20,0)"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(~held).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_suffix_sigma(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS t FROM documents
), p AS (
  SELECT lang, row_number() OVER () AS piece, w FROM (SELECT lang, list_filter(string_split(q, ' '), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split(t, chr(10))) AS q FROM d)) WHERE len(w) > 0
), v AS (
  SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p
), e AS (
  SELECT lang, w1, lead(w1, 1) OVER z AS w2, lead(w1, 2) OVER z AS w3, lead(w1, 3) OVER z AS w4 FROM v WINDOW z AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM e UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM e WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM e WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM e WHERE w4 IS NOT NULL
), c AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30
), t AS (
  SELECT lang, count(*) AS n FROM v GROUP BY lang
), s AS MATERIALIZED (
  SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, k FROM c WHERE k > 1
), j AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM s, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k
), x AS (
  SELECT j.lang, j.phrase, a, j, l.n AS l, r.n AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(l.n AS HUGEINT) + r.n) AS score
  FROM j JOIN c l ON l.lang = j.lang AND l.phrase = head JOIN c r ON r.lang = j.lang AND r.phrase = rest
), m AS (
  SELECT lang, phrase, a, l, r, score FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), i AS (
  SELECT lang, array_to_string(w[b:b + j - 1], ' ') AS phrase, max(a) AS longer
  FROM s, (SELECT unnest([2, 2, 2, 3, 3]) AS j, unnest([1, 2, 3, 1, 2]) AS b) WHERE j < k AND b + j - 1 <= k GROUP BY ALL
), o AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR CAST(100 AS HUGEINT) * i.longer < CAST(80 AS HUGEINT) * a
)
SELECT o.lang, rank, phrase, a, l, r, t.n AS n, CAST(score AS BIGINT) AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op13_suffix_sigma": op13_suffix_sigma}
ORACLES = {"op13_suffix_sigma": SQL}
