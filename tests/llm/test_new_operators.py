"""Runs, exact top-k and collocations against brute force, and on the odd cases of their docstrings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltgrid.llm import phrases, runs, topk


def brute_runs(words, least):
    """Every stretch of every period, by definition; stretches that have a smaller period go."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_documents_indexed_together(seed):
    rng = random.Random(seed)
    for _ in range(150):
        documents = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.randint(0, 45), rng.choice([1, 2, 2, 3, 6])
            words = [b"%d" % rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), 1 + rng.randrange(7)
                words = [words[min(n - 1, i if i < a else a + (i - a) % p)] for i in range(n)]
            documents.append(words)
        least = rng.choice([2, 4, 12])
        assert runs._judged(documents, least) == [brute_runs(w, least) for w in documents]


def test_next_smaller_walks_long_chains():
    down = np.concatenate([[0], np.arange(3000, 0, -1), [-1]])
    for values in (down, -down, np.arange(50), np.random.default_rng(1).permutation(4000)):
        want = [next((j for j in range(i + 1, len(values)) if values[j] < values[i]), len(values)) for i in range(len(values))]
        assert runs.next_smaller(values).tolist() == want


def digests(words):
    found = brute_runs(words, 12)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(own, words):
    n, h = len(words), zlib.crc32(str(own).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + math.floor((n - a) / (3 + g % 8))
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "dé"]) for _ in range(rng.randint(0, 70))) for _ in range(60)]
    texts += [None, "", " \t\x0b\r\n", "no\x1cbreak here", "ab " * 40, "x y " * 9 + "z " + "x y " * 9, "word " * 300, "same " * 12, "same " * 11, "日本 語 " * 20]
    rows = [(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0, "x", 1), (None, "ab " * 40, "en", "s", 0, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, runs int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_runs_theorem(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted(((i,) + digests(planted(i, (t or "").encode().split()) if i is not None else (t or "").encode().split()) for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_a_long_document_is_indexed_whole():
    words = [b"%d" % (i % 977) for i in range(150_000)]
    assert runs._judged([words, [b"x"] * 20], 12) == [[(0, 150_000, 977)], [(0, 20, 1)]]


def exact_top(rows, k, every=100, scale=1024):
    ok = [(i, [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), topk.LEAST), topk.MOST), i) for i, w in ok if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_top_k_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1), -1e-5]) for _ in range(rng.choice([6, 6, 6, 4, 0]))]) for i in range(400)]
    rows += [(400, [0.0] * 6), (401, None), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf"), 1.0]), (None, [1.0] * 6), (7, [9.0] * 6), (7, [9.0] * 6), (500, [9.0] * 6), (500, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, block int, v string")
    for block, group in ((4096, 1024), (37, 2)):
        got = topk.top_inner_products(df, block_rows=block, group_queries=group).collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == exact_top(rows, 10)
    few = topk.top_inner_products(df.filter("vec_id in (0, 1, 2)")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert topk.top_inner_products(df.limit(0)).count() == 0


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [1e17, 3.0]), (1, [2e17, 1.0]), (2, [1e305, -1.0]), (3, [-1e305, 0.5]), (4, [0.25, 0.25]), (5, [2e17, 1.0]), (6, [2e17, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_inner_products(df, k=4).collect()}
    assert got == exact_top(rows, 4) and (0, 1, 1, topk.MOST) in got


def test_partition_selection_takes_ties_in_order():
    assert sorted(topk.best(np.array([5, 1, 5, 7, 5, 5]), 3).tolist()) == [0, 2, 3]


def brute_phrases(rows, max_words=4, least=30, cover=80, top=2000):
    words, counts = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        words[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]", piece) if x]
            words[lang] += len(w)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out, by = set(), {}
    for (lang, w), a in candidates.items():
        score, _, left, right = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        inside = any(x == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y))) and 100 * b >= cover * a for (x, y), b in candidates.items())
        if not inside:
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    for lang, found in by.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return out


def corpus():
    rng = random.Random(6)
    said = ["the river Rose over", "New York City", "a\tb", "water level", "état civil", "x", "rose over the banks", "b a"]
    rows = [(rng.choice(["en", "de", None, "e\nn", "e n"]), " ".join(rng.choice(said) + rng.choice(["", "", ".", ", ", "\n", "\x0b", "\x01 "]) for _ in range(rng.randint(1, 60)))) for _ in range(300)]
    return rows + [("en", None), ("fr", ""), ("fr", " ,\t.\r"), ("en", "far out " * 3000), *[("en", "the same line again, and again")] * 40]


def test_collocations_match_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(x, y, "p", 1, 2) for x, y in rows], "lang string, text string, phrase string, n int, a int").repartition(5)
    want = brute_phrases(rows)
    assert len(want) > 60
    got = phrases.collocations(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # small ranges, chunks and stretches: prefixes are cut by bounds, suffixes meet from many chunks
    for name, value in (("RANGE_WORDS", 700), ("SAMPLE_WORDS", 4000), ("CHUNK_WORDS", 300), ("AT_ONCE", 500), ("STRETCH", 64), ("ROWS", 50), ("LEAST_BITS", 64), ("BITS", 1)):
        monkeypatch.setattr(phrases, name, value)
    small = phrases.chunks.__defaults__
    monkeypatch.setattr(phrases.chunks, "__defaults__", (300,))
    got = phrases.collocations(df, top=20).collect()
    monkeypatch.setattr(phrases.chunks, "__defaults__", small)
    assert {tuple(r) for r in got} == brute_phrases(rows, top=20)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    a, whole = 9_000_000_000_000_000_000, 18_000_000_000_000_000_001
    row = spark.createDataFrame([(a,)], "a long").select(phrases.cut_score(phrases.F.col("a"), phrases.F.lit(str(whole)).cast("decimal(20,0)")).alias("s")).first()
    assert row.s == 2_000_000 * a // whole


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_stack_counts_prefixes_over_batches(size):
    rng = random.Random(3)
    rows = Counter("61\n" + "".join(rng.choice("ab\x01c") + " " for _ in range(rng.randint(2, 4))) for _ in range(400))
    ordered = sorted(((k.encode(), n) for k, n in rows.items()), reverse=True)
    want = Counter()
    for k, n in ordered:
        words = k.split(b" ")[:-1]
        for m in range(2, len(words) + 1):
            want[b" ".join(words[:m]) + b" "] += n
    stack = phrases.Stack(5)
    for a in range(0, len(ordered), size):
        part = ordered[a : a + size]
        stack.add(phrases.pa.array([k for k, _ in part], phrases.pa.binary()), np.array([n for _, n in part]))
    stack.close()
    assert len(stack.done) == len(dict(stack.done)) and all(want[k] == n for k, n in stack.done)
    edges = {b" ".join(k.split(b" ")[:m]) + b" " for k in (ordered[0][0], ordered[-1][0]) for m in range(2, k.count(b" ") + 1)}
    assert {k for k, n in want.items() if n >= 5} | edges <= dict(stack.done).keys()


def test_earlier_operators_on_empty_tables(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    from siltgrid.llm import bpe, warc

    docs = spark.createDataFrame([], "doc_id long, text string, ids string, text_sha string")
    assert bpe.digest_round_trip(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN).count() == 0
    index, folder = warc.write_and_index(spark.createDataFrame([], "page_id long, url string, html string, digest string"))
    assert warc.read_records(index, folder).count() == 0
