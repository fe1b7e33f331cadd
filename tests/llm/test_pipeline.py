"""The pipeline's stages against what they promise: columns, clean documents kept, copies gone, every kept document packed."""

from pyspark.sql import functions as F

import corpus_pipeline
from siltgrid.llm import common


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi", "ste", "dun", "ver") for b in ("na", "gor", "li", "tes", "mo", "k")]
    clean = [". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(8)) + "." for _ in range(30)]
    shared = " ".join(rng.choice(words) for _ in range(70)) + "."
    texts = clean + [clean[0], clean[0].replace(clean[0].split()[3], "other", 1), clean[5] + "\n" + shared, clean[6][::-1] + " " + shared, "too short", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    assert seen[0] >= set(range(30)) and not seen[0] & {34, 35}
    assert seen[1] >= set(range(30)) and not seen[1] & {30, 31}
    assert seen[1] == seen[2] == seen[3]


def test_run_reads_the_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert F.col("doc_id") is not None
