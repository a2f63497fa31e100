import random
import re

import corpus_pipeline


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    """Against the definitions, row by row."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    item = " ".join(rng.choice(words) for _ in range(12))
    junk = "too short"
    texts = [(None, good[0]), (None, good[1]), (1, good[2]), (1, good[3]), (1, junk), (2, good[2] + " end"), (None, good[0]), (3, good[4] + " " + item), (3, good[5]), (None, junk), (None, None)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def shingles(t):
        w = re.findall(r"\S+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    kept = []
    for i, t in sorted(((i, t) for i, t in texts if t and t != junk), key=lambda x: (x[0] is None, x[0])):
        if not any(100 * len(shingles(t) & shingles(u)) >= 75 * len(shingles(t) | shingles(u)) for _, u in kept):
            kept.append((i, t))
    want = [(i, t) for i, t in kept if not shingles(item) <= shingles(t)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want) == 5
