"""The pipeline keeps clean documents and acts on each planted case."""

import hashlib
import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice(["an", "the", "er", "ou", "st"]) for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    item = " ".join(f"bench{k}" for k in range(30))
    texts = {i: make(60) for i in range(150)}
    texts |= {i: " ".join(w.upper() + "!!" for w in make(40).split()) for i in range(150, 200)}
    texts |= {200: texts[3], 201: texts[4].replace(" ", "  "), 202: make(40) + " " + item + " " + make(10), 203: make(30) + " a.b@c.example " + make(5)}
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == [*range(150), 203]
    redacted = texts[203].replace("a.b@c.example", "[EMAIL]")
    assert got[203]["decoded_sha256"] == hashlib.sha256(redacted.encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
