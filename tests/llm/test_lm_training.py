"""The lattice learns from the training documents, so texts that are held out score near the smoothed unigram."""

import math
import random

import public_tokenizers

from robustspark.llm import lm


def test_op9_held_out_scores_are_near_the_unigram(spark):
    rng = random.Random(5)
    lexicon = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(lexicon) for _ in range(60)) + f" x{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.lm_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    out = [r for r in got if r["held_out"]]
    assert out and len(got) == 200
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert all((r["score"] - r["base_score"]) / r["n_tokens"] > -0.2 for r in out)


def test_op9_expected_uses_add_up():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = lm.Lattice(file.read())
    text = b"a"
    prefix = lm.prefix_hashes(lm.np.frombuffer(text, lm.np.uint8))
    uses = model.expected(prefix, lm.np.array([0]), lm.np.array([1]))
    # one piece that begins the word, or the opening mark and one piece or byte
    assert math.isclose(uses.sum(), 1 + uses[-2], rel_tol=1e-9)
