"""Every training word teaches the lattice once, however long and however often it occurs, against plain versions."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers

from robustspark.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def model():
    with open(PATH, "rb") as file:
        return file.read()


def spans(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return lm.prefix_hashes(data), np.concatenate([[0], ends[:-1]]), ends


def brute_expected(pieces, word):
    """Uses by the forward and backward sums over all segmentations, one range at a time."""
    prefix, _, (n,) = spans([word])
    get = lambda table, i, j: int(table.get(lm.range_hashes(prefix, np.array([i]), np.array([j])))[0])
    p = np.exp(pieces.logs)
    arcs = [(i, j, get(pieces.inner_at, i, j)) for i in range(n) for j in range(i + 1, min(n, i + pieces.widest) + 1)]
    first = [(j, get(pieces.start_at, 0, j)) for j in range(1, min(n, pieces.widest) + 1)]
    ahead, behind, uses = [0.0] * (n + 1), [0.0] * n + [1.0], np.zeros(len(pieces.logs) - 1)
    ahead[0] = math.exp(pieces.opening)
    for j, x in first:
        ahead[j] += p[x] if x >= 0 else 0
    for j in range(1, n + 1):
        ahead[j] += ahead[j - 1] * p[-2] + sum(ahead[i] * p[x] for i, k, x in arcs if k == j and x >= 0)
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1] * p[-2] + sum(behind[k] * p[x] for h, k, x in arcs if h == i and x >= 0)
    for j, x in first:
        uses[x] += p[x] * behind[j] / ahead[n] if x >= 0 else 0
    for i, j, x in arcs:
        uses[x] += ahead[i] * p[x] * behind[j] / ahead[n] if x >= 0 else 0
    uses[-2] += math.exp(pieces.opening) * behind[0] / ahead[n]
    uses[-1] += sum(ahead[i] * p[-2] * behind[i + 1] for i in range(n)) / ahead[n]
    return uses


def test_expected_uses_of_short_and_long_words(monkeypatch):
    pieces = lm.Lattice(model())
    words = ["a", "windows", "windows", "é", "international", "zq", "counterrevolutionary"]
    want = sum(brute_expected(pieces, w) for w in words)
    assert np.allclose(pieces.expected(*spans(words)), want, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(lm, "PLACES", 7)
    prefix, s, e = spans(words)
    assert np.allclose(sum(pieces._expected_long(prefix, a, b - a) for a, b in zip(s, e, strict=True))[:-1], want, rtol=1e-9, atol=1e-12)
    # a word of hundreds of bytes is taught from like any other
    assert np.allclose(pieces.expected(*spans(["windows" * 40]))[:-2].sum(), brute_expected(pieces, "windows" * 12)[:-2].sum() / 12 * 40, rtol=0.1)


def test_op9_scores_from_all_training_words(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 9)))
    rows = []
    for k in range(60):
        words = [make() for _ in range(15)] + ["".join(make() for _ in range(30))]
        rows.append((k, " ".join(words * (1 + k % 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, ends = {}, 0
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            ends += 1
            for w in re.findall(r"[^\x20\x09-\x0D]+", text):
                counts[w] = counts.get(w, 0) + 1
    n, kinds = sum(counts.values()), len(counts)
    once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    pieces = lm.Lattice(model())
    for _ in range(2):
        pieces = lm.Lattice(model(), pieces.expected(*spans(list(counts))))
    share = (ends + 0.5) / (n + ends + 1)

    def score(text):
        words = text.split()
        logs = pieces.forward(*spans(words))
        return sum(math.log10(max(counts.get(w, 0) - discount, 0) / n + discount * kinds / n * math.exp(x)) + math.log10(1 - share) for w, x in zip(words, logs, strict=True)) + math.log10(share)

    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, PATH).collect()}
    assert all(math.isclose(got[k], score(text), rel_tol=1e-6) for k, text in rows)
