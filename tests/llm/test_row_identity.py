"""Suffix removal over rows whose ids are null or repeated, against brute force."""

import collections
import hashlib
import random

import pytest

from robustspark.llm import suffix
from tests.llm.test_corpus_operators import brute_suffix, corpus


def removed(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, id long").repartition(3)
    return collections.Counter(tuple(r) for r in suffix.suffix_dedup(df).collect())


def brute(rows):
    """Documents, told apart by id and text, stand in the order of id (null last), then digest; equal rows are one document."""
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    number = {k: n for n, k in enumerate(sorted({key(r) for r in rows}))}
    found = brute_suffix({(number[key(r)], r[1] or "") for r in rows})
    return collections.Counter((r[0], *found[number[key(r)]]) for r in rows)


def test_shared_ids_of_different_texts(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    b, x = make(250), make(281)
    for rows in ([(5, b), (7, x), (7, b)], [(None, b), (None, x), (None, b + " " + x)], [(None, b), (None, b), (1, b), (None, "tiny"), (None, None), (2, ""), (2, None)]):
        assert removed(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_rows_with_null_and_repeated_ids(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i // 3, i // 3]), t) for i, t in corpus(seed)]
    rows += rng.sample(rows, 15)
    assert removed(spark, rows) == brute(rows)
