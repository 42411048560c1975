"""The corpus operators against brute-force versions, and their edge cases."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from robustspark.llm import bpe, chunking, decontaminate, graph, html, jaccard, labelled_pages, lm, media, pii, quality, suffix, textops

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, id long, cls string, token string, n_chars long"


def corpus(seed=5, size=60):
    """Small documents with copies, near copies, shared passages, repeats, nulls, spaces and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "the", "er", "ou", "ti", "st", "é", "B"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    texts = [None, "", " \n\t", "one", "one two three four", "One Two three four", make(4000), "a" * 700, "é" * 150]
    for _ in range(size):
        base = make(rng.randrange(1, 120))
        texts.append(base)
        kind = rng.randrange(5)
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            words = base.split(" ")
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(base + " " + passage + " " + make(20))
    return list(enumerate(texts))


def frame(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, i, "x", "y", len(t) if t is not None else None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op3_jaccard(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(rows)


def test_op3_signatures_lose_no_link():
    rng = np.random.default_rng(4)
    for size in (4, 5, 8, 9, 13, 17, 26, 40, 41, 66, 200, 700):
        for _ in range(20):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            cut = int(rng.integers(0, size // 10 + 1))
            extra = int(rng.integers(0, size // 4 + 1))
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both >= 80 * (len(base) + len(other) - both) and len(other) > 3 and not np.array_equal(base, other):
                assert len(np.intersect1d(jaccard.signatures(base), jaccard.signatures(other)))
                apart = sum(int(x ^ y).bit_count() for x, y in zip(jaccard.parity(base).view(np.uint64), jaccard.parity(other).view(np.uint64), strict=True))
                assert 9 * apart <= len(base) + len(other)


def test_op3_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(2)
    for size in range(4, 61, 4):
        counts = collections.Counter()
        for _ in range(1000):
            counts.update(jaccard.signatures(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))).tolist())
        assert max(counts.values()) == 1


def test_op3_small_sets_lose_no_link():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        base = rng.integers(0, 2**63, int(rng.integers(4, 60)), dtype=np.uint64)
        gone, new = int(rng.integers(0, 1 + len(base) // 8)), int(rng.integers(0, 1 + len(base) // 5))
        one, two = np.unique(base), np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        both = len(np.intersect1d(one, two))
        if len(two) > 3 and 100 * both >= 80 * (len(one) + len(two) - both) and not np.array_equal(one, two):
            assert len(np.intersect1d(jaccard.signatures(one), jaccard.signatures(two)))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (2, 1)], "a long, b long")
    assert sorted(map(tuple, graph.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]
    assert graph.connected_components(edges.limit(0)).count() == 0


def brute_suffix(rows):
    raw = sorted((i, (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in raw:
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (i, p))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [3000, 2])
def test_op7_suffix_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.suffix_dedup(docs).collect()}
    assert got == brute_suffix(rows)


def test_op7_two_stage_order():
    rng = random.Random(2)
    for _ in range(80):
        n = rng.randrange(1, 300)
        text = np.array([rng.randrange(1, 2 + rng.randrange(6)) for _ in range(n)], np.uint8)
        starts = np.array(sorted(rng.sample(range(n), rng.randrange(1, n + 1))))
        raw = text.tobytes()
        order = suffix.two_stage_order(text, starts)
        assert sorted(order.tolist()) == starts.tolist()
        keys = [raw[i : i + 100] for i in order]
        assert keys == sorted(keys)


def test_op7_repeated_rows_keep_their_text(spark):
    text = " ".join(f"word{i}" for i in range(60))
    got = suffix.suffix_dedup(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, len(text))]


def test_op8_chunk_dedup(docs, rows):
    first, chunks = {}, {}
    for i, t in rows:
        raw, at = (t or "").encode(), 0
        chunks[i] = []
        for x in chunking.text_chunks(raw):
            first.setdefault(x, (i, at))
            chunks[i].append((at, at + len(x), x))
            at += len(x)
        assert at == len(raw)
    want = {}
    for i, t in rows:
        runs = []
        for a, b, x in chunks[i]:
            if first[x] != (i, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        raw = (t or "").encode()
        for least in (chunking.RUN, 0):
            kept_runs = [r for r in runs if r[1] - r[0] >= min(least, len(raw))]
            kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in kept_runs)], [*(a for a, _ in kept_runs), len(raw)]))
            origins = sorted({first[x][0] for a, b, x in chunks[i] if first[x] != (i, a) and any(lo <= a and b <= hi for lo, hi in kept_runs)})
            want[i, least] = (sum(b - a for a, b in kept_runs), ",".join(f"{a}:{b}" for a, b in kept_runs), origins, hashlib.sha256(kept).hexdigest())
    for least in (chunking.RUN, 0):
        got = {(r["doc_id"], least): (r["n_removed"], r["removed_spans"], r["origin_ids"], r["kept_sha256"]) for r in chunking.chunk_dedup(docs, least_run=least).collect()}
        assert got == {k: v for k, v in want.items() if k[1] == least}


def test_op8_cuts_by_the_rolling_rule():
    rng = np.random.default_rng(8)
    for raw in (rng.integers(97, 101, 5000, dtype=np.uint8).tobytes(), b"a" * 3000, rng.integers(0, 256, 31, dtype=np.uint8).tobytes(), b""):
        want, begin, h = [], 0, 0
        for k, x in enumerate(raw):
            h = (2 * h + int(chunking.GEAR[x])) % 2**32
            size = k + 1 - begin
            if (size >= chunking.LEAST and not h & 0xF800) or size == chunking.MOST:
                want.append(raw[begin : k + 1])
                begin = k + 1
        assert chunking.text_chunks(raw) == [*want, *([raw[begin:]] if begin < len(raw) else [])]


def test_op8_finds_passages_of_51_words(spark):
    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(n))
    rows = [(2 * k + j, f"{make(40)} {p} {make(40)}") for k, p in enumerate(make(51) for _ in range(200)) for j in (0, 1)]
    missed = chunking.chunk_dedup(frame(spark, rows)).filter("doc_id % 2 = 1 and n_removed = 0").count()
    assert missed <= 8


def test_op8_cuts_resist_shifts():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    a, b = set(chunking.text_chunks(raw)), set(chunking.text_chunks(b"inserted" + raw))
    assert len(a & b) > 0.95 * len(a)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    spans = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if ok:
                spans.append((m.start(), k, m.end(), name))
    spans.sort()
    return (*(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest())


def test_op2_pii(spark, rows):
    rng = random.Random(3)
    alphabet = "ab.@-_+ 0123456789() é\U0001f600%"
    texts = [t for _, t in rows] + ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.4", "4595065711051199 4595 0657 1105 1199", "+1 (917) 555-7017", "9" * 4000, "1 " * 3000, "a" * 20000, "a@" * 2000, "a@b.c" * 1500, "\U0001f600 a@b.co"]
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(800)]
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii.pii_report(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(texts)}


def test_op2_addresses_with_zero_parts(spark):
    texts = ["at 10.0.0.1 now", "0.0.0.0", "127.0.0.1 1.2.3.000", "1.2.3.00", "00256.0.0.0 0.0.0.256", "0" * 3000 + ".0.0." + "0" * 3000, "010.255.0249.0"]
    df = frame(spark, list(enumerate(texts)))
    assert {r["doc_id"]: tuple(r)[1:6] for r in pii.pii_report(df).collect()} == {i: brute_pii(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}[0] == "at [IP] now"


def test_op2_added_kinds_and_redaction(spark):
    df = frame(spark, [(1, "iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789"), (2, "GB82 WEST 1234 5698 7654 33"), (3, None), (4, "to a@b.co now")])
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_report(df).collect()}
    assert spans == {1: "iban:5:32,ssn:38:49", 2: "", 3: "", 4: "email:3:9"}
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(df).collect()}
    assert out[4] == ("to [EMAIL] now", 14) and out[3] == (None, None) and pii.redacted(df).columns == df.columns


def test_op10_bpe(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t for _, t in rows] + ["it's we'll I'M 's  x \n\n y ", "x" * 1000, "!?" * 300, "éé  x\x1c\x1d\x85y", "\U0001f600 abc\t\tdef  \n", "１２ ½ ² ٣", "<|endoftext|>"]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(500))]
    got = {r["doc_id"]: r for r in bpe.bpe_columns(frame(spark, list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        ids = codec.encode_ordinary(t or "")
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def plain_bpe(text, ranks):
    """One pretoken's ids by merging the first pair of least rank again and again."""
    parts = [bytes([b]) for b in text]
    while len(parts) > 1 and (best := min((ranks.get(a + b, 1 << 16), i) for i, (a, b) in enumerate(itertools.pairwise(parts))))[0] < 1 << 16:
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def rank_file(tmp_path, pieces):
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % k for k, p in enumerate(pieces)))
    return str(path)


def test_op10_folds_occurrences_in_the_order_of_ranks(spark, tmp_path, monkeypatch):
    """Overlapping and repeated pieces, one that merges never make, and words that later chunks and new dictionaries meet again."""
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"aa", b"ba", b"aab", b"abab", b"aaaa", b"bab", b"cb", b"bcca", b"aaab", b"abc"]
    ranks = {p: k for k, p in enumerate(pieces)}
    model = bpe.Ranks(open(path := rank_file(tmp_path, pieces), "rb").read())
    made = [p for p, _, _ in model.merges()]
    assert b"abc" in made and b"bab" in made and b"bcca" not in made
    rng = random.Random(12)
    words = ["".join(rng.choice("aaabbc") for _ in range(n)) for n in (*range(1, 40), 61, 62, 63, 64, 65, 200, 511, 512, 513)]
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(60)] + [*words, "", None]
    for chunk, known in ((8_000_000, 500_000), (300, 500_000), (300, 9), (1, 1)):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(bpe, "WORDS", known)
        got = {r["doc_id"]: r["token_ids"] for r in bpe.bpe_columns(frame(spark, list(enumerate(texts))).coalesce(1), path).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [k for p in bpe.pretokens(t or "") for k in ([ranks[p.encode()]] if p.encode() in ranks else plain_bpe(p.encode(), ranks))]


def test_op10_refuses_falling_ranks(tmp_path):
    path = rank_file(tmp_path, [bytes([b]) for b in range(256)] + [b"abc", b"ab"])
    with open(path, "rb") as file, pytest.raises(ValueError, match="lower rank"):
        bpe.Ranks(file.read()).merges()


def test_op5_media_round_trip(docs, rows):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert media.payload_of(bytes(r["media"])) == payload and r["payload_bytes"] == len(payload) and r["n_bytes"] == len(raw)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def test_op5_adpcm_against_one_block_at_a_time():
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (7, media.BLOCK), dtype=np.uint8)
    want = []
    for b in blocks:
        sample, index = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(88, int(b[2]))
        total, n = abs(sample), 1
        for byte in b[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEP[index])
                delta = ((2 * (code & 7) + 1) * step) >> 3
                sample = max(-32768, min(32767, sample - delta if code & 8 else sample + delta))
                index = max(0, min(88, index + int(media.INDEX_STEP[code & 7])))
                total, n = total + abs(sample), n + 1
        want.append(total // n)
    assert media.adpcm_energy(blocks).tolist() == want
    assert len(set(media.ALAW.tolist())) == 256 and media.MULAW[255] == media.MULAW[127] == 0


def test_op9_base_and_lattice(docs, rows):
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*WORD.findall((t or "").translate(LOWER)), " end"])
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        tokens = [*WORD.findall((t or "").translate(LOWER)), " end"]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_op9_forward_sums_all_segmentations():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = lm.Lattice(file.read())
    texts = ["thnterble", "a", "é", "x" * 30]
    joined = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    got = model.forward(textops.prefix_hashes(joined), np.concatenate([[0], ends[:-1]]), ends)
    for t, value in zip(texts, got, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        prefix, n = textops.prefix_hashes(raw), len(raw)
        weight = lambda table, i, j: float(table.get(textops.range_hashes(prefix, np.array([i]), np.array([j])))[0])

        def total(at, n=n, weight=weight):
            """All ways to go on from a place, by plain recursion over suffixes."""
            ways = [0.0] * (n + 1)
            ways[n] = 1.0
            for i in range(n - 1, at - 1, -1):
                ways[i] = math.exp(model.byte) * ways[i + 1] + sum(math.exp(weight(model.inner, i, j)) * ways[j] for j in range(i + 1, n + 1) if weight(model.inner, i, j) > -1e29)
            return ways

        ways = total(0)
        direct = math.exp(model.opening) * ways[0] + sum(math.exp(weight(model.starts, 0, j)) * ways[j] for j in range(1, n + 1) if weight(model.starts, 0, j) > -1e29)
        assert math.isclose(value, math.log(direct), rel_tol=1e-9)


def test_op4_decontamination(spark, rows):
    rng = random.Random(6)
    words = [f"w{rng.randrange(900)}" for _ in range(400)]
    items = [(k, " ".join(words[k * 20 : k * 20 + 12 + k])) for k in range(12)] + [(50, None), (51, ""), (52, "single")]
    planted = [(1000 + k, "before it " + items[k][1].upper() + " and after " * 30) for k in range(12)]
    df = frame(spark, rows + planted)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert all(got[1000 + k] == [k] for k in range(12)) and not any(got[i] for i, _ in rows)
    assert decontaminate.decontaminate(df, bench.limit(0)).filter("contaminated").count() == 0


def test_op4_edited_copies():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [make(rng.randrange(15, 60)) for _ in range(200)]
    index = decontaminate.Index([(k, " ".join(x)) for k, x in enumerate(items)])
    find = lambda texts: [[i for i, *_ in x] for _, _, x in index.hits(*textops.word_hashes(*textops.utf8(pa.array(texts)), textops.ALNUM))]
    for share, least in ((0.0, 1.0), (0.05, 0.98), (0.1, 0.95)):
        edited = [" ".join([*make(70), *(rng.choice(words) if rng.random() < share else x for x in own), *make(90)]) for own in items]
        assert sum(k in x for k, x in enumerate(find(edited))) >= least * len(items)
    clean = [" ".join(make(160)) for _ in range(300)] + [" ".join([*make(40), *own[: len(own) // 2], *make(60)]) for own in items]
    assert sum(map(bool, find(clean))) <= 0.01 * len(clean)


def test_op4_items_of_one_word(spark):
    bench = spark.createDataFrame([(1, "Solitary"), (2, "..."), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a solitary word"), (2, "solitarys"), (3, None), (4, "solitary, solitary")], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: [1]}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [2, 3]


def test_op4_accented_items_in_other_case(spark):
    items = [(k, " ".join(f"é{a}à{b}ñ ΟΔΌΣ{k} straße" for a, b in zip("abcdefgh", "hgfedcba"))) for k in range(3)]
    texts = [f"Before {t.upper()} after" for _, t in items] + [f"Before {t.lower()} after" for _, t in items]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(frame(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(k % 3 in r["item_ids"] and r["best_question"] == r["best_answer"] == 1.0 for k, r in got.items())


def test_op4_wand_returns_all_above():
    rng = random.Random(8)
    index = decontaminate.Index([(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(2, 90)))) for k in range(80)])
    for _ in range(200):
        query = rng.sample(range(len(index.terms)), rng.randrange(1, 40))
        threshold = rng.choice([0.02, 0.05, 0.1, 0.3])
        scores = collections.Counter()
        for t in query:
            for e, w in zip(*index.postings[t], strict=True):
                scores[e] += w
        assert {e for e, _ in index.search(query, threshold)} == {e for e, s in scores.items() if s >= threshold}


def test_op4_near_copies_of_short_items(spark, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12 + k))) for k in range(9)]
    texts, want = [], []
    for k, t in items:
        own = t.split(" ")
        for j in range(len(own)):
            texts.append("here now " + " ".join([*own[:j], "changed", *own[j + 1 :]]) + " and then")
            want.append([k])
        answer = max(1, len(own) // 4)
        texts.append(" ".join(own[:-answer]) + " with some other words after it")
        want.append([])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read = lambda: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["item_ids"], r["n_retrieved"]) for r in decontaminate.decontaminate(df, bench).collect()))
    one = read()
    assert {i: x for null, i, x, _ in one if not null} == dict(enumerate(want)) and len(one) == len(rows)
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    assert [x[:3] for x in read()] == [x[:3] for x in one] and [x[3] for x in read()][:2] == [1, 1]


def test_op4_blocks_of_items(spark, rows, monkeypatch):
    items = spark.createDataFrame([(k, rows[20 + k][1]) for k in range(9) if rows[20 + k][1]], "item_id long, text string")
    df = frame(spark, rows)
    one = decontaminate.decontaminate(df, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    two = decontaminate.decontaminate(df, items).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["item_ids"], r["contaminated"]) for r in one] == [(r["doc_id"], r["item_ids"], r["contaminated"]) for r in two]


def tagged(field, pages):
    """Precision and recall over the blocks of labelled pages."""
    found = [(g, b.label) for p in pages for x in [html.leaves(p)] for b, g in zip(x, field.decode(x), strict=True)]
    both = sum(g and y for g, y in found)
    return both / sum(g for g, _ in found), both / sum(y for _, y in found)


def test_op6_layouts_not_trained_on():
    assert min(tagged(html.Field(labelled_pages.pages(part="training")), labelled_pages.pages(150, 5, "held out"))) > 0.95
    assert min(tagged(html.trained(), labelled_pages.pages(150, 9))) > 0.95 and len(set(labelled_pages.layouts(150, 9))) > 120


def test_op6_sums_and_viterbi_against_enumeration():
    field = html.trained()
    for page in labelled_pages.pages(12, 3):
        blocks = html.leaves(page)[:9]
        n = len(blocks)
        local = np.array([[sum(field.by_name.get(f, (0.0, 0.0))[y] for f in x) for y in (0, 1)] for x in html.observed(blocks)])
        ways = list(itertools.product((0, 1), repeat=n))
        logs = np.array([sum(local[k, y] for k, y in enumerate(w)) + sum(field.moves[a, b] for a, b in zip(w, w[1:])) for w in ways])
        assert tuple(field.decode(blocks)) == ways[int(logs.argmax())]
        share = np.exp(logs - np.logaddexp.reduce(logs))
        padded = np.zeros((2, n + 3, 2))
        padded[0, :n] = padded[1, :n] = local
        one, two = field.expected(padded, np.array([n, 1]))
        assert np.allclose(one[0, :n, 1], [sum(p for p, w in zip(share, ways) if w[k]) for k in range(n)])
        assert np.allclose(two[0], [[sum(p * sum((a, b) == (i, j) for a, b in zip(w, w[1:])) for p, w in zip(share, ways)) for j in (0, 1)] for i in (0, 1)])
        assert np.allclose(two[1], 0)


def test_op6_what_is_no_text():
    field, say = html.trained(), "one two three four five six seven eight nine ten."
    article = f"<h1>A title of some words</h1><p title='a > b' data-x=\"<p>\">{say}</p>"
    around = [
        '<form><p>@</p></form>', '<ol class="commentlist"><li><div class="comment-body"><p>@</p></div></li></ol>', '<div id="responses"><p>@</p></div>', '<div class="consent-banner"><p>@</p></div>',
        '<div class="sponsored"><p>@</p></div>', '<div class="promo-box"><p>@</p></div>', '<div role="navigation"><a href="/">Home</a> <a href="/b">News</a></div>',
    ]
    for x in around:
        page = f"<html><body><article>{article}</article>{x.replace('@', say)}</body></html>"
        assert html.main_text(page, field)[0] == f"A title of some words\n\n{say}", x
    inside = f"<html><body><article>{article}<form><p>{say}</p></form><p>{say}</p></article></body></html>"
    assert html.main_text(inside, field)[0] == f"A title of some words\n\n{say}\n\n{say}"
    bare = f'<html><body><div class="c"><div><h1>A title of some words</h1></div><div>{say} {say}</div><div>{say} {say}</div></div></body></html>'
    assert html.main_text(bare, field)[0] == f"A title of some words\n\n{say} {say}\n\n{say} {say}"
    assert html.main_text(f"<html><body><form><main><article>{article}</article></main></form></body></html>", field)[0].endswith(say)


def test_op6_broken_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>x</a></li></ul></nav><article><h1>A &amp; B</h1><p>one\n two&nbsp;<b>three</b>.<p>four five six seven.<br></p>"
    broken = [page, page[:-9], "", None, "<", "<p", "plain words only here, nothing else to see.", "<article><p>x &lt;y&gt; z</p></article><footer>&copy; me</footer>"]
    got = html.extract_pages(spark.createDataFrame(list(enumerate(broken)), "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("clash"))).orderBy("page_id").collect()
    assert got[0]["text"] == "A & B\n\none two three.\n\nfour five six seven."
    assert got[7]["text"] == "x <y> z" and got[2]["text"] == got[3]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)


def test_op1_held_out_accuracy(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice(["an", "the", "er", "ou"]) for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    texts, labels = [(0, None), (1, "")], []
    for i in range(2, 402):
        clean = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        texts.append((i, " ".join(body) + "." if clean else " ".join(w.upper() + "!!" for w in body)))
        labels.append((i, int(clean)))
    df, known = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(df, known).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(got) == len(texts) and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert quality.quality_scores(df, known.limit(0)).filter("score <> 0.5").count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(12)
    make = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    own, near, twice, lone, other = (make(120) for _ in range(5))
    table = [(None, own), (None, near), (None, near + " more"), (3, near + " words"), (4, twice), (4, twice), (5, lone), (5, other), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in table], "doc_id long, text string, source string").repartition(3)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    want = [(None, 116, None), (None, 116, 3), (None, 117, 3), (3, 117, 3), (4, 116, 4), (4, 116, 4), (5, 116, 5), (5, 116, 5), (None, 0, None), (None, 0, None)]
    assert got == collections.Counter(want)
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each_component(df).collect())
    assert kept == collections.Counter([(None, own), (3, near + " words"), (4, twice), (5, lone), (5, other), (None, None), (None, "")])
    chunked = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"] > 0) for r in chunking.chunk_dedup(df).collect())
    assert chunked == collections.Counter([(None, len(own), False), (None, len(near), True), (None, len(near) + 5, True), (3, len(near) + 6, False), (4, len(twice), False), (4, len(twice), False), (5, len(lone), False), (5, len(other), False), (None, 0, False), (None, 0, False)])
    scored = collections.Counter((r["doc_id"], r["n_tokens"]) for r in lm.lm_scores(df, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert scored == collections.Counter([(None, 121), (None, 121), (None, 122), (3, 122), (4, 121), (5, 121), (5, 121), (None, 1), (None, 1)])
    left = decontaminate.without_leaks(df, spark.createDataFrame([(1, own), (2, lone)], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 0, 0, 3, 4, 4, 5]


def test_names_that_operators_might_use_themselves(spark):
    names = ["spans_email", "spans", "redacted", "rejected", "leak", "__email", "__spans", "__new", "pii_spans", "key", "y", "__kept", "__key", "score"]
    df = spark.createDataFrame([(1, "write to a@b.co now", *names), (1, None, *names), (None, "x", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").withColumn("id", F.lit("x"))
    bench = spark.createDataFrame([(1, "never in any of the texts")], "item_id long, text string").withColumn("key", F.lit("x"))
    for out in (pii.redacted(df), quality.keep_accepted(df, labels), decontaminate.without_leaks(df, bench), jaccard.keep_one_of_each_component(df)):
        assert out.columns == df.columns and out.count() == 3
    assert {r["text"] for r in pii.redacted(df).collect()} == {"write to [EMAIL] now", None, "x"}
    assert chunking.chunk_dedup(df).count() == lm.lm_scores(df, public_tokenizers.path("piece_bpe_32k.model")).count() == suffix.suffix_dedup(df).count() == 3


def test_texts_of_megabytes(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(420_000))
    raw = long.encode()
    assert len(raw) > textops.CHUNK
    df = spark.createDataFrame([(1, long), (2, "short"), (3, long), (4, None)], "doc_id long, text string")
    by_id = lambda out: {r["doc_id"]: r for r in out.collect()}
    path = public_tokenizers.path
    assert by_id(bpe.bpe_columns(df, path("byte_bpe_50k.tiktoken"), keep_ids=False))[1]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
    assert by_id(jaccard.jaccard_components(df))[3]["component_id"] == 1
    assert by_id(suffix.suffix_dedup(df))[3]["n_removed"] == by_id(chunking.chunk_dedup(df))[3]["n_removed"] == len(raw)
    assert by_id(lm.lm_scores(df, path("piece_bpe_32k.model")))[1]["n_tokens"] == 420_001
    assert by_id(media.media_columns(df, keep_media=False))[1]["n_bytes"] == len(raw)
    assert by_id(pii.pii_report(df))[1]["spans"] == ""
    item = spark.createDataFrame([(9, " ".join(long.split(" ")[300_000:300_030]))], "item_id long, text string")
    assert by_id(decontaminate.decontaminate(df, item))[1]["item_ids"] == [9]
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert 0 <= by_id(quality.quality_scores(df, labels))[1]["score"] <= 1
    page = spark.createDataFrame([(1, "u", f"<html><body><article><h1>A title of words</h1><p>{long}.</p></article></body></html>")], "page_id long, url string, html string")
    assert html.extract_pages(page).first()["text"] == f"A title of words\n\n{long}."


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = public_tokenizers.path
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    for df in (
        quality.quality_scores(none, labels), pii.pii_report(none), jaccard.jaccard_components(none), decontaminate.decontaminate(none, bench), media.media_columns(none), suffix.suffix_dedup(none),
        chunking.chunk_dedup(none), lm.lm_scores(none, path("piece_bpe_32k.model")), bpe.bpe_columns(none, path("byte_bpe_50k.tiktoken")),
        html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
        pii.redacted(none), quality.keep_accepted(none, labels), decontaminate.without_leaks(none, bench), jaccard.keep_one_of_each_component(none),
    ):
        assert df.count() == 0


def test_words_and_hashes():
    column = pa.array(["Ab  cé", None, " ", "x"])
    data, off = textops.utf8(column)
    s, e, at = textops.words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == ["Ab", "cé", "x"] and at.tolist() == [0, 2, 2, 2, 3]
    keys = textops.mix(np.arange(1000, dtype=np.uint64))
    table = textops.Lookup(keys, np.arange(1000.0), -1.0)
    assert table.get(keys).tolist() == list(range(1000)) and (table.get(keys + np.uint64(1)) == -1).all()
