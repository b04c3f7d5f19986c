import hashlib
import random
from collections import Counter

from voxloom.llm import fingerprint


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    sampler = fingerprint.Sampler(1024)
    for _ in range(6):
        words = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(200)]
        other = words[:120] + [f"v{k % 9}" for k in range(60)]
        a, b = " ".join(words), " ".join(other)
        assert abs(fingerprint.likeness(sampler.sample(a), sampler.sample(b)) - jaccard(a, b)) < 0.07


def test_small_memory_gives_the_same_samples():
    texts = [" ".join(f"w{k * j % 97}" for k in range(60)) for j in range(1, 9)]
    small, large = fingerprint.Sampler(16, most=70), fingerprint.Sampler(16)
    assert all((small.sample(t) == large.sample(t)).all() for t in texts * 2)


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i * 2, " ".join(rng.choice(["the", "ä", "Loom", "x", f"w{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(301, None), (303, "  "), (305, "same text here"), (307, "same text here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, range int")
    out = {r.doc_id: r for r in fingerprint.fingerprints(docs, per_range=20).collect()}
    rows.sort()
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert out[i].n_chars == len(t)
        assert out[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1
    assert out[305].fingerprint == out[307].fingerprint and out[305].near_next == 1
    assert out[301].fingerprint == out[303].fingerprint == "0000" * fingerprint.SAMPLES


def test_one_row_and_none(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(None, 5, 1.0)]
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_samples_equal_brute_force():
    """Sample by sample and word by word, from the same uniform numbers."""
    import numpy as np

    rng = random.Random(9)
    sampler = fingerprint.Sampler(32)
    agree = []
    for _ in range(10):
        text = " ".join(rng.choice(["a", "b", f"w{rng.randrange(50)}"]) for _ in range(40))
        found = sampler.sample(text)
        bags = sorted(Counter(text.encode().split()).items())
        base = fingerprint.mix(sampler.hashes.array([w for w, _ in bags]))
        (r1, r2), (c1, c2), (b, _) = (sampler._uniform(base, which) for which in range(3))
        for k in range(32):
            best = None
            for j, (_, weight) in enumerate(bags):
                r, c = -np.log(float(r1[j, k]) * float(r2[j, k])), -np.log(float(c1[j, k]) * float(c2[j, k]))
                t = np.floor(np.log(weight) / r + float(b[j, k]))
                log_a = np.log(c) - r * (t - float(b[j, k]) + 1)
                if best is None or log_a < best[0]:
                    best = log_a, int(fingerprint.mix(np.array([(int(base[j]) + (int(t) + 1) * int(fingerprint._STEP)) % 2**64], np.uint64))[0]) >> 48
            agree.append(best[1] == found[k])
    assert np.mean(agree) > 0.98  # single precision there


def test_very_long_text(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "a b"), (3, long)], "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert out[1].fingerprint == out[3].fingerprint and out[1].n_chars == len(long) and out[1].near_next < 0.2
    assert out[1].edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 2] + "a b").encode()).hexdigest()
