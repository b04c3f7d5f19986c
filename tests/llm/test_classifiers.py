import random
import zlib

import numpy as np

from voxloom.llm import langid, quality

SYLLABLES = {"xx": ["tha", "ing", "ou", "re"], "yy": ["zei", "kö", "sch", "ung"], "zz": ["ción", "os", "ña", "lla"]}


def made(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        yield i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(2, 60))), lang


def test_held_out_accuracy_of_languages(spark):
    rows = [*made(400, 1), (900, None, "xx"), (901, "123 !!", "yy"), (902, "", None), (902, "", None)]
    out = langid.identify(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string, lang_pred string")).collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in rows[:400]}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id >= 900)
    assert all(0 <= r.score <= 1 for r in out)


def test_matrix_form_equals_the_kernel_form():
    rows = list(made(60, 2))
    found = [langid.presence(t) for _, t, _ in rows]
    names, matrix = langid.train(found, [x for *_, x in rows], landmarks=1000, ridge=1e-3)
    sets = [set(f.tolist()) for f in found]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(langid._dense(found, langid.BITS) @ langid._dense(found, langid.BITS).T, kernel, atol=1e-5)
    decided = langid._dense(found, langid.BITS) @ matrix[:-1] + matrix[-1]
    assert [names[k] for k in decided.argmax(1)] == [x for *_, x in rows]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.classify(docs, labels).collect()] == [(0.5, 0)]


def test_held_out_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i, t, _ in made(400, 3):
        bad = i % 4 == 0
        rows.append((i, (t.upper().replace(" ", "!! ") if i % 8 else " ".join([rng.choice(t.split())] * 40)) if bad else t))
        labels.append((i, int(not bad)))
    rows += [(None, None), (5000, "")]
    labels += [(None, 1), (7, None), (123456, 1)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), per_class=120).collect()
    assert len(out) == len(rows)
    truth = dict(labels[:400])
    held = [r for r in out if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.95
