import hashlib
import os
import random
import re
import uuid

import pytest

from voxloom.llm import secrets

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def naive(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    bits = ["token", "ToKen ", "passwd", "PASSWORD", "api_key", "apikey", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc", "abc123", "ABCDEF0123456789abcd", "AKIA", "ZZ99" * 5, "0f" * 11, "deadbeef", "é", "𓀀", "\n", "", "-_./+"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == naive(text), text


def test_rows(spark):
    key = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    texts = [None, "", "plain words and an internationalization_of_things here", f'é token = "{"0f" * 20}" and {key}.', "Password:hunter22 " * 3, "z" * 100_000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_assign int")
    out = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        base = naive(t or "")
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert out[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
    at = texts[3].index(key)
    assert out[3].spans.endswith(f"markov:{at}:{at + len(key)}") and out[2].spans == ""
    clean = {r.doc_id: r.text for r in secrets.masked(docs).collect()}
    assert key not in clean[3] and "0f0f" not in clean[3] and clean[2] == texts[2] and clean[0] is None
    assert secrets.scan(docs.limit(0)).count() == 0


def test_long_runs_and_what_patterns_leave_of_a_run():
    rng = random.Random(5)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda n: "".join(rng.choice(mixed) for _ in range(n))
    words = ["plain", "words", "of", "ordinary", "names", "and", "things", "Here", "internationalization"]
    model = secrets.Markov([drawn(40) for _ in range(500)], words * 50)
    for n in (512, 513, 1600):
        assert secrets.spans_of(f"key {drawn(n)} end", model, 0.4) == [(4, 3, 4 + n)]
    tail = "Z" + drawn(39)
    assert secrets.spans_of("0f1e" * 6 + tail, model, 0.4) == [(0, 2, 24), (24, 3, 64)]
    assert secrets.spans_of("_".join(words * 60), model, 0.4) == []
    path = "_".join(words * 30)
    (a, kind, b), = secrets.spans_of(path + drawn(1600), model, 0.4)
    assert kind == 3 and abs(a - len(path)) < 16 and b == len(path) + 1600


def plain_spans(text, model, threshold, change=secrets.CHANGE):
    """All spans, run by run: the best choice of random stretches, tried from each start to each end."""
    base = naive(text)
    taken = sorted([(a, b) for a, _, b in base] + [m.span() for m in secrets.UUID.finditer(text)])
    added = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        at, free = m.start(), []
        for a, b in [s for s in taken if s[0] < m.end() and s[1] > m.start()] + [(m.end(), m.end())]:
            if a - at >= secrets.SHORTEST:
                free.append((at, a))
            at = max(at, b)
        for a, b in free:
            part = text[a:b]
            scores = [float(model.ratio[ord(p) if p else 0, ord(c)]) - threshold for p, c in zip(["", *part], part, strict=False)]
            n, sums = len(part), [0.0]
            for x in scores:
                sums.append(sums[-1] + x)
            best = [(0.0, ())] * (n + 1)  # of the first i characters, ending in the ordinary state
            whole = (0.0, ())
            for i in range(1, n + 1):
                ways = [best[i - 1]]
                for j in range(i):
                    value = best[j][0] + sums[i] - sums[j] - change * (j > 0)
                    if i < n:
                        ways.append((value - change, (*best[j][1], (j, i))))
                    elif value > whole[0]:
                        whole = (value, (*best[j][1], (j, i)))
                best[i] = max(ways, key=lambda w: w[0])
            chosen = max(best[n], whole, key=lambda w: w[0])[1]
            for x, y in chosen:
                s = part[x:y]
                if y - x >= secrets.SHORTEST and any(map(str.isupper, s)) + any(map(str.islower, s)) + any(map(str.isdigit, s)) >= 2:
                    added.append((a + x, 3, a + y))
    return sorted(base + added)


def test_all_spans_equal_a_plain_version():
    rng = random.Random(8)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda n: "".join(rng.choice(mixed) for _ in range(n))
    words = ["plain", "words", "of", "ordinary", "names", "internationalization", "and"]
    model = secrets.Markov([drawn(40) for _ in range(300)], words * 40)
    for _ in range(400):
        bits = [rng.choice([rng.choice(words), drawn(rng.choice([8, 20, 60, 120])), "0f" * rng.randint(5, 30), "token=", "AKIA" + "Z9" * 9, "é", "_", "/"]) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 8))]
        text = "".join(bits)
        assert secrets.spans_of(text, model, 0.5) == plain_spans(text, model, 0.5), text


def test_words_of_long_documents_are_all_learned_from(spark):
    """The sample's words aren't cut: words that sort last in a document of thousands count too."""
    text = " ".join(f"aa{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{'xyz'[k % 3]}" for k in range(3000)) + " zqzqzqzqzqzq"
    model = secrets.fit(spark.createDataFrame([(1, text), (None, "x"), (2, None)], "doc_id long, text string"))
    bare = secrets.fit(spark.createDataFrame([(1, text.removesuffix(" zqzqzqzqzqzq"))], "doc_id long, text string"))
    assert model.ratio[ord("z"), ord("q")] < bare.ratio[ord("z"), ord("q")]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("size", [40, 100, 200, 400, 600, 2000])
def test_keys_are_found_in_runs_of_any_length(model, size):
    rng = random.Random(size)
    words = ["home", "user", "project", "source", "main", "resources", "config", "data", "service", "application", "build", "release"]
    found = most = exact = 0
    for _ in range(50):
        key, path = "".join(rng.choice(LETTERS) for _ in range(40)), ""
        while len(path) < size - 40:
            path += rng.choice(words) + "/"
        at = rng.choice([k for k, c in enumerate(path) if c == "/"] or [-1]) + 1
        spans = [s for s in secrets.spans_of(f"see {path[:at]}{key}/{path[at:]}", model) if s[1] == 3]
        a, b = 4 + at, 44 + at
        hit = max([max(0, min(b, y) - max(a, x)) for x, _, y in spans], default=0)
        found += hit >= 24
        most += hit >= 36
        exact += len(spans) == 1 and abs(spans[0][0] - a) <= 6 and abs(spans[0][2] - b) <= 6
    assert found == 50 and most >= 48 and exact >= 34


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_names_of_things_are_no_secrets(model):
    rng = random.Random(9)
    plain = [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(200)]
    plain += [f"user_{u}/file" for u in plain[:50]] + [u.upper() for u in plain[:50]]
    words = ["get", "User", "Account", "internationalization", "list", "Config", "service", "Handler", "response", "Manager", "of", "things"]
    assert [t for t in plain if secrets.spans_of(t, model)] == []
    names = [rng.choice(["_", "", "-", "/"]).join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(1000)]
    assert sum(bool(secrets.spans_of(t, model)) for t in names) <= 5


def test_a_null_id_is_kept(spark):
    out = secrets.scan(spark.createDataFrame([(None, "token=abcdef1"), (None, None)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_assign) for r in out.collect()) == [(None, 0), (None, 1)]
