"""Ranked search, whitening and secret scans against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from abacusloom.llm import search, secrets, whitening
from abacusloom.llm.common import table

ODD = "doc_id long, text string, item_id string, id long, score double, rank int, spans string, x int, whitened double, deviation string, n_chars long"
LONG = "word number one and then another " * 4_000


def odd(spark):
    texts = [None, "", " \t\n ", "One two", "one  TWO", "one two three", LONG, LONG, "12 34 !!", "é中文 \U0001f600 x ÀB", "two\x00one", None]
    rows = [(i, t, "clash", 7, 1.0, 5, "s", 3, 2.0, "d", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (3, "One two", *[None] * 9), (None, "one two", *[None] * 9)], ODD)


# --- ranked search


def ranked(docs, items, k=10):
    """Exhaustive search as the contract words it."""
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    of = [(i, Counter(words(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in of), sum(sum(c.values()) for _, c in of)
    df = Counter(t for _, c in of for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in of:
            n = sum(c.values())
            m = 100 - 75 + 75 * n * big_n // big_l if n else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(docs, items, **kw):
    df = search.search(docs, items, **kw)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return [tuple(r) for r in df.orderBy("item_id", "rank", "doc_id").collect()]


def test_search_against_exhaustive_search(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = found(docs.repartition(5), items)
    assert sorted(got) == sorted(want) and len(got) >= 100
    assert sorted(found(docs, items, k=3)) == sorted(r for r in want if r[1] <= 3)


def test_search_skips_without_loss():
    """Random shards of every mix of long and short lists, small windows and few scores, so that many are equal."""
    rnd = np.random.Generator(np.random.PCG64(4))
    skipped = 0
    for _ in range(300):
        size, terms = int(rnd.integers(1, 300)), int(rnd.integers(1, 9))
        lists = [np.flatnonzero(rnd.random(size) < p) for p in rnd.choice([0.01, 0.05, 0.2, 0.5, 1.0], terms)]
        lists = [x if len(x) else np.array([0]) for x in lists]
        impact = [rnd.integers(1, 4, len(x)) for x in lists]
        query = {bytes([65 + i]): int(rnd.integers(0, 4)) for i in range(terms)}
        shard = search.Lists(None, size, {bytes([65 + i]): i for i in range(terms)}, np.cumsum([len(x) for x in lists]), np.concatenate(lists).astype(np.int32), np.concatenate(impact))
        score = np.zeros(size, np.int64)
        for x, y, w in zip(lists, impact, query.values(), strict=True):
            score[x] += y * w
        k = int(rnd.integers(1, 12))
        order = [i for i in np.lexsort((np.arange(size), -score)) if score[i] > 0][:k]
        least = int(score[order[-1]]) if len(order) == k and rnd.random() < 0.5 else 0
        best = search.best_of_shard(shard, query, k, least, window=int(rnd.choice([1, 7, 64])), long_share=int(rnd.choice([1, 4, 50])))
        assert list(zip(best.scores, best.places, strict=True)) == [(score[i], i) for i in order]
        skipped += least > 0
    assert skipped > 20


def test_search_in_small_shards_and_blocks(spark, sf_dir, monkeypatch):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").limit(12)
    whole = found(docs, items)
    monkeypatch.setattr(search, "QUERY_BYTES", 900)
    monkeypatch.setattr(search, "SHARD_DOCS", 9)
    assert found(docs.repartition(3), items) == whole


def test_search_odd_rows(spark):
    docs = odd(spark)
    items = spark.createDataFrame([(1, "one", 3), (1, "one", 4), (2, "ONE two one", 0), (3, None, 0), (4, "", 0), (5, "absent", 0), (6, "é x 中文", 0), (6, "àb ÀB", 0), (None, "three", 0)], "item_id long, text string, rank int")
    want = ranked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], k=4)
    got = found(docs, items, k=4)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[2] is None for r in found(docs, items)) and {r[0] for r in got} == {1, 2, 6, None}
    none = docs.filter("false")
    assert not found(none, items) and not found(docs, items.filter("false")) and not found(docs.filter("trim(text) = ''"), items)


def test_statistics_of_a_whole_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    of = [search.terms_of(r[0]) for r in docs.select("text").collect()]
    asked = frozenset(sorted({t for x in of for t in x})[::50])
    got = search.statistics(search.index(docs), asked)
    assert got == (sum(map(bool, of)), sum(map(len, of)), {t: n for t, n in Counter(t for x in of for t in set(x)).items() if t in asked})


# --- whitening


def whitened(rows, k=16):
    """By an eigensolver of the whole covariance; rows are (id, entries)."""
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    lists = sorted({tuple(v) for _, v in x})
    n, sums = len(lists), [sum(c) for c in zip(*lists, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    y = np.array([[float(c - m) for c, m in zip(v, mean, strict=True)] for v in lists])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x:
        z = np.array([float(c - m) for c, m in zip(v, mean, strict=True)])
        out[i] = (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), z @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum())
    return n, out


def test_whitening_against_an_eigensolver(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    n, want = whitened(rows)
    got = whitening.op12_embedding_whitening(spark, sf_dir).collect()
    assert len(got) == 16 * len(rows)
    of = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]][0] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(want[r["vec_id"]][2][r["component"] - 1], rel=1e-9)
        of[r["vec_id"], r["component"]] = r["whitened"]
    for c in range(1, 17):
        mine, theirs = np.array([of[i, c] for i, _ in rows]), np.array([want[i][1][c - 1] for i, _ in rows])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7


def test_factor_and_rotations():
    rnd = np.random.Generator(np.random.PCG64(1))
    for d, rank in ((1, 1), (2, 2), (7, 7), (7, 3), (33, 33), (64, 20)):
        a = rnd.normal(size=(d, rank)) * 10.0 ** rnd.uniform(-3, 3, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, rtol=1e-9, atol=1e-9 * v.max())
        e, u = whitening.jacobi(factor)
        assert (np.diff(e) <= 0).all() and np.allclose(u.T @ u, np.eye(rank), atol=1e-12)
        assert np.allclose(u * e @ u.T, v, atol=1e-12 * v.max())
    e, _ = whitening.jacobi(np.diag([1e-9, 1.0, 1e5])[:, ::-1])
    assert e == pytest.approx([1e10, 1.0, 1e-18], rel=1e-12)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_products_are_exact():
    for most in (3, 10**6, 10**8, 10**14):
        z = np.random.Generator(np.random.PCG64(most)).integers(-most, most, (37, 5))
        assert whitening.gram(z).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in z.T] for p in z.T]


def test_whitening_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, x string, id int, n string, whitened int, deviation int, label int"
    nan, inf = float("nan"), float("inf")
    rnd = random.Random(2)
    good = [[rnd.gauss(0, 1), rnd.gauss(5, 2), 3.0, rnd.gauss(-1000, 0.5)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(100, good[0]), (7, good[1]), (None, good[2])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [nan, 1.0, 1.0, 1.0]), (204, [inf, 1.0, 1.0, 1.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "c", 1, "n", 2, 3, 4) for i, v in rows + bad], kind)
    singles = [(i, [np.float32(c) for c in v]) for i, v in enumerate(good)]
    n, want = whitened(singles, 3)
    found, model, error = whitening.whiten(df)
    got = found.collect()
    assert (model.n, n, len(got), len(model.eigen)) == (40, 40, 43, 3) and error < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in got if r["vec_id"] in want and r["vec_id"] != 7} == {i: w[0] for i, w in want.items() if i != 7}
    mine = {r["vec_id"]: r["whitened"] for r in got}
    for c in range(3):
        pairs = np.array([(mine[i][c], want[i][1][c]) for i in want if i != 7])
        assert min(np.abs(pairs[:, 0] - pairs[:, 1]).max(), np.abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-8
    for few in (df.filter("false"), df.filter("vec_id >= 200 and vec_id < 205")):
        found, model, error = whitening.whiten(few)
        assert found.count() == 0 and model.n == 0 and error == 0
    found, model, error = whitening.whiten(df.filter("vec_id = 100"))
    assert [(r["vec_id"], r["deviation"], r["whitened"]) for r in found.collect()] == [(100, 0, [])]
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(huge)[0].filter("deviation IS NULL").count() == 2


# --- secrets


def test_secrets_against_the_contract(spark, sf_dir):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rnd = random.Random(6)
    planted = [r'token = "{}"', "API_KEY:{}", "passwd='{}", " {} ", "secret=token={}", "apikey  =  {0} password: x token={1}", "é{}é"]
    values = [lambda: f"{rnd.getrandbits(160):040x}", lambda: "AKIA" + f"{rnd.getrandbits(80):020X}"[: rnd.randrange(12, 20)], lambda: "hunter2"[: rnd.randrange(4, 8)], lambda: f"{rnd.getrandbits(200):x}"]
    some = [(i + 10_000, "\n".join(f"{t[j::7][:40]} {rnd.choice(planted).format(rnd.choice(values)(), rnd.choice(values)())}" for j in range(5))) for i, t in docs.filter("text IS NOT NULL").limit(150).collect()]
    docs = docs.unionByName(spark.createDataFrame(some, "doc_id long, text string"))
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    hits = 0
    for r in secrets.report(secrets.find_secrets(docs)).collect():
        t = texts.pop(r["doc_id"])
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(k for _, k, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds[0], kinds[1], kinds[2])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("random")) == said
        hits += len(base)
    assert not texts and hits > 400


def scan(text):
    encoding = secrets.encoding_of(public_tokenizers.path(secrets.VOCABULARY))
    return [(k, text[a:b]) for k, a, b in secrets.spans_of(text, encoding)]


def test_base_spans():
    assert scan("Password: hunter22 x") == [("assign", "Password: hunter22")]
    assert scan("secret: token: abcdefgh") == []  # the first match takes "secret: token" and is too short
    assert scan("api_key='abcdef' APIKEY=\"12345\" ſecret=abcdefgh") == [("assign", "api_key='abcdef")]
    assert scan("é\U0001f600 AKIA" + "Z" * 16 + " AKIA" + "Z" * 15) == [("access", "AKIA" + "Z" * 16)]
    assert scan("g" + "0123456789abcdef" * 2 + "g " + "a" * 23) == [("hex", "0123456789abcdef" * 2)]


def test_random_strings_and_what_is_known():
    rnd = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(rnd.choices(letters, k=rnd.randrange(20, 60))) for _ in range(500)]
    assert np.mean([scan(f"before {s} after") == [("random", s)] for s in strings]) > 0.97
    strings = ["".join(rnd.choices(letters + "+/", k=40)) for _ in range(200)]
    assert np.mean([scan(f'"{s}"') == [("random", s)] for s in strings]) > 0.97
    clean = [
        "getUserAccountById2AndReturnResult", "AbstractSingletonProxyFactoryBean2", "windows10professional64bit", "covid19vaccination2021campaign", "https://example.com/en/articles/2024/05/17/some-long-title",
        "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "md5: Q6ehzYyfJrGDPDL6BXdfHw5ZtZIXKFsjd2VLRn7QWxY",
        "2024-01-15_2024-02-15_2024-03-15", "12345678901234567890123", "this_is_a_very_long_identifier_name_with_words", "Donaudampfschifffahrtsgesellschaft", "=" * 80, "_" * 40 + "-" * 40,
    ]
    assert [s for s in clean if scan(f"see {s} here")] == []


def test_prose_is_left_alone(spark, sf_dir):
    found = secrets.op13_secret_scan(spark, sf_dir)
    assert found.filter("n_random > 0").count() == 0 and found.count() == table(spark, sf_dir, "documents").count()


def test_secrets_odd_rows(spark):
    key = "AKIA" + "Q" * 16
    docs = odd(spark).unionByName(spark.createDataFrame([(50, LONG + key, *[None] * 9), (50, key, *[None] * 9)], ODD))
    got = secrets.find_secrets(docs)
    assert got.columns == ["doc_id", "spans"] and got.count() == docs.count()
    rows = sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got.filter(F.size("spans") > 0).collect())
    assert rows == [(50, [("access", 0, 20)]), (50, [("access", len(LONG), len(LONG) + 20)])]
    assert secrets.find_secrets(docs.filter("false")).count() == 0
