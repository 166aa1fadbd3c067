"""Each training-data operator against a brute-force version, a round trip or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from abacusloom.llm import bpe, exact_dedup, fingerprints, language_id, license_scan, line_dedup, linking, near_dedup, packing, quality, url_filter
from abacusloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, score double, kept boolean, w int"
LONG = "word number one and then another " * 4_000


def odd(spark):
    texts = [None, "", " \t\n ", "One two", "One  two", "one two", LONG, LONG, "12 34 !!", "é中文 \U0001f600 x", "a  b \n c", None]
    rows = [(i, t, None if i % 2 else "en", None, None, "clash", 2.0, None, 1) for i, t in enumerate(texts)]
    rows += [(3, "One two", "en", "s", 1, None, None, True, None), (None, "no key here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def texts_of(df):
    return {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}


def test_fingerprints_and_edited_texts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = texts_of(docs)
    rows = {r["doc_id"]: r for r in fingerprints.with_edited(docs, rows=17).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for at, i in enumerate(ids):
        own, following = texts[i], texts[ids[(at + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = rows[i]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(own)
        assert r["edited_fingerprint"] == fingerprints.fingerprint(edited)
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(fingerprints.fingerprint(own), fingerprints.fingerprint(edited)))
        assert r["near_next"] == pytest.approx(fingerprints.likeness(fingerprints.fingerprint(own), fingerprints.fingerprint(following)))
    closer = np.mean([r["near_edited"] > r["near_next"] for r in rows.values() if r["n_chars"] > 20 and r["near_next"] < 1])
    assert closer > 0.97


def test_walk_matches_step_by_step_definition():
    states = fingerprints._walk()[0]
    text = "A text of some length, with é and 中."
    walk = fingerprints.START.then(text)
    phase, step, leaves = 0, 0, []
    for k in walk.kinds:
        stay = 0
        after = states[phase][int(k)][256]
        stay = (after - phase) % fingerprints.PERIOD or fingerprints.PERIOD
        step, phase = step + stay, after
        leaves.append(step)
    assert walk.leaves.tolist() == leaves
    assert walk.first(10).then(text[10:]).fingerprint() == walk.fingerprint()
    assert fingerprints.likeness("0-", "0-") == 1.0 and fingerprints.likeness("0-", walk.fingerprint()) == 0.0


def test_fingerprints_against_a_walk_of_single_steps(spark, sf_dir):
    moves = np.random.Generator(np.random.PCG64(fingerprints.SEED)).integers(0, 2, (256, fingerprints.PERIOD)).astype(bool)
    moves[:, 0] = True  # the walk can't stay on a character for ever
    _, symbols, samples, _ = fingerprints._walk()

    def walked(text):
        step, seen = 0, []
        for c in text:
            code = ord(c)
            kind = (code ^ code >> 8 ^ code >> 16) & 255
            while True:
                seen.append(kind)
                step += 1
                if moves[kind][(step - 1) % fingerprints.PERIOD]:
                    break
        return f"{step:x}-" + "".join(chr(symbols[seen[j]]) for j in samples if j < step) if text else "0-"

    rows = fingerprints.with_edited(documents(spark, sf_dir)).select("doc_id", "fingerprint").collect()
    texts = texts_of(documents(spark, sf_dir))
    assert all(r["fingerprint"] == walked(texts[r["doc_id"]]) for r in rows if len(texts[r["doc_id"]]) < 4_000)


def test_fingerprint_bands_against_all_pairs(spark, sf_dir):
    rnd = random.Random(9)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    changed = []
    for i, t in sorted(texts_of(docs).items()):
        for n, size in enumerate((15, 40, 100, 250, len(t))):
            x = list(t[:size])
            if len(x) > 10:
                changed.append((1_000 * (2 * n + 1) + i, "".join(x)))
                x[rnd.randrange(len(x))] = "q"
                changed.append((1_000 * (2 * n + 2) + i, "".join(x)))
    docs = docs.unionByName(spark.createDataFrame(changed, "doc_id long, text string"))
    prints = {i: fingerprints.fingerprint(t) for i, t in texts_of(docs).items()}
    ids = sorted(prints)
    length = {i: int(p.split("-")[0], 16) for i, p in prints.items()}
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 0.75 * length[a] <= length[b] <= length[a] / 0.75 and fingerprints.likeness(prints[a], prints[b]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(docs).collect()}
    assert len(near) > 300 and np.mean([got[a] == got[b] for a, b in near]) > 0.995


def test_fingerprint_classes(spark):
    rnd = random.Random(5)
    base = [" ".join("".join(rnd.choices("etaoinshr", k=rnd.randrange(2, 9))) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:-1] + "q") for i, t in enumerate(base)] + [(20, base[0])]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 + i] == got[i] == i for i in range(6)) and got[20] == 0


def chance_texts(n, seed, letters="ab", sizes=(300, 500)):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randrange(*sizes))) for _ in range(n)]


def test_pairs_that_share_bands_by_chance_are_not_written(spark, monkeypatch):
    """Texts of two letters share bands, all with all, and none is near another: their pairs must not go to disk."""
    texts = chance_texts(100, 3)
    assert sum(bool(fingerprints.band_hits(fingerprints.fingerprint(texts[0]), fingerprints.fingerprint(t))) for t in texts) > 50
    written, keep = [], linking.materialise
    monkeypatch.setattr(linking, "materialise", lambda df: (written.append(out := keep(df)), out)[1])
    rows = spark.createDataFrame(list(enumerate([*texts, texts[0][:-1] + "q"])), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(rows).collect()}
    assert got == {i: i % 100 for i in range(101)}
    assert sum(df.count() for df in written if {"a", "b"} <= set(df.columns)) < 100


@pytest.mark.parametrize("block", [4, linking.BLOCK])
def test_fingerprint_classes_are_those_of_all_pairs_that_share_a_band(spark, sf_dir, monkeypatch, block):
    rnd = random.Random(11)
    texts = [t for _, t in sorted(texts_of(documents(spark, sf_dir)).items())][:60] + chance_texts(20, 4, sizes=(4, 700))
    for t in list(texts):
        for size in (12, 64, 130, 600, 3_000):
            x = list(t[:size])
            texts += [t[:size], t[: int(size * rnd.uniform(0.85, 1))]]
            for _ in range(rnd.choice((1, 2, 4)) if x else 0):
                x[rnd.randrange(len(x))] = rnd.choice("qxz ")
            texts.append("".join(x))
    texts = list(dict.fromkeys(texts))
    prints = [fingerprints.fingerprint(t) for t in texts]
    keys, lengths = [set(fingerprints.bands(p)) for p in prints], [int(p.split("-")[0], 16) for p in prints]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = []
    for b in range(len(texts)):
        for a in range(b):
            if keys[a] & keys[b] and fingerprints.likeness(prints[a], prints[b]) >= 0.8:
                linked.append((a, b))
                x, y = sorted((find(a), find(b)))
                root[y] = x
    across = sum(lengths[a].bit_length() != lengths[b].bit_length() for a, b in linked)
    assert len(linked) > 200 and across > 20
    pairs = spark.createDataFrame([(prints[a], prints[b]) for a, b in linked], "x string, y string")
    x, y = (fingerprints.marked_bands_of(c) for c in ("x", "y"))
    marks = pairs.select(x.alias("x"), y.alias("y"))
    assert marks.filter(fingerprints.may_be_like(F.col("x"), F.col("y"), 0.8) & fingerprints.may_be_like(F.col("y"), F.col("x"), 0.8)).count() == len(linked)
    monkeypatch.setattr(linking, "BLOCK", block)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_exact_dedup_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).unionByName(documents(spark, sf_dir).limit(30).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.regexp_replace("text", " ", " \t ")}))
    groups = defaultdict(list)
    for i, t in texts_of(docs).items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == want


def test_large_filter_moves_hashes_alone(spark, sf_dir, monkeypatch):
    """Beyond the bound of a broadcast the filter meets hashes without the rows' other columns, and rows that can't repeat stay where they are."""
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", 0)
    docs = exact_dedup.with_keys(documents(spark, sf_dir).withColumn("row", F.struct("text", "source")))
    written = []
    keep = exact_dedup.materialise
    monkeypatch.setattr(exact_dedup, "materialise", lambda df: (written.append(df), keep(df))[1])
    marked, again = exact_dedup._marked(docs)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert exchanges and written[0].columns == ["hash"] and "text_sha256" not in "".join(exchanges) and "row#" not in "".join(exchanges)
    assert "hashpartitioning" not in marked._jdf.queryExecution().optimizedPlan().toString().replace("REPARTITION", "")
    doubtful, copies = marked.filter(again).count(), docs.groupBy("hash").count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    assert copies <= doubtful <= copies + 0.05 * docs.count()


def test_exact_dedup_keeps_one_of_rows_that_repeat(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a  b"), (2, "a b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (5, "e")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and Counter(r["keep_id"] for r in got if r["kept"]) == Counter([1, 3, None, 5])


def test_exact_dedup_survives_a_full_filter(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BLOCKS", 1)
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 64)
    docs = documents(spark, sf_dir)
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == docs.select(exact_dedup.normalised().alias("t")).distinct().count()


def words_of(text):
    return (text or "").lower().split()


def similarity(a, b):
    def bag(t):
        w = words_of(t)
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else float(words_of(a) == words_of(b))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_dedup_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = texts_of(docs)
    ids = sorted(texts)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similarity(texts[a], texts[b]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == components(ids, links)


def test_near_dedup_links_a_large_group(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join([*base[: (j := rnd.randrange(120))], f"x{i}", *base[j + 1 :]])) for i in range(400)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["class_size"] for r in got} == {400} and sum(r["kept"] for r in got) == 1


def test_near_dedup_settles_a_bucket_of_many_clusters(spark, monkeypatch):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, rows, want = words(120), [], {}
    for cluster in range(40):
        own = words(80)
        for copy in range(3):
            i = cluster + 40 * copy
            rows.append((i, " ".join([*passage, *own[: 20 + copy], f"x{i}", *own[21 + copy :]])))
            want[i] = cluster
    sketch = near_dedup.sketch
    monkeypatch.setattr(near_dedup, "sketch", lambda *a: sketch(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(linking, "BLOCK", 16)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_all_pairs_settle_a_crowded_bucket(spark):
    rows = spark.createDataFrame([(i, f"{i % 30}-{i}") for i in range(90)], "id long, content string")
    near = lambda pairs, groups: pairs.filter("a % 30 = b % 30")
    got = {r["id"]: (r["class_id"], r["class_size"]) for r in linking.link_by_bands(rows, F.array(F.lit("one")), near).collect()}
    assert got == {i: (i % 30, 3) for i in range(90)}


def test_dart_agreement_estimates_weighted_similarity():
    a = " ".join(f"a{i % 70}" for i in range(200))
    b = " ".join(f"a{i % 70}" for i in range(140)) + " " + " ".join(f"b{i}" for i in range(30))
    sets = [near_dedup.elements(near_dedup.word_hashes(t.encode())) for t in (a, b)]
    agree = []
    for seed in range(60):
        x, y = near_dedup.signatures([near_dedup.mix(s + np.uint64(seed)) for s in sets])
        agree.append((x == y).mean())
    assert np.mean(agree) == pytest.approx(similarity(a, b), abs=0.03)


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    data = ("some words  and\nmore words " * 300).encode()
    whole = near_dedup.word_hashes(data)
    monkeypatch.setattr(near_dedup, "PART_BYTES", 100)
    assert (near_dedup.word_hashes(data) == whole).all() and len(whole) == len(data.split())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = dict(map(tuple, linking.connected_components(edges).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_packing_keeps_every_id_once(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = documents(spark, sf_dir).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id is not null and doc_id > 3").withColumn("doc_id", F.col("doc_id") + 50_000))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts_of(docs).items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs).collect():
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for parts, total in [(p, len(want[i])) for i, p in pieces.items()]:
        assert gapless(parts) == total
    lengths = [gapless(s) for s in sequences.values()]
    assert all(n == 2048 or n & (n - 1) == 0 and n < 2048 for n in lengths)


def gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


def test_hilbert_key_visits_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    grid = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    keys = packing.hilbert_key(grid)
    assert sorted(keys) == list(range(8**3))
    path = grid[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_language_id_on_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = language_id.op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_size(data, content):
    import zstandard

    from abacusloom.llm import compression

    settings = zstandard.ZstdCompressionParameters.from_level(compression.LEVEL, min_match=compression.SHORTEST, write_content_size=0, write_checksum=0, write_dict_id=0)
    size = lambda b, d: len(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress(b))
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return sum(size(data[i : i + compression.BLOCK], held) - size(b"", None) for i in range(0, len(data), compression.BLOCK))


def test_language_id_against_plain_compression(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs)
    for r in language_id.identify(docs, model).limit(60).collect():
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["lang_pred"] == "und" and r["rejected"]
            continue
        data = " ".join(re.split(r"[\W\d_]+", r["text"].lower())).encode()
        found = sorted((plain_size(data, d), k) for k, d in model.dictionaries.items())
        assert r["lang_pred"] == found[0][1] and r["margin"] == pytest.approx((found[1][0] - found[0][0]) / found[1][0])


def test_language_id_rejects_ties_and_what_it_never_learnt(spark):
    rnd = random.Random(3)
    words = {k: ["".join(rnd.choices(letters, k=rnd.randrange(3, 9))) for _ in range(300)] for k, letters in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    text = lambda k, n=120: " ".join(rnd.choices(words[k], k=n))
    rows = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    asked = [(0, text("aa")), (1, text("bb")), (2, text("cc")), (3, "xyz vwx"), (4, "..."), (5, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {0: ("aa", False), 1: ("bb", False), 2: (got[2][0], True), 3: ("aa", True), 4: ("und", True), 5: ("und", True)}
    assert language_id.identify(labelled, model).filter("rejected").count() <= 0.02 * len(rows)


def test_quality_against_plain_compression(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    for r in quality.judge(docs, model).limit(40).collect():
        raw = (r["text"] or "").encode()
        a, b = plain_size(raw, model.good), plain_size(raw, model.bad)
        d = (b - a) / (a + b) if a + b else 0.0
        x = np.dot([1.0, d * 10, d * min(1.0, len(raw) / 400) * 10, (min(1.0, a / len(raw)) if raw else 0.5) * 4], model.weights)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(x, -30, 30))), abs=1e-9) and r["predicted"] == (r["score"] >= 0.3)


def test_quality_on_held_out_labels(spark, sf_dir):
    rows = quality.op7_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([r["predicted"] for r in good]) > 0.95
    assert np.mean([g["score"] > b["score"] for g in good for b in bad]) > 0.95


def test_bpe_equals_tiktoken(spark, sf_dir):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = bpe.encode(docs.withColumn("doc_id", F.col("doc_id").cast("string")), key="doc_id").join(docs.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("doc_id").agg(F.collect_set(F.coalesce("text", F.lit(""))).alias("texts")), "doc_id").collect()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() in [encoding.encode_ordinary(t) for t in r["texts"]]
    back = bpe.decode(bpe.encode(docs)).groupBy(F.col("decoded").cast("string").alias("t")).count().collect()
    assert Counter({r[0]: r[1] for r in back}) == Counter(r[1] or "" for r in docs.collect())


def test_bpe_on_random_strings():
    import tiktoken

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\t'sé1!中 _\u00a0\u2028") for _ in range(rnd.randrange(40))) for _ in range(3_000)]
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.Replay(ranks, public_tokenizers.PATTERN).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encoding.encode_ordinary(t) for t in texts]


def brute_licenses(text):
    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, w

    found = set()
    for name, template in license_scan.TEMPLATES.items():
        wanted, _ = shingles(template)
        _, w = shingles(text)
        spread = 2 * len(wanted) + 4
        for i in range(max(1, len(w) - spread + 1)):
            part = {tuple(w[j : j + 5]) for j in range(i, min(len(w) - 4, i + spread - 4))}
            if len(part & wanted) >= 0.8 * len(wanted):
                found.add(name)
                break
    return found


def test_license_scan_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = [(90_000 + i, f"foo bar baz qux, {t} And more text follows here.") for i, t in enumerate(license_scan.TEMPLATES.values())]
    rows += [(91_000, "Permission is hereby granted"), (91_001, "x " * 500 + license_scan.TEMPLATES["BSD-redistribution"].replace("source", "sauce").upper())]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {(i, name) for i, t in texts_of(docs).items() for name in brute_licenses(t)}
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert got == want and len(want) > len(rows)


def test_url_rules_and_method(spark, sf_dir):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y=/de/", "https://example.net/fr", "x://example.com/de/", "http://sub.example.com/de", "http://org/fr/", "http://x.org?/fr/", "http://notexample.net/en/", "http://Éx.org/fr/#a"]
    rows = url_filter.with_rule(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/fr", "net/"), ("example.com", "/de/", "example.com/de/"),
        ("sub.example.com", "/de", None), ("org", "/fr/", "org/fr/"), ("x.org", "", None), ("notexample.net", "/en/", "net/"), ("Éx.org", "/fr/", "org/fr/"),
    ]


def test_url_ratio_against_brute_force(spark):
    rnd = random.Random(4)
    urls = [("http://good.site/" + "".join(rnd.choices("abc", k=6)), True) for _ in range(60)] + [("http://bad.place/" + "".join(rnd.choices("xyz", k=6)), False) for _ in range(60)]
    labelled = spark.createDataFrame(urls, "url string, accepted boolean")
    model = url_filter.learn(labelled)
    counts = {k: Counter() for k in (True, False)}
    contexts = {k: Counter() for k in (True, False)}
    total = Counter()
    for u, y in urls:
        u += url_filter.END
        total[y] += len(u)
        for i in range(len(u)):
            for n in range(1, url_filter.ORDER + 2):
                if i + n <= len(u):
                    counts[y][u[i : i + n]] += 1
                    contexts[y][u[i : i + n]] += n <= url_filter.ORDER and i + n < len(u)
    kept = {s for s in counts[True] | counts[False] if counts[True][s] + counts[False][s] >= url_filter.LEAST}

    def probability(y, context, c):
        if not context:
            return (counts[y][c] + url_filter.PRIOR / url_filter.ALPHABET) / (total[y] + url_filter.PRIOR) if c in kept else None
        lower = probability(y, context[1:], c)
        if context not in kept:
            return lower
        if context + c not in kept:
            return (1.0 if lower is None else lower) * url_filter.PRIOR / (contexts[y][context] + url_filter.PRIOR)
        return (counts[y][context + c] + url_filter.PRIOR * lower) / (contexts[y][context] + url_filter.PRIOR)

    asked = [u for u, _ in urls[::11]] + ["http://good.place/abx", "ftp://q"]
    rows = url_filter.ratio(spark.createDataFrame([(u,) for u in asked], "url string"), model, "url", ["url"]).collect()
    for r in rows:
        u, want = r["url"] + url_filter.END, 0.0
        for i, c in enumerate(u):
            p = [probability(y, u[max(0, i - url_filter.ORDER) : i], c) for y in (True, False)]
            want += np.log(p[0] / p[1]) if p[0] is not None else 0.0
        assert r["_sum"] == pytest.approx(want, abs=1e-6)


def test_url_model_keeps_its_strings_however_large_the_table(spark, monkeypatch):
    rnd = random.Random(6)
    urls = [(f"http://{rnd.choice(['good', 'fine'])}.site/" + "".join(rnd.choices("abc", k=6)), True) for _ in range(60)]
    urls += [(f"http://bad.place/{rnd.choice(['x', 'y'])}/" + "".join(rnd.choices("xyz", k=6)), False) for _ in range(60)]
    labelled = spark.createDataFrame(urls, "url string, accepted boolean")
    results = []
    for most in (url_filter.MOST_STRINGS, 40):
        monkeypatch.setattr(url_filter, "MOST_STRINGS", most)
        model = url_filter.learn(labelled)
        counts = Counter(w[i : i + n] for u, _ in urls for w in [u + url_filter.END] for i in range(len(w)) for n in range(1, url_filter.ORDER + 2) if i + n <= len(w))
        assert {r["s"] for r in model.collect()} == {s for s, n in counts.items() if n >= url_filter.LEAST}
        results.append({r["url"]: r["_sum"] for r in url_filter.ratio(labelled.select("url").distinct(), model, "url", ["url"]).collect()})
    assert results[0] == pytest.approx(results[1])


def test_url_method_separates_held_back_urls(spark, sf_dir):
    assert url_filter.op2_url_filter(spark, sf_dir).count() == table(spark, sf_dir, "pages").count()
    pages = table(spark, str(Path(sf_dir).parent / "sf0.01"), "pages")  # some hundred URLs that a rule decides
    ruled = url_filter.with_rule(pages.select("page_id", "url")).filter("rule IS NOT NULL").withColumn("accepted", F.col("rule_verdict") == "allow")
    unseen = F.crc32(F.reverse("url")) % 4 == 0
    rows = url_filter.filter_urls(ruled.filter(unseen), ruled.filter(~unseen)).collect()  # neither the models nor the calibration saw these
    good, bad = ([r["ratio"] for r in rows if r["accepted"] == k] for k in (True, False))
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(r["reject_probability"] > 0.5) != r["accepted"] for r in rows]) > 0.9


def brute_lines(texts, min_docs):
    contents = {t for t in texts.values()}
    tokens = lambda line: re.split(r"\s+", line.strip(" "))
    mask = lambda w: "<*>" if re.search("[0-9]", w) else w
    seen = defaultdict(set)
    for t in contents:
        for line in t.split("\n"):
            if line.strip(" "):
                seen[line].add(t)
    leaves = defaultdict(set)
    for line in seen:
        w = tokens(line)
        leaves[len(w), tuple(map(mask, w[:3]))].add(line)
    drop = set()
    for (n, _), lines in leaves.items():
        if len(set().union(*(seen[x] for x in lines))) < min_docs:
            continue
        share = Counter()
        for line in lines:
            for i, w in enumerate(tokens(line)):
                share[i, w] += len(seen[line])
        every = len(set().union(*(seen[x] for x in lines)))
        templates = defaultdict(set)
        for level in line_dedup.LEVELS:
            for line in lines:
                t = tuple(w if share[i, w] >= min_docs and share[i, w] >= level * every and mask(w) == w else "<*>" for i, w in enumerate(tokens(line)))
                if sum(w != "<*>" for w in t) >= n / 2:
                    templates[t].add(line)
        for group in templates.values():
            if len(set().union(*(seen[x] for x in group))) >= min_docs:
                drop |= group
    return {i: "\n".join(x for x in t.split("\n") if x not in drop) for i, t in texts.items()}


def test_line_dedup_against_brute_force(spark, sf_dir):
    rows = [(90_000 + i, f"own line of {i} here\nPage {i} of 40 printed by user{i} today\nlast words q{i}") for i in range(6)]
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["clean_text"] for r in line_dedup.line_dedup(docs).collect()}
    assert got == brute_lines(texts_of(docs), line_dedup.MIN_DOCS)
    assert all("printed" not in got[90_000 + i] for i in range(6))


@pytest.mark.parametrize("names", [4, 40, 400])
def test_line_templates_keep_their_fields_at_any_size(spark, names):
    rnd = random.Random(7)
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(i, f"From the desk of {name(rnd.randrange(names))} in {name(rnd.randrange(names))} city written by hand\nw{name(i)} q{name(i * 7)} z{name(i * 3)} {name(i)}") for i in range(names * 8)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean(["From the desk" not in r["clean_text"] for r in got]) > 0.99 and np.mean([r["n_dropped"] for r in got]) < 1.05


OPERATORS = {
    "fingerprints": fingerprints.with_edited,
    "fingerprint classes": fingerprints.near_classes,
    "exact dedup": exact_dedup.exact_dedup,
    "packing": packing.pack,
    "language ID": lambda d: language_id.identify(d, language_id.learn(d)),
    "near dedup": near_dedup.near_classes,
    "quality": lambda d: quality.judge(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))),
    "license scan": license_scan.scan,
    "bpe": bpe.round_trip,
    "line dedup": line_dedup.line_dedup,
    "urls": lambda d: url_filter.filter_urls(d, d.withColumn("accepted", F.col("doc_id") % 2 == 0), url="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    run = OPERATORS[name]
    rows = odd(spark)
    got = run(rows).collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows.collect()}
    elif name != "license scan":
        assert len(got) == rows.count()
    assert run(empty(spark)).collect() == []


def test_odd_rows_have_their_defined_results(spark):
    rows = odd(spark)
    langs = [(r["text"], r["lang_pred"], r["score"]) for r in OPERATORS["language ID"](rows).collect()]
    assert all(p == "und" and s == 0 for t, p, s in langs if t is None or not re.search("[^\\W\\d_]", t))
    exact = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(rows).collect()}
    assert exact[1] == exact[11] == 0 and exact[2] == 2 and exact[4] == 3 and exact[5] == 5 and exact[7] == 6
    near = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(rows).collect()}
    assert near[1] == near[2] == near[11] == 0 and near[5] == near[4] == 3 and near[7] == 6


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    texts = texts_of(docs)
    assert len(set(texts.values())) == len(texts)
    ids = sorted(texts)
    assert not [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similarity(texts[a], texts[b]) >= 0.8]
    assert docs.count() > 0.6 * documents(spark, sf_dir).count()
    assert {r[0] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == set(ids)


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir):
    import corpus_pipeline

    clash = documents(spark, sf_dir).limit(60).select("doc_id", "text", "lang", F.lit("own").alias("row"), F.lit("own").alias("hash"), F.lit(1.5).alias("score"), F.lit(False).alias("kept"), F.lit("own").alias("place"))
    docs = clash.unionByName(clash).unionByName(odd(spark).select("doc_id", "text", "lang", F.lit("own").alias("row"), F.lit("own").alias("hash"), "score", "kept", F.lit("own").alias("place")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.dtypes == docs.dtypes, name
        rows = kept.collect()
        assert rows and all(r["row"] == r["hash"] == r["place"] == "own" for r in rows), name
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
        docs = spark.createDataFrame(rows, docs.schema)
    assert len({r["text"] for r in docs.collect()}) == docs.count()
    assert corpus_pipeline.packed(spark, docs.limit(0), sf_dir).collect() == []


def test_pairs_of_ids_beyond_20_bits():
    """Ids as large as a vocabulary of many languages has them: pairs that agreed in their last bits were taken for one another."""
    high = 1 << 20
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": high, b"c" + b"d": high + 1, b"ab" + b"cd": high + 2, b"abe": high * 3}
    words = ["abcd", "abe", "cdab", "xab", "abcde", "ab"]
    want = []
    for w in words:
        ids = [ranks[bytes([c])] for c in w.encode()]
        of = {i: t for t, i in ranks.items()}
        while pairs := [(r, i) for i in range(len(ids) - 1) if (r := ranks.get(of[ids[i]] + of[ids[i + 1]])) is not None]:
            r, i = min(pairs)
            ids[i : i + 2] = [r]
        want.append(ids)
    assert bpe.Replay(ranks, r"\S+|\s+").replay([w.encode() for w in words]) == want


def test_quality_dictionaries_hold_every_passage(spark, monkeypatch):
    """No labelled passage that is drawn is thrown away."""
    texts = [(i, f"mark{i:04d} " + "good words here " * (80 if i % 3 else 2), i % 2) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    passages, kept = quality.passages, []
    monkeypatch.setattr(quality, "passages", lambda *a: kept.append(passages(*a)) or kept[-1])
    model = quality.fit(df, df)
    drawn = Counter(r["kind"] for r in kept[0].collect())
    assert (model.bad.count(b"\n"), model.good.count(b"\n")) == (drawn[0], drawn[1])
    assert min(drawn.values()) > 150


def test_near_stage_tells_rows_of_one_id_apart(spark, sf_dir):
    import corpus_pipeline

    rnd = random.Random(1)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b = text(), text()
    rows = spark.createDataFrame([(1, a), (2, b), (2, a + " more")], "doc_id long, text string")
    kept = [r["text"] for r in corpus_pipeline.distinct(spark, rows, sf_dir).collect()]
    assert b in kept and len(kept) == 2
