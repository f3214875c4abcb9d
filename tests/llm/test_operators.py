"""Each corpus operator against a brute-force version on small tables with nulls, blanks, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkveil.llm import features, html, language, lines, mixing, multiset, packing, quality, resemblance, simhash, substrings, suffixes, suite, toxicity
from sparkveil.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, _i string, key string, host string, _y int"


def table(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), 7, "x", "k", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta été naïve omega sigma tau phi 漢字 kappa".split()) + str(rng.randint(0, 60)) for _ in range(n))


# -- 1 ------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "two Words", "A B C", "a b\nc"]
    for _ in range(60):
        t = prose(rng, rng.randint(3, 300))
        texts.append(t)
        for _ in range(rng.randint(0, 3)):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


@pytest.mark.parametrize("block", [2048, 8])
def test_links_survive_splitting(spark, block):
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 60)):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    found = connected_components(simhash.near_links(rows, block=block)).collect()
    label = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    expected = brute_components(fps)
    groups = lambda key: sorted(sorted(x for x, k in zip(fps, key) if k == v) for v in set(key))
    assert groups([label.get(x, x) for x in fps]) == groups([fps[i] for i in expected])


@pytest.mark.parametrize("block", [2048, 40])
def test_second_fingerprints_restrict_links(spark, block):
    rng = random.Random(45)
    pairs = set()
    for _ in range(20):
        x, y = rng.getrandbits(64), rng.getrandbits(64)
        for _ in range(rng.randint(1, 50)):
            a, b = x, y
            for _ in range(rng.randint(0, 5)):
                a ^= 1 << rng.randrange(64)
            for _ in range(rng.choice([0, 3, 20])):
                b ^= 1 << rng.randrange(64)
            pairs.add((a, b))
    pairs = sorted(pairs)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "fp bigint, aux bigint")
    names = {r.n: r.k for r in rows.select(F.xxhash64("fp", "aux").alias("n"), F.struct("fp", "aux").alias("k")).collect()}
    found = {tuple(names[r.node]): r.root for r in connected_components(simhash.near_links(rows, distance=7, block=block, more=14)).collect()}
    root = list(range(len(pairs)))
    for i, (a, b) in enumerate(pairs):
        for j, (c, d) in enumerate(pairs[:i]):
            if (a ^ c).bit_count() <= 7 and (b ^ d).bit_count() <= 14:
                x, y = root[i], root[j]
                root = [min(x, y) if k in (x, y) else k for k in root]
    label = [found.get((signed(a), signed(b)), (a, b)) for a, b in pairs]
    groups = lambda key: sorted(sorted(x for x, k in zip(pairs, key) if k == v) for v in set(key))
    assert groups(label) == groups(root)


def test_large_families_are_one_group(spark):
    """More near copies than a block holds, beside chance neighbours that share most bits but not the second fingerprint."""
    rng = random.Random(46)
    x, y = rng.getrandbits(64), rng.getrandbits(64)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, n)))
    family = {(flip(x, 3), flip(y, 6)) for _ in range(600)}
    others = {(flip(x, 3), rng.getrandbits(64)) for _ in range(300)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(signed(a), signed(b)) for a, b in family | others], "fp bigint, aux bigint").repartition(4)
    names = {r.n: tuple(v % (1 << 64) for v in r.k) for r in rows.select(F.xxhash64("fp", "aux").alias("n"), F.struct("fp", "aux").alias("k")).collect()}
    links = simhash.near_links(rows, distance=7, block=300, more=14)
    assert links.count() < 64 * 4 * len(family)
    found = connected_components(links).collect()
    assert len({r.root for r in found if names[r.node] in family}) == 1 and family <= {names[r.node] for r in found}
    assert not {names[r.node] for r in found} & {o for o in others if all((o[1] ^ k[1]).bit_count() > 14 for k in family | others if k != o)}


def near_components(x, y, distance, more):
    """The place of the first row of each row's component, by comparing all pairs."""
    root = np.arange(len(x))
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= distance) & (np.bitwise_count(y[:, None] ^ y[None, :]) <= more)
    while True:
        least = np.where(near, root[None, :], len(x)).min(1)
        if (least == root).all():
            return root.tolist()
        root = least


@pytest.mark.parametrize("spread", [False, True])
def test_large_blocks_lose_no_link(spark, monkeypatch, spread):
    """Families in one block that single links between their members connect; with ``spread``, their first fingerprints differ outside the block's bits and chance neighbours lie between them."""
    rng = random.Random(47)
    flip = lambda v, bits: v ^ sum(1 << b for b in bits)
    pairs = set()
    for _ in range(3):
        x = rng.getrandbits(49) << 15
        y, order = rng.getrandbits(64), rng.sample(range(64), 64)
        z = flip(y, order[:32])
        families = [(x, y), (x, z)] if spread else [(0, y), (0, z)]
        # 10 bits from one family, 12 bits on, 10 bits from the other: no other rows connect them
        pairs |= {(families[0][0], flip(y, order[:10])), (families[0][0], flip(y, order[:22]))}
        pairs |= {(a, flip(b, rng.sample(order[32:], rng.randint(0, 3)))) for a, b in families for _ in range(200)}
    if spread:
        pairs |= {(rng.getrandbits(49) << 15, rng.getrandbits(64)) for _ in range(1500)}
    pairs = sorted(pairs)
    x, y = np.array(pairs, np.uint64).T.copy()
    expected = near_components(x, y, 7, 14)
    assert len(set(expected)) == 3 + (len(pairs) - len([k for k in expected if expected.count(k) > 9]))
    signed = list(zip(x.view(np.int64).tolist(), y.view(np.int64).tolist()))
    rows = spark.createDataFrame(signed, "fp bigint, aux bigint").repartition(4)
    monkeypatch.setattr(simhash, "plan", lambda *_: [(1 << 15) - 1])
    names = {r.n: tuple(r.k) for r in rows.select(F.xxhash64("fp", "aux").alias("n"), F.struct("fp", "aux").alias("k")).collect()}
    found = {names[r.node]: r.root for r in connected_components(simhash.near_links(rows, distance=7, block=200, more=14)).collect()}
    label = [found.get(k, k) for k in signed]
    groups = lambda key: sorted(sorted(p for p, k in zip(signed, key) if k == v) for v in set(key))
    assert groups(label) == groups(expected)


def test_threshold_allotment_is_least():
    costs = [[0.0, 5, 50, 500, 5000], [0.0, 100, 110, 120, 130], [0.0, 1, 2, 90, 900], [0.0, 70, 700, 7000, 70000]]
    found = simhash.allot(costs, 3)
    assert sum(found) == 0
    best = min(sum(costs[i][e + 1] for i, e in enumerate(c)) for c in __import__("itertools").product(range(-1, 4), repeat=4) if sum(c) == 0)
    assert sum(costs[i][e + 1] for i, e in enumerate(found)) == best


# -- 2, 7, 8 -----------------------------------------------------------------


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(3)
    texts, y = [], []
    for i in range(600):
        sentences = [prose(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(sentences))
                sentences[k] += " " + rng.choice(["vilhund", "vilratte", "scumbag", "dimwit"]) + rng.choice(["", "en", "er"])
        texts.append(". ".join(sentences) + ".")
        y.append(int(bad))
    texts += [None, "", "word " * 30_000]
    docs = table(spark, texts)
    labels = spark.createDataFrame(list(enumerate(y)) + [(None, 1), (700, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, learn=~toxicity.held_out(F.col("_id")))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].predicted == y[i] for i in held]) >= 0.95
    assert got[600].score == got[601].score == 0 and got[602].predicted == 0
    hits = [r.sentence for r in toxicity.offending(docs, model).collect()]
    assert hits and np.mean([any(w in s for w in ("vilhund", "vilratte", "scumbag", "dimwit")) for s in hits]) > 0.9
    nothing = toxicity.fit(docs, labels.where("toxic = 9"))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def brute_sentences(text, model):
    """(start, end, log odds) of each sentence, byte by byte."""
    b = text.encode()
    low = bytes(32 if c in b"\t\n\x0b\x0c\r " else c + 32 if 65 <= c <= 90 else c for c in b)
    padded = b" " + low + b" " * 8
    cuts = [0] + [i for i in range(1, len(b)) if b[i - 1] in b".!?\n" and b[i] not in b".!?\n"] + [len(b)]
    out = []
    for s, e in zip(cuts, cuts[1:]):
        z = model.bias
        for n, weights in zip(toxicity.GRAMS, model.weights):
            found = set()
            for gram in {padded[i : i + n] for i in range(s, e)}:
                h = 0
                for c in gram:
                    h = (h * 0x01000193 + c) % (1 << 32)
                found.add(((h ^ h >> 15) * 0x85EBCA6B % (1 << 32)) >> 32 - toxicity.BITS)
            z += sum(float(weights[k]) for k in found)
        out.append((s, e, z))
    return out


def test_toxicity_scores_and_spots_match_noisy_or(spark):
    rng = random.Random(33)
    texts = ["".join(rng.choice("abAB .!?\né漢") for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["... \n", "x" * 500, "ab. " * 60]
    draw = np.random.default_rng(2)
    model = toxicity.Model((draw.random((2, 1 << toxicity.BITS)) * (draw.random((2, 1 << toxicity.BITS)) < 0.05) * 9).astype(np.float32), -4.0, 0.8, 0.3)
    chance = lambda z: 1 / (1 + np.exp(-(0.8 * z + 0.3)))
    for r in toxicity.score(table(spark, texts), model).collect():
        own = brute_sentences(texts[r.doc_id], model)
        none = np.prod([1 / (1 + np.exp(z)) for *_, z in own])
        p = chance(np.log((1 - none) / none))
        assert abs(r.score - p) < 1e-6 and r.predicted == (p >= 0.5)
        likely = {(s, e) for s, e, z in own if chance(z) >= 0.5}
        likely |= {max(own, key=lambda x: x[2])[:2]} if p >= 0.5 else set()
        assert {(x.start, x.end) for x in r.sentences} == likely


@pytest.mark.parametrize("size", [1, 3, 512])
def test_toxicity_does_not_depend_on_pieces(size):
    rng = random.Random(34)
    draw = np.random.default_rng(3)
    model = toxicity.Model((draw.random((2, 1 << toxicity.BITS)) < 0.02).astype(np.float32), -5.0)
    for text in (". ".join(prose(rng, 9) for _ in range(30)), "no end " * 200, "a.b!c\n" * 50):
        parts = lambda n: [np.concatenate(x).tolist() for x in zip(*toxicity.sentence_logits(text.encode(), model, n))]
        (starts, z), (expected, z0) = parts(size), parts(1 << 20)
        assert starts == expected and np.allclose(z, z0, rtol=0, atol=1e-9)


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(35)
    texts = [". ".join(prose(rng, 12) for _ in range(900)) + (" vilhund." if i % 2 else ".") for i in range(24)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, toxic int")
    docs = table(spark, texts)
    assert min(map(len, texts)) > 1 << 16
    assert toxicity.fit(docs, labels).weights.any()
    assert not toxicity.fit(docs, labels, most_chars=1000).weights.any()


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(d)
    got = language.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    odd = language.predict(table(spark, [None, "", "12 34 !!", "the and of 😀"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd][:3] == ["und"] * 3 and [r.score for r in odd][:3] == [0.0] * 3
    empty = language.fit(d.where("false"))
    assert {r.lang_pred for r in language.predict(d.limit(5), empty).collect()} == {"und"}


def test_rare_languages_have_a_prototype(spark, monkeypatch):
    monkeypatch.setattr(language, "LEAST", 40)
    texts = ["the quick brown fox and the lazy dog"] * 2000 + ["żółć gęś jaźń łódź świętość"] * 100 + ["ωμέγα και άλφα"] * 3
    langs = ["en"] * 2000 + ["pl"] * 100 + ["el"] * 3
    docs = table(spark, texts, langs=langs)
    model = language.fit(docs, sample=3)
    assert model.languages == ["el", "en", "pl"]
    assert {(r.doc_id < 2000, r.doc_id < 2100, r.lang_pred) for r in language.predict(docs, model).collect()} == {(True, True, "en"), (False, True, "pl"), (False, False, "el")}


def brute_vector(text):
    symbols = [0]
    for c in text or "":
        k = language._class(ord(c))
        if k or symbols[-1]:
            symbols.append(k)
    symbols += [0] * (symbols[-1] != 0)
    total = np.zeros(language.WIDTH)
    for i in range(len(symbols) - 2):
        bound = np.ones(language.WIDTH)
        for k in range(3):
            bound *= np.roll(language._LETTERS, 2 - k, axis=1)[symbols[i + k]]
        total += bound
    return total


@pytest.mark.parametrize("at_once", [1, 2, 3, 50, 1 << 20])
def test_language_vectors_do_not_depend_on_pieces(at_once):
    rng = random.Random(4)
    texts = [prose(rng, 80), None, "", "12 !!", "ÄÖÜ ß", "𐐷𐐷𐐷 abc", "ΟΔΟΣ İ x"] + ["".join(rng.choice("ab Ä漢1.") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    found, lettered = language.vectors(texts, at_once)
    assert (found == np.array([brute_vector(t) for t in texts])).all()
    assert lettered.tolist() == [any(c.isalpha() for c in t or "") for t in texts]


def test_language_scores_match_cosines_of_prototypes(spark):
    rng = random.Random(31)
    langs = ["xx" if i % 3 else "yy" for i in range(60)]
    texts = ["".join(rng.choice("abcdefg " if x == "xx" else "efghijk ") for _ in range(60)) for x in langs]
    docs = table(spark, texts, langs=langs)
    seen = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    unit = lambda v: v / np.linalg.norm(v)
    vectors = [unit(brute_vector(t)) for t in texts]
    prototypes = {x: unit(sum(vectors[i] for i in seen if langs[i] == x)) for x in ("xx", "yy")}
    model = language.fit(docs.repartition(5))
    for r in language.predict(docs, model).collect():
        cosines = {x: float(vectors[r.doc_id] @ p) for x, p in prototypes.items()}
        best = max(cosines, key=cosines.get)
        assert r.lang_pred == best and abs(r.score - max(0, cosines[best])) < 1e-4 and r.held_out == (r.doc_id not in seen)


def brute_counts(t):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "")).split(" ") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if any(c not in "\t\x0b\x0c\r " for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts_match_brute_force():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "a", "a b c d e " * 3, "x\nx\n x\nx\n", "    é", "# * $ % & | < >"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["\n".join(prose(rng, rng.randint(0, 4)) for _ in range(5)) for _ in range(50)]
    for t in texts:
        assert quality.measure(None if t is None else t.encode())[0] == brute_counts(t)


@pytest.mark.parametrize("size", [1, 7, 512])
def test_quality_counts_and_features_do_not_depend_on_pieces(size):
    for text in ((prose(random.Random(6), 200) + "\n") * 3, "x" * 3000 + " y", "", " \n ", "é"):
        (counts, features), (whole, expected) = quality.measure(text.encode(), size), quality.measure(text.encode())
        assert counts == whole == brute_counts(text) and (features == expected).all()


def brute_features(text):
    b = (text or "").encode()
    out = Counter()
    for word in b.split():
        h = sum(int(features._BYTE[c]) * pow(features._STEP, k, 1 << 64) for k, c in enumerate(word)) % (1 << 64)
        # powers begin with 1 and go on with the step
        h = (h ^ h >> 29) * 0x9E3779B97F4A7C15 % (1 << 64)
        out[(h ^ h >> 32) >> 64 - quality.BITS] += 1
    for i in range(len(b) - 2):
        h = 0
        for c in b[i : i + 3]:
            h = (h * 0x01000193 + c) % (1 << 32)
        h = (h ^ h >> 15) * 0x85EBCA6B % (1 << 32)
        out[(1 << quality.BITS) + (h >> 32 - quality.BITS)] += 1
    return out


def test_quality_scores_match_the_model_term_by_term(spark):
    rng = random.Random(32)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(30)] + [None, "", "a b"]
    weights = np.random.default_rng(1).normal(size=quality.DIM) * 3
    model = quality.Model(weights, 0.2, 1.5, -0.1)
    for r in quality.score(table(spark, texts), model).collect():
        counts = brute_features(texts[r.doc_id])
        norm = max(np.sqrt(sum(np.log1p(c) ** 2 for c in counts.values())), 1e-9)
        z = sum(weights[k] * np.log1p(c) for k, c in counts.items()) / norm + 0.2
        p = 1 / (1 + np.exp(-(1.5 * z - 0.1)))
        n, *_, repeated = brute_counts(texts[r.doc_id])
        assert abs(r.score - p) < 1e-9 and r.kept == (n >= 10 and 100 * repeated <= 20 * n and p >= 0.5)


def test_contradictory_and_repeated_labels(spark):
    docs = table(spark, [f"good text number {i} with words" if i % 2 else f"BAD!! {i} ***" for i in range(80)])
    labels = [(i, i % 2) for i in range(80)]
    noisy = labels + labels[:30] + [(200, 0), (200, 1), (201, 1)]
    fits = []
    for rows in (labels, noisy, noisy[::-1]):
        q = spark.createDataFrame(rows, "doc_id bigint, quality int").repartition(3)
        fits.append((quality.fit(docs, q), toxicity.fit(docs, q, label_col="quality")))
    for good, tox in fits[1:]:
        assert (good.weights == fits[0][0].weights).all() and (tox.weights == fits[0][1].weights).all()
    for k in (quality.fit, lambda d, x: toxicity.fit(d, x, label_col="quality")):
        flipped = spark.createDataFrame(labels + [(i, 1 - y) for i, y in labels], "doc_id bigint, quality int")
        assert not k(docs, flipped).weights.any()


def test_quality_learns(spark):
    rng = random.Random(7)
    texts = [prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for i in range(400)] + [None, "", "few words"]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.mean([got[i].kept == (i % 3 > 0) for i in range(300, 400)]) >= 0.97
    assert all(got[i].base_failed and not got[i].kept for i in (400, 401, 402))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


# -- 3 ------------------------------------------------------------------------


def test_packing_round_trip(spark):
    rng = random.Random(8)
    texts = [None, "", "a", "<|endoftext|> x", "a<|endoftext|><|endoftext|>" + "b " * 9, "<|endoftext |>", "tab\t\n\n  end ", "ñ😀" * 50, "a" * 3000, " " * 5000, "\n" * 700_000] + [prose(rng, rng.randint(1, 1500)) for _ in range(12)]
    docs = table(spark, texts)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        expected = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by[i], key=lambda r: r.start)
        assert sum((r.ids for r in own), []) == expected
        assert all(r.length == len(r.ids) and r.length <= 2048 and r.length.bit_count() == 1 and r.offset == 0 and r.length == 1 << r.bucket and r.doc_tokens == len(expected) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack(docs.limit(0)).count() == 0


def test_buckets_hold_equal_lengths(spark, tmp_path):
    rng = random.Random(36)
    packing.write_buckets(packing.pack(table(spark, [prose(rng, rng.randint(0, 300)) for _ in range(9)]), with_ids=True), str(tmp_path / "b"))
    rows = spark.read.parquet(str(tmp_path / "b")).collect()
    assert rows and all(len(r.ids) == r.length == 1 << r.bucket for r in rows)


def test_lengths():
    assert packing.lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]
    assert packing.lengths(0) == []


# -- 4 ------------------------------------------------------------------------


def test_suffix_array_matches_sorting():
    rng = random.Random(9)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 16))]
        order = suffixes.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffixes.common_prefixes(s, order)
        for k in range(1, len(order)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_removal(texts, length):
    seen = Counter(b[p : p + length] for t in texts for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_removal_matches_brute_force(spark, monkeypatch, group):
    rng = random.Random(10)
    make = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    passage, texts = make(900), []
    for _ in range(14):
        b = make(rng.randint(0, 1500))
        k, a = rng.randint(0, len(b)), rng.randint(0, 400)
        texts += [b, b[:k] + "#" + b[k:], b[: len(b) // 2] + passage[a : a + rng.randint(395, 500)] + b[len(b) // 2 :] + passage[: rng.randint(399, 402)]]
    texts += [None, "a" * 1200, "ab" * 700, texts[0], "short"]
    spans = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda docs, length, scratch: spans(docs, length, group=group, scratch=scratch))
    got = {r[0]: tuple(r)[1:5] for r in substrings.remove_repeats(table(spark, texts), with_text=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 400)


def test_many_repeated_rows_have_their_spans_once(spark):
    rng = random.Random(42)
    text = "".join(rng.choice("abcdé fgh") for _ in range(3000))
    docs = spark.createDataFrame([(None, text)] * 10_000 + [(1, text[:900]), (2, "own " * 3)], "doc_id bigint, text string").repartition(7)
    got = substrings.remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    n, part = len(text.encode()), len(text[:900].encode())
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, n, n, 1, 10_000), (1, part, part, 1, 1), (2, 12, 0, 0, 1)], key=str)


def test_kept_text_of_the_query(spark, tmp_path):
    rng = random.Random(43)
    passage = "é".join(prose(rng, 60) for _ in range(2))
    texts = [None, "", prose(rng, 50), prose(rng, 30) + passage, passage + prose(rng, 30)]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suite.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (_, removed, _, digest) in enumerate(brute_removal(texts, 400)):
        assert got[i].n_removed == removed and got[i].kept_sha256 == digest
        if "\ufffd" not in got[i].text:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest
    assert got[2].text == texts[2] and passage not in got[3].text and len(got[3].text) < len(texts[3]) - 300


def test_anchors_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    text = ("ab" * 500 + prose(random.Random(11), 300)).encode()
    windows = []
    for _, _, low, high, at in substrings._document_anchors(text, 400, 128):
        for a, z, k in zip(low.tolist(), high.tolist(), at.tolist()):
            windows += range(a, z + 1)
            assert a <= k and k + 128 <= z + 400 and z <= k
    assert windows == list(range(len(text) - 399))


# -- 5, 10 -------------------------------------------------------------------


def duck(sql, texts, sources):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))])
    return con.execute(sql).fetchall()


def test_lines_match_brute_force(spark):
    rng = random.Random(12)
    common = ["menu | home", " menu | home\t", "all rights reserved", ""]
    texts = ["\n".join([rng.choice(common) for _ in range(2)] + [prose(rng, 4) for _ in range(rng.randint(0, 4))] * rng.randint(1, 2)) for _ in range(120)] + [None, "", "menu | home"]
    sources = [rng.choice(["a", "b", None]) for _ in texts]
    docs = table(spark, texts, sources)
    out = lines.drop_boilerplate(docs, ratio=0.3)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    blank = lambda x: x.strip(" \t\x0b\x0c\r")
    pages, having = Counter(sources), Counter()
    for t, s in zip(texts, sources):
        having.update({(s, blank(x)) for x in (t or "").split("\n") if blank(x)})
    drop = {k for k, n in having.items() if n >= 3 and n > pages[k[0]] * 0.3}
    assert drop
    for r in out.collect():
        t, s = texts[r.doc_id], sources[r.doc_id]
        if t is None:
            assert (r.text, r.n_lines, r.n_dropped) == (None, 0, 0)
            continue
        kept = [x for x in t.split("\n") if (s, blank(x)) not in drop]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_targets(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        goal = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **goal}
        capped |= {s: 2.0 * sizes[s] for s in over}


def brute_mix(rows):
    """How often each id of ``rows`` (id, text, source; ids once) is taken."""
    size = {i: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ").count("") for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    goal, out = brute_targets(total), {}
    for s in total:
        own = sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16), i) for i, _, x in rows if x == s)
        passes = int(goal[s] // total[s]) if total[s] else 0
        left = goal[s] - passes * total[s]
        for _, i in own:
            left -= size[i]
            out[i] = passes + (total[s] > 0 and passes < 2 and left >= -1e-9)
    return out


def test_mix_matches_brute_force(spark):
    rng = random.Random(13)
    names = ["b", "a", None, "ä", "Z", "empty", "tiny"]
    texts, sources = [], []
    for _ in range(700):
        s = rng.choices(names, [9, 3, 2, 4, 2, 1, 0.2])[0]
        sources.append(s)
        texts.append(rng.choice([None, "", "\t "]) if s == "empty" else prose(rng, rng.randint(0, 30)) + rng.choice(["", " \n"]))
    docs = table(spark, texts, sources)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = [len((t or "").split()) for t in texts]
    total = Counter()
    for s, n in zip(sources, size):
        total[s] += n
    goal = brute_targets(total)
    taken = Counter()
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == total[sources[i]] and abs(r.target - goal[sources[i]]) < 1e-6 * max(1, goal[sources[i]])
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[sources[i]] += r.taken
    for s in total:
        assert goal[s] - max(n for n, x in zip(size, sources) if x == s) - 1e-6 <= taken[s] <= goal[s] + 1e-6
    oracle = {r[0]: r[1:] for r in duck(mixing.ORACLE, texts, sources)}
    assert {i: (r.size, r.source_size, r.taken) for i, r in got.items()} == {i: (r[0], r[1], r[3]) for i, r in oracle.items()}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[i] * r.size == r.taken for i, r in got.items())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_over_many_ranges_match_brute_force(spark):
    rng = random.Random(39)
    sizes = {f"s{k:04d}": rng.choice([0, 1, 5, 40, 3000]) for k in range(500)} | {None: 77, "ß": 9}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    goal = brute_targets(sizes)
    got = mixing.targets(rows).collect()
    assert len(got) == len(sizes) and all(abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source]) for r in got)
    assert mixing.targets(rows.limit(0)).count() == 0


# -- 6 ------------------------------------------------------------------------


def test_fingerprints_and_edits(spark):
    rng = random.Random(14)
    texts = [None, "", "a", "par one two three\n\npar two here now", "par two here now\npar one two three"] + ["\n".join(prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    texts += [texts[-1], "é" * 7, "word " * 5000]
    got = {r.doc_id: r for r in multiset.compare_neighbours(table(spark, texts), range_rows=5).collect()}
    assert len(got) == len(texts)
    vectors = [multiset.text_vector(t or "") for t in texts]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].fingerprint == multiset.to_text(vectors[i]) and got[i].edited_fingerprint == multiset.to_text(multiset.text_vector(e))
        assert got[i].near_next == multiset.likeness(vectors[i], vectors[(i + 1) % len(texts)])
    assert got[3].fingerprint == got[4].fingerprint  # order of paragraphs
    assert (multiset.delete(multiset.insert(vectors[5], "new one"), "new one") == vectors[5]).all()
    long = [i for i in range(5, 45) if len(texts[i]) > 400]
    assert np.mean([got[i].near_edited for i in long]) > 0.4 > 0.2 > np.mean([got[i].near_next for i in long[:-1]])


def brute_likeness(a, b):
    """The cosine of the two multisets of 3-word shingles of paragraphs."""

    def shingles(t):
        out = Counter()
        for p in t.split("\n"):
            w = p.split()
            out.update(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else None
        return out

    x, y = shingles(a), shingles(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def test_likeness_is_near_the_exact_cosine():
    rng = random.Random(37)
    pool = [prose(rng, rng.randint(1, 30)) for _ in range(40)]
    off = []
    for _ in range(150):
        a, b = ("\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(2))
        off.append(multiset.likeness(multiset.text_vector(a), multiset.text_vector(b)) - brute_likeness(a, b))
    assert np.abs(off).mean() < 0.07 and np.abs(off).max() < 0.35


def test_hot_ids_and_repeated_rows_stay(spark):
    rng = random.Random(38)
    rows = [(None, prose(rng, 5)) for _ in range(120)] + [(None, "one text that repeats")] * 90 + [(None, None)] * 40 + [(7, "seven")] * 30 + [(i, prose(rng, 6)) for i in range(10, 60)] + [(-(1 << 63), "first")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = multiset.compare_neighbours(docs, range_rows=10).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, multiset.to_text(multiset.text_vector(t or ""))) for i, t in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 7) == 29
    assert sum(r.near_next == 1.0 for r in got if r.fingerprint == multiset.to_text(multiset.text_vector("one text that repeats"))) == 89
    by = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 10}
    texts = dict(rows)
    for i in range(10, 59):
        e = multiset.edited(texts[i], texts[i + 1])
        assert by[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


def test_lanes_of_long_repetitive_texts_do_not_wrap():
    passage = prose(random.Random(19), 100)
    for text in ("\n".join([passage] * 3000), "\n".join([passage] * 6000), "word " * 80_000):
        whole, half = multiset.text_vector(text), multiset.text_vector(text[: len(text) // 2])
        assert multiset.likeness(whole, half) > 0.99


def test_one_document_is_its_own_next(spark):
    r = multiset.compare_neighbours(table(spark, ["abcd ef"])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert multiset.compare_neighbours(table(spark, ["x"]).limit(0)).count() == 0


# -- 9 ------------------------------------------------------------------------


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p><p>no";</script></head><body class="nav-open">
    <header><h2>Site</h2></header><nav><ul><li>Home</ul></nav><!-- x <p>no</p> --><main><article><header><h1>Head &amp; tail</h1></header>
    <p>One <b>bo</b>ld&nbsp;word<br>next<p>Two &#233;&lt;p&gt;<div class="share-buttons">Tweet</div><p hidden>no<p>Three</p>
    <section id="comments"><p>Nice!</p></section></article><aside>Side</aside></main><footer>&copy;</footer><form><p>mail</p></form></body></html>"""
    kept = " ".join(t for k, t in html.blocks(page) if k == html.ARTICLE)
    assert kept == "Head & tail One bold word next Two é<p> Three"
    framed = '<div class="page with-sidebar"><div id="menu">M</div><article class="post"><div class="entry-header"><h1>T</h1></div>a<img src=x>b<x-y>c</x-y><script>no</script>d<br>e</article><div class="comments"><article>first!</article></div></div>'
    assert [t for k, t in html.blocks(framed) if k == html.ARTICLE] == ["T", "abcd", "e"]
    assert html.blocks(None) == html.blocks("") == []
    assert html.blocks("just text") == [(html.OPEN, "just text")]


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, u, h, *_ in rows], "page_id bigint, url string, html string")


def test_host_decides_about_unmarked_blocks(spark):
    rng = random.Random(15)
    rows = [(i, f"https://h{i % 2}.example/x/{i}", f"<body><div>Welcome to the big site</div><div><p>{prose(rng, 30)}</p></div><div>Share</div><div>Call us under 555 today or tomorrow</div></body>", 1) for i in range(40)]
    rows += [(40, None, None, 1), (41, "nohost", "", 1), (42, "https://h9.example/", "<p>alone</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for i in range(40):
        body = rows[i][2].split("<p>")[1].split("</p>")[0]
        assert got[i].text == body and got[i].n_chars == len(body)
    assert got[40].text == got[41].text == "" and got[42].text == "alone"
    assert html.extract(pages.limit(0)).count() == 0


def test_host_decides_about_articles_and_what_is_beside_them(spark):
    rng = random.Random(17)
    own = [(prose(rng, 30), prose(rng, 8)) for _ in range(40)]
    rows = [(i, f"https://h.example/{i}", f"<body><div>{b}</div><div>Welcome to the big site</div><article><p>{a}</p><p>Call us under 555 today or tomorrow</p></article></body>") for i, (a, b) in enumerate(own)]
    got = {r.page_id: r for r in html.extract(pages_of(spark, rows)).collect()}
    assert [got[i].text for i in range(40)] == [f"{b} {a}" for a, b in own]
    assert {got[i].n_repeated for i in range(40)} == {12}


@pytest.mark.parametrize("group", [1000, 20])
def test_strings_of_most_pages_are_cut_beside_articles(spark, group):
    rng = random.Random(44)
    own = [prose(rng, 20) for _ in range(70)]
    rows = [(i, "https://h.example/", f"<p>Read all about it on our site: {t}</p><article><p>Read all about it on our site: {t}</p></article>") for i, t in enumerate(own)]
    got = {r.page_id: (r.text, r.n_repeated) for r in html.extract(pages_of(spark, rows).repartition(3), group=group).collect()}
    assert got == {i: (f"{t} Read all about it on our site: {t}", 7) for i, t in enumerate(own)}


def test_copied_articles_and_shared_passages_stay(spark):
    rng = random.Random(40)
    passage, copied = prose(rng, 60), prose(rng, 90)
    rows = [(i, f"https://h.example/{i}", f"<div>Welcome to the big site</div><article><p>{copied if i < 8 else prose(rng, 80)}</p>{'<p>' + passage + '</p>' if 5 < i < 15 else ''}</article>") for i in range(40)]
    rows += [(100 + i, f"https://g.example/{i}", f"<div>Menu of site g</div><div>{copied if i < 8 else prose(rng, 80)}</div>") for i in range(20)]
    for r in html.extract(pages_of(spark, rows)).collect():
        kept = [x.split("</")[0] for x in rows[r.page_id if r.page_id < 100 else r.page_id - 60][2].replace("<div>", "<p>").split("<p>")[2:]]
        assert r.text == " ".join(kept)


def test_repeats_are_counted_over_the_whole_host(spark):
    rng = random.Random(18)
    own = [" ".join(f"w{i}x{rng.randint(0, 9)}y{k}" for k in range(20)) for i in range(400)]
    often, seldom = set(rng.sample(range(400), 4)), set(rng.sample(range(400), 3))  # 1 % and just under
    rows = [(i, "https://h.example/", f"<p>{t}</p>" + "<p>Seen on a hundredth of it</p>" * (i in often) + "<p>Found on somewhat fewer pages</p>" * (i in seldom)) for i, t in enumerate(own)]
    expected = {i: t + " Found on somewhat fewer pages" * (i in seldom) for i, t in enumerate(own)}
    copied = min(seldom - often)
    rows += [(1000 + k, "https://h.example/", rows[copied][2] + f"<p>frame {k}</p>" * (k % 2)) for k in range(40)]  # one page, by its longest block
    expected |= {1000 + k: expected[copied] + f" frame {k}" * (k % 2) for k in range(40)}
    for parts, group in ((1, 200), (5, 200), (3, 1000)):
        assert {r.page_id: r.text for r in html.extract(pages_of(spark, rows).repartition(parts), group=group).collect()} == expected


def brute_extraction(rows):
    """The rule over plain blocks and tuples of symbols, with no suffix array, hash or groups."""
    read = []
    for i, url, page in rows:
        found = html.blocks(page)
        symbols = html.END * ["\0"] if found else []
        for _, text in found:
            symbols = symbols + text.split(" ") + html.END * ["\0"]
        read.append((i, html.host_of(url), found, symbols))
    pages, having = {}, {}
    for _, host, found, symbols in read:
        longest = max((t for _, t in found), key=len, default="")
        pages.setdefault(host, set()).add(longest)
        for x in [(host, t) for _, t in found] + [(host, *symbols[k : k + html.TOKENS]) for k in range(len(symbols) - html.TOKENS + 1)]:
            having.setdefault(x, set()).add(longest)
    out = {}
    for i, host, found, symbols in read:
        n = len(pages[host])
        enough, most = max(html.PAGES, html.SHARE * n), max(html.MOST, html.MOST_SHARE * n)
        cut = set()
        for k in range(len(symbols) - html.TOKENS + 1):
            if len(having[(host, *symbols[k : k + html.TOKENS])]) >= most and symbols[k : k + html.TOKENS].count("\0") <= 2:
                cut |= set(range(k, k + html.TOKENS))
        kept, at = [], html.END
        for kind, text in found:
            own = range(at, at + len(text.split(" ")))
            at = own.stop + html.END
            if kind == html.ARTICLE and len(having[host, text]) < most:
                kept.append(text)
            if kind == html.OPEN and len(having[host, text]) < enough:
                kept.append(" ".join(w for k, w in zip(own, text.split(" ")) if k not in cut))
        out[i] = " ".join(x for x in kept if x)
    return out


@pytest.mark.parametrize("group", [256, 9])
def test_extraction_matches_brute_force(spark, group):
    rng = random.Random(41)
    pieces = [prose(rng, rng.randint(1, 9)) for _ in range(25)] + ["Share", "a b", "|"]
    rows = []
    for i in range(90):
        body = [f"<{t}>{rng.choice(pieces) + ' ' + prose(rng, rng.randint(0, 12)) if rng.random() < 0.4 else rng.choice(pieces)}</{t}>" for t in rng.choices(["p", "div", "nav", "h2", "aside"], k=rng.randint(0, 9))]
        cut = rng.randint(0, len(body))
        page = "".join(["<div>Welcome to our site</div>", *body[:cut], "<article>", *body[cut:], "<p>Thanks for reading us</p></article>"] if rng.random() < 0.5 else ["<div>Welcome to our site</div>", *body])
        rows.append((i, f"https://h{rng.choice([0, 0, 0, 1])}.example/{i}", page))
    rows += [(90 + k, *rows[k][1:]) for k in range(20)] + [(200, "https://h0.example/", ""), (201, None, "<p>x</p>")]
    got = {r.page_id: r.text for r in html.extract(pages_of(spark, rows).repartition(4), group=group).collect()}
    expected = brute_extraction(rows)
    if group >= 110:
        assert got == expected
    else:  # strings on three pages only may lie apart in small groups; larger shares are always found
        assert sum(got[i] == expected[i] for i in got) >= 0.6 * len(got)
        assert all(len(got[i]) >= len(expected[i]) and not ("Welcome" in got[i] or "Thanks" in got[i]) for i in got)


def test_marks_and_names_can_be_hidden(spark):
    """With elements and class names taken away the suffix array alone leaves nearly the same text."""
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = {r.page_id: r.text.split(" ") for r in html.extract(d).collect()}
    plain = F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), 'class="ad"', 'class="x7"')
    off = total = 0
    for r in html.extract(d.withColumn("html", plain)).collect():
        a, b = Counter(text[r.page_id]), Counter(r.text.split(" "))
        off += sum((a - b).values()) + sum((b - a).values())
        total += sum(a.values())
    assert off < 0.15 * total


def test_repeated_strings_match_counting():
    rng = random.Random(16)
    for _ in range(60):
        streams = [np.array([rng.choice((5, 6, 7)) for _ in range(rng.randint(0, 12))], np.uint64) for _ in range(12)]
        owners = sorted(rng.randint(0, 8) for _ in streams)
        least = rng.choice((2, 3, 4.5))
        having = {}
        for k, s in enumerate(streams):
            for i in range(len(s) - 2):
                having.setdefault(tuple(s[i : i + 3].tolist()), set()).add(owners[k])
        found, begins = html.repeated_strings(streams, owners, 3, least)
        for k, (s, begin) in enumerate(zip(streams, begins.tolist())):
            n = [len(having.get(tuple(s[i : i + 3].tolist()), ())) for i in range(len(s) + 1)]
            assert found[begin : begin + len(s) + 1].tolist() == [x if x >= least else 0 for x in n]


# -- near-duplicates by shared shingles ------------------------------------------


def brute_shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_similar(texts):
    sets = [brute_shingles(t) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links.append((j, i))
    return links


def near_copies(rng, n, size):
    base = [f"w{rng.randint(0, 4000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(size), rng.randint(0, max(1, size // 45))):
            w[k] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_probe_matches_brute_force():
    rng = random.Random(50)
    for text in ["", "one", "A a B", *near_copies(rng, 5, 80)]:
        words = resemblance.words_of(text.encode()).tolist()
        a, b = resemblance._ODD[:2].tolist()
        pairs = [(x * a + y * b) % (1 << 64) for x, y in zip(words, words[1:])] or words
        for found, kinds in zip(resemblance.probe(text.encode()), (words, pairs)):
            counts = Counter(kinds)
            sums, total = [0.0] * 64, sum(np.sqrt(c) for c in counts.values())
            for h, c in counts.items():
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
                h = (h ^ h >> 27) * 0x94D049BB133111EB % (1 << 64)
                h ^= h >> 31
                for k in range(64):
                    sums[k] += np.sqrt(c) * (h >> k & 1)
            assert found == sum(1 << k for k in range(64) if 2 * sums[k] > total + 1e-9)
    assert resemblance.words_of(b"One TWO one")[0] == resemblance.words_of(b"one")[0] and len(resemblance.words_of(None)) == 0


def test_links_in_memory_match_brute_force():
    rng = random.Random(51)
    texts = [None, "", "a b", "A  b", "a c", "five words are one shingle"] + [t for _ in range(6) for t in near_copies(rng, rng.randint(1, 9), rng.randint(5, 120))] + [" "]
    root = list(range(len(texts)))
    for j, i in brute_similar(texts):
        a, b = root[j], root[i]
        root = [min(a, b) if x in (a, b) else x for x in root]
    found = list(range(len(texts)))
    for first, other in resemblance.similar_links([resemblance.sketch((t or "").encode()) for t in texts]):
        found[other] = first
    assert found == root


def test_long_texts_are_compared_by_their_smallest_shingles():
    rng = random.Random(52)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(9000)]
    near, far = list(base), list(base)
    for k in range(0, 9000, 90):  # about 10 % of the shingles: similarity 0.89
        near[k] = f"x{k}"
    for k in range(0, 9000, 20):  # a quarter: 0.6
        far[k] = f"y{k}"
    sketches = [resemblance.sketch(" ".join(t).encode()) for t in (base, near, far, base[:300])]
    assert [len(s) for s in sketches] == [1024, 1024, 1024, 296]
    assert resemblance.similar_links(sketches) == [(0, 1)]


@pytest.mark.parametrize("group", [1024, 12])
def test_near_copies_are_found_once(spark, group):
    rng = random.Random(53)
    texts, family = [], []
    for k, n in enumerate([1, 1, 2, 3, 5, 40, 9]):
        for t in near_copies(rng, n, rng.randint(60, 200)):
            texts.append(t)
            family.append(k)
    texts += [texts[3]] * 30 + [None, "", " \n"]
    family += [family[3]] * 30 + [99] * 3
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, texts[0], "en", "s", 1, 1, "x", "k", "z", 1), (None, "words of its own without any id", "en", "s", 1, 1, "x", "k", "z", 1)], SCHEMA))
    links = brute_similar(texts)
    root = list(range(len(texts)))
    for j, i in links:
        a, b = root[j], root[i]
        root = [min(a, b) if x in (a, b) else x for x in root]
    kept = resemblance.keep_one(docs.repartition(5), group=group, leaders=6)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and len(ids) == len(set(ids))
    assert {i for i in ids if i is not None} == set(root)
    groups = resemblance.similar_groups(docs, group=group, leaders=6).collect()
    assert len(groups) == len({t for t in texts}) + 1
    assert resemblance.keep_one(docs.limit(0)).count() == 0


def test_large_candidate_groups_lose_no_link(spark):
    """Families whose centres only a chain of single links connects, in groups of many times the size compared whole."""
    rng = random.Random(54)
    distance = lambda a, b: [(x ^ y).bit_count() for x, y in zip(resemblance.probe(a.encode()), resemblance.probe(b.encode()))]
    texts = []
    while len(texts) < 4 * 64:
        words = [[f"w{rng.randint(0, 4000)}" for _ in range(200)]]
        for k in range(3):  # four words on, 20 of 196 shingles: similarity 0.81
            words.append([f"x{rng.randint(0, 10**6)}" if i % 50 == 7 + 6 * k else w for i, w in enumerate(words[-1])])
        chain = [" ".join(w) for w in words]
        if any(a > 7 or b > 14 for a, b in map(distance, chain, chain[1:])):  # candidates are found by probes
            continue
        texts += chain
        for centre in (words[0], words[3]):
            for k in rng.sample(range(195), 30):
                texts.append(" ".join([*centre[:k], "changed", *centre[k + 1 :]]))
    root = list(range(len(texts)))
    for j, i in brute_similar(texts):
        a, b = root[j], root[i]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert set(root) == {0, 64, 128, 192}
    docs = table(spark, texts + ["", *(" " * k for k in range(1, 30))])
    kept = resemblance.keep_one(docs.repartition(5), group=12, leaders=1).collect()
    assert sorted(r.doc_id for r in kept) == [0, 64, 128, 192, 256]


def test_texts_of_large_candidate_groups_are_shuffled_once(spark, tmp_path):
    """A group over the size compared whole moves sketches again, not its texts."""
    rng = random.Random(55)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(30000)]
    docs = table(spark, [" ".join([*words[: 600 * k], "changed", *words[600 * k + 1 :]]) for k in range(40)]).repartition(4)
    docs.write.parquet(path := f"{tmp_path}/docs")
    docs = spark.read.parquet(path)

    def shuffled(group):
        sc = spark.sparkContext._jsc.sc()
        written = []
        for run in (False, True):
            if run:
                groups = resemblance.similar_groups(docs, group=group, leaders=6)
                assert groups.count() == 40 and groups.select("least").distinct().count() == 1
            sc.listenerBus().waitUntilEmpty(30_000)
            written.append(sc.statusStore().executorSummary("driver").totalShuffleWrite())
        return written[1] - written[0]

    assert shuffled(12) < 1.5 * shuffled(1024)


def test_recall_against_brute_force(spark):
    """All pairs of sf0.01 that share 0.8 of their shingles."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(d.select("doc_id", "text").collect())
    having = {}
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    shared = Counter((a, b) for v in having.values() if len(v) < 60 for k, b in enumerate(v) for a in v[:k])
    pairs = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * len(sets[a] | sets[b])]
    rows = resemblance.similar_groups(d).select("t", "least.fp", F.col("least.t").alias("l")).join(d.select("doc_id", F.xxhash64("text").alias("t")), "t").collect()
    group = {r.doc_id: (r.fp, r.l) for r in rows}
    assert pairs and np.mean([group[a] == group[b] for a, b in pairs]) >= 0.95
