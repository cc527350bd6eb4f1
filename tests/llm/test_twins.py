"""Plain Python twins of the models and rules, step by step on small inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from barloom.llm import fingerprint, language, packing, pii, quality
from barloom.llm.textkernel import shingles
from pyspark.sql import functions as F
from tests.llm.reference_rules import words

MASK = (1 << 64) - 1
TEXTS = ["", "one", "one two three", "a b c d e f g h", " ".join(str(k * k) for k in range(40)), " ".join(f"w{k % 90} x{k}" for k in range(400)), "Ünïcode ß 😀 text of eight words right here"]


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def batch(texts):
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)


def plain_fingerprint(hashes, bins=512, bits=4):
    least = {}
    for h in hashes:
        b, value = h >> 55, h & (1 << 55) - 1
        least[b] = min(value, least.get(b, value))
    if not least:
        return ""
    out = ""
    for b in range(bins):
        attempt, donor = 0, b
        while donor not in least:
            attempt += 1
            donor = (mixed((b * 0x9E3779B97F4A7C15 + mixed(attempt)) & MASK) >> 11) % bins
        out += f"{mixed(least[donor]) & (1 << bits) - 1:0{bits}b}"
    return f"{int(out, 2):0{bins * bits // 4}x}"


def test_fingerprints_equal_a_plain_twin():
    found, at = shingles(*batch(TEXTS))
    expected = [plain_fingerprint([int(h) for h in found[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert fingerprint.fingerprints(TEXTS) == expected


def test_shingles_are_those_of_the_contract():
    """Equal runs of five words, and no others, have equal hashes."""
    texts = [*TEXTS, "A b C d E f", "a b c d e", "x a b c d e", "w" * 700_000 + " b c d e", "w" * 700_000 + " b c d E", "w" * 700_001 + " b c d e"]
    found, at = shingles(*batch(texts))
    own = []
    for t in texts:
        w = words(t)
        own += [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    assert len(own) == len(found) == at[-1]
    assert len(set(zip(own, found.tolist(), strict=True))) == len(set(own)) == len(set(found.tolist()))


def plain_place(level, n, size):
    """The fill level that a piece of n ids goes to: the least sum of squares of counts of partly filled windows, then the fullest."""
    best = None
    for h in range(size - n + 1):
        if h and not level[h]:
            continue
        after = list(level)
        if h:
            after[h] -= 1
        if h + n < size:
            after[h + n] += 1
        cost = sum(c * c for c in after[1:size])
        if best is None or (cost, -h) < best[0]:
            best = ((cost, -h), h)
    return best[1]


def test_packing_follows_the_rule():
    draw, size = random.Random(3), 24
    packer, level = packing.Packer(size), [0] * (size + 1)
    for k in range(2000):
        n = draw.choice([1, 2, 3, 5, 8, 13, draw.randrange(1, size)])
        h = plain_place(level, n, size)
        if h:
            level[h] -= 1
        if h + n < size:
            level[h + n] += 1
        packer.place((k, 0, bytes(4 * n), n))
        assert packer.level.tolist() == level
        assert sum(len(w) for w in packer.open.values()) == sum(level)


def test_pieces_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer, draw = packing.Encoder(path), Tokenizer.from_file(path), random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzéüß0123456789'.,-!?()"
    texts = [" ".join("".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(20)) for _ in range(500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def plain_grams(text):
    """Hashes of the 1- to 3-grams of lower-cased letters and single blanks between them."""
    kept = " "
    for c in f"{text.lower()} ":
        if c.isalpha():
            kept += c
        elif kept[-1] != " ":
            kept += " "
    out = []
    for n in (1, 2, 3):
        for k in range(len(kept) - n + 1):
            value = n
            for c in kept[k : k + n]:
                value = (value * 0x100000001B3 + ord(c)) & MASK
            if kept[k : k + n] != " ":
                out.append(mixed(value) >> 49 & language.BUCKETS - 1)
    return out


LETTERS = [("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("der Hund und die Katze", "de"), ("das Haus ist groß", "de"), ("el gato y el perro", "es"), ("12 34 !", "es"), ("", "en"), (None, "de"), ("lost", None), ("ein Satz", "de")]


def plain_bayes(rows, text):
    """(language, probability) by counts, smoothed by half a count, scaled by the root of the number of n-grams."""
    cells, documents = defaultdict(Counter), Counter()
    for t, lang in rows:
        if t is not None and lang is not None:
            documents[lang] += 1
            cells[lang].update(plain_grams(t))
    own, scores = plain_grams(text or ""), {}
    for lang in sorted(documents):
        total = sum(cells[lang].values()) + 0.5 * language.BUCKETS
        log = sum(math.log((cells[lang][g] + 0.5) / total) for g in own) + math.log(documents[lang] / sum(documents.values()))
        scores[lang] = log / math.sqrt(max(len(own), 1))
    best = max(sorted(scores), key=lambda k: scores[k])
    share = 1 / sum(math.exp(s - scores[best]) for s in scores.values())
    return (best, share) if any(c.isalpha() for c in text or "") else ("und", 0.0)


def test_language_equals_a_plain_twin(spark):
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(LETTERS)], "doc_id long, text string, lang string")
    model = language.train(docs)
    asked = ["the big cat", "die große Katze", "el perro", "", "42", None, "Katze cat gato", "a", "x" * 30]
    found = language.identify(spark.createDataFrame(list(enumerate(asked)), "k long, text string"), model).orderBy("k").collect()
    for row, text in zip(found, asked, strict=True):
        lang, share = plain_bayes(LETTERS, text)
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(share, abs=2e-6)
    long = "the cat sat. " * 50_000
    assert len(long) > language.LONG
    row = language.identify(spark.createDataFrame([(long,)], "text string"), model).first()
    assert (row["lang_pred"], row["score"]) == ("en", pytest.approx(1.0))


def plain_terms(text):
    """The buckets of each word and its shape, by the library's hash of them as texts of one word."""
    return quality.terms(*batch([text]))[0].tolist()


def test_context_sums_equal_a_plain_twin(spark):
    texts = ["a b c a b", "one Two 3 four", "", "x", "a b c " * 30]
    index, total = quality.index_vectors(), np.zeros((quality.TERMS, quality.WIDTH))
    for t in texts:
        term = plain_terms(t)
        for i, own in enumerate(term):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(term):
                    total[own] += index[term[j]]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    assert np.array_equal(quality._context_sums(docs), total)


def test_quality_scores_equal_a_plain_twin(monkeypatch):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(quality.TERMS, quality.WIDTH)).astype(np.float32)
    texts = ["A few words\nand a few words\n", "", "one", "lines\nlines\nlines\nother words here", " ".join(f"w{k % 50}" for k in range(700))]
    monkeypatch.setattr(quality, "_PART", 64)
    found = quality.pooled(vectors, *batch(texts))
    layers = draw.normal(size=(found.shape[1], 3)), draw.normal(size=3), draw.normal(size=(3, 1)), draw.normal(size=1)
    shift, scale = found.mean(axis=0), found.std(axis=0) + 1
    scores = quality.Model(vectors, shift, scale, layers, 1.7).score(found)
    for t, row, score in zip(texts, found, scores, strict=True):
        term, n = plain_terms(t), max(len(words(t)), 1)
        parts = [np.sum([vectors[x] for x in term[k::2]], axis=0) / n if term else np.zeros(quality.WIDTH) for k in (0, 1)]
        lines = [x for x in t.split("\n") if x]
        shares = [len(set(x)) / len(x) if x else 1.0 for x in (words(t), lines)]
        own = np.concatenate([*parts, [math.log1p(n)], shares])
        assert np.allclose(own, row, atol=1e-4)
        hidden = [math.tanh(sum((row[i] - shift[i]) / scale[i] * layers[0][i, j] for i in range(len(row))) + layers[1][j]) for j in range(3)]
        logit = sum(h * layers[2][j, 0] for j, h in enumerate(hidden)) + layers[3][0]
        assert score == pytest.approx(1 / (1 + math.exp(-logit / 1.7)), rel=1e-6)


def test_network_lowers_its_loss():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(900, 6))
    y = ((x[:, 0] - 0.5 * x[:, 1] + 0.3 * np.tanh(x[:, 2])) > 0).astype(float)
    w1, b1, w2, b2 = quality._fit(x, y)
    logit = (np.tanh(x @ w1 + b1) @ w2 + b2)[:, 0]
    assert ((logit > 0) == (y > 0)).mean() > 0.9


def plain_reliabilities(votes, rounds=50):
    """Expectation-maximisation over single candidates of one family: (probability of each, how often each labeler is right)."""
    share, right = 0.5, [0.95, 0.8, 0.7]
    for _ in range(rounds):
        good = []
        for own in votes:
            yes, no = share, 1 - share
            for v, a in zip(own, right, strict=True):
                yes *= a if v > 0 else 1 - a if v < 0 else 1
                no *= 1 - a if v > 0 else a if v < 0 else 1
            good.append(yes / (yes + no))
        share = min(0.99, max(0.01, (sum(good) + 1) / (len(votes) + 2)))
        for k, first in enumerate((0.95, 0.8, 0.7)):
            voted = [(v[k], g) for v, g in zip(votes, good, strict=True) if v[k]]
            hits = 10 * first + sum(g if v > 0 else 1 - g for v, g in voted)
            right[k] = min(0.995, max(0.505, hits / (10 + len(voted))))
    return good, right


def test_personal_data_model_equals_a_plain_twin(spark):
    draw = random.Random(6)
    rows = []
    for k in range(120):
        rows.append(draw.choice(["call {}", "phone: {}", "order {}", "version {}", "{}"]).format(draw.choice([f"{200 + k}-555-{1000 + k}", f"a{k}@b{k}.com", f"a{k}@b.zz9", "4111111111111111", "4111111111111112", f"1.2.3.{k}", f"u{k} (at) site (dot) org"])))
    found = spark.createDataFrame([(t,) for t in rows], "text string").select(pii.candidates(F.col("text")).alias("spans")).cache()
    s = F.col("s")
    flat = found.select(F.explode("spans").alias("s")).select(pii._family(s).alias("family"), F.array(*pii._votes(s)).alias("votes"), F.array(*[F.coalesce(f, F.lit("")) for f in pii._features(s)]).alias("features")).collect()
    good = {}
    for family in {r["family"] for r in flat}:
        own = [k for k, r in enumerate(flat) if r["family"] == family]
        each, right = plain_reliabilities([flat[k]["votes"] for k in own])
        good |= dict(zip(own, each, strict=True))
        assert pii.train(found).trust[family] == pytest.approx(right, rel=1e-9)
    yes, no = sum(good.values()), sum(1 - g for g in good.values())
    model = pii.train(found)
    assert model.prior == pytest.approx(math.log((yes + 0.5) / (no + 0.5)))
    for k in range(6):
        for value in {r["features"][k] for r in flat}:
            mine = [good[i] for i, r in enumerate(flat) if r["features"][k] == value]
            expected = math.log((sum(mine) + 0.5) / (yes + 1)) - math.log((sum(1 - g for g in mine) + 0.5) / (no + 1))
            assert model.weights[k][value] == pytest.approx(expected, rel=1e-9)
    scored = found.select(F.explode("spans").alias("s")).select(pii._score(model, s).alias("x")).collect()
    assert [r["x"] for r in scored] == pytest.approx([model.prior + sum(model.weights[k][v] for k, v in enumerate(r["features"])) for r in flat])


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_running_sums_and_replacements_of_any_length(spark, n):
    from barloom.llm import spans

    numbers = [(k * 37) % 11 - 3 for k in range(n)]
    row = spark.range(1).select(spans.running(F.lit(numbers).cast("array<int>"), lambda a, x: a + x).alias("sums"), spans.running(F.lit(numbers).cast("array<int>"), lambda a, x: F.greatest(a, x)).alias("tops")).first()
    assert row["sums"] == np.cumsum(numbers).tolist() and row["tops"] == np.maximum.accumulate([0, *numbers])[1:].tolist()
    text = "é😀" * 700 + "".join(f"u{k}@x.com 😀" for k in range(n))
    made = spark.createDataFrame([(text,)], "text string").select(spans.replaced(F.col("text"), spans.matches(F.col("text"), "email", pii._PATTERNS["email"])).alias("t")).first()["t"]
    assert made == "é😀" * 700 + "<EMAIL> 😀" * n


def test_personal_data_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert pii.find(none).count() == 0 and pii.redact(none).columns == ["doc_id", "text", "spans"]
