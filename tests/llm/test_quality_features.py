"""Features of the quality classifier: work that is done once, and shares of what is new."""

import numpy as np
from barloom.llm import quality


def _batch(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def test_words_are_found_and_hashed_once(monkeypatch):
    asked, spans = [], []
    words, hashes = quality.words, quality.span_hashes
    monkeypatch.setattr(quality, "words", lambda *a: asked.append(1) or words(*a))
    monkeypatch.setattr(quality, "span_hashes", lambda *a, **k: spans.append(1) or hashes(*a, **k))
    quality.pooled(np.ones((quality.TERMS, 4), np.float32), *_batch(["One two two", "", "x\ny\nx"]))
    assert len(asked) == 1 and len(spans) == 3  # words, shapes and lines


def test_shares_and_sums_of_texts_of_all_sizes():
    draw = np.random.default_rng(5)
    texts = ["", "a", *[" ".join(f"w{k}" for k in draw.integers(0, 40, n)) for n in (1, 7, 300, 9000, 3)], ""]
    data, at = _batch(texts)
    vectors = draw.normal(size=(quality.TERMS, 4)).astype(np.float32)
    found = quality.pooled(vectors, data, at)
    term, term_at = quality.terms(data, at)
    for k, text in enumerate(texts):
        w = text.split()
        assert np.isclose(found[k, -2], len(set(w)) / len(w) if w else 1.0)
        own = term[term_at[k] : term_at[k + 1]]
        for side in (0, 1):
            mean = vectors[own[side::2]].astype(float).sum(axis=0) / max(len(w), 1)
            assert np.allclose(found[k, 4 * side : 4 * side + 4], mean, atol=1e-5)
    assert quality._new_share(np.zeros(0, np.uint64), np.zeros(0, np.int64)).shape == (0,)
