"""Near-duplicates by pairs of words against brute force, and the keys of tensors."""

import random

import numpy as np
import pytest
from barloom.llm import neardup, setjoin
from barloom.llm.textkernel import U, mix
from tests.llm.reference_rules import words
from tests.llm.test_operators import documents, edge_rows, near_corpus


def pairs_of(text):
    w = words(text)
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute(rows):
    sets = [pairs_of(t) for _, t in rows]

    label = list(range(len(rows)))
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None] if sets[k] else [i]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[k]), least, i == least))
    return out


def close_corpus(seed):
    """Texts with one to a dozen changed words among 20 to 90, so that many pairs are near the threshold, and a hot template."""
    draw, rows = random.Random(seed), []
    template = [f"t{k}" for k in range(40)]
    for base in range(50):
        text = [f"b{base}w{draw.randrange(10**6)}" for _ in range(draw.choice([1, 2, 3, 5, 20, 50, 90]))]
        if base % 4 == 0:
            text = template + text[: draw.randrange(1, 14)]
        for _ in range(draw.randrange(1, 9)):
            new = list(text)
            for _ in range(draw.randrange(0, 1 + len(new) // 12)):
                new[draw.randrange(len(new))] = f"e{draw.randrange(10**6)}"
            rows.append(" ".join(new))
    return [(k * 7 % 1009, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("rows", [edge_rows(), close_corpus(1), close_corpus(2), near_corpus(4)], ids=["edges", "close", "close2", "near"])
def test_components_equal_brute_force(spark, rows):
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize(("small", "most"), [(1, 200_000), (3, 0), (1, 0)])
def test_large_groups_lose_no_link(spark, monkeypatch, small, most):
    monkeypatch.setattr(setjoin, "SMALL_GROUP", small)
    monkeypatch.setattr(setjoin, "MOST_HEAVY", most)
    rows = close_corpus(7)
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, brute(rows)))


def test_exact_join_and_none(spark):
    rows = close_corpus(9)
    out = neardup.join(documents(spark, rows), exact=True).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == sorted((i, c) for i, _, c, _ in brute(rows))
    assert neardup.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_few_minhashes_make_many_keys():
    tokens = np.unique(mix(np.arange(500, dtype=U)))
    at = np.array([0, 0, 1, len(tokens)])
    keys = neardup.tensor_keys(tokens, at)
    assert [len(k) for k in keys] == [0, 64, 64] and len(set(keys[2].tolist())) == 64
    assert neardup.minhashes(tokens, at).shape == (3, 64)
    # a collection on one side and one on the other make a key: equal keys come in whole blocks of a tensor
    half = np.sort(np.concatenate([tokens[:450], np.unique(mix(np.arange(900, 950, dtype=U)))]))
    same = (neardup.tensor_keys(tokens, np.array([0, len(tokens)]))[0] == neardup.tensor_keys(half, np.array([0, len(half)]))[0]).reshape(4, 4, 4)
    for table in same:
        assert table.any() and (table == table.any(axis=1)[:, None] & table.any(axis=0)[None, :]).all()


def test_misses_are_as_rare_as_stated():
    """Pairs of sets just at 0.8: one tensor misses about 0.033 of them."""
    draw, missed, trials = np.random.default_rng(3), 0, 1500
    for _ in range(trials):
        pool = np.unique(draw.integers(0, 1 << 63, 120).astype(U))
        both, a, b = pool[:80], pool[80:90], pool[90:100]
        one, two = (np.sort(np.concatenate([both, x])) for x in (a, b))
        same = neardup.tensor_keys(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]))
        missed += not (same[0][:16] == same[1][:16]).any()
    assert 0.015 < missed / trials < 0.055
