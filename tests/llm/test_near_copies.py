"""The near-copy stage against brute force over five-word shingles."""

import random

import pytest

from tesserae.llm import near_copies


def sets_of(texts):
    out = {}
    for d, t in texts.items():
        w = t.lower().split()
        out[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return out


def brute(texts):
    """What stays: the smallest id of each component of pairs with 0.8 in common."""
    sets, root = sets_of(texts), {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def stay(spark, texts):
    return {r["doc_id"] for r in near_copies.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


@pytest.fixture(scope="module")
def words():
    return [f"w{k}" for k in range(400)]


def test_every_near_pair(spark, words):
    """Copies with one or two words changed, of texts of frequent words."""
    rng, texts = random.Random(5), {}
    for k in range(120):
        own = rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randint(30, 120))
        other = list(own)
        for _ in range(rng.randint(1, 2)):
            other[rng.randrange(len(other))] = rng.choice(words)
        texts |= {2 * k: " ".join(own), 2 * k + 1: " ".join(other)}
    assert stay(spark, texts) == brute(texts)


def test_crowded_keys(spark, words):
    """All texts share a passage that makes up half of many of them, so most keys of it hold texts that aren't copies."""
    rng, texts = random.Random(6), {}
    passage = [f"licence{k}" for k in range(40)]
    for k in range(60):
        own = passage + rng.choices(words, k=rng.randint(30, 60))
        texts |= {2 * k: " ".join(own), 2 * k + 1: " ".join([*own[:-2], "changed", own[-1]])}
    assert stay(spark, texts) == brute(texts)


def test_other_order_stays(spark, words):
    texts = {1: " ".join(words[:100]), 2: " ".join(reversed(words[:100])), 3: " ".join(words[:60] + words[200:240])}
    assert stay(spark, texts) == {1, 2, 3}


def test_few_different_words(spark, words):
    rng = random.Random(7)
    long = rng.choices(words[:19], k=3000)
    short = words[100:115]
    texts = {1: " ".join(long), 2: " ".join([*long[:-1], "x"]), 3: " ".join(short), 4: " ".join([*short[:-1], "x"]), 5: "a b c", 6: "a b d"}
    assert stay(spark, texts) == {1, 3, 5, 6} == brute(texts)
