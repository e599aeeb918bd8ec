"""The embedding against a step-by-step walk, bands and links against all pairs."""

import random

import numpy as np
import pytest

from tesserae.llm import fingerprints


def walked(text):
    """A walk that takes each step by itself: the text's place at every step until its end."""
    moves = np.random.Generator(np.random.PCG64(20240607)).random((fingerprints.PERIOD, 256)) < 0.5
    codes = [ord(c) for c in text]
    place, places, stayed = 0, [], 0
    while place < len(codes):
        places.append(place)
        h = ((codes[place] * 2654435761) & 0xFFFFFFFF) >> 24
        stayed += 1
        if moves[(len(places) - 1) % fingerprints.PERIOD][h] or stayed == 255:
            place, stayed = place + 1, 0
    return codes, places


def test_walk_step_by_step():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc déf\U0001f600", k=n)) for n in (1, 2, 17, 300, 5000)]
    steps = fingerprints.walker().steps
    for text, found in zip(texts, fingerprints.walker()(texts), strict=True):
        codes, places = walked(text)
        for k, byte in enumerate(found):
            step = int(steps[k])
            if step >= len(places):
                assert byte == 0
                continue
            gram = 0
            for c in [*codes[places[step] : places[step] + 4], 0, 0, 0][:4]:
                gram = (gram + c + 1) * 0x9E3779B97F4A7C15 % 2**64
            assert byte == (gram >> 40) % 255 + 1
        assert len(found) % fingerprints.SAMPLES == 0 and int(steps[len(found) - 1]) >= len(places) - 1


def components(names, linked):
    root = {n: n for n in names}
    for a, b in linked:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = {n: low if r == high else r for n, r in root.items()}
    return root


@pytest.mark.parametrize("kind", ["documents", "crowded"])
def test_recall_of_all_pairs(spark, data, kind):
    """Of all pairs with likeness of 0.8 or more nine in ten at least are of one class, and no class goes beyond what links reach."""
    if kind == "documents":
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/../sf0.01/documents.parquet").collect()}
    else:  # copies with a few edits, so bands hold many of them
        rng = random.Random(4)
        base = "".join(rng.choices("abcdefgh ", k=1500))
        texts = {}
        for k in range(250):
            own = list(base)
            for _ in range(rng.randint(0, 40)):
                own[rng.randrange(len(own))] = rng.choice("abcdefgh ")
            texts[k] = "".join(own)
    names = sorted(texts)
    prints = dict(zip(names, fingerprints.walker()([texts[n] or "" for n in names]), strict=True))
    linked = [(a, b) for a in names for b in names if a < b and fingerprints.likeness(prints[a], prints[b]) >= 0.8]
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(frame).collect()}
    print(len(linked), sum(got[a] == got[b] for a, b in linked))
    assert len(linked) > 20 and sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    root = components(names, linked)
    assert all(root[n] == root[got[n]] for n in names)
