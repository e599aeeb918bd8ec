"""The operators' inner parts against brute force, on small inputs."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tesserae.llm import common, decontaminate, fingerprints, html_text, near_copies, pieces, quality, secrets, simhash, token_ids, warc


def test_ascii_lower_keeps_offsets():
    assert common.ascii_lower("AÉİK") == "aÉİK"[:1] + "Éİ" + "k"


# --- 8: suffix automaton ---


def brute_hits(items, words, window):
    hit, names = set(), set()
    for name, item in items:
        n = min(window, len(item))
        for k in range(len(item) - n + 1) if n else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == item[k : k + n]:
                    hit.update(range(at, at + n))
                    names.add(name)
    return hit, names


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        alphabet = "abc"[: rng.randint(1, 3)]
        items = [(str(k), rng.choices(alphabet, k=rng.randint(0, 9))) for k in range(rng.randint(1, 4))]
        words = rng.choices(alphabet + "x", k=rng.randint(0, 40))
        spans, names, _ = decontaminate.SuffixAutomaton(items, 4).scan(words)
        got = set(itertools.chain.from_iterable(range(a, b) for a, b in spans))
        assert (got, names) == brute_hits(items, words, 4)
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(spans))


def test_without_spans():
    assert decontaminate.without_spans("A bb, CC dd.", [[1, 3]]) == "A  dd."
    assert decontaminate.words_of("É x_y 1") == ["É", "x", "y", "1"]


# --- 5: secrets ---


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.pattern, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_against_plain_expressions():
    rng, words = random.Random(1), secrets.prefilter()
    parts = ["password", "passwd", "secret", "token", "api_key", "APIKEY", '"', " ", ":", "=", "'", "abc", "123456", "AKIA", "ABCDEFGHIJ0123456", "é", "ſecret", "deadbeef", "0123456789abcdef", "\n", "K", "-_"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert [s for s in secrets.find(text, words) if s[1] < 3] == brute_secrets(text)


def test_checksums():
    import zlib

    body = "z" * 30
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()))
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert [secrets.KINDS[k] for _, k, _ in secrets.find(f"x {good} {bad} npm_{good[4:]}", secrets.prefilter())] == ["github", "npm"]
    assert secrets.masked("abcdef", [(1, 3), (2, 4)], "#") == "a#ef"


# --- 3: token files ---


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    values[rng.random(n) < 0.9] %= 300
    data, index = token_ids.pack(values)
    assert (token_ids.unpack(np.frombuffer(data, np.uint8), index) == values).all()


def test_file_round_trip_and_random_access():
    rng, out = np.random.default_rng(0), token_ids.Writer()
    docs = [rng.integers(0, 60_000, rng.integers(0, 3000)).astype("<u4") for _ in range(200)]
    for k, ids in enumerate(docs):
        out.add(k or None, ids.tobytes())
    file = token_ids.File(b"".join(out.chunks()))
    got = list(file.documents(most=1000))
    assert [g[0] for g in got] == [None, *range(1, 200)]
    assert all((a == g[2]).all() for a, g in zip(docs, got, strict=True))
    whole = np.concatenate(docs)
    assert (file.ids(777, 5000) == whole[777:5000]).all()


def test_encoder_equals_the_library():
    encode = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a<|endoftext|>b", "漢字 kana  \n\n x", "it's we'll 'tis don't\t y z", "x" * 3000, "́e", "a\n b", "a \n", "12a4 _x_ ½ a\tb,  x", "À É œ ß 12,34.5 a.b", "The thtion, ndst. On the onand!", "l'été ñandú straße"]
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(encode(text, b""), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


# --- 2: sampled segmentations ---


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def segmentations(lattice, unit):
    if not unit:
        yield (), 1.0
    for n in range(1, len(unit) + 1):
        found = lattice.weights.get(unit[:n])
        if found is None and n == 1:
            found = (lattice.byte_id[ord(unit[0])], lattice.byte_weight)
        if found:
            for rest, weight in segmentations(lattice, unit[n:]):
                yield (found[0], *rest), found[1] * weight


def test_samples_follow_the_distribution(lattice):
    text, n = "the cat\n", 8000
    every = [(sum((a for a, _ in c), ()), math.prod(b for _, b in c)) for c in itertools.product(*(list(segmentations(lattice, u)) for u in pieces.units_of(text)))]
    total = sum(w for _, w in every)
    p = {a: w / total for a, w in every}
    found = pieces.sample_texts(lattice, [text] * n, list(range(n)), 3)
    assert all(len({s.ids.tobytes() for s in r}) == 3 for r in found)
    assert all(r[0].value >= r[1].value >= r[2].value for r in found)
    first, second = (Counter(tuple(r[k].ids.tolist()) for r in found) for k in (0, 1))
    for a in sorted(p, key=p.get)[-4:]:
        assert abs(first[a] / n - p[a]) < 0.02
        assert abs(second[a] / n - sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)) < 0.02
    assert found[0][0].log == pytest.approx(math.log(p[tuple(found[0][0].ids.tolist())]), abs=1e-4)
    # Inclusion scores weigh a sample without bias.
    assert np.mean([sum(math.exp(s.log - s.inclusion) for s in r) for r in found]) == pytest.approx(1, abs=0.02)


def test_samples_decode_and_end(lattice):
    texts = ["", "a", "漢字 kana", "a  b   c\n\n x", "x" * 2000, " lead", "tail ", "\x00é½²", "the " * 500, "▁"]
    for text, samples in zip(texts, pieces.sample_texts(lattice, texts, list(range(len(texts))), 3), strict=True):
        assert samples and all(lattice.decode(s.ids) == text.replace("▁", " ") for s in samples)
        assert len({s.ids.tobytes() for s in samples}) == len(samples)
    assert len(pieces.sample_texts(lattice, [""], [1], 3)[0]) == 1


def test_samples_depend_on_the_key_alone(lattice):
    texts = ["the quick brown fox", "jumps over", "the lazy dog and more"]
    together = pieces.sample_texts(lattice, texts, [7, 8, 9], 2)
    lattice.clear()
    alone = [pieces.sample_texts(lattice, [t], [k], 2)[0] for t, k in zip(texts, (7, 8, 9), strict=True)]
    assert [[s.ids.tolist() for s in r] for r in together] == [[s.ids.tolist() for s in r] for r in alone]


# --- 6 and the near copies of the pipeline ---


def test_simhash_against_its_definition():
    import xxhash

    def plain(text, width):
        words = re.findall(r"[^\x20\x09-\x0D]+", common.ascii_lower(text))
        if not words:
            return 0
        grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for text in ("", " \n", "One", "one TWO", "a b c d e f g", "É x y\x0bz w", "the " * 50):
        assert simhash.print_of(text, 3) % 2**64 == plain(text, 3)


def test_near_copy_prints():
    base = [f"word{k}" for k in range(100)]
    near = base[:50] + ["other"] + base[51:]
    bits = lambda a, b: bin(int.from_bytes(near_copies.print_of(a)) ^ int.from_bytes(near_copies.print_of(b))).count("1")
    assert bits(" ".join(base), " ".join(near)) <= near_copies.MAX_BITS
    assert bits(" ".join(base), " ".join(f"x{k}" for k in range(100))) > 30
    assert near_copies.print_of("A b") == near_copies.print_of("a  B\n") != near_copies.print_of("a c")


# --- 9: fingerprints ---


def test_walks_side_by_side_equal_single_ones():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcé 漢", k=rng.randint(0, 400))) for _ in range(120)]
    walk = fingerprints.walker()
    assert walk(texts) == [walk([t])[0] for t in texts]


def test_likeness():
    rng = random.Random(4)
    a = "".join(rng.choices("abcdefgh ", k=3000))
    b = "".join(rng.choices("abcdefgh ", k=3000))
    near = a[:1500] + "x" + a[1500:]
    fa, fb, fn, fe = fingerprints.walker()([a, b, near, fingerprints.edited(a, b)])
    assert fingerprints.likeness(fa, fa) == 1 and fingerprints.likeness(b"", b"") == 1 and fingerprints.likeness(fa, b"") == 0
    assert fingerprints.likeness(fa, fn) > 0.8 > fingerprints.likeness(fa, fe) > 0.5 > 0.1 > fingerprints.likeness(fa, fb)


# --- 4: main text ---


def test_main_text():
    long = "the quick brown fox is on the hill and it was not there for a while with us all " * 4
    page = f"<html><head><title>T</title><script>'<p>no</p>'</script></head><body><nav><a href=x>Menu</a></nav><div class=ad>Buy &amp; go</div><article><h1>Head &amp; more</h1><p><b>One<br>two<p>Th&eacute;  end &lt;p&gt;</article><footer>x</footer></body></html>"
    assert html_text.main_text(page) == "Head & more\n\nOne two\n\nThé end <p>"
    plain = f"<body><div id='cookie-notice'>We use the cookies of all</div><h2>A title</h2><p>{long}</p><p>Short.</p><ul><li><a href=x>Link</a></li></ul><div class='comments'><p>{long}</p></div>"
    assert html_text.main_text(plain) == "A title\n\n" + long.strip() + "\n\nShort."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<!-- x", "<script>x")] == [""] * 5


def test_second_pass():
    assert html_text.second_pass([0, 1, 0, 0, -1, 0]) == [True, True, True, False, False, False]
    assert html_text.second_pass([0, 0]) == [False, False]


# --- 7: records ---


def test_capture_round_trip():
    data = warc.capture(3, "https://a.org/x\ny", "é".encode(), None, None, "a") + warc.capture(None, None, b"", 3, "u", "b")
    found = list(warc.parse(data))
    assert [h["warc-type"] for h, _ in found] == ["request", "response", "metadata", "request", "revisit", "metadata"]
    assert found[0][0]["warc-concurrent-to"] == found[1][0]["warc-record-id"] == found[2][0]["warc-concurrent-to"]
    assert warc._row(*found[1], True)[-1] == "é".encode() and warc._row(*found[4], True)[6] == 0


# --- 1: ranking ---


def test_ranking_separates():
    rng = np.random.default_rng(0)
    good = rng.random(600) < 0.8
    rows = rng.normal(size=(600, 5)) + good[:, None] * np.array([3, 0, 0, -2, 0])
    model = quality.fit(rows, good)
    assert ((model.score(rows) >= quality.CUT) == good).mean() > 0.95
    assert quality.fit(rows, np.ones(600, bool)).score(rows).tolist() == [0.5] * 600
    assert all(np.isfinite(quality.features(t)).all() for t in (None, "", " ", "a", "\n\n", "x" * 100_000))
