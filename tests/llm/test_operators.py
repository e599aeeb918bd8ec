"""The operators on Spark: contracts, nulls, empty and long texts, ties, empty tables and clashing columns."""

import hashlib
import zlib

import public_tokenizers
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tesserae.llm import common, decontaminate, fingerprints, html_text, near_copies, pieces, pii, quality, queries, secrets, simhash, token_ids, warc
from tesserae.llm.common import shared_dir

LONG = "thtion onand the of ndst " * 8000
#: A null, an empty and a blank text, copies, a very long text, a repeated row, a null id.
DOCS = [(1, None), (2, ""), (3, " \n"), (4, "One two three four"), (5, "one TWO three four"), (6, LONG), (4, "One two three four"), (None, "no id here"), (8, "password = hunter22 x 0123456789abcdef01234567")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, duck, data, name):
    found = queries.QUERIES[name](spark, data).toPandas()
    assert rows(found) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_decontamination(spark, docs, nothing):
    bench = spark.createDataFrame([(1, "two three four"), (1, "two three four"), (2, None), (3, ""), (None, "no id")], "item_id long, text string")
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("extra", F.lit(1))
    found = decontaminate.scan(clash, bench)
    assert "extra" in found.columns
    got = {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.digest(found).collect()}
    assert {(1, 0, 0, False), (2, 0, 0, False), (4, 3, 1, True), (5, 3, 1, True), (6, 0, 0, False), (None, 2, 1, True)} <= got
    assert found.count() == len(DOCS)
    assert decontaminate.digest(decontaminate.scan(nothing, bench)).count() == 0
    assert decontaminate.digest(decontaminate.scan(docs, bench.limit(0))).filter("contaminated").count() == 0
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(decontaminate.scan(docs, bench), max_words=3).collect()}
    assert kept[4] == "One " and kept[1] is None and kept[None] == "no id here"
    assert None not in {r["doc_id"] for r in decontaminate.clean(docs, bench, max_words=3, max_coverage=0.6).collect()}
    parts = decontaminate.clean(docs, bench, max_words=3, shard_words=2).collect()
    assert sorted(map(str, parts)) == sorted(map(str, decontaminate.clean(docs, bench, max_words=3).collect()))


def test_decontamination_in_shards(spark, data):
    d, b = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    one = decontaminate.digest(decontaminate.scan(d.select("doc_id", "text"), b)).toPandas()
    many = decontaminate.digest(decontaminate.scan(d.select("doc_id", "text"), b, shard_words=400)).toPandas()
    assert rows(one) == rows(many) and one.contaminated.any()


def test_secrets(docs, nothing):
    found = secrets.scan(docs.withColumn("secrets", F.lit(1)).withColumn("kind", F.lit("k")))
    got = {r["doc_id"]: r for r in secrets.digest(found).collect()}
    assert got[8]["spans"] == "assign:0:19,hex:22:46" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(docs)).collect()}
    assert masked[8] == "[SECRET] x [SECRET]" and masked[4] == "One two three four" and masked[1] is None
    assert secrets.digest(secrets.scan(nothing)).count() == 0


def brute_tokens(pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for key, text in pairs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_token_files(spark, data, docs, nothing, monkeypatch):
    d = spark.read.parquet(f"{data}/documents.parquet")
    folder = shared_dir(spark) + "/t"
    files = token_ids.write(d, folder, public_tokenizers.path("byte_bpe_50k.json"), end=2, file_bytes=50_000)
    assert files.count() > 3
    got = sorted(tuple(r)[:4] for r in token_ids.read(spark, folder, files).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(brute_tokens(sorted((r["doc_id"], r["text"]) for r in d.collect())))
    monkeypatch.setattr(common, "MOST_RANGES", 2)  # then a range has several files
    folder = shared_dir(spark) + "/t"
    files = token_ids.write(d, folder, public_tokenizers.path("byte_bpe_50k.json"), end=2, file_bytes=20_000)
    assert files.count() > 4
    assert got == sorted(tuple(r)[:4] for r in token_ids.read(spark, folder, files).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    folder = shared_dir(spark) + "/t"
    files = token_ids.write(docs.withColumn("file", F.lit(1)).withColumn("key", F.lit(2)), folder, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    back = token_ids.read(spark, folder, files).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 2, 3, 4, 4, 5, 6, 8] and [r["n_tokens"] for r in back][1:3] == [1, 1]
    folder = shared_dir(spark) + "/t"
    assert token_ids.read(spark, folder, token_ids.write(nothing, folder, public_tokenizers.path("byte_bpe_50k.json"), end=2)).count() == 0


def test_main_texts(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (2, None, "<article>a</article>", "t"), (3, "u", "<article>" + "<p>x y</p>" * 5000, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).orderBy("page_id", F.length("text")).collect()
    assert [len(r["text"]) for r in got] == [0, 0, 1, 5000 * 5 - 2]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_archives(spark):
    big = "<p>é</p>" * 200
    pages = spark.createDataFrame([(1, "a", big, 0), (2, "b", big, 0), (3, None, big, 0), (3, None, big, 0), (4, "c", "s", 0), (5, "d", "s", 0), (6, "e", None, 0), (None, "f", big, 0)], "page_id long, url string, html string, digest int")
    folder = shared_dir(spark) + "/w"
    assert warc.write(warc.marked(pages), folder, file_bytes=500).agg(F.sum("captures")).first()[0] == 8
    got = warc.assemble(warc.read(spark, folder)).select("page_id", "url", "refers_to", "response.*", F.col("request.record_id").alias("q"), F.col("metadata.record_id").alias("m")).collect()
    assert len(got) == 8 and all(r["q"] and r["m"] for r in got)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] != 3) == [(0, "revisit", 3, 1800), (1, "revisit", 3, 1800), (2, "revisit", 3, 1800), (4, "response", None, 1), (5, "response", None, 1), (6, "response", None, 0)]
    assert [(r["record_type"], r["url"], bytes(r["payload"]).decode()) for r in got if r["page_id"] == 3] == [("response", None, big)] * 2
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 1800} == {hashlib.sha1(big.encode()).hexdigest()}


def brute_components(found):
    prints = sorted({fp for _, fp in found})
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin((a ^ b) % 2**64).count("1") <= 2:
                root[top(a)] = top(b)
    least = {}
    for d, p in found:
        least[top(p)] = min(least.get(top(p), 1 << 62), d)
    return {(d, p): least[top(p)] for d, p in found}


@pytest.mark.parametrize("hot", [256, 2])
def test_components_of_planted_bits(spark, hot):
    import random

    rng = random.Random(hot)
    found = []
    for c in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            fp = base
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
            found.append((len(found) + 1, fp - 2**64 if fp >= 2**63 else fp))
    found += [(900, 0), (901, 0), (902, 3), (903, -1), (904, (2**64 - 1) ^ 3 << 62)]
    df = spark.createDataFrame(found, "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(df, shared_dir(spark), hot=hot).collect()}
    assert got == brute_components(found)


def test_near_duplicates(docs, nothing):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit(1)).withColumn("n", F.lit(1))).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)} <= got
    assert simhash.near_duplicates(nothing).count() == 0


def test_near_copies(spark, docs, nothing):
    base = [f"word{k}" for k in range(200)]
    rows_ = [(10, " ".join(base), "a"), (11, " ".join([*base[:-1], "x"]), "b"), (12, " ".join(reversed([f"y{k}" for k in range(200)])), "c"), (9, " ".join(["z", *base[1:]]), "d"), (12, "other", "e"), (12, "other", "e"), (None, "other", "f")]
    got = near_copies.deduplicated(spark.createDataFrame(rows_, "doc_id long, text string, _p0 string")).collect()
    assert sorted(r["doc_id"] for r in got) == [9, 12, 12]
    assert near_copies.deduplicated(nothing).count() == 0
    assert sorted(r["doc_id"] or 0 for r in near_copies.deduplicated(docs).collect()) == [0, 1, 4, 6, 8]


def test_fingerprints(spark, data, docs, nothing, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 50_000)
    d = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    order = sorted(texts, reverse=True)
    after = {k: texts[order[(i + 1) % len(order)]] for i, k in enumerate(order)}
    for part in (d, fingerprints.with_next(d, range_bytes=60_000) and d):
        for r in fingerprints.compare_edits(part).collect():
            want = fingerprints.edited(texts[r["doc_id"]], after[r["doc_id"]])
            assert r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["n_chars"] == len(texts[r["doc_id"]])
            assert r["fingerprint"] == fingerprints.walker()([texts[r["doc_id"]]])[0].hex()
    assert fingerprints.compare_edits(nothing).count() == 0
    assert fingerprints.compare_edits(docs.withColumn("halo", F.lit(1)).withColumn("part", F.lit(1))).count() == len(DOCS)
    single = fingerprints.compare_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0


def test_ranges_cover_all(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    found = fingerprints.with_next(d, range_bytes=40_000)
    parts = found.filter("halo = 0").groupBy("part").count().count()
    assert parts > 3 and found.filter("halo = 1").count() == parts and found.filter("halo = 0").count() == d.count()


def test_near_classes(spark, nothing):
    import random

    rng = random.Random(9)
    a, b = ("".join(rng.choices("abcdefgh ", k=2000)) for _ in range(2))
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(spark.createDataFrame([(1, a), (2, a), (3, a[:1900] + "x" + a[1900:]), (4, b), (5, "")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert fingerprints.near_classes(nothing).count() == 0


def test_surrogates(spark, docs, nothing):
    texts = [
        "Call +1 (988) 555-2485 or (988) 555-2485", "mail A.B@X.EXAMPLE.COM and a.b@x.example.com, c@x.example.com", "ip 70.123.182.155. not 4.0", "card 4041894974608795 and 4041 8949 7460 8795, not 7536784127813050",
        "Mr. John Smith met Anna Smith; ANNA SMITH. Иван Иванов", None, "", "nothing The Quick", "id 123-45-6789",
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, kind string").withColumn("n_email", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.replace(df, "key").collect()}
    assert got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == texts[7] and got[0]["kind"] == "x"
    import re

    phones = re.findall(r"\((\d{3})\) (\d{3}-\d{4})", got[0]["text"])
    assert phones[0] == phones[1] and phones[0] != ("988", "555-2485") and got[0]["text"].startswith("Call +1 (")
    mails = re.findall(r"\S+@[\w.]+\w", got[1]["text"])
    assert mails[0] == mails[1].upper() and mails[0] != "A.B@X.EXAMPLE.COM" and len({m.lower().split("@")[1] for m in mails}) == 1
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[3]["text"])
    assert cards[0] == cards[1].replace(" ", "") != "4041894974608795" and cards[2] == "7536784127813050"
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(cards[0]))) % 10 == 0
    name = re.match(r"Mr\. (\w+) (\w+) met (\w+) (\w+); (\w+) (\w+)\. (\w+) (\w+)$", got[4]["text"])
    assert name[1] in pii.GIVEN["latin"]["m"] and name[3] in pii.GIVEN["latin"]["f"] and name[2] == name[4] != "Smith"
    assert name[5] == name[3].upper() and name[6] == name[4].upper() and name[7] in pii.GIVEN["cyrillic"]["m"]
    assert got[2]["n_ip"] == 1 and got[2]["text"].endswith(" not 4.0") and "6789" not in got[8]["text"]
    assert pii.replace(nothing, "key").count() == 0 and pii.replace(docs, "key").count() == len(DOCS)


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With a space of few surrogates, collisions are drawn anew until all differ from each other and from all originals."""
    monkeypatch.setattr(pii, "_surrogate", lambda: F.concat(F.lit("s"), F.pmod(F.xxhash64("canonical", "attempt"), F.lit(40)).cast("string")))
    e = spark.createDataFrame([("email", f"s{k}", "") for k in range(12)], "kind string, canonical string, gender string")
    got = pii.surrogates(e, "k", shared_dir(spark)).collect()
    assert len({r["surrogate"] for r in got}) == 12 and not {r["surrogate"] for r in got} & {f"s{k}" for k in range(12)}


def test_classifier(spark, data, docs, nothing):
    d, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(*quality.sample(d, labels.filter(~quality.held_out())))
    got = quality.scored(d.withColumn("score", F.lit("clash")), model).join(labels, "doc_id")
    held = got.filter(quality.held_out()).select(F.avg((((F.col("score") >= quality.CUT).cast("int")) == F.col("quality")).cast("int")).alias("a")).first()["a"]
    assert held > 0.9
    assert quality.scored(docs, model).filter("score between 0 and 1").count() == len(DOCS)
    assert quality.scored(nothing, model).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1)], "doc_id long, quality int")
    assert quality.scored(docs, quality.fit(*quality.sample(docs, odd))).filter("score = 0.5").count() == len(DOCS)
    assert quality.held_out("doc_id") is not None
    r = spark.createDataFrame([(k,) for k in range(50)], "doc_id long").withColumn("h", quality.held_out()).collect()
    assert all(x["h"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)


def test_segmentations(docs, nothing):
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.sample(docs.withColumn("sample", F.lit("x")), model, k=2).collect()
    assert all(r["round_trip"] for r in got) and sum(r["sample"] == 0 for r in got) == len(DOCS)
    assert [(r["n_tokens"], r["log_prob"], r["log_inclusion"]) for r in got if r["doc_id"] in (1, 2)] == [(0, 0.0, 0.0)] * 2
    twice = [bytes(r["ids"]) for r in got if r["doc_id"] == 4]
    assert len(twice) == 4 and len(set(twice)) == 2
    assert pieces.sample(nothing, model).count() == 0
    back = pieces.decode(pieces.encode(docs.filter("doc_id = 4"), model).drop("text"), model)
    assert back.first()["text"] == "One two three four"


def test_quality_sample_takes_repeated_documents_once(spark, data):
    """The sample is the same with every document there three times; labels aren't what is cut by."""
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    few = quality.sample(docs, labels, rows=60)
    many = quality.sample(docs.unionByName(docs).unionByName(docs), labels, rows=60)
    assert len(few[1]) == 60 and (few[0] == many[0]).all() and (few[1] == many[1]).all()
    share = labels.selectExpr("avg(quality)").first()[0]
    assert abs(few[1].mean() - share) < 0.2


def test_fit_finds_the_least_loss():
    """Newton's method against plain gradient descent on the same preference pairs."""
    import numpy as np

    pick = np.random.default_rng(3)
    rows, good = pick.normal(size=(300, 4)), pick.random(300) < 0.5
    rows[good] += [0.8, -0.5, 0, 0.3]
    model = quality.fit(rows, good, pairs=3000, seed=11)
    x = ((rows - rows.mean(axis=0)) / rows.std(axis=0)).clip(-8, 8)
    rng = np.random.default_rng(11)
    d = x[rng.choice(np.flatnonzero(good), 3000)] - x[rng.choice(np.flatnonzero(~good), 3000)]
    w = np.zeros(4)
    for _ in range(4000):
        p = 1 / (1 + np.exp(d @ w))
        w -= 0.5 * (2e-3 * w - p @ d / 3000)
    assert np.abs(w - model.weights).max() < 0.02


def test_clean_keeps_clashing_columns_with_any_number_of_automata(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l tail", 7, "x"), (2, "nothing here", 8, "y")], "doc_id long, text string, n_words long, hit_spans string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "other words of an item that stand apart from it all")], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.clean(docs, bench, max_coverage=1.1).collect()))
    two = sorted(map(tuple, decontaminate.clean(docs, bench, max_coverage=1.1, shard_words=12).collect()))
    assert one == two == [(1, " tail", 7, "x"), (2, "nothing here", 8, "y")]
