"""Surrogates against a plain version, and the inputs that could exhaust the matcher or a format."""

import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from tesserae.llm import pii

KEY = "a key"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(raw):
    bare = raw.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def plain_kind(raw):
    digits = re.sub(r"\D", "", raw, flags=re.A)
    if "@" in raw:
        return "email"
    if re.fullmatch(r"[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+", raw):
        return "ipv6"
    if re.fullmatch(r"[A-Z]{2}\d\d[ A-Z0-9]+", raw):
        return "iban" if mod97(raw) == 1 else None
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", raw):
        return "ip"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", raw):
        return "ssn"
    if raw[0].isdigit() and len(digits) >= 13:
        return "card" if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65", digits) and luhn(digits) else None
    return "phone" if raw[0] in "+(0123456789" else "person"


def plain_canonical(kind, raw):
    digits = re.sub(r"\D", "", raw, flags=re.A)
    if kind in ("email", "ip", "ipv6"):
        return raw.lower()
    if kind == "iban":
        return raw.replace(" ", "")
    if kind in ("ssn", "card"):
        return digits
    if kind == "phone":
        return "1" + digits if len(digits) == 10 and raw[0] != "+" else digits
    return regex.sub("^" + pii._PREFIX, "", raw).lower()


def plainly(texts):
    """(kind, canonical, raw, end of what precedes it) of each entity of each text, and the text's parts between matches."""
    pattern = regex.compile(pii.PATTERN)
    for text in texts:
        found, parts, last = [], [], 0
        for m in pattern.finditer(text or ""):
            kind = plain_kind(m[0])
            if kind:
                found.append((kind, plain_canonical(kind, m[0]), m[0]))
                parts.append(text[last : m.start()])
                last = m.end()
        yield found, [*parts, (text or "")[last:]]


def check(before, after):
    """The whole operator by a plain version: the same entities found, all else kept, one surrogate for each entity and no two alike."""
    names: dict = {}
    for row, (found, parts) in zip(after, plainly(before), strict=True):
        counts = Counter(k for k, _, _ in found)
        assert {k: row[f"n_{k}"] for k in pii.KINDS} == {k: counts[k] for k in pii.KINDS}
        if not found:
            continue
        m = re.fullmatch("(.+?)".join(map(re.escape, parts)), row["text"], re.S)
        assert m, (parts, row["text"][:200])
        for (kind, canonical, raw), new in zip(found, m.groups(), strict=True):
            assert new != raw
            if kind != "person":
                assert re.sub(r"\w", "x", new) == re.sub(r"\w", "x", raw) or len(new) != len(raw) or kind in ("email", "ip")
            assert kind != "iban" or mod97(new) == 1 and new[:2] == raw[:2]
            name = plain_canonical(kind, new)
            assert plain_kind(new) == kind and names.setdefault((kind, canonical), name) == name
            assert kind != "card" or luhn(re.sub(r"\D", "", new))
    assert len({(k, v) for (k, _), v in names.items()}) == len(names)
    assert not {(k, v) for (k, _), v in names.items()} & names.keys()
    return names


def run(spark, texts):
    rows = pii.replace(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), KEY).collect()
    return [r for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_documents_against_the_plain_version(spark, data):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert len(check(texts, run(spark, texts))) > 10


def test_ways_of_writing(spark):
    texts = [
        "Mr Smith and John Smith, JOHN SMITH; my name is Zelda Quux. Señora Quux", "call 988 555 2485 or +1 988 555 2485 or 988-555-2485", "not 100 200 3000, 12 988 555 2485",
        "me llamo Rosa Prieto", "a@b.com. x@y.co.uk, lib@4.17.21, Ελένη Παππά, меня зовут Ольга Петрова", None, "", "+49 30 1234567",
    ]
    got = run(spark, texts)
    names = check(texts, got)
    assert got[2]["n_phone"] == 0 and got[4]["n_email"] == 2 and got[1]["n_phone"] == 3 and got[5]["text"] is None
    assert names["person", "smith"] == names["person", "john smith"].split()[1] and names["person", "quux"] == names["person", "zelda quux"].split()[1]
    assert got[0]["text"].split("; ")[1].startswith("my name is ")


def test_titles_names_accounts_and_addresses(spark):
    """Titles in any case and several of them, given names of other languages, IBAN with their check digits, IPv6; and what only looks like them."""
    texts = [
        "MR SMITH and Mr Smith", "Dr Wang Wei, Prof. Dr. Lena Weber; DR WEBER", "Emily Clark, Priya Natarajan, Olga Petrova and EMILY CLARK", "Dear Zoltan Kovacs, yours", "Dear Sir, dear all; Signed by the clerk",
        "DE89 3704 0044 0532 0130 00, DE89370400440532013000 and GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 01", "2001:db8:85a3:0:0:8a2e:370:7334, FE80::1 and fe80::1", "std::vector, A::B, at 12:30:45, a: b",
    ]
    got = run(spark, texts)
    names = check(texts, got)
    assert [r["n_person"] for r in got] == [2, 3, 4, 1, 0, 0, 0, 0, 0]
    assert [r["n_iban"] for r in got] == [0, 0, 0, 0, 0, 3, 0, 0, 0] and [r["n_ipv6"] for r in got] == [0, 0, 0, 0, 0, 0, 0, 3, 0]
    assert got[0]["text"].split()[1].lower() == got[0]["text"].split()[-1].lower() and got[0]["text"].startswith("MR ") and got[0]["text"].split()[1].isupper()
    assert got[4]["text"] == texts[4] and got[6]["text"] == texts[6] and got[8]["text"] == texts[8]
    assert names["person", "lena weber"].split()[-1] == names["person", "weber"]
    assert not any(n in r["text"].lower() for r in got for n in ("smith", "wang", "weber", "clark", "natarajan", "petrova", "kovacs"))


def test_long_addresses(spark):
    """Neither the matcher's stack nor its time grows with an address or a name."""
    texts = ["a@" + "b." * 100_000 + "com", "a" * 1_000_000 + "@x.com", "Mr " + "A'" * 300_000, "+2" * 200_000, "1-" * 300_000, "x@y.com " * 20_000]
    got = run(spark, texts)
    assert [r["n_email"] for r in got] == [0, 1, 0, 0, 0, 20_000] and len(got[1]["text"]) >= 1_000_006


def test_a_full_format_still_ends(spark):
    """All one-letter addresses at one-letter domains, and all numbers of one short format, are there: surrogates grow."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(f"{a}@{b}.de" for b in letters) for a in letters] + ["; ".join(f"+2 {a:02d} {b:02d}" for b in range(100)) for a in range(100)]
    names = check(texts, run(spark, texts))
    assert Counter(k for k, _ in names) == {"email": 676, "phone": 10_000}


def test_many_surnames(spark):
    """More surnames behind a title than four syllables make."""
    import itertools

    some = ["".join(x).capitalize() for x in itertools.islice(itertools.product("bcdfglmnprst", "aeiou", "bdlmnrst", "aeiou", "klmnrst", "aeio"), 0, 60_000)]
    texts = [" ".join(f"Mr {n}," for n in some[k : k + 1000]) for k in range(0, 60_000, 1000)]
    got = run(spark, texts)
    new = regex.findall(r"Mr (\p{L}+),", " ".join(r["text"] for r in got))
    assert len(new) == 60_000 == len(set(new)) and not set(new) & set(some)


def test_coreference_outlives_collisions(spark, monkeypatch):
    """Surnames that fall together are drawn anew as surnames, so whoever bears one keeps it."""
    plain = pii._surrogate
    monkeypatch.setattr(pii, "_surrogate", lambda: F.when((F.col("kind") == "surname") & (F.col("attempt") == 0), F.lit("same")).otherwise(plain()))
    texts = [f"Mr {s} and John {s}, Anna {s}." for s in ("Smith", "Jones", "Brown", "Weber")]
    names = check(texts, run(spark, texts))
    for s in ("smith", "jones", "brown", "weber"):
        assert len({v.split()[-1] for (_, c), v in names.items() if c.split()[-1] == s}) == 1


def test_extra_columns_of_any_name(spark):
    df = spark.createDataFrame([("a@b.com", 1, 2, 3, 4)], "text string, _rid int, _parts int, _raw int, _new int")
    row = pii.replace(df, KEY).first()
    assert (row["_rid"], row["_parts"], row["_raw"], row["_new"]) == (1, 2, 3, 4) and row["text"] != "a@b.com"


def test_given_names_change_places():
    names = pii.given_names(KEY)
    lists = [names for script in pii.GIVEN.values() for names in script.values()]
    assert len(names) == sum(map(len, lists)) and sorted(names) == sorted(names.values())
    assert all(names[n.lower()] in {x.lower() for x in some} - {n.lower()} for some in lists for n in some)
