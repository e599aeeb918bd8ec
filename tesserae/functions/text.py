"""Text columns: tokens, chunks, code analysis, intent, expansion; the Porter stem in an Arrow UDF over distinct terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import fixed


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_tokens(text: Column) -> Column:
    """Tokens of a code or strict query."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_./:\-]+"), F.lit(0))


def chunks(text: Column, size: int = 1400) -> Column:
    """Pieces of `size` characters, after three or more line ends became two."""
    tidy = F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))
    count = F.ceil(F.length(tidy) / size).cast("int")
    return F.when(F.length(tidy) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(tidy, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def imports(code: Column, language: Column) -> Column:
    """D30."""
    lines = F.transform(F.split(code, "\n"), F.trim)
    return F.array_distinct(
        F.when(language == "python", F.filter(lines, lambda x: x.startswith("import ") | x.startswith("from ")))
        .when(language.isin("javascript", "typescript"), F.filter(lines, lambda x: x.contains("import ") | x.contains("require(")))
        .when(language == "java", F.filter(lines, lambda x: x.startswith("import ")))
        .otherwise(F.array().cast("array<string>"))
    )


def _found(code: Column, language: Column, patterns: dict[str, str]) -> Column:
    chain = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, pattern in patterns.items():
        chain = chain.when(language == name, F.regexp_extract_all(code, F.lit(pattern), F.lit(1)))
    return F.array_distinct(chain.otherwise(F.array().cast("array<string>")))


def types(code: Column, language: Column) -> Column:
    """D31."""
    return _found(code, language, fixed.TYPE_PATTERNS)


def functions(code: Column, language: Column) -> Column:
    """D32."""
    return _found(code, language, fixed.FUNCTION_PATTERNS)


def file_language(path: Column) -> Column:
    """J6."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    chain = F.when(F.lit(False), F.lit(""))
    for name, language in fixed.EXTENSION_LANGUAGE.items():
        chain = chain.when(extension == name, F.lit(language))
    return chain.otherwise("text")


def intent(query: Column) -> Column:
    """The first list with a substring of the query."""
    low = F.lower(query)
    chain = F.when(F.lit(False), F.lit(""))
    for name, words in fixed.INTENTS:
        chain = chain.when(low.rlike("|".join(words)), F.lit(name))
    return chain.otherwise("general")


def expansions(query: Column) -> Column:
    """The query's five variants, in order."""
    q = F.trim(query)
    return F.array(q, *(F.concat(q, F.lit(" " + x)) for x in ("documentation", "api reference", "tutorial", "github")))


def authority(url: Column, intent_: Column, scraped: Column, learned: Column, affinity: Column) -> Column:
    """E30."""
    low = F.lower(url)
    chain = F.when(F.lit(False), F.lit(0))
    for name, (rules, otherwise) in fixed.AUTHORITY.items():
        inner = F.when(F.lit(False), F.lit(0))
        for words, points in rules:
            inner = inner.when(low.rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(points))
        chain = chain.when(intent_ == name, inner.otherwise(otherwise))
    return F.greatest(F.lit(0.1), chain.cast("double") + F.when(scraped, 0.5).otherwise(0.0) + (learned - 1) + affinity * 0.1)


# --- Porter's algorithm (1980) ---------------------------------------------------------------------------------------

STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and such with other characters than a-z stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or _measure(word) == 1 and _short(word):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + new
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if _double(word) and word[-1] == "l" and _measure(word) > 1:
        word = word[:-1]
    return word


def stems(terms: DataFrame, *, term: str = "term", into: str = "stem") -> DataFrame:
    """Distinct terms with their stem added; meant for a dictionary of terms that is joined back, not for all tokens."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [porter(x) if x is not None else None for x in batch.column(term).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, into])

    return terms.mapInArrow(run, T.StructType([*terms.schema.fields, T.StructField(into, T.StringType())]))
