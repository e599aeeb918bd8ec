"""URL columns: normalisation, domains, safety checks, gates and scores. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import fixed


def any_of(column: Column, words: list[str]) -> Column:
    """Whether a string contains one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | column.contains(word)
    return found


def normalize(url: Column) -> Column:
    """Without fragment and trailing slashes of the path; the query stays."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"/+(?=\?|$)", "")


def normalize_source(url: Column) -> Column:
    """Scheme and host lower-cased, one trailing slash of the path off, empty without scheme or host."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?"
    path = F.regexp_extract(url, parts, 3)
    path = F.when(path == "", F.lit("/")).when((path != "/") & path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    whole = F.concat(F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)), path, F.regexp_extract(url, parts, 4))
    return F.when(url.rlike(parts), whole).otherwise(F.lit(""))


def strip_fragment(url: Column) -> Column:
    """The form by which a crawl tells pages apart."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def raw_file(url: Column) -> Column:
    """C4: a repository's blob page as the raw file."""
    return F.when(url.contains("github.com") & url.contains("/blob/"), F.replace(F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com")), F.lit("/blob/"), F.lit("/"))).otherwise(url)


def domain(url: Column) -> Column:
    """Authority as written, `unknown` if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("unknown"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(domain(url), "^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def safety(url: Column, allowed: list[str] | None = None) -> Column:
    """`ok`, or why a URL must not be fetched: scheme, host, blocked name or suffix, address range, allow-list.

    IPv4 ranges are tested by arithmetic on the octets, IPv6 literals by their prefixes.
    """
    h = F.regexp_replace(F.regexp_replace(host(url), r"^\[", ""), r"\].*$", "")
    octets = F.split(h, r"\.")
    a, b = octets.getItem(0).try_cast("int"), F.get(octets, F.lit(1)).try_cast("int")
    v4 = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    reserved = (a == 0) | (a == 127) | ((a == 169) & (b == 254)) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.between(18, 19))
    v6 = h.contains(":") & h.rlike("^(::1?$|f[cd]|fe[89ab]|ff|::ffff:)")
    rule = (
        F.when(~F.lower(url).rlike("^https?://"), F.lit("scheme"))
        .when(h.isin("", "unknown"), F.lit("host"))
        .when(h.isin(fixed.BLOCKED_HOSTS), F.lit("blocked host"))
        .when(h.rlike("(" + "|".join(x.replace(".", r"\.") for x in fixed.BLOCKED_SUFFIXES) + ")$"), F.lit("blocked suffix"))
        .when(v4 & (private | reserved), F.lit("private address"))
        .when(v6, F.lit("private address"))
    )
    if allowed:
        inside = F.lit(False)
        for name in allowed:
            inside = inside | (h == name) | h.endswith("." + name)
        rule = rule.when(~inside, F.lit("not allowed"))
    return rule.otherwise(F.lit("ok"))


def same_domain(url: Column, seed: Column) -> Column:
    """C7."""
    return domain(url) == domain(seed)


def _extension(url: Column, extensions: list[str]) -> Column:
    return F.lower(path(url)).rlike("(" + "|".join(x.replace(".", r"\.") for x in extensions) + ")$")


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")


def allowed_v1(url: Column, blocked: list[str] | None = None) -> Column:
    """Scheme, extension, path patterns (on path and query), segments."""
    segments = F.array(*(F.lit(x) for x in [*fixed.BLOCKED_SEGMENTS_V1, *(blocked or [])]))
    q = query(url)
    full = F.lower(F.when(q != "", F.concat(path(url), F.lit("?"), q)).otherwise(path(url)))
    return F.lower(url).rlike("^https?://") & ~_extension(url, fixed.BLOCKED_EXTENSIONS_V1) & ~full.rlike("|".join(f"(?:{p})" for p in fixed.BLOCKED_PATHS_V1)) & ~F.arrays_overlap(_segments(url), segments)


def _first(text: Column, rules: list[tuple[str, int]]) -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for pattern, points in rules:
        chain = chain.when(text.rlike(pattern), F.lit(points))
    return chain.otherwise(F.lit(0))


def score_v1(url: Column, seed: str) -> Column:
    """0 to 100, 0 for what the gate rejects."""
    p = F.lower(path(url))
    own, base = F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(host(F.lit(seed)), r"^www\.", "")
    seed_path = F.lower(F.regexp_replace(path(F.lit(seed)), "/+$", ""))
    depth = F.size(_segments(url))
    points = (
        F.lit(50)
        + F.when(own.contains(base) | base.contains(own), 15).otherwise(-25)
        + F.when((seed_path != "") & p.startswith(seed_path), 10).otherwise(0)
        + _first(p, fixed.HIGH_VALUE_V1)
        + _first(p, fixed.LOW_VALUE_V1)
        + F.when(depth == 0, 5).when(depth <= 2, 8).when(depth <= 4, 3).when(depth >= 7, -8).otherwise(0)
        + F.when(query(url) != "", -5).otherwise(0)
    )
    return F.when(allowed_v1(url), F.greatest(F.lit(0), F.least(F.lit(100), points))).otherwise(F.lit(0))


def label_v1(score: Column) -> Column:
    """C11."""
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "ok").when(score >= 25, "low").otherwise("skip")


def allowed_v2(url: Column, seed: str) -> Column:
    """Universal segments and extensions, and the patterns of the seed's own domain (on the path as written)."""
    segments = F.array(*(F.lit(x) for x in fixed.BLOCKED_SEGMENTS_V2))
    p = path(url)
    bad = F.lit(False)
    for name, patterns in fixed.DOMAIN_RULES_V2.items():
        bad = bad | (host(F.lit(seed)).contains(name) & p.rlike("|".join(f"(?:{x})" for x in patterns)))
    return F.lower(url).rlike("^https?://") & ~_extension(url, fixed.BLOCKED_EXTENSIONS_V2) & ~F.arrays_overlap(_segments(url), segments) & ~bad


def score_v2(url: Column, seed: str) -> Column:
    """C13."""
    p = F.lower(path(url))
    q = query(url)
    full = F.lower(F.when(q != "", F.concat(path(url), F.lit("?"), q)).otherwise(path(url)))
    own, base = F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(host(F.lit(seed)), r"^www\.", "")
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    low = F.lit(0)
    for pattern, points in fixed.LOW_VALUE_V2:
        low = low + F.when(full.rlike(pattern), F.lit(points)).otherwise(F.lit(0))
    points = F.lit(50) + F.when(own.contains(base) | base.contains(own), 20).otherwise(-30) + _first(full, fixed.HIGH_VALUE_V2) + low + F.when(slashes <= 2, 5).when(slashes >= 6, -5).otherwise(0)
    return F.when(allowed_v2(url, seed), F.greatest(F.lit(0), F.least(F.lit(100), points))).otherwise(F.lit(0))


def category_v2(score: Column) -> Column:
    """C14."""
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 45, "ok").when(score >= 20, "low").otherwise("skip")


def document_uri(url: Column) -> Column:
    """Docs://host/stem, with a hash of the query if there is one; the stem has at most 120 safe characters."""
    stem = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), "[^A-Za-z0-9._-]+", "-")
    stem = F.substring(F.when(stem == "", F.lit("index")).otherwise(stem), 1, 120)
    q = query(url)
    return F.concat(F.lit("docs://"), host(url), F.lit("/"), stem, F.when(q != "", F.concat(F.lit("-q"), F.substring(F.sha1(q.cast("binary")), 1, 12))).otherwise(F.lit("")))


def code_uri(uri: Column, position: Column) -> Column:
    """C16."""
    return F.concat(F.lit("code://snippet/"), F.substring(F.sha1(F.concat_ws(":", uri, position.cast("string")).cast("binary")), 1, 12))


def repository(url: Column) -> Column:
    """C17: owner and name of a repository."""
    pattern = r"github\.com/([^/?#]+)/([^/?#]+)"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "").alias("name"))


def source_type(url: Column) -> Column:
    """C20."""
    return F.when(F.lower(url).contains("github.com"), "github").when(any_of(F.lower(url), ["docs.", "/docs", "/documentation", "readthedocs"]), "docs").otherwise("community")


def relevance(url: Column) -> Column:
    """Additive score of a source."""
    low = F.lower(url)
    points = (
        F.when(any_of(low, ["docs.", "/docs", "/documentation", "official", ".io/docs"]), 10).otherwise(0)
        + F.when(low.contains("readthedocs"), 8).otherwise(0)
        + F.when(any_of(low, fixed.LANGUAGE_SITES), 9).otherwise(0)
        + F.when(low.contains("github.com"), 3).otherwise(0)
        + F.when(low.contains("stackoverflow.com"), 2).otherwise(0)
    )
    return F.greatest(points, F.lit(1))


def bucket(url: Column) -> Column:
    """0 for documentation, 1 for others, 2 for code hosts."""
    return F.when(any_of(url, ["docs.", "/docs", "/learn", "/reference"]), 0).when(url.contains("github.com"), 2).otherwise(1)
