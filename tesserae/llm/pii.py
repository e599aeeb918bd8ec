"""Personal data: surrogate generation in DataFrame operations alone.

Entities (e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards, bank accounts (IBAN), US social security
numbers, names of persons) are found by one regular expression and checked (card issuers and Luhn sums, octets, the remainder of an
IBAN by 97). Persons are a listed given name and a surname, or one or two capitalised words after a title ("Mrs", "HERR",
"Dr") or a phrase that introduces a name ("my name is", "me llamo", "Dear" and two words); US numbers may be written with dashes, dots, spaces or brackets, others with their country's code.

Each distinct entity, in a canonical form, gets a surrogate derived from a secret key: of the same type, format, letter case and
script, for persons of the same gender, with valid check digits. All ways of writing one entity get the same surrogate. A person's
surrogate is made of that of the given name (listed ones change places in a keyed cycle, so different ones stay different) and that of
the surname, so "Mr Smith" and "John Smith" keep a surname in common; an e-mail domain has one surrogate too.

A surrogate that another entity has, or that is itself an entity of the input, is drawn anew until none is left, so
distinct entities stay distinct. That ends, as no format is a closed space: names and mailboxes grow by a syllable or letter
with each draw; a number whose format stays crowded for GROW draws gets more digits at its end (an IPv4 address a fifth part), the
one case in which a format isn't kept.

Texts without entities aren't shuffled. Those with entities are written once to the shared folder, numbered there, and
joined to the surrogates by entity; entities that make up more than HEAVY of all occurrences are joined by broadcast (at
most 1 / HEAVY of them), so that no key is hot.

Defined results: null and empty texts pass unchanged with counts of 0; repeated rows give a row each; extra columns pass
through, also such as are named like the counts (the counts replace those); an empty table gives an empty table. A given
name without a surname, or without a title before it, isn't an entity. Time is linear in a text's length; an address is read up to
127 labels of 63 characters, the most that a domain can have; with more it isn't one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

KINDS = ("email", "phone", "ip", "card", "ssn", "person", "iban", "ipv6")
HEAVY = 0.001
#: Draws after which a number's format counts as used up.
GROW = 8

# Given names by script and gender, and the syllables of made surnames by script: fixed values of this operator.
GIVEN = {
    "latin": {
        "f": "Anna Maria Laura Julia Sarah Emma Sophie Claire Elena Carmen Ingrid Katharina Charlotte Isabelle Lucia Mary Jennifer Linda Susan Jessica Emily Olivia Hannah Nina Olga Priya Fatima Aisha Elizabeth Patricia Barbara Margaret Karen Nancy Lisa Rachel Alice Helen Marta Sofia Camille Chloé Amélie Heike Sabine Monika".split(),
        "m": "John Peter Thomas Michael David Daniel Martin Stefan Pierre Carlos Miguel Antonio Andreas Wolfgang François José James Robert William Richard Charles Joseph Christopher Matthew Andrew Paul George Steven Kevin Brian Henry Edward Luis Juan Javier Pablo Jacques Louis Hans Klaus Jürgen Ahmed Mohammed Raj Dmitri".split(),
    },
    "cyrillic": {
        "f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
        "m": "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Александр".split(),
    },
    "greek": {
        "f": "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική Γεωργία Δήμητρα".split(),
        "m": "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης Χρήστος Αθανάσιος".split(),
    },
}
SYLLABLES = {
    "latin": "bar den fel gor han kel lam mor nes pol rad sel tov vin wes".split(),
    "cyrillic": "бар ден фел гор хан кел лам мор нес пол рад сел тов вин зан".split(),
    "greek": "βαρ δεν φελ γορ χαν κελ λαμ μορ νες πολ ραδ σελ τοβ βιν ζαν".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Г-жа Κυρία".split(), "m": "Mr Herr Monsieur Señor Sr Signor Г-н Κύριος".split(), "": "Dr Prof Professor Doctor Mx".split()}

#: Phrases that introduce a person's name.
CUES = ["name is", "Name:", "name's", "m'appelle", "m’appelle", "Nom :", "Name ist", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "nombre es", "Nombre:", "меня зовут", "Меня зовут", "με λένε", "Με λένε"]
#: Such after which two capitalised words are a person, and one isn't.
CUES_OF_TWO = ["Dear", "Attn:", "Signed by", "Written by", "Kind regards,", "Best regards,", "Yours sincerely,"]

_NAMES = "|".join(w for script in GIVEN.values() for names in script.values() for n in names for w in (n, n.upper()))
_TITLES = "|".join(w for titles in TITLES.values() for t in titles for w in (t, t.upper()))
_ONE = rf"(?:(?:{_TITLES})\.?|{'|'.join(CUES)}) (?:(?:{_TITLES})\.? )?"
_TWO = rf"(?:{'|'.join(CUES_OF_TWO)})\s"
_PREFIX = rf"(?:{_ONE}|{_TWO})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SURNAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
# Repeated groups are bounded: the JVM's matcher recurses into them.
_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,125}\.\p{L}{2,63}+"
_V6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f]{1,4}:)(?=[0-9A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:]|\.\p{N})"
# All others begin with a digit, a sign or a capital letter, or one of the phrases: that is tested first.
_OTHERS = [
    r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![\p{{L}}\p{{N}}]|\.\p{{N}})",
    r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    r"(?<![\p{L}\p{N}.+-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}+])(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}.+-])(?:\+?1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}]|[.-]\d)",
    r"(?<![\p{L}\p{N}.+-])(?<!\d )(?:\+?1 )?[2-9]\d{2} [2-9]\d{2} \d{4}(?![\p{L}\p{N}]|[ .-]\d)",
    r"(?<![\p{L}\p{N}+])\+[2-9]\d{0,2}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\p{L}\p{N}]|\.\d)",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_ONE})(?:{_SURNAME} )?{_SURNAME}",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_TWO}){_SURNAME} {_SURNAME}",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_NAMES}) {_SURNAME}",
]
_FIRST = "".join(sorted({c[0] for c in CUES + CUES_OF_TWO}))
_REST = rf"(?=[\p{{Lu}}\d+({_FIRST}])(?:{'|'.join(_OTHERS)})"
PATTERN = f"{_MAIL}|{_V6}|{_REST}"
#: What each IPv6 address has; it begins with a colon, so it is looked for fast.
_COLONS = r":(?::|[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_DIGITS = "regexp_replace(raw, '[^0-9]', '')"
_LUHN = "aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when i % 2 = 1 then cast(substr(reverse({d}), i, 1) as int) when cast(substr(reverse({d}), i, 1) as int) > 4 then 2 * cast(substr(reverse({d}), i, 1) as int) - 9 else 2 * cast(substr(reverse({d}), i, 1) as int) end)"


#: The remainder by 97 of what an IBAN's characters stand for, A to Z for 10 to 35.
_MOD97 = "aggregate(filter(split({x}, ''), c -> c <> ''), 0, (s, c) -> case when c rlike '[0-9]' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"
_BARE = "replace(raw, ' ', '')"


def _kind() -> Column:
    """The type of a match `raw`, null for numbers that aren't what they look like."""
    return F.expr(
        f"""case when contains(raw, '@') then 'email'
        when raw rlike '^[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f:]+$' then 'ipv6'
        when raw rlike '^[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]+$' then case when {_MOD97.format(x=f"concat(substr({_BARE}, 5), substr({_BARE}, 1, 4))")} = 1 then 'iban' end
        when raw rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then 'ip'
        when raw rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
        when raw rlike '^[0-9]' and length({_DIGITS}) >= 13 then
          case when {_DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65)' and ({_LUHN.format(d=_DIGITS)}) % 10 = 0 then 'card' end
        when raw rlike '^[+(0-9]' then 'phone'
        else 'person' end"""
    )


def _canonical() -> Column:
    """One form for all ways of writing an entity; of persons given name (or title's gender), surname."""
    return F.expr(
        f"""case kind when 'email' then lower(raw) when 'ipv6' then lower(raw) when 'iban' then {_BARE} when 'ip' then raw when 'ssn' then {_DIGITS} when 'card' then {_DIGITS}
        when 'phone' then case when length({_DIGITS}) = 10 and not startswith(raw, '+') then concat('1', {_DIGITS}) else {_DIGITS} end
        else lower(regexp_replace(raw, {_sql('^' + _PREFIX)}, '')) end"""
    )


def _letter(of: str, seed: str, i: str) -> str:
    """Another character of the same class, drawn by seed and place."""
    r = f"xxhash64({seed}, {i})"
    return (
        f"case when {of} rlike '[a-z]' then chr(97 + pmod({r}, 26)) when {of} rlike '[A-Z]' then chr(65 + pmod({r}, 26)) when {of} rlike '[0-9]' then cast(pmod({r}, 10) as string) "
        f"when {of} rlike '\\\\p{{IsCyrillic}}' then substr('абвгдежзиклмнопрстуфхцчшэюя', cast(1 + pmod({r}, 27) as int), 1) "
        f"when {of} rlike '\\\\p{{IsGreek}}' then substr('αβγδεζηθικλμνξοπρστυφχψω', cast(1 + pmod({r}, 24) as int), 1) "
        f"when {of} rlike '\\\\p{{L}}' then chr(97 + pmod({r}, 26)) else {of} end"
    )


def _scrambled(text: str, seed: str) -> str:
    return f"array_join(transform(split({text}, ''), (c, i) -> {_letter('c', seed, 'i')}), '')"


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(_sql(w) for w in words) + ")"


_SCRIPT = "case when canonical rlike '\\\\p{IsCyrillic}' then 'cyrillic' when canonical rlike '\\\\p{IsGreek}' then 'greek' else 'latin' end"
_DOMAIN = "substring_index(canonical, '@', -1)"


def _surrogate() -> Column:
    """The surrogate of a canonical entity, in canonical form, by seed (of key, entity and attempt) and domain_seed (of key and domain)."""
    local = f"substr(canonical, 1, length(canonical) - length({_DOMAIN}) - 1)"
    top = f"concat('.', substring_index({_DOMAIN}, '.', -1))"
    labels = f"substr({_DOMAIN}, 1, length({_DOMAIN}) - length({top}))"
    more = "array_join(transform(sequence(1, attempt), i -> chr(97 + pmod(xxhash64(seed, -i), 26))), '')"
    mail = f"concat({_scrambled(local, 'seed')}, case when attempt > 0 then {more} else '' end, '@', {_scrambled(labels, 'domain_seed')}, {top})"
    octet = lambda n: f"cast(pmod(xxhash64(seed, {n}), 256) as string)"
    tail = lambda mark: f"case when attempt >= {GROW} then concat('{mark}', array_join(transform(sequence({GROW}, attempt), i -> cast(pmod(xxhash64(seed, -i), 10) as string)), '')) else '' end"
    ip = f"concat(concat_ws('.', cast(1 + pmod(xxhash64(seed, 1), 223) as string), {octet(2)}, {octet(3)}, {octet(4)}), {tail('.')})"
    body = f"concat(substr(canonical, 1, 1), {_scrambled('substr(canonical, 2, length(canonical) - 2)', 'seed')})"
    card = f"transform(array({body}), b -> concat(b, cast(pmod(10 - ({_LUHN.format(d='concat(b, 0)').replace('concat(b, 0)', 'concat(b, \'0\')')}) % 10, 10) as string)))[0]"
    phone = f"concat(substr(canonical, 1, 1), cast(2 + pmod(xxhash64(seed, 0), 8) as string), {_scrambled('substr(canonical, 3)', 'seed')})"
    ssn = f"concat('9', {_scrambled('substr(canonical, 2)', 'seed')})"
    hexed = "array_join(transform(split(canonical, ''), (c, i) -> case when c rlike '[0-9a-f]' then substr('0123456789abcdef', cast(1 + pmod(xxhash64(seed, i), 16) as int), 1) else c end), '')"
    longer = f"case when attempt >= {GROW} then concat(':', array_join(transform(sequence({GROW}, attempt), i -> substr('0123456789abcdef', cast(1 + pmod(xxhash64(seed, -i), 16) as int), 1)), '')) else '' end"
    account = f"transform(array(concat({_scrambled('substr(canonical, 5)', 'seed')}, {tail('')})), b -> concat(substr(canonical, 1, 2), lpad(cast(98 - {_MOD97.format(x='concat(b, substr(canonical, 1, 2), 00)').replace(', 00)', ', \'00\')')} as string), 2, '0'), b))[0]"
    syllable = "case " + " ".join(f"when {_SCRIPT} = '{s}' then {_list(SYLLABLES[s])}[cast(pmod(xxhash64(seed, i), {len(SYLLABLES[s])}) as int)]" for s in SYLLABLES) + " end"
    name = lambda n: f"array_join(transform(sequence(1, {n} + attempt), i -> {syllable}), '')"
    given = f"concat({name(2)}, case when gender <> 'f' then '' when {_SCRIPT} = 'cyrillic' then 'а' when {_SCRIPT} = 'greek' then 'α' else 'a' end)"
    return F.expr(
        f"case kind when 'email' then {mail} when 'ip' then {ip} when 'card' then concat({card}, {tail('')}) when 'phone' then concat({phone}, {tail('')}) "
        f"when 'iban' then {account} when 'ipv6' then concat({hexed}, {longer}) when 'ssn' then concat({ssn}, {tail('')}) when 'given' then {given} else {name(4)} end"
    )


def given_names(key: str) -> dict[str, str]:
    """Each listed given name's surrogate: the next one of its script and gender in an order that the key decides."""
    out = {}
    for script in GIVEN.values():
        for names in script.values():
            order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
            out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _gender() -> Column:
    """Of a person: by title, else by given name."""
    titles = " ".join(f"when raw rlike {_sql(f'^(?i:{'|'.join(TITLES[g])})[.]? ')} then '{g}'" for g in TITLES)
    names = " ".join(f"when canonical rlike {_sql(f'^(?iu:{'|'.join(GIVEN[s][g])}) ')} then '{g}'" for s in GIVEN for g in "fm")
    return F.expr(f"case when kind <> 'person' then '' {titles} {names} else '' end")


def _written() -> Column:
    """The surrogate in the format of the match: its layout of digits (with what it is longer by at the end), its letter case, its title."""
    at = f"length(regexp_replace(substr(raw, 1, i), '[^0-9]', '')) + length(canonical) - length({_DIGITS})"
    filled = f"array_join(transform(sequence(1, length(raw)), i -> case when substr(raw, i, 1) rlike '[0-9]' then substr(surrogate, {at}, 1) else substr(raw, i, 1) end), '')"
    letters = "length(regexp_replace(substr(raw, 1, i), '[^0-9A-Z]', ''))"
    account = f"array_join(transform(sequence(1, length(raw)), i -> case when substr(raw, i, 1) = ' ' then ' ' else substr(surrogate, {letters}, 1) end), '')"
    prefix = f"regexp_extract(raw, {_sql('^' + _PREFIX)}, 0)"
    name = f"substr(raw, 1 + length({prefix}))"
    return F.expr(
        f"case when kind in ('phone', 'card', 'ssn') then concat({filled}, substr(surrogate, 1 + length(canonical))) when kind = 'person' then concat({prefix}, case when {name} = upper({name}) then upper(surrogate) else initcap(surrogate) end) "
        f"when kind = 'iban' then concat({account}, substr(surrogate, 1 + length(canonical))) "
        "when kind in ('email', 'ipv6') and raw = upper(raw) and raw <> lower(raw) then upper(surrogate) else surrogate end"
    )


def surrogates(entities: DataFrame, key: str, where: str) -> DataFrame:
    """(kind, canonical, gender, surrogate) of distinct entities; no two of a kind get the same, none an entity of the input.

    Each round redraws those that collide; the first by hash keeps its surrogate. Rounds go on until no entity is left, which
    they come to, as the space of surrogates grows with each.
    """
    left = common.cut(entities.withColumn("attempt", F.lit(0)), where, "entities")
    originals = left.select("kind", F.col("canonical").alias("surrogate"))
    done = None
    step = 0
    while True:
        seeded = left.withColumn("seed", F.expr(f"sha2(concat_ws('|', {_sql(key)}, kind, canonical, cast(attempt as string)), 256)")).withColumn("domain_seed", F.expr(f"sha2(concat_ws('|', {_sql(key)}, {_DOMAIN}), 256)"))
        drawn = common.cut(seeded.withColumn("surrogate", _surrogate()).drop("seed", "domain_seed"), where, f"drawn-{step}")
        # The first of each surrogate keeps it; a group holds only what collides.
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct(F.xxhash64("canonical").alias("h"), "canonical")).alias("first"))
        good = drawn.join(first.select("kind", "surrogate", F.col("first.canonical").alias("canonical")), ["kind", "surrogate", "canonical"], "left_semi")
        good = good.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = common.cut(good, where, f"good-{step}")
        done = good if done is None else done.unionByName(good)
        left = common.cut(drawn.drop("surrogate").join(good, ["kind", "canonical"], "left_anti").withColumn("attempt", F.col("attempt") + 1), where, f"left-{step}")
        step += 1
        if not left.take(1):
            return done.select("kind", "canonical", "gender", "surrogate")


def named(entities: DataFrame, key: str, where: str) -> DataFrame:
    """(kind, canonical, n, surrogate) of distinct entities (kind, canonical, gender, n); persons are put together from their names' surrogates."""
    parts = entities.withColumn("surname", F.expr("case when kind = 'person' then substring_index(canonical, ' ', -1) end")).withColumn("given", F.expr("case when kind = 'person' and contains(canonical, ' ') then substring_index(canonical, ' ', 1) end"))
    listed = F.expr("map(" + ", ".join(_sql(w) for pair in given_names(key).items() for w in pair) + ")[given]")
    parts = common.cut(parts.withColumn("listed", listed), where, "parts")
    persons = parts.filter("kind = 'person'")
    names = lambda of, kind: persons.groupBy(F.col(of).alias("canonical")).agg(F.max("gender").alias("gender"), F.count(F.lit(1)).alias("m")).select(F.lit(kind).alias("kind"), "canonical", "gender", "m")
    drawn = names("surname", "surname").unionByName(names("given", "given").join(persons.filter("listed is null").select(F.col("given").alias("canonical")).distinct(), "canonical", "left_semi").select("kind", "canonical", "gender", "m"))
    drawn = common.cut(drawn, where, "names-of-persons")
    others = parts.filter("kind <> 'person'").select("kind", "canonical", "gender")
    found = common.cut(surrogates(others.unionByName(drawn.select("kind", "canonical", "gender")), key, where), where, "drawn")
    of = lambda kind, name: found.filter(F.col("kind") == kind).join(drawn.filter(F.col("kind") == kind).select("canonical", "m"), "canonical").select(F.col("canonical").alias(name), "m", F.col("surrogate").alias(f"{name}_new"))
    # A surname that many persons have is joined by broadcast, like an entity that occurs often.
    most = max(1.0, HEAVY * (persons.count() or 1))
    whole = common.join_heavy(persons.select("canonical", "n", "given", "listed", "surname"), of("surname", "surname"), ["surname"], "m", most, ["surname_new"])
    known = whole.filter("given is null or listed is not null").select("canonical", "n", F.concat_ws(" ", "listed", "surname_new").alias("surrogate"))
    new = common.join_heavy(whole.filter("given is not null and listed is null"), of("given", "given"), ["given"], "m", most, ["given_new"]).select("canonical", "n", F.concat_ws(" ", "given_new", "surname_new").alias("surrogate"))
    persons = known.unionByName(new).select(F.lit("person").alias("kind"), "canonical", "n", "surrogate")
    return found.filter("kind not in ('surname', 'given')").join(entities.select("kind", "canonical", "n"), ["kind", "canonical"]).select("kind", "canonical", "n", "surrogate").unionByName(persons)


def replace(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """The documents with entities replaced, and a count n_<kind> for each kind."""
    where = common.shared_dir(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*[c for c in docs.columns if c in counts])
    columns = docs.columns
    rid, parts, raw, new = (common.unused(columns, n) for n in ("_rid", "_parts", "_raw", "_new"))
    has_at = F.contains(F.col(text), F.lit("@"))
    # A cheap test first: a text without an @ has no address, and the other entities begin with few characters.
    maybe = F.when(has_at, F.col(text).rlike(f"{_MAIL}|{_REST}")).otherwise(F.col(text).rlike(_REST)) | (F.col(text).rlike(_COLONS) & F.col(text).rlike(_V6))
    maybe = F.coalesce(maybe, F.lit(False))
    touched = (
        docs.filter(maybe)
        .withColumn(raw, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
        .withColumn(parts, F.split(F.col(text), PATTERN, -1))
        .withColumn(rid, F.monotonically_increasing_id())
    )
    touched = common.cut(touched.drop(text), where, "touched")
    each = touched.select(F.col(rid).alias("rid"), F.posexplode(raw).alias("pos", "raw")).withColumn("kind", _kind())
    each = common.cut(each.withColumn("canonical", _canonical()).withColumn("gender", _gender()), where, "found")
    found = each.filter("kind is not null")
    entities = common.cut(found.groupBy("kind", "canonical").agg(F.max("gender").alias("gender"), F.count(F.lit(1)).alias("n")), where, "distinct")
    total = entities.agg(F.sum("n")).first()[0] or 0
    names = common.cut(named(entities, key, where), where, "names")
    joined = common.join_heavy(found, names, ["kind", "canonical"], "n", max(1.0, HEAVY * total), ["surrogate"]).select("rid", "pos", "kind", _written().alias("new"))
    whole = joined.unionByName(each.filter("kind is null").select("rid", "pos", "kind", F.col("raw").alias("new")))
    per_row = whole.groupBy(F.col("rid").alias(rid)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias(new),  # the entities of one document
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS),
    )
    built = F.array_join(F.zip_with(parts, new, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    changed = touched.join(per_row, rid).withColumn(text, built).select(*columns, *(F.col(c).cast("long").alias(c) for c in counts))
    same = docs.filter(~maybe).select(*columns, *(F.lit(0).cast("long").alias(c) for c in counts))
    return same.unionByName(changed)
