"""Surrogates for personal data: detected entities get keyed replacements of their own kind, format, script and gender.

Only DataFrame functions are used. The same entity gets the same surrogate in every document and layout (coreference);
different entities of a kind get different ones, and no surrogate equals a detected original: collisions are searched for
over all entities and drawn again until there are none (distinctness).

A phone behind +1 has 3-3-4 digits. Behind other country codes it has 7 to 15 digits in groups, and a group that begins an
address, a card, another phone or a social security number isn't part of it; a plain number that still fits into the 15 is.

A number of 13 to 19 digits counts as a card only if its check digit is right (Luhn); others stay as they are. Surrogates of cards
and bank accounts have right check digits too, bank accounts keep their country and phones the first two digits behind a +.

Secrets are letters and digits (tokens also ``_`` and ``-``) behind ``password =`` or ``token =`` in any case, with or without
blanks and quotes, and access keys. Names are one or two words behind a title, titles and names written as usual or in capitals.
A name of two words is replaced alike where its document has it without the title; such mentions aren't counted.

Addresses of version 6 are eight groups, or three groups or more with a digit among them and ``::`` inside or behind. Groups of
zeros stay, so that a short form stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, free_names, shuffle_partitions
from seriesloom.sources.artifacts import settle

# Titles that announce a name, by grammatical gender, and the syllables of invented names by script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "Κύριος"]
SYLLABLES = {
    "latin": ["ba", "be", "da", "do", "el", "fa", "ga", "ha", "jo", "ka", "la", "le", "li", "lo", "ma", "mi", "mo", "na", "ne", "no", "pa", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "va", "vi"],
    "cyrillic": ["ба", "ва", "га", "да", "за", "ка", "ла", "ле", "ли", "ма", "ми", "на", "не", "ра", "ре", "са", "та", "ти", "фа", "ви"],
    "greek": ["βα", "γα", "δα", "κα", "λα", "λε", "μα", "μι", "να", "νε", "πα", "ρα", "ρε", "σα", "τα", "τι", "φα", "θε"],
}
ENDINGS = {
    ("latin", "first_f"): "na", ("latin", "first_m"): "ron", ("latin", "surname"): "mer",
    ("cyrillic", "first_f"): "на", ("cyrillic", "first_m"): "рон", ("cyrillic", "surname"): "мер",
    ("greek", "first_f"): "να", ("greek", "first_m"): "ρος", ("greek", "surname"): "μης",
}

# Titles as usual and in capitals, those with and without accents.
_PLAIN = str.maketrans("ÁÉÍÓÚΆΈΉΊΌΎΏ", "AEIOUΑΕΗΙΟΥΩ")
_raised = lambda titles: sorted({y for t in titles for y in (t, t.upper(), t.upper().translate(_PLAIN))})
FEMALE_FORMS, MALE_FORMS = _raised(FEMALE_TITLES), _raised(MALE_TITLES)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME, _RAISED = r"\p{Lu}\p{Ll}++", r"\p{Lu}{2,}+(?!\p{Ll})"
_TITLE = "(?:" + "|".join(sorted(FEMALE_FORMS + MALE_FORMS, key=len, reverse=True)) + ")"
_PASSWORD, _TOKEN = (rf"(?i:{word})\s*+=\s*+[\"']?+" for word in ("password", "token"))
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = (
    rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])(?!(?:[0-9A-Fa-f]*:){{8}})"
    rf"(?:(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|{_HEX}:(?::{_HEX}){{2,6}}|(?:{_HEX}:){{3,6}}:))(?![\w:]|\.\d)"
)
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?!\d)"
_LOCAL = r"\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_DIGIT = r"\d[ .()-]{0,2}"
_GROUP = rf"(?:[ .-](?!{_IP}|{_SSN}|{_CARD}(?![ -]\d{{4}}(?!\d))|{_LOCAL})|(?<=[\d)]))"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+(?<=[A-Za-z]{2})",
    "password": rf"{_PASSWORD}[0-9A-Za-z]{{6,}}+",
    "token": rf"{_TOKEN}[0-9A-Za-z_-]{{16,}}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": _IP6,
    "ip": rf"(?<![\d.]){_IP}",
    "ssn": rf"(?<![\d-]){_SSN}",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|(?<![\w+])\+[2-9]\d{{0,2}}(?:[ .-]?\(\d{{1,4}}\))?{_GROUP}\d{{1,4}}(?:{_GROUP}\d{{2,4}}){{1,5}}(?!\d)(?<={_DIGIT * 7})(?<!{_DIGIT * 16})"
    rf"|(?<![\w)(])\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?!\d)|(?<![\d-]){_LOCAL}",
    "card": rf"(?<!\d){_CARD}",
    "name": rf"(?<![\p{{L}}]){_TITLE}\.? (?:{_NAME}(?: {_NAME})?|{_RAISED}(?: {_RAISED})?)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAY_HOLD = "[0-9@=]|AKIA|(?=[" + "".join(sorted({t[0] for t in FEMALE_FORMS + MALE_FORMS})) + "])" + _TITLE + r"\.? \p{Lu}"
ANNOUNCED = f"^(?:{_PASSWORD}|{_TOKEN})"
SHAPED = {k: f"^(?:{PATTERNS[k]})$" for k in ("email", "ipv6", "ip", "ssn", "phone", "access_key", "card", "iban", "name")}


def kind_of(surface: Column) -> Column:
    """The first kind whose pattern matches the whole surface, without its announcement; what is left stood after one. Null for
    numbers that only look like a card."""
    bare = F.regexp_replace(surface, ANNOUNCED, "")
    digits = F.regexp_replace(bare, r"\D", "")
    checked = _luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)
    out = F.when(bare.rlike(SHAPED["email"]), "email")
    for kind in ("access_key", "ipv6", "ip", "ssn", "phone", "card", "iban", "name"):
        known = F.when((bare != surface) | checked, kind) if kind == "card" else F.lit(kind)
        out = out.when(bare.rlike(SHAPED[kind]), known)
    return out.otherwise("secret")


def _parts(surface: Column, kind: Column) -> Column:
    """What a surface is made of: titles and announcements stay (null kind), names are first names by gender and surnames, all
    else is one part. Parts begin with their ``glue``."""
    tokens = F.split(surface, " ")
    first = F.when(F.regexp_replace(tokens[0], r"\.$", "").isin(FEMALE_FORMS), "first_f").otherwise("first_m")
    role = lambda i: F.when(i == 0, F.lit(None)).when((i == 1) & (F.size(tokens) == 3), first).otherwise("surname")
    named = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), role(i).alias("kind"), t.alias("raw"), F.when(i > 0, " ").otherwise("").alias("glue")))
    whole = F.array(
        F.struct(F.lit(0).alias("i"), kind.alias("kind"), F.regexp_replace(surface, ANNOUNCED, "").alias("raw"), F.regexp_extract(surface, ANNOUNCED, 0).alias("glue"))
    )
    return F.when(kind == "name", named).otherwise(whole)


def _hextets(raw: Column) -> Column:
    """The eight groups of a version 6 address, small letters, without leading zeros."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(raw, "::", 1)), F.when(raw.contains("::"), groups(F.substring_index(raw, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", ""))


def _norm(kind: Column, raw: Column) -> Column:
    """What makes two surfaces the same entity: letters without case (those of secrets only if they are hexadecimal), numbers
    without layout or the +1 of a country; the + of others stays."""
    digits = F.regexp_replace(raw, r"\D", "")
    phone = (
        F.when(raw.startswith("+1") & (F.length(digits) == 11), F.substring(digits, 2, 10))
        .when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    )
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "ipv6", F.array_join(_hextets(raw), ":"))
        .when((kind == "secret") & ~raw.rlike("^(?:[0-9a-f]{8,}|[0-9A-F]{8,})$"), raw).when(kind.isin("ip", "access_key"), raw).otherwise(F.lower(raw))
    )


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _byte(digests: Column, i: Column) -> Column:
    """Byte ``i`` (from 0) of the keyed stream."""
    hexed = F.get(digests, F.floor(i / 32).cast("int"))
    return F.conv(F.substring(hexed, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _alike(s: Column, digests: Column, secret: bool = False) -> Column:
    """Each digit, small and capital letter replaced with one of its class, all else kept; hexadecimal secrets stay so."""
    hexed = s.rlike("^[0-9a-f]{8,}$") if secret else F.lit(False)
    one = lambda c, i: (
        F.when(hexed, _pick("0123456789abcdef", _byte(digests, i)))
        .when(c.rlike("[0-9]"), _pick("0123456789", _byte(digests, i)))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", _byte(digests, i)))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _byte(digests, i))).otherwise(c)
    )
    return F.array_join(F.transform(_chars(s), one), "")


def _luhn_digit(body: Column) -> Column:
    n = F.length(body)
    value = lambda i: F.coalesce(F.substring(body, i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when((n - i) % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return ((10 - total % 10) % 10).cast("string")


def _iban_digits(country: Column, body: Column) -> Column:
    """The two check digits: 98 less the rest by 97 of the number in which letters count from 10 and the country comes last."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


PATIENCE = 4
"""attempts within the entity's own form; further ones draw from a wider one, since short forms have few values"""
MOST_ATTEMPTS = 64


def _octet(octet: Column, b: Column, wide: Column) -> Column:
    """As many digits as before, or three."""
    drawn = F.when(~wide & (F.length(octet) == 1), b % 9 + 1).when(~wide & (F.length(octet) == 2), b % 90 + 10).otherwise(b % 150 + 100)
    return drawn.cast("string")


def _hextet(group: Column, digests: Column, i: Column, wide: Column) -> Column:
    """As many hexadecimal digits as before, or four; no leading zero, but zeros stay."""
    drawn = [_pick("123456789abcdef" if k == 0 else "0123456789abcdef", _byte(digests, i * 4 + k)) for k in range(4)]
    return F.when(group == "0", group).otherwise(F.substring(F.concat(*drawn), F.lit(1), F.when(wide, 4).otherwise(F.length(group))))


def _invented(kind: Column, norm: Column, digests: Column, attempt: Column) -> Column:
    script = F.when(norm.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    out = None
    for (name, role), ending in ENDINGS.items():
        syllables = F.array(*[F.lit(x) for x in SYLLABLES[name]])
        own = _syllables(syllables, len(SYLLABLES[name]), digests, attempt)
        here = (script == name) & (kind == role)
        value = F.concat(F.array_join(own, ""), F.lit(ending))
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def _syllables(syllables: Column, n: int, digests: Column, attempt: Column) -> Column:
    """Three syllables, one more for every three attempts, so that names never run out."""
    return F.transform(F.sequence(F.lit(0), 2 + F.floor(attempt / 3).cast("int")), lambda i: F.get(syllables, _byte(digests, i) % n))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    digests = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(norm) + 40) / 32).cast("int")),
        lambda b: F.sha2(F.concat_ws("|", F.lit(key), inner, b.cast("string")), 256),
    )
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    label = F.substring_index(domain, ".", 1)
    longer = F.substring(inner, F.lit(1), F.floor(attempt / PATIENCE).cast("int"))
    mail = F.concat(
        longer, _alike(F.concat(local, F.lit("@"), label), digests), F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("com"),
    )
    rest = F.substring(norm, F.lit(2), F.length(norm))
    body = F.concat(F.substring(norm, 1, 1), _alike(F.substring(norm, F.lit(2), F.length(norm) - 2), digests))
    octets = F.transform(F.split(norm, r"\."), lambda o, i: _octet(o, _byte(digests, i), attempt >= PATIENCE))
    account = _alike(F.substring(norm, F.lit(5), F.length(norm)), digests)
    prefix = F.when(F.length(norm) > 10, 3).otherwise(2)  # the +, and two digits behind it unless the number is short
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "ipv6", F.array_join(F.transform(F.split(norm, ":"), lambda g, i: _hextet(g, digests, i, attempt >= PATIENCE)), ":"))
        .when(kind == "card", F.concat(body, _luhn_digit(body)))
        .when(kind == "ssn", F.concat(F.lit("9"), _alike(rest, digests)))
        .when((kind == "phone") & norm.startswith("+"), F.concat(F.substring(norm, F.lit(1), prefix), _alike(F.substring(norm, prefix + 1, F.length(norm)), digests)))
        .when(kind == "phone", F.concat(_pick("23456789", _byte(digests, F.lit(31))), _alike(rest, digests)))
        .when(kind == "access_key", F.concat(F.lit("AKIA"), _alike(F.substring(norm, F.lit(5), F.length(norm)), digests)))
        .when(kind == "iban", F.concat(F.substring(norm, 1, 2), _iban_digits(F.substring(norm, 1, 2), account), account))
        .when(kind == "secret", F.concat(_alike(norm, digests, secret=True), longer))
        .otherwise(_invented(kind, norm, digests, attempt))
    )


def _padded(group: Column, like: Column) -> Column:
    return F.lpad(group, F.greatest(F.length(group), F.length(like)), "0")


def _rendered(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the layout of the surface."""
    own, new = F.split(raw, ":"), F.split(made, ":")
    before = F.size(F.split(F.substring_index(raw, "::", 1), ":"))  # groups left of the shortening
    grouped = F.transform(own, lambda g, i: F.when(g == "", g).otherwise(_padded(F.get(new, F.when(i < before, i).otherwise(8 - F.size(own) + i)), g)))
    address = F.array_join(grouped, ":")
    digits, plain = F.length(F.regexp_replace(raw, "[^0-9A-Za-z]", "")), F.ltrim(made, F.lit("+"))
    source = F.concat(F.when(digits > F.length(plain), F.lit("1")).otherwise(F.lit("")), plain)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda s, c: F.when(
        c.rlike("[0-9A-Za-z]"), F.struct(F.concat(s["out"], F.substring(source, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    laid = F.aggregate(_chars(raw), start, step)["out"]
    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(made)).otherwise(
        F.when(kind.isin("first_f", "first_m", "surname"), F.initcap(made)).otherwise(made)
    )
    return F.when(kind.isNull(), raw).when(kind.isin("phone", "card", "ssn", "iban"), laid).when(
        kind == "ipv6", F.when(raw == F.lower(raw), address).otherwise(F.upper(address))
    ).when(
        ((kind == "secret") & (made != F.lower(made))) | kind.isin("access_key", "ip"), made
    ).otherwise(cased)


def mapping(parts: DataFrame, key: str) -> DataFrame:
    """``kind, norm, surrogate`` for the distinct entities of ``kind, norm``, free of collisions.

    Surrogates that collide are drawn again, after ``PATIENCE`` attempts from wider forms: longer names, mail addresses and secrets,
    octets of three and groups of four digits. The forms left are phones, cards, social security numbers, bank accounts and access keys, which keep their
    length: a corpus that holds more distinct ones than the form has values is refused with an error.
    """
    entities = parts.where("kind is not null").select("kind", "norm").distinct()
    drawn, _ = settle(entities.withColumn("attempt", F.lit(0)).withColumn("ok", F.lit(False)), "entities")
    originals = drawn.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("is_original"))
    for _ in range(MOST_ATTEMPTS):
        spread = drawn.repartition(shuffle_partitions(drawn.sparkSession), "kind", "norm")  # few bytes, much work
        made = spread.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        rank = F.struct(~F.col("ok"), F.col("norm"))
        owners = made.groupBy("kind", "surrogate").agg(F.min(rank).alias("owner"))
        checked = (
            made.join(owners, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
            .withColumn("ok", (F.col("owner") == rank) & F.col("is_original").isNull())
            .select("kind", "norm", "attempt", "ok", "surrogate")
        )
        checked, seen = settle(checked, "surrogates", {"left": F.coalesce(F.sum((~F.col("ok")).cast("int")), F.lit(0))})
        if not seen["left"]:
            return checked.select("kind", "norm", "surrogate")
        drawn = checked.select("kind", "norm", F.when(F.col("ok"), F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"), "ok")
    full = checked.where(~F.col("ok")).groupBy("kind").count().collect()
    raise ValueError(f"no free surrogates left for {sorted((r['kind'], r['count']) for r in full)}")


def replace_entities(docs: DataFrame, key: str, text: str = "text", into: str = "_n_entities") -> DataFrame:
    """``docs`` with surrogates in the text and their number ``into``, a name that no column has; rows without entities pass as
    they are, other columns too, whatever their names.

    Null texts stay null. Rows are told apart by a number of their own, so repeated rows and document ids are harmless. Only
    rows that can hold an entity are written and joined. A row's names without their title are looked for in that row only.
    """
    body, names = F.col(f"`{text}`"), docs.columns
    row, own, new, n, spoken = free_names(docs, "_row", "_found", "_new", "_entities", "_names")
    held = F.coalesce(body.rlike(MAY_HOLD), F.lit(False))
    rest = docs.where(~held).withColumn(into, F.lit(0))
    found = docs.where(held).withColumn(row, F.monotonically_increasing_id()).withColumn(own, F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    found, _ = settle(found, "found")
    hits = found.where(F.size(own) > 0).select(row, F.posexplode(own).alias("pos", "surface"))
    surfaces, _ = settle(hits.select("surface").distinct().withColumn("form", kind_of(F.col("surface"))), "surfaces")
    parts = surfaces.select("surface", F.explode(_parts(F.col("surface"), F.col("form"))).alias("p")).select("surface", "p.i", "p.kind", "p.raw", "p.glue")
    parts = parts.withColumn("norm", F.when(F.col("kind").isNotNull(), _norm(F.col("kind"), F.col("raw"))))
    known = parts.join(mapping(parts, key), ["kind", "norm"], "left")
    made = known.repartition(shuffle_partitions(docs.sparkSession), "surface").select(  # few bytes, much work
        "surface", F.struct("i", F.concat("glue", _rendered(F.col("kind"), F.col("raw"), F.col("surrogate"))).alias("out"), "raw").alias("p"),
        F.col("kind").isNotNull().alias("is_entity"), F.col("kind").isin("first_f", "first_m").alias("has_first"),
    )
    put = lambda x, field: F.array_join(F.transform(x, lambda p: p[field]), "")
    replacements = made.groupBy("surface").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.max("is_entity").alias("is_entity"), F.max("has_first").alias("full"))
    tail = F.slice("ps", 2, 2)
    called = F.struct(F.array_join(F.transform(tail, lambda p: p["raw"]), " ").alias("old"), F.ltrim(put(tail, "out")).alias("new"))
    replacements, _ = settle(replacements.select("surface", put(F.col("ps"), "out").alias("new"), "is_entity", F.when(F.col("full"), called).alias("name")), "replacements")
    per_row = (
        hits.join(replacements, "surface").groupBy(row)
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda p: p["new"]).alias(new),
            F.sum(F.col("is_entity").cast("int")).cast("int").alias(n),
            F.sort_array(F.collect_set("name")).alias(spoken),
        )
    )
    gaps = F.split(body, ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.col(new), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    mention = lambda p: F.concat(F.lit(r"(?<!\p{L})"), p["old"], F.lit(r"(?!\p{L})"))
    rebuilt = F.when(F.size(spoken) > 0, F.aggregate(spoken, rebuilt, lambda s, p: F.regexp_replace(s, mention(p), p["new"]))).otherwise(rebuilt)
    done = found.join(per_row, row, "left").select(
        *[F.when(F.col(new).isNull(), F.col(f"`{c}`")).otherwise(rebuilt).alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(n, F.lit(0)).alias(into),
    )
    return rest.unionByName(done)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_entities`` of every row."""
    return replace_entities(columns_of(docs, "doc_id", "text"), key, into="n_entities")


def with_surrogate_texts(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text``; ``n_chars`` is counted anew where entities were found."""
    (n,) = free_names(docs, "_n_entities")
    done = replace_entities(docs, key, into=n)
    count = F.when(F.col(n) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", count).drop(n)
