"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns and, where the format has one, by a check digit; what a text's cards are is settled first,
so that a number beside a card, or one that is none, hides nothing. Each distinct entity gets a surrogate
from a keyed hash that keeps its type and format: the digits of a phone number or card in their grouping, with a
valid check digit, a host in an address, hexadecimal for a hexadecimal secret, a name of the same gender and script.
Surrogates that meet each other, or an entity that occurs, are drawn again, so that distinct entities stay distinct and
the same entity has the same surrogate everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import lookup, materialize

ATTEMPTS = 50
HOT_SHARE = 1000

#: Titles that tell a gender. Fixed values.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Signora", "Госпожа", "госпожа", "Г-жа", "г-жа")
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "господин", "Г-н", "г-н")
NEUTRAL = ("Dr", "Prof")
#: Syllables that names are made of, and their endings by gender.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te", "na la", "no ren", "nis ley"),
    "cyrillic": ("ба бе би бо да де ди до ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те", "на ла", "ний рен", "лис ней"),
}

#: Country codes of phone numbers that are not of three digits. Fixed values.
COUNTRY_CODES = ((r"^[17]", 1), (r"^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", 2))
#: What keys of well-known services begin with. Fixed values.
KEY_PREFIXES = r"AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk_live_|sk-"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(FEMALE + MALE + NEUTRAL)
#: A part of a name, to its end: also McDonald, O'Brien and Smith-Jones, but not the 's of a genitive.
_PART = r"\p{Lu}(?:[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]+)(?:['’]\p{Lu}[\p{L}\p{M}]+|-[\p{L}\p{M}]+)*"
#: Patterns by type, tried in this order at each place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "mac": r"(?<![0-9A-Fa-f:\-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![0-9A-Fa-f:\-])",
    "ip6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "key": rf"(?<![A-Za-z0-9_\-])(?:{KEY_PREFIXES})(?=[A-Za-z_\-]*\d)[A-Za-z0-9_\-]{{16,}}",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\+\d{10,14}|\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d){7,12})(?!\d)",
    "card": r"(?<!\d)(?<!\d\.)\d(?:[ \-]?\d){12,18}(?!\d)",
    "national": r"(?<![\d+])(?<!\d[.\-])(?:\d{3}(?: \d{3} |\.\d{3}\.|-\d{3}-)\d{4}|0\d(?:[ .\-]\d{2}){4}|0\d{2,4}[ /\-]\d{6,8})(?![\d\-]|\.\d)",
    "secret": r"(?=[A-Za-z0-9_+/\-]{16})(?<=(?i:token|secret|passw(?:or)?d|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/\-]++",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_PART}(?: {_PART})?",
}
BEFORE_CARDS, AFTER_CARDS = ("|".join(f"(?:{PATTERNS[k]})" for k in kinds) for kinds in (("email", "mac", "ip6", "ip", "key", "ssn", "phone"), ("national", "secret", "name")))
#: Groupings of digits that cards are written in, the usual ones first; a year in front belongs to none of them.
CARD_GROUPS = (r"\d{13,19}", r"\d{4}(?:[ \-]\d{4}){3}", r"\d{4}[ \-]\d{6}[ \-]\d{4,5}", r"\d{4}(?:[ \-]\d{4}){3}[ \-]\d{1,3}", r"\d{4}(?:[ \-]\d{3}){3}", r"\d{6}[ \-]\d{13}")
#: How account numbers are written: in one, or in fours with or without a shorter rest.
ACCOUNTS = (r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", r"[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7} [A-Z0-9]{1,3}", r"[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}")
#: A date inside a run of digits makes it no card.
DATE = r"(?<!\d)(?:19|20)\d\d-[01]\d-[0-3]\d(?!\d)"
TITLED = rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}"
#: A text without a match of this has no entity.
HINT = rf"[0-9@]|{KEY_PREFIXES}|(?i:token|secret|passw|key)|(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, of which the last is the check digit."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, b: a + b)


def _account_rest(core: Column) -> Column:
    """An account number's rest by 97, of which a valid one has 1: its first four characters last, letters as 10 to 35."""
    moved = F.split(F.concat(F.substr(core, F.lit(5)), F.substr(core, F.lit(1), F.lit(4))), "")
    digit = lambda c: F.ascii(c) - F.lit(48)
    return F.aggregate(moved, F.lit(0), lambda r, c: F.when(c == "", r).when(F.ascii(c) > 57, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + digit(c)) % 97))


def _compact(raw: Column) -> Column:
    return F.replace(raw, F.lit(" "), F.lit(""))


def kind_of(raw: Column) -> Column:
    """An entity's type; null for what only looks like one (a number without a valid check digit)."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        whole = raw.rlike(rf"^(?:{pattern})$") if kind != "secret" else raw.rlike(r"^[A-Za-z0-9_+/\-]{16,}$")
        if kind == "card":
            whole = whole & (_luhn_sum(_digits(raw)) % 10 == 0)
        out = F.when(whole, F.lit("phone" if kind == "national" else kind)).otherwise(out)
    account = raw.rlike(rf"^(?:{'|'.join(ACCOUNTS)})$") & (_account_rest(_compact(raw)) == 1)
    out = F.when(account, F.lit("account")).otherwise(out)
    # what no other pattern has is a bare mention of a name that the text has with a title
    return F.when(raw.rlike(rf"^{_PART}(?: {_PART})?$") & (F.length(raw) < 16), F.lit("name")).otherwise(out)


def cards_of(text: Column) -> Column:
    """The cards of a text, by their check digits: what stands in a grouping of cards at any place, then whole runs of
    digits, blanks and hyphens in other groupings."""
    begin = r"(?=\d)(?<!\d)(?<!\d\.)"
    grouped = [F.regexp_extract_all(text, F.lit(rf"{begin}(?!(?:19|20)\d\d[ \-])(?=({g})(?!\d))"), F.lit(1)) for g in CARD_GROUPS]
    others = F.regexp_extract_all(text, F.lit(rf"{begin}(?<!\d[ \-])(?=(\d(?:[ \-]?\d){{12,18}})(?!\d))"), F.lit(1))
    others = F.filter(others, lambda x: ~x.rlike(PATTERNS["ssn"]) & ~x.rlike(DATE))
    valid = F.filter(F.array_distinct(F.concat(*grouped, others)), lambda x: _luhn_sum(_digits(x)) % 10 == 0)
    return F.when(text.rlike(r"\d(?:[ \-]?\d){12}"), valid).otherwise(F.array().cast("array<string>"))


def accounts_of(text: Column) -> Column:
    """The international account numbers of a text, by their check digits."""
    found = [F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9])(?=({a})(?![A-Za-z0-9]))"), F.lit(1)) for a in ACCOUNTS]
    valid = F.filter(F.array_distinct(F.concat(*found)), lambda x: _account_rest(_compact(x)) == 1)
    return F.when(text.rlike(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2} ?[A-Z0-9]{4}"), valid).otherwise(F.array().cast("array<string>"))


def name_parts(raw: Column) -> Column:
    """The parts of a name, without its title."""
    return F.split(_name_of(raw), " ")


def pattern_of(text: Column) -> Column:
    """The pattern of a text's entities: that of every type, of cards those that the text has, and of names without a title
    those parts that the text has with one."""
    cards = F.array_join(cards_of(text), "|")
    titled = F.when(text.rlike(TITLED), F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    parts = F.array_join(F.array_distinct(F.flatten(F.transform(titled, name_parts))), "|")
    one = F.concat(F.lit("(?:"), parts, F.lit(")"))
    bare = F.when(parts != "", F.concat(F.lit(r"|(?<![\p{L}\p{M}'’\-])"), one, F.lit("(?: "), one, F.lit(r")?(?![\p{L}\p{M}]|['’]\p{Lu}|-\p{L})"))).otherwise("")
    some = F.concat(F.lit(rf"{BEFORE_CARDS}|(?<!\d)(?<!\d\.)(?=\d(?:[ \-]?\d){{12}})(?:"), cards, F.lit(rf")(?!\d)|{AFTER_CARDS}"))
    accounts = F.array_join(accounts_of(text), "|")
    known = F.when(accounts != "", F.concat(F.lit("(?<![A-Za-z0-9])(?:"), accounts, F.lit(")(?![A-Za-z0-9])|"))).otherwise("")
    return F.concat(known, F.when(cards != "", some).otherwise(f"{BEFORE_CARDS}|{AFTER_CARDS}"), bare)


def _name_of(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", "")


def gender_of(raw: Column) -> Column:
    """By the title; null for a neutral one or none."""
    return F.when(raw.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f").when(raw.rlike(rf"^(?:{'|'.join(MALE)})\b"), "m")


def core_of(kind: Column, raw: Column) -> Column:
    """What makes two entities the same, whatever their format; of names, one part at a time."""
    plus = F.when(F.startswith(raw, F.lit("+")), "+").otherwise("")
    letters = F.regexp_replace(F.lower(raw), "[^0-9a-f]", "")
    return F.when(kind.isin("email", "ip6"), F.lower(raw)).when(kind == "phone", F.concat(plus, _digits(raw))).when(kind == "mac", letters).when(kind == "account", _compact(raw)).when(kind.isin("card", "ssn"), _digits(raw)).when(kind == "name", F.translate(F.lower(raw), "’", "'")).otherwise(raw)


def _byte(h: Column, i: Column | int) -> Column:
    """Number i of the 64 bytes in 128 hexadecimal digits."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(h, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(core: Column, h: Column) -> Column:
    """A string of the same shape: digits for digits, small letters for small, capitals for capitals, the rest as it is."""

    def drawn(i: Column) -> Column:
        c = F.substr(core, i + 1, F.lit(1))
        of = lambda letters: F.substr(F.lit(letters), _byte(h, i) % len(letters) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), of("0123456789")).when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(core) - 1), drawn), "")


def _hexed(core: Column, h: Column) -> Column:
    """A string of the same shape: hexadecimal digits for such, the rest as it is."""
    drawn = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(h, i % 128 + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(core, ""), drawn), "")


def _name(core: Column, gender: Column, h: Column, attempt: Column) -> Column:
    """A part of a name of a gender in the script of a core; later attempts draw from longer ones, so they suffice."""
    out = F.lit(None).cast("string")
    for script, (middle, female, male, neutral) in SYLLABLES.items():
        pool = F.array(*[F.lit(s) for s in middle.split()])
        ends = {g: F.array(*[F.lit(s) for s in e.split()]) for g, e in (("f", female), ("m", male), ("n", neutral))}
        pick = lambda a, i: F.element_at(a, _byte(h, i) % F.size(a) + 1)
        end = F.when(gender == "f", pick(ends["f"], 9)).when(gender == "m", pick(ends["m"], 9)).otherwise(pick(ends["n"], 9))
        more = F.when(attempt >= 10, F.concat(pick(pool, 3), pick(pool, 4))).when(attempt >= 5, pick(pool, 3)).otherwise("")
        made = F.initcap(F.concat(pick(pool, 0), pick(pool, 1), pick(pool, 2), more, end))
        out = F.when(core.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~core.rlike(r"\p{IsCyrillic}"), made).otherwise(out)
    return out


def surrogate_core(kind: Column, core: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a core, drawn by a keyed hash."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, core, attempt.cast("string")), 512)
    shaped = _shaped(core, h)
    octet = lambda i: (_byte(h, i) % 254 + 1).cast("string")
    tail = F.regexp_extract(core, r"(\.[^.@]*)$", 1)
    body = F.concat(F.substr(core, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2), F.length(core) - 2))
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    # a phone number keeps its country's code, or its first digit where it has none
    number, drawn, plus = _digits(core), _digits(shaped), F.startswith(core, F.lit("+"))
    code = F.lit(3)
    for begins, n in reversed(COUNTRY_CODES):
        code = F.when(number.rlike(begins), n).otherwise(code)
    code = F.when(plus, code).otherwise(1)
    phone = F.concat(F.when(plus, "+").otherwise(""), F.substr(number, F.lit(1), code), (F.substr(drawn, code + 1, F.lit(1)).cast("int") % 8 + 2).cast("string"), F.substr(drawn, code + 2, F.length(core)))
    country, own = F.substr(core, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(5), F.length(core))
    account = F.concat(country, F.lpad((98 - _account_rest(F.concat(country, F.lit("00"), own))).cast("string"), 2, "0"), own)
    prefix = F.regexp_extract(core, rf"^(?:{KEY_PREFIXES})", 0)
    hexed = F.substr(F.concat(h, F.repeat(h, 8)), F.lit(1), F.length(core))
    # a short address has few of its shape: later attempts put letters before it
    longer = F.when(attempt >= 3, F.translate(F.substr(h, F.lit(100), F.floor(attempt / 3).cast("int")), "0123456789", "ghijklmnop")).otherwise("")
    email = F.concat(longer, F.substr(shaped, F.lit(1), F.length(core) - F.length(tail)), tail)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "phone", phone)
        .when(kind == "account", account)
        .when(kind.isin("mac", "ip6"), _hexed(core, h))
        .when(kind == "key", F.concat(prefix, F.substr(shaped, F.length(prefix) + 1, F.length(core))))
        .when(kind == "name", _name(core, gender, h, attempt))
        .when((kind == "secret") & core.rlike("^[0-9a-f]*[a-f][0-9a-f]*$") & (F.length(core) <= 1024), hexed)
        .otherwise(shaped)
    )


def rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """A surrogate in the format of one occurrence."""

    def digit(i: Column) -> Column:
        c = F.substr(raw, i + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(_digits(surrogate), F.length(_digits(F.substr(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    def sign(i: Column) -> Column:
        c = F.substr(raw, i + 1, F.lit(1))
        upto = F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^0-9A-Za-z]", "")
        return F.when(c.rlike("[0-9A-Za-z]"), F.substr(surrogate, F.length(upto), F.lit(1))).otherwise(c)

    signs = F.array_join(F.transform(F.sequence(F.lit(0), F.length(raw) - 1), sign), "")
    capital = F.when(raw == F.upper(raw), F.upper(signs)).otherwise(signs)
    in_place = F.array_join(F.transform(F.sequence(F.lit(0), F.length(raw) - 1), digit), "")
    email = F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), in_place).when(kind.isin("email", "ip6"), email).when(kind.isin("mac", "account"), capital).otherwise(surrogate)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, core, gender) to (kind, core, surrogate), with no two surrogates of a kind alike and none that is itself
    an entity. Of entities that drew the same surrogate the first in order keeps it, the others draw again."""
    waiting = materialize(entities.groupBy("kind", "core").agg(F.min("gender").alias("gender")).repartition("core"), "entities")
    taken = waiting.select("kind", F.when(F.col("kind") == "name", F.initcap("core")).otherwise(F.col("core")).alias("surrogate"))
    done = None
    for attempt in range(ATTEMPTS):
        drawn = waiting.withColumn("surrogate", surrogate_core(F.col("kind"), F.col("core"), F.col("gender"), key, F.lit(attempt)))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("core").alias("core"))
        won = materialize(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "core", "surrogate"), "assigned")
        done = won if done is None else done.unionByName(won)
        waiting = materialize(waiting.join(won, ["kind", "core"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return done
        taken = taken.unionByName(won.select("kind", "surrogate"))
    raise ValueError("surrogates of this format are too few for the entities")


def replace_entities(df: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with surrogates in its text, and n_entities, the number of places replaced (in place of a column of that name).

    Everything else in a text stays as it is. A null text stays null, with 0 entities; rows that repeat are treated
    alike; an empty table gives no rows; texts of any length are matched whole. Columns of df keep their names, whatever they
    are. A different key gives different surrogates; the same key the same ones, for a corpus in which the same surrogates
    are free. Digits without a valid check digit are no card. A name that a text has with a title is replaced there
    wherever it or a part of it stands; each part has one surrogate in the corpus, whatever the title, with the gender of
    the titles before first names where they agree.
    """
    kept = [c for c in df.columns if c not in ("n_entities", text)]
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    body = F.col(text)
    rows = df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(id_col).alias("id"), body.alias("text"), F.xxhash64(body).alias("hash"), F.when(hinted, pattern_of(body)).alias("pattern"))
    rows = rows.withColumn("matches", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    rows = rows.withColumn("raws", F.filter("matches", lambda x: kind_of(x).isNotNull()))
    # texts are matched once: what follows reads this table
    rows = materialize(rows.withColumn("pattern", F.when(F.size("raws") > 0, F.col("pattern"))), "matched")
    some = F.coalesce(F.size("raws"), F.lit(0)) > 0

    spots = rows.filter(some).select("id", "hash", F.explode(F.array_distinct("raws")).alias("raw")).distinct().withColumn("kind", kind_of(F.col("raw")))
    parts = F.when(F.col("kind") == "name", name_parts(F.col("raw"))).otherwise(F.array("raw"))
    spots = spots.withColumn("two", F.size(parts) == 2).select("id", "hash", "raw", "kind", "two", F.posexplode(parts).alias("pos", "part"))
    # of first names; and of names in Cyrillic every part, whose ending has a gender
    gender = F.when((F.col("two") & (F.col("pos") == 0)) | F.col("part").rlike(r"\p{IsCyrillic}"), gender_of(F.col("raw")))
    spots = spots.withColumns({"core": core_of(F.col("kind"), F.col("part")), "gender": gender})
    spots = materialize(spots.withColumn("entity", F.concat_ws("|", "kind", "core")).drop("two"), "occurrences")
    agreed = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    counts = materialize(spots.groupBy("entity", "kind", "core").agg(F.count("*").alias("n"), agreed.alias("gender")), "counts")
    total = spots.count()
    assigned = assign(counts, key).withColumn("entity", F.concat_ws("|", "kind", "core")).select("entity", "surrogate")
    assigned = materialize(assigned.join(counts.select("entity", "n"), "entity"), "surrogates")
    spots = lookup(spots, assigned.drop("n"), "entity", hot=assigned.filter(F.col("n") * HOT_SHARE > total).drop("n"))
    new = rendered(F.col("kind"), F.col("part"), F.col("surrogate"))
    whole = spots.groupBy("id", "hash", "raw").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))).alias("l"), F.first("kind").alias("kind"))
    title = F.when(F.col("kind") == "name", F.regexp_extract("raw", rf"^(?:{_TITLE})\.? ", 0)).otherwise("")
    whole = whole.select("id", "hash", "raw", F.concat(title, F.array_join(F.transform("l", lambda x: x["new"]), " ")).alias("new"))
    by_text = whole.groupBy("id", "hash").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("news")).withColumnRenamed("id", "at").withColumnRenamed("hash", "of")

    changed = rows.filter(some).join(by_text, F.col("id").eqNullSafe(F.col("at")) & (F.col("hash") == F.col("of")))
    pieces = F.split("text", F.col("pattern"), -1)
    put = F.transform("matches", lambda x: F.coalesce(F.element_at("news", x), x))
    joined = F.array_join(F.zip_with(pieces, F.concat(put, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    order = lambda body, n: [F.col(f"row.`{c}`").alias(c) for c in kept] + [body.alias(text), n.cast("long").alias("n_entities")]
    return changed.select(*order(joined, F.size("raws"))).unionByName(rows.filter(~some).select(*order(F.col("text"), F.lit(0))))
