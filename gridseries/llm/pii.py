"""Surrogates for personal data, with DataFrame functions only.

Entities (e-mail addresses, phone numbers, IPv4 addresses, card and account numbers, IBANs, access
keys, assigned secrets, names after a title, and such a name or its surname again without one in the same
text) are replaced by surrogates of the same type, format, script and gender, derived from a key.  The
same entity always gets the same surrogate.

* Digits, IPv4 addresses, IBANs: a keyed Feistel network over the digits (or the 32 bits) of the entity.
  It is a permutation of all strings of one format, so distinct entities stay distinct by construction;
  punctuation and country code stay as they are, and check digits are as right or wrong as they were.
* Secrets, the domain and the local part of an e-mail address, given names and surnames are drawn from a
  keyed hash, each for itself: so two addresses of one domain keep one domain, and a surname is the same
  with and without title and given name.  Distinct ones could get the same surrogate, so all distinct
  ones are checked and those that clash are drawn anew, and longer after some attempts, until none do.

The plan holds a digest of the key, never the key; whoever reads the plan could still draw the same
surrogates, so event logs of such a job are to be kept like the key.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm.session import checkpointed

_MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа"]
_NEUTRAL = ["Dr", "Prof"]
#: Of these the upper case is a title too; others in upper case are mostly something else.
_SHOUTED = ["Mr", "Mrs", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Dr", "Prof"]
_TITLES = "|".join(_MALE + _FEMALE + _NEUTRAL + [t.upper() for t in _SHOUTED])
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_SECRET = r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{8,}"
_AWS = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b(?!\.\d)"
_PHONE = r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}\b|\(\d{3}\) ?\d{3}[ -]\d{4}\b|\b\d{3}-\d{3}-\d{4}\b|\b0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}\b"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
_NUMBER = r"\b\d{4}(?:[ -]\d{4}){3}\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{9,19}\b"
_NAME = rf"\b(?:{_TITLES})\b\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}"
#: All entities; where two could begin at one place, the earlier alternative wins.
PATTERN = "|".join([_EMAIL, _SECRET, _AWS, _IPV4, _PHONE, _IBAN, _NUMBER, _NAME])
#: What is drawn grows by a letter or syllable each so many attempts.
_GROW = 8

_SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe ga go ha jo ka ke ki la le li lo ma me mi mo na ne no pa pe ra re ro".split(),
    "cyrillic": "ба бе би бо да де до фа фе га го ха жо ка ке ки ла ле ли ло ма ме ми мо на не но па пе ра ре ро".split(),
    "greek": "βα βε βι βο δα δε δο φα φε γα γο χα ζο κα κε κι λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρο".split(),
}
_ENDINGS = {"latin": ("n", "a", "s"), "cyrillic": ("н", "на", "с"), "greek": ("ς", "α", "ν")}


def maybe(text: Column) -> Column:
    """False only for texts without an entity: every alternative of PATTERN has one of these in it, the cheap ones first."""
    signs = [text.contains(x) for x in ("@", "=", ":", "AKIA", "ASIA")]
    return reduce(lambda x, y: x | y, [*signs, text.rlike(r"\d[\d.]"), text.rlike(rf"\b(?:{_TITLES})\b")])


def kind(e: Column) -> Column:
    """email, secret, ipv4, phone, iban, number or name."""
    full = lambda p: e.rlike(f"^(?:{p})$")
    return F.when(full(_EMAIL), "email").when(full(_SECRET) | full(_AWS), "secret").when(full(_IPV4), "ipv4").when(full(_PHONE), "phone").when(full(_IBAN), "iban").when(full(_NUMBER), "number").otherwise("name")


def described(entities: Column) -> Column:
    """Of each entity e a struct (e, kind, title, bare, gender): the title of a name with what follows it up to the name, the
    rest, and 0 for a title of men, 1 for one of women, else 2.  Each is worked out once, and all else reads it."""
    titled = F.transform(entities, lambda e: F.struct(e.alias("e"), kind(e).alias("kind"), F.regexp_extract(e, rf"^((?:{_TITLES})\b\.? )?", 1).alias("title")))
    word = lambda x: F.regexp_replace(x["title"], r"\.? $", "")
    of = lambda titles: titles + [t.upper() for t in titles]
    return F.transform(
        titled,
        lambda x: F.struct(
            x["e"].alias("e"),
            x["kind"].alias("kind"),
            x["title"].alias("title"),
            F.substring(x["e"], F.length(x["title"]) + 1, F.length(x["e"])).alias("bare"),
            F.when(word(x).isin(of(_MALE)), 0).when(word(x).isin(of(_FEMALE)), 1).otherwise(2).alias("gender"),
        ),
    )


def _secret_value(e: Column) -> Column:
    return F.regexp_extract(e, r"([A-Za-z0-9+/_.~-]{8,})$", 1)


def units(x: Column) -> Column:
    """What is drawn for a described entity: an array of (what, unit), each of which has one surrogate everywhere."""
    e, words = x["e"], F.split(F.lower(x["bare"]), " ")
    unit = lambda what, u: F.struct(F.lit(what).alias("what"), u.alias("unit"))
    names = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "surname").otherwise("given").alias("what"), w.alias("unit")))
    return (
        F.when(x["kind"] == "email", F.array(unit("domain", F.lower(F.substring_index(e, "@", -1))), unit("email", F.lower(e))))
        .when(x["kind"] == "secret", F.array(unit("secret", _secret_value(e))))
        .when(x["kind"] == "name", names)
        .otherwise(F.array().cast("array<struct<what:string,unit:string>>"))
    )


def _hash(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, m_left: Column, m_right: Column, key: str, tweak: Column) -> tuple[Column, Column]:
    """Four rounds over the pairs left < m_left, right < m_right; every round can be undone."""
    state = F.struct(left.alias("l"), right.alias("r"))
    def step(s, i):
        l2 = F.pmod(s["l"] + F.pmod(_number(_hash(key, tweak, i, F.lit("l"), s["r"])), m_left), m_left)
        r2 = F.pmod(s["r"] + F.pmod(_number(_hash(key, tweak, i, F.lit("r"), l2)), m_right), m_right)
        return F.struct(l2.alias("l"), r2.alias("r"))
    out = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), state, step)
    return out["l"], out["r"]


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), 1 + n, "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """Another string of as many digits (0 to 36), by a keyed permutation of all such strings."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a)
    number = lambda s: F.coalesce(F.try_cast(s, "long") if hasattr(F, "try_cast") else s.try_cast("long"), F.lit(0))
    l2, r2 = _feistel(number(left), number(right), _power(a), _power(n - a), key, F.concat(F.lit(tweak), n.cast("string")))
    pad = lambda v, width: F.when(width > 0, F.lpad(v.cast("string"), width, "0")).otherwise("")
    return F.concat(pad(l2, a), pad(r2, n - a))


def _refill(e: Column, digits: Column) -> Column:
    """`e` with its digits replaced in order by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    def step(s, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit.cast("int")).alias("at"))
    return F.aggregate(F.split(e, ""), start, step)["out"]


def _only_digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after `digits`."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10)), F.lit(10))


def _numbers(e: Column, key: str) -> Column:
    digits = _only_digits(e)
    body, check = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    new = permute_digits(body, key, "number")
    return _refill(e, F.concat(new, F.pmod(_luhn(new) + check - _luhn(body), F.lit(10)).cast("string")))


def _phone(e: Column, key: str) -> Column:
    country = F.regexp_extract(e, r"^\+(\d{1,3}?)(?:[ .(-]|\d{8,}$)", 1)
    rest = F.substring(_only_digits(e), F.length(country) + 1, F.length(e))
    return _refill(e, F.concat(country, permute_digits(rest, key, "phone")))


def _ipv4(e: Column, key: str) -> Column:
    part = [F.element_at(F.split(e, r"\."), i + 1).cast("long") for i in range(4)]
    valid = reduce(lambda a, b: a & b, [p <= 255 for p in part])
    l2, r2 = _feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ipv4"))
    octet = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string"))
    return F.when(valid, F.concat_ws(".", octet(l2), octet(r2))).otherwise(_refill(e, permute_digits(_only_digits(e), key, "ipv4")))


def _drawn(chars: Column, draw: Column) -> Column:
    """Letters, digits and case of `chars` drawn anew from the hex string `draw`; other characters stay."""
    at = lambda i: F.conv(F.substring(draw, 2 * F.pmod(i, F.lit(30)) + 1, F.lit(4)), 16, 10).cast("int") + i
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), F.pmod(at(i), F.lit(len(alphabet))) + 1, F.lit(1))
    one = lambda c, i: F.when(c.rlike("^[0-9]$"), pick("0123456789", i)).when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz", i)).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c)
    return F.array_join(F.transform(F.split(chars, ""), one), "")


def _letters(draw: Column, n: Column | int, alphabet: Column, size: int) -> Column:
    """`n` of the `size` letters or syllables of `alphabet`, drawn from the hex string `draw` (20 at most are independent)."""
    at = lambda i: F.conv(F.substring(draw, 3 * F.pmod(i, F.lit(20)) + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 20).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda i: F.element_at(alphabet, F.pmod(at(i), F.lit(size)) + 1)), "")


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _by_script(word: Column, of: dict[str, Column]) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), of["cyrillic"]).when(word.rlike(r"\p{IsGreek}"), of["greek"]).otherwise(of["latin"])


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _secret(c: Column, key: str, attempt: Column) -> Column:
    """Hex stays hex; the fixed beginning of access keys stays."""
    draw = F.concat(_hash(key, "secret", attempt, c), _hash(key, "secret2", attempt, c))
    same_hex = F.substring(F.repeat(draw, F.ceil(F.length(c) / 128).cast("int")), F.lit(1), F.length(c))
    return F.when(c.rlike("^[0-9a-f]+$"), same_hex).when(c.rlike(f"^{_AWS}$"), F.concat(F.substring(c, 1, 4), _drawn(F.substring(c, 5, 16), draw))).otherwise(_drawn(c, draw))


def drawn_unit(what: str, unit: Column, key: str, attempt: Column, letters: int = 10) -> Column:
    """The surrogate of a unit: an email (with its own domain), domain, secret or name (without case and ending);
    `letters` is the size of what is drawn."""
    if what == "secret":
        return _secret(unit, key, attempt)
    # A given name and a surname that are spelled alike are drawn alike.
    draw, more = _hash(key, what, attempt, unit), F.floor(attempt / _GROW).cast("int")
    if what == "name":
        return _letters(draw, max(1, letters // 2) + more, _by_script(unit, {k: _array(v) for k, v in _SYLLABLES.items()}), 32)
    if what == "domain":
        return F.concat(_letters(draw, letters + more, _array(_ALPHABET), 26), F.lit("."), F.substring_index(unit, ".", -1))
    longer = F.when(more > 0, _letters(_hash(key, "more", attempt, unit), more, _array(_ALPHABET), 26)).otherwise("")
    return F.concat(_drawn(F.substring_index(unit, "@", 1), draw), longer, F.lit("@"), F.substring_index(unit, "@", -1))


def _iban_check(e: Column) -> Column:
    """The check number that belongs to an IBAN: 2 to 98."""
    c = F.regexp_replace(e, " ", "")
    value = lambda x: F.when(x.rlike("^[0-9]$"), x.cast("int")).otherwise(F.ascii(x) - 55)
    chars = F.split(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 2), F.lit("00")), "")
    rest = F.aggregate(F.filter(chars, lambda x: x != ""), F.lit(0), lambda r, x: F.pmod(r * F.when(x.rlike("^[0-9]$"), 10).otherwise(100) + value(x), F.lit(97)))
    return 98 - rest


def _iban(e: Column, key: str) -> Column:
    """Country and grouping stay; digits are permuted, each letter is shifted by its place; the check number is as right as it was."""
    shift = lambda i: F.pmod(_number(_hash(key, "iban letter", i)), F.lit(26)).cast("int")
    body = F.substring(e, F.lit(5), F.length(e))
    shifted = F.array_join(F.transform(F.split(body, ""), lambda x, i: F.when(x.rlike("^[A-Z]$"), F.char(F.pmod(F.ascii(x) - 65 + shift(i), F.lit(26)) + 65)).otherwise(x)), "")
    new = _refill(shifted, permute_digits(_only_digits(body), key, "iban"))
    old = F.substring(e, 3, 2).cast("int")
    bare = F.concat(F.substring(e, 1, 2), F.lit("00"), new)
    check = 2 + F.pmod(_iban_check(bare) - 2 + old - _iban_check(e), F.lit(97))
    return F.concat(F.substring(e, 1, 2), F.when(old.between(2, 98), F.lpad(check.cast("string"), 2, "0")).otherwise(F.substring(e, 3, 2)), new)


def surrogate(x: Column, key: str, all_of: Column, redrawn: Column | None = None, letters: int = 10) -> Column:
    """The surrogate of one described mention; `all_of` has those of its text, `redrawn` maps what + unit to the attempt it needs.

    A title that tells no gender takes that of another mention of the same name in the text.
    """
    e = x["e"]

    def unit(drawn: str, what: Column | str, u: Column) -> Column:
        what = F.lit(what) if isinstance(what, str) else what
        attempt = F.lit(0) if redrawn is None else F.coalesce(F.try_element_at(redrawn, F.concat_ws("\x1f", what, u)), F.lit(0))
        return drawn_unit(drawn, u, key, attempt, letters)

    lower, value = F.lower(e), _secret_value(e)
    email = F.concat(F.substring_index(unit("email", "email", lower), "@", 1), F.lit("@"), unit("domain", "domain", F.substring_index(lower, "@", -1)))
    others = F.filter(all_of, lambda y: (y["kind"] == "name") & (y["gender"] < 2) & (y["bare"] == x["bare"]))
    gender = F.when(x["gender"] < 2, x["gender"]).otherwise(F.coalesce(F.try_element_at(others, F.lit(1))["gender"], F.lit(2)))
    words = F.split(x["bare"], " ")
    endings = {k: F.element_at(_array(v), gender + 1) for k, v in _ENDINGS.items()}

    def word(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        made = F.concat(unit("name", F.when(last, "surname").otherwise("given"), F.lower(w)), F.when(last, "").otherwise(_by_script(w, endings)))
        return F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(made)).otherwise(F.initcap(made))

    return (
        F.when(x["kind"] == "secret", F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(value)), unit("secret", "secret", value)))
        .when(x["kind"] == "email", email)
        .when(x["kind"] == "name", F.concat(x["title"], F.array_join(F.transform(words, word), " ")))
        .when(x["kind"] == "ipv4", _ipv4(e, key))
        .when(x["kind"] == "phone", _phone(e, key))
        .when(x["kind"] == "iban", _iban(e, key))
        .otherwise(_numbers(e, key))
    )


def _again(found: Column) -> Column:
    """A pattern of the names that have a title among the described entities: whole, and the surname if it isn't short; null without any."""
    names = F.transform(F.filter(found, lambda x: (x["kind"] == "name") & (F.length(x["title"]) > 0)), lambda x: x["bare"])
    whole = F.filter(names, lambda n: F.contains(n, F.lit(" ")))
    last = F.filter(F.transform(names, lambda n: F.substring_index(n, " ", -1)), lambda n: F.length(n) >= 3)
    return F.array_join(F.concat(F.array_distinct(whole), F.array_distinct(last)), "|")


def with_entities(docs: DataFrame, pattern: str, entities: str) -> DataFrame:
    """`docs` with the columns `pattern`, which finds all entities of its text, and `entities`, all of them in order, described.

    The second is empty for a null text.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    docs = docs.withColumn(entities, F.when(maybe(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none))
    docs = docs.withColumn(entities, described(F.col(entities)))
    docs = docs.withColumn(pattern, _again(F.col(entities)))
    more = F.concat(F.lit(PATTERN + r"|\b(?:"), F.col(pattern), F.lit(r")\b"))
    docs = docs.withColumn(pattern, F.when(F.col(pattern) != "", more).otherwise(F.lit(PATTERN)))
    return docs.withColumn(entities, F.when(F.col(pattern) != PATTERN, described(F.regexp_extract_all(text, F.col(pattern), F.lit(0)))).otherwise(F.col(entities)))


def clashes(found: DataFrame, key: str, letters: int = 10) -> DataFrame | None:
    """(what, unit, attempt) of the units that need another attempt than the first; None if none do.

    `found` has a column `entities` of described ones.  Distinct units with one surrogate are told apart:
    the smallest keeps it, the others draw again, until all surrogates of a kind differ.
    """
    e = found.select(F.explode("entities").alias("x")).select(F.explode(units(F.col("x"))).alias("u"))
    all_of = e.select("u.what", "u.unit").distinct().withColumn("attempt", F.lit(0))
    one = lambda kind: drawn_unit(kind, F.col("unit"), key, F.col("attempt"), letters)
    made = F.when(F.col("what") == "email", one("email")).when(F.col("what") == "domain", one("domain")).when(F.col("what") == "secret", one("secret")).otherwise(one("name"))
    redrawn = None
    while True:
        drawn = all_of.withColumn("surrogate", made)
        same = drawn.groupBy("what", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
        again = checkpointed(same.select("what", "surrogate"))
        if not again.limit(1).count():
            return redrawn
        order = Window.partitionBy("what", "surrogate").orderBy("attempt", "unit")
        moved = drawn.join(again.withColumn("again", F.lit(1)), ["what", "surrogate"], "left")
        moved = moved.withColumn("attempt", F.col("attempt") + F.when(F.col("again").isNotNull(), F.row_number().over(order) - 1).otherwise(0))
        all_of = checkpointed(moved.select("what", "unit", "attempt"))
        redrawn = all_of.where("attempt > 0")


def replace_entities(docs: DataFrame, key: str, letters: int = 10) -> DataFrame:
    """`docs` with surrogates in `text`, and the number of entities in `n_entities`; other columns stay.

    A null text stays null and an empty one empty, with no entity.  Texts are cut at the entities and
    joined again, so nothing else changes.  An earlier column n_entities is replaced; columns of any other
    name are left alone.  Repeated rows get the same surrogates; an empty table gives no rows.
    """
    key = hashlib.sha256(key.encode()).hexdigest()
    docs = docs.drop("n_entities")
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any column of docs
    pattern, entities, redraw = f"{own}p", f"{own}e", f"{own}r"
    # Written once: the patterns are the dear part, and a filter on their result would run them again and again.
    found = checkpointed(with_entities(docs, pattern, entities))
    redrawn = clashes(found.select(F.col(entities).alias("entities")).where("size(entities) > 0"), key, letters)
    table = None
    if redrawn is not None:
        mentions = found.select(F.sha2("text", 256).alias(redraw), F.explode(entities).alias("x")).select(redraw, F.explode(units(F.col("x"))).alias("u")).select(redraw, "u.what", "u.unit").distinct()
        entry = F.struct(F.concat_ws("\x1f", "what", "unit"), "attempt")
        by_text = mentions.join(redrawn, ["what", "unit"]).groupBy(F.col(redraw).alias(f"{redraw}k")).agg(F.map_from_entries(F.collect_set(entry)).alias(redraw))
        found = found.join(by_text, F.sha2("text", 256) == F.col(f"{redraw}k"), "left").drop(f"{redraw}k")
        table = F.coalesce(redraw, F.create_map().cast("map<string,int>"))
    new = F.transform(entities, lambda x: surrogate(x, key, F.col(entities), table, letters))
    pieces = F.split("text", F.col(pattern), -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    n = F.size(entities).cast("long")
    return found.select(*[(F.when(F.col("text").isNotNull() & (n > 0), joined).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)) for c in docs.columns], n.alias("n_entities"))


#: The key of the registered query.  A real one comes from a secret store.
DEMO_KEY = "example key"


def op8(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DEMO_KEY)
