"""Personal data replaced by keyed surrogates, in DataFrame expressions only.

Entities are found by regular expressions: e-mail addresses, telephone numbers, IPv4
addresses, payment card and social security numbers, hexadecimal secrets, and names
behind a title; a name found so is replaced wherever else its document has it, given name
or surname alone. Each has an identity that spelling does not change (letters in lower
case, digits without separators; given name and surname apart), and the surrogate is a
function of key, type, identity and attempt alone: every mention, in any document, gets
the same one. It keeps the format: letters stay letters of their script and case, digits
digits, separators and top-level domains stay, card numbers keep a valid (or invalid)
check digit, addresses move to 10.0.0.0/8 (from the fifth attempt on to 240.0.0.0/4), names keep gender and script and get a syllable longer with each attempt.

Two identities of one type never share a surrogate, and none is another's identity: the
table of identities is checked, the losers of a clash try again with the next attempt.
Only identities past the first attempt are looked up by the documents; all others are
computed in place, so texts are not shuffled unless those exceptions are many.

Defined results: null text stays null and empty text empty, with no entities; repeated
rows are each rewritten alike; an empty table gives no rows; extra columns stay under any
name, while ``text`` is replaced and ``n_entities`` and ``entity_types`` are added (replacing
columns of those names; mentions without a title are not counted). If an identity finds no free surrogate in ``MAX_ATTEMPTS`` tries, the
job raises.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.shared import written

MAX_ATTEMPTS = 64
WOMEN = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|госпожа"
MEN = "Mr|Herr|Señor|Sr|Monsieur|господин"
TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{WOMEN}|{MEN}|Dr|Prof)\.?[ \x{{A0}}]"
NAME = r"\p{Lu}[\p{L}'-]+"
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "PHONE": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "IP": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "SECRET": r"(?<![\p{L}\p{N}])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])",
    "CARD": r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "PERSON": rf"{TITLE}{NAME}(?:[ \x{{A0}}]{NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these have no entity.
HINT = rf"[@0-9]|(?:{WOMEN}|{MEN}|Dr|Prof)\.?[ \x{{A0}}]\p{{Lu}}"
NUMBERS = ("PHONE", "SSN", "CARD")

LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SYLLABLES = {
    "Latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "vi"],
    "Cyrillic": ["ба", "бе", "бо", "да", "де", "до", "фа", "фе", "га", "го", "ка", "ке", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "ра", "ре", "ри", "ро", "са", "се", "та", "ви"],
}
ENDINGS = {"Latin": {"F": ["na", "la", "ra", "sa"], "M": ["n", "rd", "s", "rt"], "N": ["n", "na", "s", "ra"], "S": ["berg", "man", "sen", "well"]}, "Cyrillic": {"F": ["на", "ла", "ра", "са"], "M": ["н", "рд", "с", "рт"], "N": ["н", "на", "с", "ра"], "S": ["енко", "ин", "ский", "ов"]}}


def kind(hit: Column) -> Column:
    """The entity type of a match."""
    out = F.when(F.lit(False), "")
    for name, p in PATTERNS.items():
        out = out.when(hit.rlike(rf"^(?:{p})$"), name)
    return out


def digest(key: str, name: Column, identity: Column, attempt: Column) -> Column:
    """Keyed SHA-256, nested so that the key guards both ends."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), name, attempt.cast("string"), identity), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), 256)


def draw(d: Column, i: Column, n: int) -> Column:
    """The i-th number below n that a digest gives."""
    at = 2 * F.pmod(i, F.lit(32)) + 1
    return F.pmod(F.conv(F.substr(d, at, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int"), F.lit(n))


def letter(alphabet: str, d: Column, i: Column) -> Column:
    return F.substr(F.lit(alphabet), draw(d, i, len(alphabet)) + 1, F.lit(1))


def swapped(c: Column, d: Column, i: Column) -> Column:
    """Another character of the same sort (lower case): digit, or letter of the script."""
    return (
        F.when(c.rlike("[0-9]"), draw(d, i, 10).cast("string"))
        .when(c.rlike(r"\p{IsCyrillic}"), letter(CYRILLIC, d, i))
        .when(c.rlike(r"\p{IsGreek}"), letter(GREEK, d, i))
        .when(c.rlike(r"\p{L}"), letter(LATIN, d, i))
        .otherwise(c)
    )


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def joined(a: Column) -> Column:
    return F.array_join(a, "")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string whose check digit is last."""
    each = F.transform(chars(F.reverse(digits)), lambda c, i: c.cast("int") * (1 + F.pmod(i, F.lit(2))))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + F.pmod(x, F.lit(10))), F.lit(10))


def surrogate(name: Column, identity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an identity, in the identity's own spelling."""
    d = digest(key, name, identity, attempt)
    swap = lambda s: joined(F.transform(chars(s), lambda c, i: swapped(c, d, i)))
    body, tld = F.regexp_extract(identity, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(identity, r"^(.*)(\.[^.]+)$", 2)
    hex_ = joined(F.transform(chars(identity), lambda _, i: F.substr(d, F.pmod(i, F.lit(64)) + 1, F.lit(1))))
    card = F.left(swap(identity), F.length(identity) - 1)
    check = F.pmod(10 - luhn(F.concat(card, F.lit("0"))), F.lit(10))
    last = F.when(luhn(identity) == 0, check).otherwise(F.pmod(check + 1 + draw(d, F.lit(31), 9), F.lit(10)))
    octet = lambda i: draw(d, F.lit(i), 256).cast("string")

    def composed(script: str, sort: str) -> Column:
        s = F.array(*map(F.lit, SYLLABLES[script]))
        e = F.array(*map(F.lit, ENDINGS[script][sort]))
        parts = [F.element_at(s, draw(d, F.lit(i), 32) + 1) for i in range(3)]
        grown = joined(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.element_at(s, draw(d, i + 5, 32) + 1)))
        return F.concat(*parts, F.when(attempt > 0, grown).otherwise(""), F.element_at(e, draw(d, F.lit(5), 4) + 1))

    named = lambda sort: F.when(identity.rlike(r"\p{IsCyrillic}"), composed("Cyrillic", sort)).otherwise(composed("Latin", sort))
    return (
        F.when(name == "EMAIL", F.concat(swap(body), tld))
        .when(name == "PHONE", F.concat(F.left(identity, F.lit(1)), F.substr(swap(identity), F.lit(2))))
        .when(name == "SSN", swap(identity))
        .when(name == "CARD", F.concat(card, last.cast("string")))
        .when(name == "IP", F.concat_ws(".", F.when(attempt < 4, "10").otherwise((240 + draw(d, F.lit(3), 16)).cast("string")), octet(0), octet(1), octet(2)))
        .when(name == "SECRET", hex_)
        .when(name == "GIVEN_F", named("F")).when(name == "GIVEN_M", named("M")).when(name == "GIVEN_N", named("N"))
        .when(name == "SURNAME", named("S"))
    )


def like(s: Column, model: Column) -> Column:
    """``s`` in the case of ``model``: all capitals, or capital first, or as it is."""
    return F.when((F.length(model) > 1) & (model == F.upper(model)), F.upper(s)).otherwise(F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2))))


def names(hit: Column) -> tuple[Column, Column, Column]:
    """Title with its blanks, given name (or empty) and surname of a PERSON match."""
    title = F.regexp_extract(hit, rf"^({TITLE})", 1)
    rest = F.substr(hit, F.length(title) + 1)
    given = F.regexp_extract(rest, r"^([^ \x{A0}]+[ \x{A0}])", 1)
    return title, given, F.substr(rest, F.length(given) + 1)


def parts(name: Column, hit: Column) -> Column:
    """The (type, identity) pairs that a match is made of."""
    title, given, surname = names(hit)
    sort = F.when(title.rlike(rf"^(?:{WOMEN})[^\p{{L}}]"), "GIVEN_F").when(title.rlike(rf"^(?:{MEN})[^\p{{L}}]"), "GIVEN_M").otherwise("GIVEN_N")
    one = lambda t, i: F.struct(t.alias("type"), F.lower(i).alias("identity"))
    last = one(F.lit("SURNAME"), surname)
    bare = F.regexp_replace(given, r"[ \x{A0}]", "")
    person = F.when(given != "", F.array(one(sort, bare), last)).otherwise(F.array(last))
    identity = F.when(name.isin(*NUMBERS), F.regexp_replace(hit, "[^0-9]", "")).otherwise(hit)
    return F.when(name == "PERSON", person).otherwise(F.array(one(name, identity)))


def rendered(name: Column, hit: Column, own: Column, attempts: Column, key: str) -> Column:
    """A match rewritten; ``own`` are its ``parts``, ``attempts`` a map of the exceptions or null."""

    def new(p: Column) -> Column:
        found = F.try_element_at(attempts, F.concat_ws("|", p["type"], p["identity"]))
        return surrogate(p["type"], p["identity"], F.coalesce(found, F.lit(0)), key)

    s = F.transform(own, new)
    first = F.get(s, F.lit(0))
    step = lambda acc, c: F.struct(
        F.concat(acc["s"], F.when(c.rlike("[0-9]"), F.substr(first, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"),
        (acc["k"] + c.rlike("[0-9]").cast("int")).alias("k"),
    )
    digits = F.aggregate(chars(hit), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), step)["s"]
    cased = joined(F.zip_with(chars(hit), chars(first), lambda c, n: F.when(c != F.lower(c), F.upper(n)).otherwise(n)))
    cased = F.when((hit == F.upper(hit)) & (hit != F.lower(hit)), F.upper(first)).otherwise(cased)
    title, given, surname = names(hit)
    last = like(F.get(s, F.size(s) - 1), surname)
    blank = F.right(given, F.lit(1))
    person = F.concat(title, F.when(given != "", F.concat(like(first, F.regexp_replace(given, r"[ \x{A0}]", "")), blank)).otherwise(""), last)
    return F.when(name.isin(*NUMBERS), digits).when(name == "IP", first).when(name == "PERSON", person).otherwise(cased)


def hits(text: Column) -> Column:
    """Matches as (type, hit, parts), in order; empty where no hint of any is there."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform(found, lambda h: F.struct(kind(h).alias("type"), h.alias("hit")))
    return F.transform(typed, lambda x: F.struct(x["type"], x["hit"], parts(x["type"], x["hit"]).alias("parts")))


def spelled_names(found: Column) -> Column:
    """The given names and surnames of PERSON matches as they are spelled: (word, type, identity)."""

    def one(x: Column) -> Column:
        _, given, surname = names(x["hit"])
        words = F.filter(F.array(F.regexp_replace(given, r"[ \x{A0}]", ""), surname), lambda w: w != "")
        return F.zip_with(words, x["parts"], lambda w, p: F.struct(w.alias("word"), p["type"].alias("type"), p["identity"].alias("identity")))

    return F.flatten(F.transform(F.filter(found, lambda x: x["type"] == "PERSON"), one))


def without_names(s: Column, named: Column, attempts: Column, key: str) -> Column:
    """A stretch of text with later mentions of these names, without a title, replaced by their surrogates; words as spelled or in capitals."""
    words = F.array_distinct(F.flatten(F.transform(named, lambda n: F.array(n["word"], F.upper(n["word"])))))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def new(h: Column) -> Column:
        n = F.get(F.filter(named, lambda n: n["identity"] == F.lower(h)), F.lit(0))
        attempt = F.coalesce(F.try_element_at(attempts, F.concat_ws("|", n["type"], n["identity"])), F.lit(0))
        return like(surrogate(n["type"], n["identity"], attempt, key), h)

    kept = F.split(s, pattern, -1)
    put = F.concat(F.transform(F.regexp_extract_all(s, pattern, F.lit(0)), new), F.array(F.lit("")))
    return joined(F.zip_with(kept, put, lambda a, b: F.concat(a, b)))


def assigned(identities: DataFrame, key: str) -> DataFrame:
    """(type, identity, attempt, surrogate): distinct within each type, and no surrogate is an identity of the type."""
    todo, done = identities, None
    for attempt in range(MAX_ATTEMPTS):
        tried = todo.withColumn("surrogate", surrogate(F.col("type"), F.col("identity"), F.lit(attempt), key))
        free = tried.join(identities.select("type", F.col("identity").alias("surrogate")), ["type", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = free.groupBy("type", "surrogate").agg(F.min("identity").alias("identity")).select("type", "identity", F.lit(attempt).alias("attempt"), "surrogate")
        won = written(won, "surrogates")
        done = won if done is None else done.unionAll(won)
        todo = written(todo.join(won, ["type", "identity"], "left_anti"), "identities")
        if todo.isEmpty():
            return done
    raise RuntimeError("no free surrogate: the space of a format is too small for its identities")


def pseudonymised(documents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents with surrogates, the table of surrogates). Keep the second apart: it undoes the first."""
    documents = documents.drop("n_entities", "entity_types").withColumn("text", F.col("text").cast("string"))
    # columns by number, so that no name of the input is in the way
    names_ = documents.columns
    docs = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names_)])
    text = F.col(f"c{names_.index('text')}")
    found = docs.filter(text.rlike(HINT)).select(F.explode(hits(text)).alias("x"))
    identities = written(found.select(F.explode("x.parts").alias("p")).select("p.type", "p.identity").distinct(), "identities")
    table = assigned(identities, key)
    again = written(table.filter("attempt > 0").select("type", "identity", "attempt"), "exceptions")

    row = F.xxhash64(text)
    if again.isEmpty():
        docs = docs.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        mentions = docs.filter(text.rlike(HINT)).select(row.alias("row"), F.explode(F.flatten(F.transform(hits(text), lambda x: x["parts"]))).alias("p"))
        mentions = mentions.select("row", "p.type", "p.identity").distinct().join(again, ["type", "identity"])
        entry = F.struct(F.concat_ws("|", "type", "identity"), "attempt")
        attempts = written(mentions.groupBy("row").agg(F.map_from_entries(F.collect_set(entry)).alias("attempts")), "attempts")
        docs = docs.withColumn("row", row).join(attempts, "row", "left").drop("row")

    docs = docs.withColumn("hits", hits(text)).withColumn("named", spelled_names(F.col("hits")))
    new = F.transform("hits", lambda x: rendered(x["type"], x["hit"], x["parts"], F.col("attempts"), key))
    between = F.split(text, ANY, -1)
    between = F.when(F.size("named") > 0, F.transform(between, lambda s: without_names(s, F.col("named"), F.col("attempts"), key))).otherwise(between)
    padded = F.concat(new, F.array(F.lit("")))
    rewritten = joined(F.zip_with(between, padded, lambda a, b: F.concat(a, b)))
    out = {f"c{k}": c for k, c in enumerate(names_)}
    docs = docs.select(
        *[(F.when(F.size("hits") > 0, rewritten).otherwise(text) if c == "text" else F.col(k)).alias(c) for k, c in out.items()],
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_entities"), F.transform("hits", lambda x: x["type"]).alias("entity_types"),
    )
    return docs, table
