"""Operator 2 [native]: personal data replaced by keyed, type-consistent surrogates.

DataFrame functions only. Entities (e-mail and IP addresses, phone, card, social-security and bank
account numbers, secrets, names after a title) are found by one pattern. Each distinct entity gets a
surrogate from a keyed hash: digits stay digits, letters stay letters of their script and case,
separators stay, card and bank account numbers pass their check digits again, phone numbers keep the
country's code, names keep title, gender and script, addresses become reserved ones. A number like a card's
that fails its check digit is no card and stays. Surrogates are checked over all entities of the table: two
entities never share one, and none is itself an entity; who loses such a collision is hashed again.
The same entity (a number in another grouping, an address or a hexadecimal secret in other case, a name without its first
name, a name that comes again without its title) has the same surrogate wherever it comes.

Rows with entities are written apart; of them only the entities are shuffled, once for each distinct
text, and the texts are joined to their replacements at the end. All other rows pass through.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: Titles before names, by gender; "n": those that don't tell it (fixed values).
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Sr Signor Господин Κύριος",
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Sra Signora Госпожа Κυρία",
    "n": "Dr Doctor Prof Professor Доктор Профессор",
}
#: Parts that surrogate names are made of, by script; endings by gender ("": surnames).
PARTS = {
    "latin": "bal cor del fen gar hol jun kel lor mar nol pel rus sal tor ven".split(),
    "cyrillic": "бал гор дел жан зел кол лар мир нов пет рус сал тор фед чер юр".split(),
    "greek": "βαλ γορ δελ ζαν θελ καλ λαρ μιρ νικ παλ ρον σαλ τορ φιλ χαρ στα".split(),
}
ENDINGS = {
    "latin": {"m": "an en io ok".split(), "f": "a ia ella ine".split(), "n": "is ey or el".split(), "": "by der mont well".split()},
    "cyrillic": {"m": "ан ей ил слав".split(), "f": "а ия ина мила".split(), "n": "ри лю ни жи".split(), "": "ев ко ский ук".split()},
    "greek": {"m": "ος ης ων ας".split(), "f": "α ια ινα η".split(), "n": "ι ου ις ω".split(), "": "ιδης ακης ου ας".split()},
}
#: Letters that stand for hexadecimal digits, by script.
LETTERS = {"latin": "ghijklmnopqrstuv", "cyrillic": "абвгдежиклмнопрс", "greek": "αβγδεζηθικλμνξοπ"}
#: Country codes of one and of two digits; all others have three (fixed values).
CODES = {1: "1 7".split(), 2: "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

#: Their first letters: a quick test before the longer ones.
_FIRST = "".join(sorted({t[0] for t in " ".join(TITLES.values()).split()}))
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_TITLE = rf"(?:{'|'.join(' '.join(TITLES.values()).split())})"
#: A name's titles, one or several.
TITLED = rf"^(?:{_TITLE}\.? +)+"
#: What secrets of known makers begin with (fixed by them).
MAKERS = r"(?:(?:sk|pk)[-_](?:(?:live|test)[-_])?|(?:github_pat|ghp|gho|glpat|xoxb|xoxp)[-_])"
#: A word that says that a secret follows, in a name that may go on, maybe quoted; or the scheme of a header.
NAMED = r"(?i:token|secret|passwo?r?d|api[_-]?key)[\w-]{0,24}[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
BEARER = r"(?i:bearer)\s{1,2}"
#: Patterns of each kind, in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{{32,}}|eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{5,}}|AKIA[0-9A-Z]{{16}}|{MAKERS}[A-Za-z0-9_-]{{16,}})(?![0-9A-Za-z])|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{12}})(?<={NAMED}|{BEARER})[A-Za-z0-9+/_-]{{12,}}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)|(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+(-])\d(?:[ -]?\d){12,18}(?!\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?!\d)|(?<![\w+])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+.-])(?:\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4} \d{3,4} \d{3,4}|0\d(?:[ .-]\d{2}){4}|0\d{1,4}[ /-]\d{5,8})(?!\d)",
    "name": rf"(?=[{_FIRST}])(?<!\p{{L}})(?:{_TITLE}\.? +)+{_NAME}(?: +{_NAME}){{0,3}}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What each kind can't be without, quickly told: a digit, an @, or what a secret without digits and a name begin with.
MAYBE = rf"[@0-9]|[A-Fa-f]{{32}}|eyJ|AKIA|{MAKERS}|{NAMED}|{BEARER}|" + KINDS["name"]
#: A secret of hexadecimal digits, in lower, upper or mixed case.
HEX = "^[0-9A-Fa-f]{32,}$"
ROUNDS = 40
#: Bytes of texts with entities that a task replaces, about.
PART_BYTES = 8 << 20


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kind_of(raw: Column) -> Column:
    """Of a match; secrets have patterns that depend on what stands before them, so they are all the rest."""
    return F.coalesce(F.when(raw.rlike(HEX), F.lit("secret")), *(F.when(raw.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items() if k != "secret"), F.lit("secret"))


def national(raw: Column) -> Column:
    """A phone number's digits without its country's code and leading zeros."""
    digits = _digits(raw)
    code = F.when(F.left(digits, F.lit(1)).isin(CODES[1]), 1).when(F.left(digits, F.lit(2)).isin(CODES[2]), 2).otherwise(3)
    return F.regexp_replace(F.when(raw.startswith("+"), digits.substr(code + 1, F.length(digits))).otherwise(digits), "^0+", "")


def canonical(kind: Column, raw: Column) -> Column:
    """What is equal for all ways to write an entity."""
    lowered = (kind == "email") | ((kind == "secret") & raw.rlike(HEX) & (F.upper(raw) == raw))
    return F.when(kind.isin("card", "ssn"), _digits(raw)).when(kind == "phone", national(raw)).when(kind == "iban", F.regexp_replace(raw, " ", "")).when(lowered, F.lower(raw)).otherwise(raw)


def script_of(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(c.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def stream(*seed: Column) -> Column:
    """256 hexadecimal digits from the seed."""
    whole = F.concat_ws("\x1f", *seed)
    return F.concat(*(F.sha2(F.concat(whole, F.lit(f"\x1f{i}")), 256) for i in range(4)))


def like(value: Column, bits: Column) -> Column:
    """value with other digits and letters of the same script and case, from `bits`; all else stays."""
    digits, letters = F.translate(bits, "abcdef", "012345"), {k: F.translate(bits, "0123456789abcdef", v) for k, v in LETTERS.items()}

    def one(c: Column, i: Column) -> Column:
        of = lambda s: s.substr(i % 256 + 1, F.lit(1))
        script = script_of(c)
        letter = F.when(script == "cyrillic", of(letters["cyrillic"])).when(script == "greek", of(letters["greek"])).otherwise(of(letters["latin"]))
        return F.when(c.rlike(r"\d"), of(digits)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def mod97(account: Column) -> Column:
    """Remainder of a bank account's check: its first four characters count last, letters as 10 to 35."""
    turned = F.split(F.concat(account.substr(F.lit(5), F.length(account)), F.left(account, F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)


def luhn(digits: Column) -> Column:
    """Sum of the check-digit rule; a valid number's ends in 0."""
    n = F.length(digits)
    d = lambda i: digits.substr(i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, d(i) * 2 - F.when(d(i) > 4, 9).otherwise(0)).otherwise(d(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def pick(bits: Column, at: int, of: list[str]) -> Column:
    """One of the values, by two hexadecimal digits."""
    return F.element_at(F.array(*map(F.lit, of)), (F.conv(F.substring(bits, at, 2), 16, 10).cast("int") % len(of) + 1).cast("int"))


def candidate(kind: Column, canon: Column, attempt: Column, key: Column) -> Column:
    """The surrogate of an entity's canonical form after `attempt` lost collisions."""
    bits = stream(key, kind, canon, attempt.cast("string"))
    digits, n = F.translate(bits, "abcdef", "012345"), F.length(canon)
    hexadecimal = F.substring(bits, 1, 256)
    card = F.concat(F.left(canon, F.lit(1)), digits.substr(F.lit(2), n - 2))
    check = (10 - luhn(F.concat(card, F.lit("0")))) % 10
    number = F.concat(card, F.when(luhn(canon) == 0, check.cast("string")).otherwise(digits.substr(n, F.lit(1))))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    labels = F.split(domain, r"\.")
    reserved = F.element_at(labels, -1).isin("com", "net", "org")
    below = F.when(reserved, F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))).otherwise(F.slice(labels, 1, F.size(labels) - 1))
    mapped = like(F.array_join(below, "."), F.substring(bits, 65, 192))
    host = F.concat_ws(".", F.when(F.size(below) > 0, mapped), F.when(reserved, F.concat(F.lit("example."), F.element_at(labels, -1))).otherwise(F.lit("example")))
    octets = [F.conv(F.substring(bits, 2 * i + 1, 2), 16, 10).cast("int") for i in range(4)]
    address = F.when(canon.contains(":"), like_hex(canon, bits)).otherwise(F.concat_ws(".", (240 + octets[0] % 15).cast("string"), *(o.cast("string") for o in octets[1:3]), (1 + octets[3] % 254).cast("string")))
    prefix = F.regexp_extract(canon, rf"^(AKIA|{MAKERS})", 1)
    secret = F.when(canon.rlike("^[0-9a-f]{1,256}$"), hexadecimal.substr(F.lit(1), n)).when(canon.rlike(HEX), like_hex(canon, bits, cased=True)).otherwise(F.concat(prefix, like(canon.substr(F.length(prefix) + 1, n), bits)))
    name = F.coalesce(*(F.when(F.concat(kind, F.lit("/"), script_of(canon)) == f"{prefix_}{g}/{script}", _name(bits, attempt, script, g)) for script in PARTS for g, prefix_ in (("m", "given_"), ("f", "given_"), ("n", "given_"), ("", "surname"))))
    country, account = F.left(canon, F.lit(2)), like(canon.substr(F.lit(5), n), bits)
    fitting = F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(mod97(canon) == 1, fitting).otherwise(digits.substr(F.lit(200), F.lit(2))), account)
    return (
        F.when(kind == "email", F.concat(like(local, bits), F.lit("@"), host))
        .when(kind == "ip", address)
        .when(kind == "ssn", F.concat(F.lit("9"), digits.substr(F.lit(2), F.lit(8))))
        .when(kind == "card", number)
        .when(kind == "phone", F.regexp_replace(digits.substr(F.lit(1), n), "^0", "7"))
        .when(kind == "iban", iban)
        .when(kind == "secret", secret)
        .otherwise(name)
    )


def like_hex(value: Column, bits: Column, cased: bool = False) -> Column:
    """value with other hexadecimal digits from `bits`; cased: digits stay digits, letters stay letters of their case."""
    at = lambda b, i: b.substr(i % 256 + 1, F.lit(1))
    letters = F.translate(bits, "0123456789", "abcdefabcd")
    own = lambda c, i: F.when(c.rlike("[0-9]"), at(F.translate(bits, "abcdef", "012345"), i)).when(c.rlike("[A-F]"), F.upper(at(letters, i))).otherwise(at(letters, i))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Fa-f]"), own(c, i) if cased else at(bits, i)).otherwise(c)), "")


def _name(bits: Column, attempt: Column, script: str, gender: str) -> Column:
    """A name of two parts and an ending; after lost collisions with further parts."""
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(20), attempt.cast("int"))), lambda i: F.element_at(F.array(*map(F.lit, PARTS[script])), (F.conv(bits.substr(2 * i + 21, F.lit(2)), 16, 10).cast("int") % 16 + 1).cast("int"))), "")
    return F.initcap(F.concat(pick(bits, 1, PARTS[script]), more, pick(bits, 5, ENDINGS[script][gender])))


def rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the raw entity's own format."""
    n, own = F.length(_digits(raw)), F.length(surrogate)
    # the k-th of the raw entity's n digits becomes digit k - (n - own) of the surrogate; those before stay
    digit = lambda c, i: F.length(_digits(raw.substr(F.lit(1), i + 1))) - (n - own)
    grouped = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(r"\d") & (digit(c, i) > 0), surrogate.substr(digit(c, i), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c == " ", c).otherwise(surrogate.substr(F.length(F.regexp_replace(raw.substr(F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    upper = (kind.isin("email") | kind.startswith("given") | (kind == "surname") | ((kind == "secret") & raw.rlike(HEX))) & (F.upper(raw) == raw) & (F.lower(raw) != raw)
    return F.when(kind.isin("card", "ssn", "phone"), grouped).when(kind == "iban", spaced).when(upper, F.upper(surrogate)).otherwise(surrogate)


def tokens(kind: Column, raw: Column) -> Column:
    """The entities in a match: a name's words have each their own, all other matches are one."""
    words = F.split(F.regexp_replace(raw, TITLED, ""), " +")
    titles = F.transform(F.split(F.regexp_extract(raw, TITLED, 0), " +"), lambda t: F.rtrim(t, F.lit(".")))
    has = lambda g: F.arrays_overlap(titles, F.array(*map(F.lit, TITLES[g].split())))
    gender = F.when(has("f"), F.lit("given_f")).when(has("m"), F.lit("given_m")).otherwise(F.lit("given_n"))
    made = lambda k, part, canon: F.struct(k.alias("kind"), part.alias("part"), canon.alias("canon"))
    name = lambda w, k: made(k, w, F.initcap(F.lower(w)))
    last = name(F.element_at(words, -1), F.lit("surname"))
    given = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: name(w, gender))
    return F.when(kind == "name", F.concat(given, F.array(last))).otherwise(F.array(made(kind, raw, canonical(kind, raw))))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of each distinct (kind, canon): no surrogate comes twice in a kind or is an entity of it.

    Only those that lost a collision go on to the next round. Every round is written to the shared
    folder; the driver only learns how many collisions were left. The key is joined as a row's value: as a
    literal it would stand in plans, and so in event logs. Raises RuntimeError after ROUNDS rounds with collisions.
    """
    secret = F.broadcast(entities.sparkSession.createDataFrame([(1, key)], "one int, secret string"))
    every = C.saved(entities.select("kind", "canon").distinct())
    real = every.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
    left, settled = every, None
    for attempt in range(ROUNDS):
        now = left.withColumn("one", F.lit(1)).join(secret, "one").withColumn("surrogate", candidate(F.col("kind"), F.col("canon"), F.lit(attempt), F.col("secret")))
        now = C.saved(now.drop("one", "secret"))
        owner = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"))
        judged = now.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        judged = C.saved(judged.select("kind", "canon", "surrogate", ((F.col("owner") != F.col("canon")) | F.col("taken").isNotNull()).alias("lost")))
        won = judged.where("not lost").drop("lost")
        settled = won if settled is None else settled.unionByName(won)
        left = judged.where("lost").select("kind", "canon")
        if not left.count():
            return settled
        # what is settled is taken from the next round on
        real = real.unionByName(won.select("kind", "surrogate", F.lit(True).alias("taken")))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def replace_entities(df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """df with surrogates in text_col, and count_col: how many places were replaced.

    A null text stays null with count 0, empty texts and texts of any length are handled as others are,
    repeated rows repeat with equal results, other columns stay as they are (a count_col of theirs is
    replaced), an empty table gives an empty one.
    """
    row, made, names, alone = (C.fresh(df, name) for name in ("pii_row", "pii_made", "pii_names", "pii_alone"))
    kept = [c for c in df.columns if c != count_col]
    text = F.col(text_col)
    hit = F.coalesce(text.rlike(MAYBE) & text.rlike(PATTERN), F.lit(False))
    hits = C.saved(df.where(hit).select(*kept))
    found = hits.select(F.md5(text).alias("row"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))).alias("raw")).distinct()
    found = found.withColumn("match", kind_of(F.col("raw"))).where((F.col("match") != "card") | (luhn(_digits(F.col("raw"))) == 0)).where((F.col("match") != "iban") | (mod97(F.regexp_replace("raw", " ", "")) == 1))
    found = found.select("row", "raw", "match", F.posexplode(tokens(F.col("match"), F.col("raw"))).alias("place", "entity")).select("row", "raw", "match", "place", "entity.*")
    found = C.saved(found)
    known = assign(found, key)
    each = found.join(known, ["kind", "canon"]).withColumn("out", rendered(F.col("kind"), F.col("part"), F.col("surrogate")))
    # the words of a name in the order in which they came, after its title
    whole = each.groupBy("row", "raw", "match").agg(F.array_sort(F.collect_list(F.struct("place", "part", "out"))).alias("parts"))
    title = F.regexp_extract("raw", TITLED, 0)
    out = F.when(F.col("match") == "name", F.concat(title, F.array_join("parts.out", " "))).otherwise(F.element_at("parts.out", 1))
    maps = whole.withColumn("out", out).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "out"))).alias(made), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("match") == "name", F.col("parts"))))).alias(names)).withColumnRenamed("row", row)
    # texts are dealt out evenly before the costly part, whatever the join made of them
    size = hits.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    hits = hits.withColumn(row, F.md5(text)).join(maps, row, "left").repartition(n)
    between, entities = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    # a name without its title, as it was or in capitals; not one that the text also has as a word in lower case
    word = lambda w: F.concat(F.lit(r"(?<!\p{L})\Q"), w, F.lit(r"\E(?!\p{L})"))
    again = lambda t, n: F.regexp_replace(F.regexp_replace(t, word(n["part"]), n["out"]), word(F.upper(n["part"])), F.upper(n["out"]))
    own = F.filter(names, lambda n: ~F.rlike(text, word(F.lower(n["part"]))))
    bare = lambda t: F.aggregate(F.col(alone), t, again)
    between = F.when(F.size(alone) > 0, F.transform(between, bare)).otherwise(between)
    out = lambda e: F.coalesce(F.element_at(made, e), e)  # noqa: E731  what only looks like an entity stays
    new = F.array_join(F.zip_with(between, F.transform(entities, out), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = F.size(F.filter(entities, lambda e: F.map_contains_key(made, e)))
    replaced = hits.withColumn(alone, own).withColumn(count_col, F.when(F.col(made).isNull(), 0).otherwise(count)).withColumn(text_col, F.when(F.col(made).isNull(), text).otherwise(new)).select(*kept, count_col)
    return df.where(~hit).select(*kept).withColumn(count_col, F.lit(0)).unionByName(replaced)


def default_key(spark: SparkSession) -> str:
    """The secret of the session (spark.lakeloom.surrogate.secret; Spark redacts settings of such names in its logs).

    Where it has none, one is drawn and kept for the session, so that nobody can replay the surrogates.
    """
    setting = "spark.lakeloom.surrogate.secret"
    if not spark.conf.get(setting, ""):
        spark.conf.set(setting, secrets.token_hex(16))
    return spark.conf.get(setting)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text."""
    docs = C.dealt(spark, sf_dir, "documents")
    return replace_entities(docs, default_key(spark)).select("doc_id", "text", "n_entities")
