"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

Entities: e-mail and IP addresses, phone, card, social security and IBAN
numbers, access keys, hexadecimal secrets, and names after a title (which gives
their gender). A surrogate is a keyed hash of the entity written in its format:
letters stay letters, digits digits, cards keep a valid check digit, IBANs their
country and check sum, names their script and gender. Equal entities get equal
surrogates in every document; a name is taken part by part, so "Mr Ada Hall" and
"Mr Hall" stay the same person.

Collision checks keep entities apart: over all distinct entities no two get the
same surrogate and none gets another entity of the corpus; whoever collides
takes the next hash until nobody does. After ``PATIENCE`` hashes a surrogate grows by a character with every further
one (an IP address takes a port), so a format whose forms are all taken has room again and the search ends. Only
those exceptions are looked up; all other surrogates are computed in place, so the texts are not shuffled.

The key is the caller's: given, or ``spark.glyphmill.surrogate.key`` of the session. Without either a public one is used,
with which anyone can repeat the surrogates; that is for tests.

Everything is a DataFrame expression. Defined cases: a null text stays null,
texts without entities stay as they are, texts of any length are replaced throughout, repeated rows alike; of entities that
collide at the same attempt the smaller keeps its surrogate; no texts give no entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import bounded, settle_measured

# Titles by gender.
MALE = "Mr Mister Sir Herr Monsieur Señor Sr Don г-н κύριος".split()
FEMALE = "Mrs Ms Miss Madam Frau Mme Madame Mlle Señora Sra Doña г-жа κυρία".split()

TITLE = r"(?:" + "|".join(sorted(MALE + FEMALE, key=lambda t: (-len(t), t))) + r")"
NAME = rf"(?<![\p{{L}}\d]){TITLE}\.?\s\p{{Lu}}\p{{L}}+(?:\s\p{{Lu}}\p{{L}}+)?"
# Tried in this order at every place of a text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|(?<![\d\-])\d{3}-\d{3}-\d{4})(?!\d)",
    "card": r"(?<![\dA-Za-z])\d(?:[ \-]?\d){12,18}(?![\dA-Za-z])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{16,128}(?![A-Za-z0-9])",
    "name": NAME,
}
ANY = "|".join(PATTERNS.values())
# What a text must have to hold any entity: one pass of a simple pattern.
GATE = rf"[0-9@]|AKIA|(?<![\p{{L}}\d]){TITLE}\.?\s\p{{Lu}}"
KEY = "surrogates-1"  # Public, for tests.
KEY_SETTING = "spark.glyphmill.surrogate.key"
PATIENCE = 6
MOST_GROWN = 30

# Syllables of surrogate names by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe ga go ha jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе во га да де до за ка ке ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ро са со та те".split(),
    "greek": "βα γα δα δη θα κα κο λα λε λι μα με μη νε νι νο πα πε ρα ρι ρο σα σο τα τε το φι φο".split(),
}
ENDINGS = {
    "latin": {"f": "na", "m": "rik", "": "ster"},
    "cyrillic": {"f": "на", "m": "рик", "": "ко"},
    "greek": {"f": "να", "m": "ρος", "": "κης"},
}


def mentions(text: Column) -> Column:
    """The entity mentions of a text, from left to right."""
    found = F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def kind(mention: Column) -> Column:
    """Which pattern a mention belongs to."""
    chain = F.when(mention.rlike(rf"^(?:{PATTERNS['email']})$"), F.lit("email"))
    for name, pattern in list(PATTERNS.items())[1:]:
        chain = chain.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(name))
    return chain


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def normal(mention: Column, type_: Column) -> Column:
    """The entity behind a mention, whatever its case and separators."""
    return (
        F.when(type_ == "email", F.lower(mention))
        .when(type_ == "iban", F.regexp_replace(mention, " ", ""))
        .when(type_.isin("ssn", "phone", "card"), _digits(mention))
        .otherwise(mention)
    )


def parts(mention: Column) -> Column:
    """The entities of a mention: one, or each part of a name with its gender and script."""
    type_ = kind(mention)
    words = F.split(mention, r"\s+")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(MALE), F.lit("m")).otherwise(F.lit("f"))
    count = F.size(words)

    def part(number: int, given: bool) -> Column:
        word = words[number]
        sex = gender if given else F.lit("")
        return F.struct(F.concat_ws("-", F.lit("name"), _script(word), sex).alias("type"), F.lower(word).alias("entity"))

    whole = F.array(F.struct(type_.alias("type"), normal(mention, type_).alias("entity")))
    named = F.when(count > 2, F.array(part(1, True), part(2, False))).otherwise(F.array(part(1, False)))
    return F.when(type_ == "name", named).otherwise(whole)


def _script(word: Column) -> Column:
    return (
        F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic"))
        .when(word.rlike(r"\p{IsGreek}"), F.lit("greek"))
        .otherwise(F.lit("latin"))
    )


def _hash(type_: Column, entity: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits."""
    base = F.concat_ws("\u0001", F.lit(key), type_, entity, attempt.cast("string"))
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(base, F.lit("\u0001+")), 256))


def _draw(hashed: Column, place: Column) -> Column:
    """A number from 0 to 65535 for a place, from overlapping digits of the hash."""
    four = F.substring(hashed, F.pmod(place * 3, F.lit(124)) + 1, 4)
    return F.conv(four, 16, 10).cast("int")


def _pick(letters: str | Column, number: Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(letters, F.pmod(number, F.length(letters)) + 1, F.lit(1))


def _same_classes(value: Column, hashed: Column) -> Column:
    """Every letter and digit replaced by another of its class."""
    characters = F.split(value, "")

    def one(character: Column, place: Column) -> Column:
        number = _draw(hashed, place)
        return (
            F.when(character.rlike("[0-9]"), _pick("0123456789", number))
            .when(character.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", number))
            .when(character.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", number))
            .otherwise(character)
        )

    return F.array_join(F.transform(characters, one), "")


def _luhn(body: Column) -> Column:
    """The digit that makes ``body`` followed by it pass the card check."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d: d.cast("int"))

    def weight(total: Column, item: Column) -> Column:
        doubled = item["d"] * F.when(item["i"] % 2 == 0, 2).otherwise(1)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    numbered = F.transform(digits, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.pmod(F.lit(10) - F.aggregate(numbered, F.lit(0), weight) % 10, F.lit(10)).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """Two check digits: 98 less the rest of account, country and 00 as a number, modulo 97."""
    characters = F.split(F.concat(account, country, F.lit("00")), "")

    def step(rest: Column, character: Column) -> Column:
        letter = character.rlike("[A-Z]")
        value = F.when(letter, F.ascii(character) - 55).otherwise(character.cast("int"))
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.lpad((F.lit(98) - F.aggregate(characters, F.lit(0), step)).cast("string"), 2, "0")


def _growth(letters: str, hashed: Column, attempt: Column) -> Column:
    """Nothing for the first attempts, then one more character for each."""
    count = F.greatest(F.least(attempt.cast("int") - PATIENCE, F.lit(MOST_GROWN)), F.lit(0))
    places = F.slice(F.sequence(F.lit(1), F.lit(MOST_GROWN)), F.lit(1), count)
    return F.array_join(F.transform(places, lambda i: _pick(letters, _draw(hashed, i + 50))), "")


def _email(entity: Column, hashed: Column, grown: Column) -> Column:
    ending = F.regexp_extract(entity, r"\.[a-z]+$", 0)
    drawn = _same_classes(F.substring(entity, F.lit(1), F.length(entity) - F.length(ending)), hashed)
    return F.concat(F.substring_index(drawn, "@", 1), grown, F.lit("@"), F.substring_index(drawn, "@", -1), ending)


def _ip(entity: Column, hashed: Column, attempt: Column) -> Column:
    octets = F.split(entity, r"\.")
    drawn = F.array_join(F.transform(octets, lambda _, i: (_draw(hashed, i) % 254 + 1).cast("string")), ".")
    port = F.concat(F.lit(":"), (_draw(hashed, F.lit(20)) % 60000 + 1024).cast("string"))
    return F.concat(drawn, F.when(attempt > PATIENCE, port).otherwise(""))


def _phone(entity: Column, hashed: Column) -> Column:
    """Numbers of eleven digits or more keep the first one, which is of the country."""
    kept = F.when(F.length(entity) > 10, 1).otherwise(0)
    return F.concat(F.substring(entity, F.lit(1), kept), _same_classes(F.substring(entity, kept + 1, F.length(entity)), hashed))


def _card(entity: Column, hashed: Column, grown: Column) -> Column:
    """The issuer digit and the length stay; valid numbers stay valid, others stay others."""
    body = F.concat(F.substring(entity, 1, 1), _same_classes(F.substring(entity, F.lit(2), F.length(entity) - 2), hashed), grown)
    check = _luhn(body)
    return F.concat(body, F.when(F.call_function("luhn_check", entity), check).otherwise(((check.cast("int") + 1) % 10).cast("string")))


def _iban(entity: Column, hashed: Column, grown: Column) -> Column:
    country, account = F.substring(entity, 1, 2), F.substring(entity, F.lit(5), F.length(entity))
    drawn = F.concat(_same_classes(account, hashed), grown)
    return F.concat(country, _iban_check(country, drawn), drawn)


def _hex(entity: Column, hashed: Column) -> Column:
    characters = F.split(entity, "")

    def one(character: Column, place: Column) -> Column:
        number = _draw(hashed, place)
        return F.when(character.rlike("[0-9]"), _pick("0123456789", number)).otherwise(_pick("abcdef", number))

    return F.array_join(F.transform(characters, one), "")


def _name(type_: Column, hashed: Column, attempt: Column) -> Column:
    """Three syllables and an ending; later attempts have more syllables, so there is always room."""

    def of(script: str) -> Column:
        syllables, endings = F.array(*[F.lit(s) for s in SYLLABLES[script]]), ENDINGS[script]
        places = F.sequence(F.lit(0), F.least(F.lit(2) + attempt.cast("int"), F.lit(30)))
        body = F.array_join(F.transform(places, lambda i: F.element_at(syllables, (_draw(hashed, i) % len(SYLLABLES[script]) + 1).cast("int"))), "")
        ending = F.when(type_.endswith("-f"), endings["f"]).when(type_.endswith("-m"), endings["m"]).otherwise(endings[""])
        return F.concat(body, ending)

    return F.when(type_.contains("cyrillic"), of("cyrillic")).when(type_.contains("greek"), of("greek")).otherwise(of("latin"))


def surrogate(type_: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a normalised entity."""
    hashed = _hash(type_, entity, attempt, key)
    digits, letters = _growth("0123456789", hashed, attempt), _growth("abcdefghijklmnopqrstuvwxyz", hashed, attempt)
    secret = F.concat(F.substring(entity, 1, 4), _same_classes(F.substring(entity, F.lit(5), F.length(entity)), hashed))
    return (
        F.when(type_ == "email", _email(entity, hashed, letters))
        .when(type_ == "ip", _ip(entity, hashed, attempt))
        .when(type_ == "phone", F.concat(_phone(entity, hashed), digits))
        .when(type_ == "card", _card(entity, hashed, digits))
        .when(type_ == "iban", _iban(entity, hashed, digits))
        .when(type_ == "hex", F.concat(_hex(entity, hashed), digits))
        .when(type_ == "key", F.concat(secret, digits))
        .when(type_.startswith("name"), _name(type_, hashed, attempt))
        .otherwise(F.concat(_same_classes(entity, hashed), digits))
    )


def _formatted(mention: Column, found: Column) -> Column:
    """A surrogate in the format of the mention: its separators and its case."""
    separated = F.array_join(
        F.transform(
            F.split(mention, ""),
            lambda c, i: F.when(c.rlike(r"[\dA-Z]"), F.substring(found, _before(mention, i) + 1, F.lit(1))).otherwise(c),
        ),
        "",
    )
    separated = F.concat(separated, F.substring(found, _before(mention, F.length(mention)) + 1, F.length(found)))  # what has grown
    return F.when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") | mention.rlike(r"^[\d ()+.\-]+$") & ~mention.rlike(r"\d\.\d+\.\d"), separated).otherwise(
        F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(found)).otherwise(found)
    )


def _before(mention: Column, place: Column) -> Column:
    """How many letters and digits stand before a place."""
    head = F.substring(mention, F.lit(1), place)
    return F.length(F.regexp_replace(head, r"[^\dA-Z]", ""))


def replacement(mention: Column, attempts: Column | None, key: str = KEY) -> Column:
    """What stands in the text instead of a mention; ``attempts`` maps type and entity to a later attempt."""

    def drawn(part: Column) -> Column:
        attempt = F.lit(0)
        if attempts is not None:
            attempt = F.coalesce(F.element_at(attempts, F.concat_ws(":", part["type"], part["entity"])), F.lit(0))
        return surrogate(part["type"], part["entity"], attempt, key)

    found = F.transform(parts(mention), drawn)
    words = F.split(mention, r"\s+")

    def cased(word: Column, value: Column) -> Column:
        return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(value)).otherwise(F.initcap(value))

    named = F.array_join(F.concat(F.slice(words, 1, 1), F.zip_with(F.slice(words, 2, 2), found, cased)), " ")
    return F.when(kind(mention) == "name", named).otherwise(_formatted(mention, found[0]))


def entities(texts: DataFrame, text: str = "text") -> DataFrame:
    """The distinct ``type, entity`` of a table of texts."""
    found = texts.select(F.explode(mentions(F.col(text))).alias("mention")).distinct()
    return found.select(F.explode(parts(F.col("mention"))).alias("part")).select("part.type", "part.entity").distinct()


def resolved(found: DataFrame, key: str = KEY) -> tuple[DataFrame, int]:
    """``type, entity, attempt, surrogate`` without collisions, and how many need a later attempt."""
    group = F.regexp_replace("type", r"-[fm]?$", "")

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("surrogate", surrogate(F.col("type"), F.col("entity"), F.col("attempt"), key))

    table, _ = settle_measured(named(found.withColumn("attempt", F.lit(0))), "entities", n=F.count(F.lit(1)))
    while True:
        # Whoever came to its surrogate first keeps it; ties go to the smaller entity.
        order = Window.partitionBy(group, "surrogate").orderBy("attempt", "type", "entity")
        ranked = table.withColumn("rank", F.row_number().over(order))
        real = table.select(group.alias("group"), F.col("entity").alias("taken")).distinct()
        taken = ranked.join(real, (group == F.col("group")) & (F.col("surrogate") == F.col("taken")), "left")
        bump = ((F.col("rank") > 1) | F.col("taken").isNotNull()).cast("int")
        moved = taken.select("type", "entity", (F.col("attempt") + bump).alias("attempt"), bump.alias("bump"))
        table, measured = settle_measured(
            named(moved), "entities", bumps=F.sum("bump"), late=F.sum(F.when(F.col("attempt") > 0, 1).otherwise(0))
        )
        if not measured["bumps"]:
            return table.drop("bump"), measured["late"] or 0


def replace_entities(texts: DataFrame, text: str = "text", key: str | None = None, count: str = "n_entities") -> DataFrame:
    """``texts`` with surrogates in place of all entities, and how many mentions were replaced."""
    key = key or texts.sparkSession.conf.get(KEY_SETTING, KEY)
    table, late = resolved(entities(texts, text), key)
    value, attempts = F.col(text), None
    rows = texts
    if late:
        late_rows = bounded(table.filter("attempt > 0").select("type", "entity", "attempt"), "late", F.lit(80), 16 * 1024 * 1024)
        held = texts.select(F.sha2(value, 256).alias("_digest"), F.explode(mentions(value)).alias("mention")).distinct()
        held = held.select("_digest", F.explode(parts(F.col("mention"))).alias("part")).select("_digest", "part.*").distinct()
        name = F.concat_ws(":", "type", "entity")
        fixes = held.join(late_rows, ["type", "entity"]).groupBy("_digest")
        fixes = fixes.agg(F.map_from_entries(F.collect_list(F.struct(name, "attempt"))).alias("_attempts"))
        fixes = bounded(fixes, "fixes", F.lit(64) + F.size("_attempts") * 80, 16 * 1024 * 1024)
        rows = texts.withColumn("_digest", F.sha2(value, 256)).join(fixes, "_digest", "left")
        attempts = F.coalesce(F.col("_attempts"), F.create_map().cast("map<string,int>"))
    found = mentions(value)
    between = F.split(value, ANY)
    pairs = F.zip_with(between, F.transform(found, lambda m: replacement(m, attempts, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    replaced = F.when(F.size(found) > 0, F.array_join(pairs, "")).otherwise(value)
    return rows.withColumns({count: F.size(found).cast("bigint"), text: replaced}).select(*[F.col(f"`{c}`") for c in texts.columns if c != count], count)
