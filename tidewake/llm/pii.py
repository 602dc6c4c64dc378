"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities (emails, telephone, card and social security numbers, IPv4 addresses, secrets, names after
a title) are found by patterns; card numbers must pass their check digit. Each distinct entity gets a
surrogate drawn by a keyed hash: of the same type and format, for names of the same gender and
script. Surrogates are checked against each other and against all entities of the corpus; whoever
meets a collision draws again, so distinct entities stay distinct and every mention of one entity
gets the same surrogate.

Only mentions are exchanged, each distinct text once; texts without a candidate character stay
where they are.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Titles by gender, titles of either, and given and family names to draw from by script.
FEMALE = ["Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "госпожа", "г-жа"]
MALE = ["Mr", "Monsieur", "Herr", "Señor", "Sr", "господин", "г-н"]
EITHER = ["Dr", "Prof", "Professor", "Mx", "Rev", "д-р", "проф"]
NAMES = {
    ("latin", "female"): ["Ada", "Clara", "Elena", "Greta", "Ines", "Julia", "Lena", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Vera"],
    ("latin", "male"): ["Adam", "Carl", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Tomas", "Victor"],
    ("latin", "family"): ["Albrecht", "Bauer", "Castillo", "Durand", "Engel", "Ferrer", "Garnier", "Holm", "Iversen", "Jansen", "Keller", "Lambert", "Moreau", "Navarro", "Olsen", "Perrin", "Quint", "Romero", "Sander", "Torres", "Vidal", "Weber"],
    ("cyrillic", "female"): ["Анна", "Вера", "Дарья", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "male"): ["Антон", "Борис", "Глеб", "Иван", "Лев", "Максим", "Олег", "Павел"],
    ("cyrillic", "family"): ["Белых", "Гончаренко", "Долгих", "Живаго", "Коваленко", "Лысенко", "Мельник", "Седых", "Черных", "Шевченко"],
}
_TITLE = "(?:(?:" + "|".join(EITHER) + r")\.? )*(?:" + "|".join(FEMALE + MALE + EITHER) + r")\.? "
_NAME = r"\p{Lu}[\p{L}'-]{1,40}"

#: Patterns by type; where several match at one place the first one counts.
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,64}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?<![0-9][.,])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1 ?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]|[ .-]?\([0-9]{1,4}\)[ .-]?)[0-9](?:[ .-][0-9]{2,4}){2,4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_NAME}(?: {_NAME})?",
}
#: No entity starts behind a letter but those that start with a digit: what stands before the patterns turns most places away at once.
ANY = r"(?:(?<!\p{L})|(?=[0-9]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What a text must hold to be looked at closer: a digit, an @, a secret of letters only, or a title before a capital. The lookahead turns most places away at once.
HINT = r"[0-9@]|(?<!\p{L})(?:sk-[A-Za-z]{20}|ghp_[A-Za-z]{36}|AKIA[A-Z]{16}|[a-fA-F]{32}|(?=[" + "".join(sorted({t[0] for t in FEMALE + MALE + EITHER})) + rf"]){_TITLE}\p{{Lu}})"


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, double_first: bool) -> Column:
    """Sum of the check-digit rule, from the right; double_first: the rightmost digit is doubled."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == (0 if double_first else 1), doubled).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda s, x: s + x)


def kind_of(mention: Column) -> Column:
    """The type of a mention; null for a number that fails its check digit."""
    found = None
    for kind, pattern in PATTERNS.items():
        whole = mention.rlike(rf"\A(?:{pattern})\z")
        if kind == "card":
            n = _digits(mention)
            whole = whole & n.rlike(r"\A[0-9]{13,19}\z")
            sound = F.when(luhn_sum(n, False) % 10 == 0, F.lit(kind))
        else:
            sound = F.lit(kind)
        found = F.when(whole, sound) if found is None else found.when(whole, sound)
    return found


def _name_of(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"\A{_TITLE}", "")


def norm_of(mention: Column, kind: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "phone", "ssn"), _digits(mention))
        .when(kind == "name", _name_of(mention))
        .when(kind == "secret", F.lower(mention))
        .otherwise(mention)
    )


def class_of(mention: Column, kind: Column) -> Column:
    """For names, script and gender of the title; titles of either gender leave it to the name's hash."""
    title = F.regexp_extract(mention, rf"\A({_TITLE})", 1)
    says = lambda titles: title.rlike(r"(?:\A| )(?:" + "|".join(titles) + r")\.? ")
    drawn = F.when(F.pmod(F.crc32(_name_of(mention).cast("binary")), F.lit(2)) == 0, "female").otherwise("male")
    gender = F.when(says(FEMALE), "female").when(says(MALE), "male").otherwise(drawn)
    script = F.when(_name_of(mention).rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return F.when(kind == "name", F.concat_ws(" ", script, gender)).otherwise("")


def _draw(key: str, kind: Column, what: Column, attempt: int) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, what, F.lit(str(attempt))), 512)


def surrogate(key: str, kind: Column, norm: Column, class_: Column, attempt: int, wider: int = 0) -> Column:
    """The surrogate, in the form of norm_of, that an entity draws at an attempt.

    wider: characters that it has more than the entity, for formats without room; IPv4 addresses
    then get an IPv6 address of the range for documentation.
    """
    hexes = _draw(key, kind, norm, attempt)
    digits = F.translate(hexes, "abcdef", "012345")
    letters = F.translate(hexes, "0123456789abcdef", "bcdfghjklmnprstv")
    at = lambda text, i: F.substr(text, (i % 128 + 1).cast("int"), F.lit(1))

    def alike(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), at(digits, i)).when(c.rlike(r"\p{L}"), at(letters, i)).otherwise(c)

    like = lambda text: F.array_join(F.transform(_chars(text), alike), "")
    n = F.char_length(norm)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    # From the end of the draw, so that they do not repeat what short formats take from its start.
    more = lambda text: F.substr(text, F.lit(129 - wider), F.lit(wider)) if wider else F.lit("")
    email = F.concat(like(local), more(letters), F.lit("@"), like(F.regexp_replace(domain, r"\.[^.]*\z", "")), F.lit(".example"))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(digits, F.lit(1), (n - 2).cast("int")))
    body = F.concat(body, more(digits))
    card = F.concat(body, F.pmod(-luhn_sum(body, True), F.lit(10)).cast("string"))
    phone = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.translate(F.substr(digits, F.lit(1), F.lit(1)), "01", "23"), F.substr(digits, F.lit(2), (n - 2).cast("int")), more(digits))
    ssn = F.concat(F.lit("9"), F.substr(digits, F.lit(1), F.lit(8)), more(digits))
    octet = lambda k: F.conv(F.substr(hexes, F.lit(2 * k + 1), F.lit(2)), 16, 10)
    ip = F.concat_ws(".", (F.conv(F.substr(hexes, F.lit(9), F.lit(1)), 16, 10).cast("int") + 240).cast("string"), octet(0), octet(1), octet(2))
    if wider:
        ip = F.concat_ws(":", F.lit("2001:db8"), *(F.substr(hexes, F.lit(4 * k + 1), F.lit(4)) for k in range(6)))
    secret = F.when(norm.rlike(r"\A[0-9a-f]+\z"), F.substr(hexes, F.lit(1), n)).otherwise(
        F.concat(F.regexp_extract(norm, r"\A(akia|ghp_|sk-)", 1), like(F.regexp_replace(norm, r"\A(akia|ghp_|sk-)", "")))
    )

    def pick(names: list[str], what: Column, salt: str) -> Column:
        number = F.conv(F.substr(_draw(key, F.lit(salt), what, 0), F.lit(1), F.lit(8)), 16, 10).cast("long")
        return F.get(F.array(*map(F.lit, names)), F.pmod(number, F.lit(len(names))).cast("int"))

    name = None
    for (script, gender), given in NAMES.items():
        if gender == "family":
            continue
        family = NAMES[script, "family"]
        last = F.substring_index(norm, " ", -1)
        # A further family name is joined for each attempt: the space grows until all are distinct.
        chosen = F.concat_ws("-", pick(family, last, "family"), *(pick(family, norm, f"more{k}") for k in range(attempt)))
        whole = F.when(norm.contains(" "), F.concat_ws(" ", pick(given, F.substring_index(norm, " ", 1), "given"), chosen)).otherwise(chosen)
        mine = class_ == f"{script} {gender}"
        name = F.when(mine, whole) if name is None else name.when(mine, whole)
    secret = F.concat(secret, more(F.when(norm.rlike(r"\A[0-9a-f]+\z"), hexes).otherwise(letters))) if wider else secret
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "name", name)
    )


def assign(entities: DataFrame, key: str, attempts: int = 12) -> DataFrame:
    """kind, class, norm and a surrogate for each distinct entity; no two of a kind share one, and none is an entity itself.

    Each attempt is a round over the entities still without: of those that draw the same surrogate
    the one with the smallest keyed hash gets it. Entities that find none in so many attempts, as
    their format has too little room, draw wider ones, by two characters more each time: the room
    grows until all are served.
    """
    entities = common.materialize(entities.distinct(), "entities")
    taken = entities.select("kind", F.col("norm").alias("drawn"))
    pending, given = entities, None
    for attempt in itertools.count():
        wider = min(max(0, attempt - attempts + 1) * 2, 64)
        drawn = pending.withColumn("drawn", surrogate(key, F.col("kind"), F.col("norm"), F.col("class"), attempt, wider))
        free = drawn.join(taken, ["kind", "drawn"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        order = F.struct(F.sha2(F.concat_ws("\x1f", F.lit(key), "norm", "class"), 256).alias("order"), "norm", "class")
        won = free.groupBy("kind", "drawn").agg(F.min(order).alias("w")).select("kind", "w.class", "w.norm", "drawn")
        before, given = given, common.materialize(won if given is None else given.unionByName(won), "surrogates")
        if before is not None:
            common.discard(before)
        pending = entities.join(given.select("kind", "class", "norm"), ["kind", "class", "norm"], "left_anti")
        if pending.limit(1).count() == 0:
            return given


def _poured(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced by the given ones, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))
    )
    return F.aggregate(_chars(mention), start, step, lambda s: s["out"])


def formatted(mention: Column, kind: Column, drawn: Column) -> Column:
    """The surrogate in the format of a mention: its separators, case and title."""
    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(drawn)).otherwise(drawn)
    title = F.regexp_extract(mention, rf"\A({_TITLE})", 1)
    # A wider number goes on after the last digit that the mention has.
    rest = F.substr(drawn, F.char_length(_digits(mention)) + 1, F.char_length(drawn))
    number = F.concat(_poured(mention, drawn), rest)
    return (
        F.when(kind.isin("card", "phone", "ssn"), number).when(kind.isin("email", "secret"), cased).when(kind == "name", F.concat(title, drawn)).otherwise(drawn)
    )


def pseudonymize(docs: DataFrame, key: str, count: str = "n_entities") -> DataFrame:
    """docs with entities in `text` replaced, and their number as the column `count`.

    All other columns and rows stay as they are. A null text stays null and an empty one empty;
    texts without entities are unchanged; equal texts are treated once; an empty table gives no
    rows. The same key gives the same surrogates for the same table. A column of docs that is called
    `count` is an error; other names never clash.
    """
    if count.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {count} already: give the count another name")
    mark, n, new_ = common.fresh(docs.withColumn(count, F.lit(0)), "mark", "n", "new")
    text = F.col("text").cast("string")
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    given = docs.withColumn(mark, F.when(hinted, F.sha2(text, 256)))
    mentions = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    # One row for each distinct text with mentions, however many documents share it.
    texts = given.filter(hinted).select(mark, mentions.alias("m")).filter(F.size("m") > 0).groupBy(mark).agg(F.first("m").alias("m"))
    spread = texts.select(mark, F.posexplode("m").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    spread = spread.withColumn("norm", norm_of(F.col("mention"), F.col("kind"))).withColumn("class", class_of(F.col("mention"), F.col("kind")))
    with common.Scope() as scope:
        spread = common.materialize(spread, "mentions")
        table = assign(spread.filter("kind IS NOT NULL").select("kind", "class", "norm"), key)
        told = spread.join(table, ["kind", "class", "norm"], "left")
        new = F.coalesce(formatted(F.col("mention"), F.col("kind"), F.col("drawn")), F.col("mention"))
        # The mentions of one text: as many as it has.
        answers = told.groupBy(mark).agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))).alias(new_), F.count("kind").alias(n))
        answers = scope.keep(common.materialize(answers, "answers"))
    kept = [c for c in docs.columns if c != "text"]
    news = F.transform(new_, lambda x: x["new"])
    pieces = F.split(text, ANY, -1)
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(news, i), F.lit("")))), "")
    # Rows without a hint never meet the join, so their texts are not exchanged.
    untouched = given.filter(~hinted).select(*kept, text.alias("text"), F.lit(0).cast("long").alias(count))
    touched = given.filter(hinted).join(answers, mark, "left")
    touched = touched.select(*kept, F.when(F.col(new_).isNull(), text).otherwise(rebuilt).alias("text"), F.coalesce(n, F.lit(0)).cast("long").alias(count))
    return untouched.unionByName(touched).select(*docs.columns, count)
