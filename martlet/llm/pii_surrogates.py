"""PII: keyed, type-consistent surrogates (operator 6, native).

Entities are found by one pattern over whole texts: e-mail and IP addresses, phone,
card, account and social-security numbers, secrets, and names after a title; where a text
names someone by title, given and family name, the two names without a title are found in
that text too.  Every distinct entity gets a surrogate from a keyed hash of its type and
canonical form: digits become digits and letters become letters of the same script and
case, separators stay where the mention has them.  Given and family names are entities of
their own, so that full and shortened mentions agree; they become names of the title's
gender and of their own script (Latin, Cyrillic, Greek or Armenian, else Latin).  Mentions
of one entity in different formats share a surrogate (coreference).

Collision checks: a surrogate that is itself a real entity, or that another entity has
taken, is drawn again, ``ATTEMPTS`` times.  Entities without one by then belong to a
format that has hardly any room; they exchange their forms in a keyed order, which keeps
format and distinctness, as no drawn surrogate is a real entity.  Only an entity that
stands alone in a format without room becomes a keyed hash.

Edge cases: null texts stay null; texts without entities pass unchanged; very long
entities are replaced whole; a full name titled with both genders in one text takes the
female form where it has no title; repeated rows and extra columns pass through, but for
columns named ``pii_...`` like the operator's own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, without_own

KEY = "martlet-surrogates"
ATTEMPTS = 8
EXCHANGE_ROWS = 4096  # entities of a crowded format that one group exchanges
# Titles that give a gender; fixed values.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Госпожа", "Κυρία")
GIVEN = {  # gender and script -> given names, fixed values
    "m-latin": ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo",
                "Martin", "Noel", "Oscar", "Paul", "Simon", "Victor"),
    "f-latin": ("Alice", "Bianca", "Clara", "Diana", "Emma", "Flora", "Helen", "Irene", "Julia",
                "Laura", "Maria", "Nina", "Olivia", "Paula", "Sara", "Vera"),
    "m-cyrillic": ("Антон", "Борис", "Виктор", "Денис", "Иван", "Олег", "Павел", "Роман"),
    "m-greek": ("Αλέξης", "Γιάννης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Στέλιος", "Φώτης"),
    "f-greek": ("Άννα", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
    "m-armenian": ("Արամ", "Գրիգոր", "Դավիթ", "Հայկ", "Նարեկ", "Տիգրան"),
    "f-armenian": ("Աննա", "Լուսինե", "Մարիամ", "Նարինե", "Սիրան", "Սոնա"),
    "f-cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
}
SYLLABLES = {  # consonants, vowels, and the family-name ending by gender
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": "n", "f": "n"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "в", "f": "ва"}),
    "greek": ("βγδζκλμνπρτφ", "αεηιου", {"m": "ς", "f": "υ"}),
    "armenian": ("բգդզկլմնպռստ", "աեիոու", {"m": "ան", "f": "ան"}),
}

_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES)
_LOCAL = r"[\p{L}\p{N}._%+\-]"
_LABEL = r"[\p{L}\p{N}\-]++"
PATTERNS = {  # first match wins, in this order
    # No repeated group may backtrack: a long address would exhaust the matcher's stack.
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@{_LABEL}(?:(?:\.{_LABEL})*+(?<=\.\p{{L}}{{2,63}})"
             rf"|(?:\.{_LABEL}(?=\.\p{{L}}{{2}}))*+\.\p{{L}}{{2,}})",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]*+\d)[0-9a-f]{24,128}(?![0-9A-Za-z])(?<!\d{24,128})",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){1,4}(?!\d)"
             r"|(?<![\d+])(?:\(\d{3}\) ?|\d{3}[\-.])\d{3}[\-.]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[@\d]|(?:{_TITLES})\.? "
_FULL_NAME = r"^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"
_SPLIT_NAME = rf"^((?:{_TITLES})\.? )(.*)$"
# Character classes that keep their kind: pattern -> replacement alphabet.
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "".join(map(chr, range(0x61, 0x7B))),
    "[A-Z]": "".join(map(chr, range(0x41, 0x5B))),
    "[а-яё]": "".join(map(chr, range(0x430, 0x450))),
    "[А-ЯЁ]": "".join(map(chr, range(0x410, 0x430))),
    "[α-ω]": "".join(map(chr, range(0x3B1, 0x3CA))),
    "[ա-ֆ]": "".join(map(chr, range(0x561, 0x587))),
    "[Ա-Ֆ]": "".join(map(chr, range(0x531, 0x557))),
    "[Α-Ω]": "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA)])),
    r"\p{Lu}": "".join(map(chr, range(0x41, 0x5B))),
    r"\p{L}": "".join(map(chr, range(0x61, 0x7B))),
}
FILLED = ("phone", "ssn", "iban", "card")   # types whose separators belong to the mention


def _pattern() -> Column:
    """The pattern of a text's mentions: entities, and the full names known in the text."""
    known = F.concat(F.lit(ANY + r"|(?<!\p{L})(?=\p{Lu})(?:"), F.array_join("pii_names", "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size("pii_names") > 0, known).otherwise(F.lit(ANY))


def find_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``pii_mentions``, the entity strings of each text in order, ``pii_names``,
    the full names that stand after a title, and ``pii_female``, those after a woman's."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    out = docs.withColumn("pii_mentions", F.when(t.rlike(HINT), F.regexp_extract_all(
        t, F.lit(ANY), F.lit(0))).otherwise(none))
    full = lambda m: _after_title(m).rlike(_FULL_NAME)
    titled = lambda keep_it: F.array_sort(F.array_distinct(F.transform(
        F.filter("pii_mentions", keep_it), _after_title)))
    out = out.withColumn("pii_names", titled(full)).withColumn(
        "pii_female", titled(lambda m: full(m) & _title(m).isin(*FEMALE_TITLES)))
    return out.withColumn("pii_mentions", F.when(F.size("pii_names") > 0, F.regexp_extract_all(
        t, _pattern(), F.lit(0))).otherwise(F.col("pii_mentions")))


def _after_title(mention: Column) -> Column:
    return F.regexp_extract(mention, _SPLIT_NAME, 2)


def _title(mention: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(mention, _SPLIT_NAME, 1), r"[. ]+$", "")


def _kind(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.when(mention.rlike(_FULL_NAME), F.lit("name")).otherwise(F.lit("card"))


def _parts(kind: Column, mention: Column, female: Column) -> Column:
    """The entities of a mention, as (part, kind, canon); a name has up to two."""
    title = _title(mention)
    name = F.when(title == "", mention).otherwise(_after_title(mention))
    gender = F.when(title.isin(*FEMALE_TITLES) | ((title == "") & F.array_contains(female, name)), "f").otherwise("m")
    given, family = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)

    def entity(part: int, what: str, word: Column) -> Column:
        script = F.lit("latin")
        for s in ("cyrillic", "greek", "armenian"):
            script = F.when(word.rlike(rf"\p{{Is{s.capitalize()}}}"), s).otherwise(script)
        return F.struct(F.lit(part).alias("part"), F.lit(what).alias("kind"),
                        F.concat(gender, F.lit("-"), script, F.lit("|"), word).alias("canon"))
    canon = F.when(kind.isin(*FILLED), F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")).when(
        kind == "email", F.lower(mention)).otherwise(mention)
    return F.when((kind == "name") & name.contains(" "), F.array(entity(0, "given", given), entity(1, "family", family))) \
        .when(kind == "name", F.array(entity(1, "family", family))) \
        .otherwise(F.array(F.struct(F.lit(0).alias("part"), kind.alias("kind"), canon.alias("canon"))))


def _byte(digest: Column, i: Column) -> Column:
    """A value of 0 to 255 from a 64-digit hash, by position."""
    return F.conv(F.substr(digest, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")


def _like(c: Column, v: Column, alphabets: dict[str, str]) -> Column:
    out = None
    for pattern, letters in alphabets.items():
        new = F.substr(F.lit(letters), v % len(letters) + 1, F.lit(1))
        out = F.when(c.rlike(f"^{pattern}$"), new) if out is None else out.when(c.rlike(f"^{pattern}$"), new)
    return out.otherwise(c)


def _fixed(kind: Column, canon: Column) -> tuple[Column, Column]:
    """How many characters at a form's start and end its format fixes."""
    head = F.when(kind == "iban", 2).when(kind.isin("phone", "card"), 1).otherwise(0)
    tail = F.when(kind == "email", F.length(F.substring_index(canon, ".", -1))).otherwise(0)
    return head, tail


def _middle(kind: Column, canon: Column) -> tuple[Column, Column, Column]:
    head, tail = _fixed(kind, canon)
    return (F.substr(canon, F.lit(1), head), F.substr(canon, head + 1, F.length(canon) - head - tail),
            F.substr(canon, F.length(canon) - tail + 1, tail))


def _format(kind: Column, canon: Column) -> Column:
    """What all surrogates of a form have in common."""
    head, middle, tail = _middle(kind, canon)
    for pattern, letters in ALPHABETS.items():
        middle = F.regexp_replace(middle, pattern, letters[0])
    return F.when(kind.isin("given", "family"), F.substring_index(canon, "|", 1)).when(
        kind == "ip", "").when(kind == "secret", F.regexp_replace(F.regexp_replace(
            canon, "[0-9]", "0"), "[a-f]", "a")).otherwise(F.concat(head, middle, tail))


def _draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity at an attempt."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    # Bound to a variable, so that a long form is hashed once and not once a character.
    return F.element_at(F.transform(F.array(hashed), lambda digest: _drawn(kind, canon, attempt, digest)), 1)


def _drawn(kind: Column, canon: Column, attempt: Column, digest: Column) -> Column:
    start, middle, end = _middle(kind, canon)
    def letters(alphabets):
        return F.concat(start, F.array_join(F.transform(F.split(middle, ""), lambda c, i: _like(
            c, _byte(digest, i), alphabets)), ""), end)
    hexes = {"[0-9]": "0123456789", "[a-f]": "abcdef"}
    octet = lambda i, low, n: (F.lit(low) + _byte(digest, F.lit(i)) % n).cast("string")
    group = F.substring_index(canon, "|", 1)
    script, gender = F.substring_index(group, "-", -1), F.substr(group, F.lit(1), F.lit(1))
    given, made = None, None
    for name, names in GIVEN.items():
        pick = F.element_at(F.array(*map(F.lit, names)), _byte(digest, F.lit(0)) % len(names) + 1)
        given = F.when(group == name, pick) if given is None else given.when(group == name, pick)
    for name, (cons, vows, ends) in SYLLABLES.items():
        # Two more syllables an attempt: there is room for any number of names.
        syllables = F.array_join(F.transform(
            F.sequence(F.lit(1), F.lit(3) + F.floor(attempt / 2).cast("int") * 2), lambda i: F.concat(
                F.substr(F.lit(cons), _byte(digest, i * 2) % len(cons) + 1, F.lit(1)),
                F.substr(F.lit(vows), _byte(digest, i * 2 + 1) % len(vows) + 1, F.lit(1)))), "")
        whole = F.concat(F.initcap(syllables), F.when(gender == "m", ends["m"]).otherwise(ends["f"]))
        made = F.when(script == name, whole) if made is None else made.when(script == name, whole)
    return F.when(kind == "given", F.concat(group, F.lit("|"), F.when(attempt < 2, given).otherwise(made))) \
        .when(kind == "family", F.concat(group, F.lit("|"), made)) \
        .when(kind == "ip", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))) \
        .when(kind == "secret", letters(hexes)).otherwise(letters(ALPHABETS))


def _exchange(pending: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for entities whose format has hardly any room: each takes
    the form of the next of its format in a keyed order, in groups of about ``EXCHANGE_ROWS``."""
    kind, canon = F.col("kind"), F.col("canon")
    keyed = lambda df: df.withColumns({"format": _format(kind, canon), "h": F.xxhash64(F.lit(key), kind, canon)})
    left = keep(keyed(pending.select("kind", "canon")), "crowded")
    sizes = left.groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"))
    dealt = left.join(sizes, ["kind", "format"]).withColumn(
        "part", F.pmod(F.shiftright("h", 20), F.ceil(F.col("n") / EXCHANGE_ROWS)))
    ring = Window.partitionBy("kind", "format", "part")
    order = ring.orderBy("h", "canon")
    taken = keep(dealt.select("kind", "canon", "format", "h", F.coalesce(
        F.lead("canon").over(order), F.first("canon").over(order)).alias("surrogate"),
        F.count(F.lit(1)).over(ring).alias("m")), "exchanged")
    done = taken.where("m > 1").select("kind", "canon", "surrogate")
    # One alone takes the form of another entity of its format, which has a drawn surrogate.
    alone = taken.where("m = 1").select("kind", "canon", "format", "h")
    if alone.isEmpty():
        return done
    others = keyed(entities).join(left.select("kind", "canon"), ["kind", "canon"], "left_anti").groupBy(
        "kind", "format").agg(F.min_by("canon", "h").alias("other"))
    several = Window.partitionBy("kind", "format").orderBy("h", "canon")
    last = alone.withColumn("i", F.row_number().over(several)).join(others, ["kind", "format"], "left")
    hashed = F.sha2(F.concat_ws("|", F.lit(key), kind, canon), 256)
    marked = F.when(kind == "email", F.concat(F.substr(hashed, F.lit(1), F.lit(16)), F.lit("@"), F.substr(
        hashed, F.lit(17), F.lit(8)), F.lit("."), F.substring_index(canon, ".", -1))).otherwise(
        F.substr(F.translate(hashed, "abcdef", "012345"), F.lit(1), F.lit(24)))
    return done.unionByName(last.select("kind", "canon", F.when(
        (F.col("i") == 1) & F.col("other").isNotNull(), F.col("other")).otherwise(marked).alias("surrogate")))


def assign_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): distinct per kind, and
    never itself an entity of the table unless its format has no room left."""
    entities = keep(entities.select("kind", "canon").distinct(), "entities")
    pending = entities.withColumn("attempt", F.lit(0))
    done = None
    for attempt in range(ATTEMPTS):
        drawn = keep(pending.withColumn("surrogate", _draw(
            F.col("kind"), F.col("canon"), F.col("attempt"), key)), "drawn")
        free = drawn.join(entities.select("kind", F.col("canon").alias("surrogate")),
                          ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = keep(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select(
            "kind", "canon", "surrogate"), "surrogates")
        done = won if done is None else keep(done.unionByName(won), "surrogates")
        pending = drawn.join(won, ["kind", "canon"], "left_anti").select(
            "kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done
    return keep(done.unionByName(_exchange(pending, entities, key)), "surrogates")


def _render(kind: Column, mention: Column, surrogate: Column, part: Column) -> Column:
    """The surrogate in the mention's own format; of a name, its part."""
    filled = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(
        c.rlike(r"[\p{L}\p{N}]"), F.substr(surrogate, F.length(F.regexp_replace(
            F.substr(mention, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")), F.lit(1))).otherwise(c)), "")
    title, word = F.regexp_extract(mention, _SPLIT_NAME, 1), F.substring_index(surrogate, "|", -1)
    alone = ~F.when(title == "", mention).otherwise(_after_title(mention)).contains(" ")
    return F.when(kind == "given", F.concat(title, word, F.lit(" "))) \
        .when(kind == "family", F.concat(F.when(alone, title).otherwise(""), word)) \
        .when(kind.isin(*FILLED), filled).otherwise(surrogate)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with its texts rewritten, plus ``pii_entities`` (mentions replaced)."""
    docs = without_own(docs, "pii_")
    found = keep(find_mentions(docs.withColumn("pii_row", F.monotonically_increasing_id()), text), "pii-found")
    hit = F.coalesce(F.size("pii_mentions"), F.lit(0)) > 0
    mentions = found.where(hit).select("pii_row", "pii_female", F.posexplode("pii_mentions").alias("at", "mention"))
    mentions = mentions.withColumn("e", F.explode(_parts(
        _kind(F.col("mention")), F.col("mention"), F.col("pii_female")))).select(
        "pii_row", "at", "mention", "e.part", "e.kind", "e.canon")
    table = assign_surrogates(mentions, key)
    new = mentions.join(table, ["kind", "canon"]).select("pii_row", "at", "part", _render(
        F.col("kind"), F.col("mention"), F.col("surrogate"), F.col("part")).alias("new"))
    lists = new.groupBy("pii_row").agg(F.collect_list(F.struct("at", "part", "new")).alias("pii_new"))
    # The text between mentions, and the parts of the mentions, in order.
    pieces = F.transform(F.split(F.col(text), _pattern(), -1), lambda p, i: F.struct(
        i.alias("at"), F.lit(-1).alias("part"), p.alias("new")))
    rebuilt = F.array_join(F.transform(F.sort_array(F.concat(pieces, F.col("pii_new"))), lambda x: x["new"]), "")
    columns = docs.columns
    changed = found.where(hit).join(lists, "pii_row").withColumn(text, rebuilt).select(
        *columns, F.size("pii_mentions").alias("pii_entities"))
    same = found.where(~hit).select(*columns, F.lit(0).alias("pii_entities"))
    return changed.unionByName(same)


def pii_report(docs: DataFrame) -> DataFrame:
    """Every document with its rewritten text and the number of replaced mentions."""
    return pseudonymise(docs.select("doc_id", "text")).select(
        "doc_id", "text", F.col("pii_entities").alias("n_entities"))
