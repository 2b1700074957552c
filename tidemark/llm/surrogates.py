"""Personal data replaced by keyed surrogates of the same type. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import quoted
from ..scratch import drop_table, write_table

#: Rounds of new draws for surrogates that clash. Each leaves a small share of the clashes.
MOST_ROUNDS = 40

# Patterns of the entities, in Java's syntax.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\d+.-])\d(?:[ -]?\d){12,18}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}([-.])\d{3}\1\d{4}(?![\w-]|\.\d)"
_MALE, _FEMALE, _EITHER = "Mr|Herr|Monsieur|Señor|господин|г-н|κύριος|κος", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|госпожа|г-жа|κυρία|κα", "Dr|Prof"
#: One word of a name: a capital, then letters, marks, and parts after a hyphen or an apostrophe, but for a possessive.
_JOINT = r"['’-](?!s(?!\p{L}))\p{L}"
_WORD = rf"\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:{_JOINT}[\p{{L}}\p{{M}}]*+)*+"
_NAME = rf"{_WORD}(?: (?:(?:von|van|de|der|den|del|da|di|du|la|le|al|bin|ben)(?: (?:der|den|la|las|los))? )?{_WORD}){{0,2}}"
NAME = rf"(?<![\p{{L}}])(?:{_MALE}|{_FEMALE}|{_EITHER})\.? {_NAME}"
_TITLED = rf"^(?:{_MALE}|{_FEMALE}|{_EITHER})\.? "
KINDS = {"email": EMAIL, "ip": IP, "iban": IBAN, "ssn": SSN, "phone": PHONE, "card": CARD, "name": NAME}
PATTERN = "|".join(KINDS.values())
# Given names by gender and script, and the syllables of family names.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Noel Oscar Paul",
    ("f", "latin"): "Anna Bella Clara Diana Emma Flora Greta Hanna Irene Julia Klara Laura Maria Nina Olga Paula",
    ("n", "latin"): "Alex Andrea Chris Dominique Jamie Jordan Kim Lee Luca Morgan Noa Robin Sascha Sam Toni Yuri",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Олег Павел Роман Степан Фёдор",
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София",
    ("n", "cyrillic"): "Саша Женя Валя Шура Слава Тоня Паша Ваня Миша Лёша Коля Толя Гриша Петя Сеня Вова",
}
GIVEN |= {
    ("m", "greek"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσονας Κώστας Λουκάς Μάνος Νίκος Πέτρος Σπύρος Τάσος Φώτης Χρήστος",
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νεφέλη Ξένια Ρένα Σοφία Χριστίνα",
    ("n", "greek"): "Άρτεμις Δανάη Μελίνα Φοίβη Ίρις Δάφνη Κλειώ Ήβη Ορφέας Αρης Στάθης Μάκης Τάκης Άκης Λάκης Σάκης",
}
SYLLABLES = {"greek": "μπα ρεν ντορ μι λες τα βον κερ λιν σο χαρ νε βελ γου ρο σταμ", "latin": "ba ren dor mi les ta von ker lin so har ne vel gu ro stam", "cyrillic": "ба рен дор ми лес та вон кер лин со хар не вел гу ро стам"}


def _kind(found: Column) -> Column:
    """The first of KINDS whose pattern is the whole of ``found``."""
    kind = F.lit("name")
    for name, pattern in reversed([x for x in KINDS.items() if x[0] != "name"]):
        whole = F.regexp_replace(found, f"^(?:{pattern})$", "") == ""
        kind = F.when(whole, F.lit(name)).otherwise(kind)
    return kind


def _gender(found: Column) -> Column:
    return F.when(found.rlike(f"^(?:{_MALE})\\.? "), "m").when(found.rlike(f"^(?:{_FEMALE})\\.? "), "f").otherwise("n")


def canonical(kind: Column, found: Column) -> Column:
    """What tells an entity from others, however it is written: digits of numbers (with the country apart), small letters of addresses and names. Names carry their gender."""
    digits = F.regexp_replace(found, r"\D", "")
    country = F.regexp_extract(found, r"^\+(\d{1,3})", 1)
    phone = F.concat(country, F.lit("|"), F.substring(digits, F.length(country) + 1, F.length(digits)))
    name = F.concat(_gender(found), F.lit("|"), F.lower(F.regexp_replace(found, _TITLED, "")))
    return F.when(kind == "email", F.lower(found)).when(kind == "ip", found).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).when(kind == "phone", phone).when(kind == "name", name).otherwise(digits)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A stand-in for a canonical entity of the same form, drawn from the key, the entity and the number of the attempt."""
    hex_ = F.concat(*(F.sha2(F.concat_ws("\x01", F.lit(f"{key}/{k}"), kind, canon, attempt.cast("string")), 256) for k in range(2)))
    chars = F.split(canon, "")
    # 12 digits of 14 hexadecimal ones at a time, so that all digits come equally often
    many = F.concat(*(F.lpad(F.pmod(F.conv(F.substring(hex_, 1 + 14 * k, 14), 16, 10).cast("bigint"), F.lit(10**12)).cast("string"), 12, "0") for k in range(9)))
    digit = lambda i: F.substring(many, F.pmod(i, F.lit(108)) + 1, F.lit(1))
    small = lambda i: F.char(F.lit(97) + F.pmod(F.conv(F.substring(hex_, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int"), F.lit(26)))
    cyrillic = lambda i: F.substring(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), F.pmod(F.conv(F.substring(hex_, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int"), F.lit(28)) + 1, F.lit(1))

    def drawn(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[A-Z]"), F.upper(small(i))).when(c.rlike("[\\u0430-\\u044f\\u0451]"), cyrillic(i)).when(c.rlike("\\p{L}"), small(i)).otherwise(c)

    joined = lambda keep: F.array_join(F.transform(chars, lambda c, i: F.when(keep(i), c).otherwise(drawn(c, i))), "")
    bar = F.instr(canon, "|")
    top = F.length(canon) - F.length(F.substring_index(canon, ".", -1))  # where the last label of an address begins
    octets = [F.conv(F.substring(hex_, 1 + 4 * k, 4), 16, 10).cast("int") for k in range(4)]
    ip = F.concat_ws(".", (1 + F.pmod(octets[0], F.lit(223))).cast("string"), *(F.pmod(x, F.lit(256)).cast("string") for x in octets[1:3]), (1 + F.pmod(octets[3], F.lit(254))).cast("string"))
    # the last digit keeps the Luhn remainder, so that valid numbers stay valid and others don't become so
    double = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    luhn = lambda s: F.aggregate(F.transform(F.split(F.reverse(s), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, double(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))).otherwise(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))), F.lit(0), lambda a, x: a + x)
    body = joined(lambda i: i < 1)
    card = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.pmod(F.substring(body, -1, 1).cast("int") + luhn(canon) - luhn(body), F.lit(10)).cast("string"))
    script = F.when(canon.rlike("[\\u0400-\\u04ff]"), "cyrillic").when(canon.rlike("[\\u0370-\\u03ff\\u1f00-\\u1fff]"), "greek").otherwise("latin")
    part = lambda at, size: F.pmod(F.conv(F.substring(hex_, at, 4), 16, 10).cast("int"), F.lit(size)) + 1
    given = F.lit(None).cast("string")
    for (gender, own), names in GIVEN.items():
        given = F.when((F.substring(canon, 1, 1) == gender) & (script == own), F.element_at(F.array(*map(F.lit, names.split())), part(1, 16))).otherwise(given)
    of_script = lambda at, own: F.element_at(F.array(*map(F.lit, SYLLABLES[own].split())), at)
    place = lambda i: F.pmod(F.conv(F.substring(hex_, i * 2 + 5, F.lit(2)), 16, 10).cast("int"), F.lit(16)) + 1
    syllable = lambda i: F.when(script == "cyrillic", of_script(place(i), "cyrillic")).when(script == "greek", of_script(place(i), "greek")).otherwise(of_script(place(i), "latin"))
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.least(attempt, F.lit(40))), lambda i: syllable(i)), ""))
    name = F.when(F.instr(canon, " ") > 0, F.concat_ws(" ", given, family)).otherwise(family)
    return F.when(kind == "email", joined(lambda i: i >= top)).when(kind == "ip", ip).when(kind == "iban", joined(lambda i: i < 2)).when(kind == "phone", joined(lambda i: i < bar)).when(kind == "card", card).when(kind == "name", F.concat(F.substring(canon, 1, 2), name)).otherwise(joined(lambda i: F.lit(False)))


def written(kind: Column, found: Column, stand_in: Column) -> Column:
    """The surrogate written as the entity was: its separators, its capital letters, its title."""
    chars, plain = F.split(found, ""), F.regexp_replace(stand_in, "[^0-9A-Za-z]", "")
    spaced = F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    cased = F.transform(chars, lambda c, i: F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(F.substring(stand_in, i + 1, F.lit(1)))).otherwise(F.substring(stand_in, i + 1, F.lit(1))))
    name = F.substring(stand_in, F.lit(3), F.length(stand_in))
    plain_name = F.regexp_replace(found, _TITLED, "")
    # a mention by the family name alone gets the stand-in's; capitals throughout stay so
    shown = F.when(F.instr(plain_name, " ") > 0, name).otherwise(F.substring_index(name, " ", -1))
    shown = F.when((F.length(plain_name) > 1) & (plain_name == F.upper(plain_name)), F.upper(shown)).otherwise(shown)
    title = F.concat(F.regexp_extract(found, _TITLED, 0), shown)
    return F.when(kind == "email", F.array_join(cased, "")).when(kind == "ip", stand_in).when(kind == "name", title).otherwise(F.array_join(spaced, ""))


def shape(kind: Column, of: Column) -> Column:
    """What an entity or stand-in looks like to a reader: names without their gender, names and addresses in small letters."""
    return F.when(kind == "name", F.lower(F.substring(of, F.lit(3), F.length(of)))).when(kind == "email", F.lower(of)).otherwise(of)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon`` and ``stand_in`` for distinct entities: no two of a kind look alike (``shape``) and none looks like an entity.

    Entities whose stand-in clashes (all but the smallest that drew it, and any that drew an entity) draw again until none does. RuntimeError if MOST_ROUNDS do not suffice, as when a kind has nearly as many entities as forms.
    """
    drawn = lambda df: df.withColumn("stand_in", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("shape", shape(F.col("kind"), F.col("stand_in")))
    current = write_table(drawn(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))), "stand_ins")
    real = lambda df: df.select("kind", shape(F.col("kind"), F.col("canon")).alias("shape")).distinct().withColumn("real", F.lit(True))
    for _ in range(MOST_ROUNDS):
        keepers = current.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon")).alias("keeper"))
        bad = keepers.join(real(current), ["kind", "shape"], "left").where("n > 1 or real").select("kind", "shape", F.when(F.col("real"), F.lit(None)).otherwise(F.col("keeper.canon")).alias("keeper"), F.lit(True).alias("clash"))
        marked = current.join(bad, ["kind", "shape"], "left").withColumn("again", F.coalesce("clash", F.lit(False)) & ~F.coalesce(F.col("keeper") == F.col("canon"), F.lit(False)))
        if not marked.where("again").limit(1).count():
            return current.select("kind", "canon", "stand_in")
        kept = marked.where("not again").select("kind", "canon", "attempt", "stand_in", "shape")
        after = write_table(kept.unionByName(drawn(marked.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))), "stand_ins")
        drop_table(current)
        current = after
    raise RuntimeError("stand-ins still clash: too many entities of one kind")


def _quoted_words(words: Column) -> Column:
    """An alternation of words as they are, in Java's syntax."""
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{M}\p{N} ])", r"\\$1")), "|")


def _mentions(text: Column) -> Column:
    """The pattern for one text: PATTERN, and the names that it gives with a title, without one: whole names, and family names of whole names, as they are or in capitals. Longer ones first."""
    titled = F.transform(F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda n: n != ""), lambda n: F.regexp_replace(n, _TITLED, ""))
    whole = F.filter(titled, lambda n: F.instr(n, " ") > 0)
    names = F.array_distinct(F.concat(whole, F.transform(whole, lambda n: F.substring_index(n, " ", -1)), F.filter(titled, lambda n: F.length(n) > 3)))
    names = F.array_distinct(F.concat(names, F.transform(names, lambda n: F.upper(n))))
    ordered = F.transform(F.sort_array(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda x: x["n"])
    more = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}'’-])(?:"), _quoted_words(ordered), F.lit(rf")(?![\p{{L}}\p{{M}}\p{{N}}]|{_JOINT})"))
    return F.when(F.size(names) > 0, more).otherwise(F.lit(PATTERN))


def _same_person(each: DataFrame) -> DataFrame:
    """``each`` with the mentions of a name that does not say all brought to the whole one of their text: "Mr Smith" and "Smith" to "m|john smith", "Anna Smith" to "f|anna smith"."""
    is_name = F.col("kind") == "name"
    words = F.substring(F.col("canon"), F.lit(3), F.length("canon"))
    marked = each.withColumns({"__words": F.when(is_name, words), "__gender": F.when(is_name, F.substring("canon", 1, 1)), "__titled": is_name & F.col("found").rlike(_TITLED)})
    known = marked.where("__titled").select("__key", "__words", "__gender", "canon").distinct()
    whole = known.where(F.instr("__words", " ") > 0).withColumn("__family", F.substring_index("__words", " ", -1))
    # in order: the same words; the family name, by gender if the mention tells one
    by_words = known.groupBy("__key", "__words").agg(F.min(F.struct((F.col("__gender") == "n").alias("n"), "canon")).alias("w"))
    best = lambda g: F.min(F.when(F.col("__gender").isin(g, "n"), F.struct((F.col("__gender") == "n").alias("n"), F.col("canon")))).alias(g)
    by_family = whole.groupBy("__key", F.col("__family").alias("__words")).agg(best("m"), best("f"), F.min("canon").alias("any"))
    joined = marked.join(by_words, ["__key", "__words"], "left").join(by_family, ["__key", "__words"], "left")
    family = F.when(F.instr("__words", " ") > 0, F.lit(None)).when(F.col("__gender") == "m", F.col("m.canon")).when(F.col("__gender") == "f", F.col("f.canon")).otherwise(F.col("any"))
    own = F.when(F.col("__titled") & (F.col("__gender") != "n"), F.col("canon")).otherwise(F.col("w.canon"))
    return joined.withColumn("canon", F.coalesce(family, own, F.col("canon"))).select("__key", "at", "found", "kind", "canon")


def replace_entities(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text`` with every detected entity replaced, and ``n_entities``, for every row of ``df``.

    Entities: e-mail and IP addresses, IBANs, card and social security numbers, phone numbers, and names after a title, which are then found without it in the same text too, whole or by the family name. Mentions by the family name alone are of the one whole name of the text that ends in it and fits the title's gender (of several the first in order; none: a person of their own). An entity has one surrogate in all rows, whatever its separators or case; different entities have different ones (see ``assign``). Without ``key`` surrogates can't be linked to entities. Texts without an entity, null and empty ones stay as they are. Repeated rows keep their number. Common entities are reduced to one before surrogates are drawn, and the join that brings them back has no step after it that needs a key's rows together.
    """
    text = F.col(quoted(text_col))
    rows = df.select(F.col(quoted(id_col)).alias(id_col), text.alias("text"))
    clean = rows.where(~F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))).withColumn("n_entities", F.lit(0))
    mixed = rows.where(F.col("text").rlike(PATTERN))
    # rows with the same id and text share their replacement
    mixed = mixed.withColumn("__key", F.md5(F.concat_ws("\x01", F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("\x02")), F.col("text"))))
    mixed = mixed.withColumn("__pattern", _mentions(F.col("text")))
    found = write_table(mixed.select("__key", id_col, F.regexp_extract_all("text", F.col("__pattern"), F.lit(0)).alias("found"), F.split("text", F.col("__pattern"), -1).alias("rest")), "entities")
    each = found.select("__key", F.posexplode("found").alias("at", "found")).withColumn("kind", _kind(F.col("found"))).withColumn("canon", canonical(F.col("kind"), F.col("found")))
    each = _same_person(each)
    stand_ins = assign(each, key)
    put = each.join(stand_ins, ["kind", "canon"]).select("__key", F.struct("at", written(F.col("kind"), F.col("found"), F.col("stand_in")).alias("put")).alias("put"))
    lists = put.groupBy("__key").agg(F.array_sort(F.collect_set("put")).alias("puts"))
    body = F.array_join(F.transform("puts", lambda p, i: F.concat(F.get(F.col("rest"), i), p["put"])), "")
    replaced = found.join(lists, "__key").select(id_col, F.concat(body, F.element_at("rest", -1)).alias("text"), F.size("puts").alias("n_entities"))
    return clean.unionByName(replaced)
