"""Personal data replaced by keyed surrogates (native).

Detected: e-mail addresses, phone numbers, payment cards (Luhn-valid only),
IPv4 addresses, US social security numbers, values assigned to secret-like
names, well-known key formats, and person names after a title.  One regular
expression finds all of them; a text is cut at its matches, each match is
replaced by its surrogate, everything else stays as it was.

A surrogate is a function of the key, the space and the entity's identity (case
and digit grouping do not matter), so equal entities get equal surrogates in
every document (coreference).  A space is a type, but secret values and keys are
one space and so are the parts of all persons' names: a key is the same entity
behind any assignment, a name part behind any title.  It keeps type and format:
digits stay digits, letters letters of their script and case, cards stay
Luhn-valid, addresses valid, country codes, top-level domains and titles are kept.

Persons: a name is replaced part by part, so "Mr Smith" and "Dr John Smith" keep
the surname in common.  The first of several parts is a given name; its gender
is that of its titles in all documents or, where only neutral ones stand before
it, that of the list of common given names; titles that contradict each other
leave it open.  Parts known from a titled mention are replaced wherever they
stand capitalised in the same document, also without a title, with "'s" kept.

Collision check: over all distinct entities of a space, a surrogate that two
entities share or that is itself a real entity is drawn again for all but one
(the attempt enters the hash) until all are distinct.  Only the entities that
needed another attempt, and name parts whose mentions tell different forms, are
joined back to the documents.

Edge cases: a null text stays null, an empty one empty; matches that fail
their check stay unchanged; null ids, repeated rows and empty tables need no
special care.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, let, small

L = "[\\p{L}\\p{N}._%+-]"
OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
MALE, FEMALE, EITHER = "Mr|Herr|Señor|Sr|Monsieur|господин|г-н|κύριος", "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа|г-жа|κυρία", "Dr|Prof"
SECRET_NAME = "(?:[A-Za-z_]*(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))[\"']?\\s{0,4}[:=]\\s{0,4}[\"']?"
PATTERNS = {
    "secret": f"(?<![A-Za-z_])(?i:{SECRET_NAME})(?-i)[A-Za-z0-9_/+=~.-]{{12,}}+",
    "key": "(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])",
    "email": f"(?<!{L}){L}++@[\\p{{L}}\\p{{N}}-]++(?:\\.[\\p{{L}}\\p{{N}}-]++)++",
    "ip": f"(?<![\\d.])(?:{OCTET}\\.){{3}}{OCTET}(?!\\.?\\d)",
    "card": "(?<![\\d-])(?:\\d{13,19}|\\d{4}([ -])\\d{4}\\1\\d{4}\\1\\d{1,7})(?![\\d-])",
    "phone": "(?<![\\d+])(?:\\+?\\d{1,3}[ .-]?\\(\\d{2,4}\\)[ .-]?\\d{3,4}[ .-]?\\d{3,4}|\\+\\d{1,3}(?:[ .-]\\d{2,4}){2,4}|\\+\\d{9,15}|\\(\\d{3}\\) ?\\d{3}[.-]\\d{4}|\\d{3}[.-]\\d{3}[.-]\\d{4})(?!\\d)",
    "ssn": "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])",
    "person": f"(?<!\\p{{L}})(?:{MALE}|{FEMALE}|{EITHER})\\.? \\p{{Lu}}[\\p{{L}}'’-]++(?: \\p{{Lu}}[\\p{{L}}'’-]++){{0,2}}",
}
#: The only back reference is the card's group; no other group captures.
ANY = "|".join(PATTERNS[k] for k in ("secret", "key", "email", "ip", "phone", "ssn", "card", "person"))

LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Edgar Felix Georg Hugo Ivan Jonas Karim Louis Marco Nils Oscar Pavel Quentin Robert Simon Tomas",
    ("latin", "f"): "Alice Berta Clara Diana Elena Frida Greta Hanna Irene Julia Karin Laura Maria Nadia Olivia Paula Rosa Sara Teresa Vera",
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Денис Егор Иван Кирилл Максим Николай Олег Павел Роман Сергей",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Марина Нина Ольга Полина Татьяна",
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σπύρος",
    ("greek", "f"): "Άννα Βασιλική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
}
SYLLABLES = {
    "latin": "bal ber cor dan del fer gar hol jan kel lan mar nor pet quin ros sal ter vel wen zim".split(),
    "cyrillic": "бал вер гор дан жел зим кар лев мор нов пет рос сав тим хол чер".split(),
    "greek": "βαλ γερ δαν ζημ καρ λεβ μορ νικ πετ ροσ σαβ τιμ φιλ χρυ".split(),
}
ENDINGS = {"latin": "son sen man feld ton ez ini berg ova ski".split(), "cyrillic": "енко кин ский чук ян".split(),
           "greek": "άκης ίδης όπουλος έλης".split()}
#: Common given names, as far as a neutral title leaves the gender open (fixed values).
COMMON = {
    "m": "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew "
         "george kenneth peter hans klaus jürgen wolfgang stefan jean pierre michel françois philippe juan josé carlos luis "
         "miguel antonio иван сергей александр дмитрий николай γιώργος δημήτρης νίκος",
    "f": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret anna ann emily laura "
         "helen ruth julia ursula monika petra sabine claudia marie nathalie isabelle sophie maría carmen ana isabel laura "
         "lucía анна мария елена ольга наталья μαρία ελένη κατερίνα",
}
GIVEN_LONGER = 3  # from this attempt on a given name may grow
LONGER = 6  # from this attempt on a crowded format may grow
MAX_ATTEMPTS = 64


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _is(value: Column, name: str) -> Column:
    return value.rlike("^(?:" + PATTERNS[name] + ")$")


def kind(value: Column) -> Column:
    """Type of a match; null if it fails its check."""
    digits = F.regexp_replace(value, "\\D", "")
    return (F.when(_is(value, "secret"), "secret").when(_is(value, "key"), "key").when(_is(value, "email"), "email")
            .when(_is(value, "ip"), "ip").when(_is(value, "phone"), "phone").when(_is(value, "ssn"), "ssn")
            .when(_is(value, "card"), F.when(_luhn(digits), "card"))
            .when(value.rlike(f"^(?:{MALE})\\.? "), "person_m").when(value.rlike(f"^(?:{FEMALE})\\.? "), "person_f")
            .when(value.rlike(f"^(?:{EITHER})\\.? "), "person_x"))


def _head(value: Column, type_: Column) -> Column:
    """What of a match is kept in front: the secret's name, the title."""
    return (F.when(type_ == "secret", F.regexp_extract(value, f"^(?i:{SECRET_NAME})", 0))
            .when(type_.startswith("person"), F.regexp_extract(value, "^[^ ]+ ", 0)).otherwise(""))


def _tail(value: Column, type_: Column) -> Column:
    """What of a name is kept at its end: a possessive ending, loose marks."""
    return F.when(type_.startswith("person"), F.regexp_extract(value, "(?:['’]s)?['’-]*$", 0)).otherwise("")


def identity(value: Column, type_: Column) -> Column:
    """What makes two mentions the same entity."""
    rest = F.substr(value, F.length(_head(value, type_)) + 1)
    rest = F.substr(rest, F.lit(1), F.length(rest) - F.length(_tail(value, type_)))
    return (F.when(type_.isin("phone", "ssn", "card"), F.regexp_replace(value, "\\D", ""))
            .when(type_ == "email", F.lower(value)).when(type_.startswith("person"), F.lower(rest)).otherwise(rest))


def space(type_: Column) -> Column:
    """Where identities are told apart: a type, but one for all name parts and one
    for secret values and keys."""
    return F.when(type_.startswith("person"), "person").when(type_ == "key", "secret").otherwise(type_)


def parts(type_: Column, ident: Column) -> Column:
    """array<struct<space, ident, form>>: the parts a mention is replaced by, with
    the form their surrogates take as far as this mention tells."""
    common = {g: F.array(*[F.lit(n) for n in sorted(set(names.split()))]) for g, names in COMMON.items()}

    def name_part(whole):
        def one(part, i):
            neutral = (F.when(F.array_contains(common["m"], part), "given_m").when(F.array_contains(common["f"], part), "given_f")
                       .otherwise("given_x"))
            given = F.when(type_ == "person_m", "given_m").when(type_ == "person_f", "given_f").otherwise(neutral)
            return F.struct(F.lit("person").alias("space"), part.alias("ident"),
                            F.when((i == 0) & (F.size(whole) > 1), given).otherwise("surname").alias("form"))
        return F.transform(whole, one)

    form = F.when((type_ == "secret") & _is(ident, "key"), "key").otherwise(type_)
    return (F.when(type_.startswith("person"), let(F.split(ident, " "), name_part))
            .otherwise(F.array(F.struct(space(type_).alias("space"), ident.alias("ident"), form.alias("form")))))


def _stream(key: str, space_: Column, ident: Column, attempt: Column) -> Column:
    """512 hex digits drawn from the key, space, identity and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), space_, ident, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{k}")).cast("binary"), 512) for k in range(4)])


def _draw(stream: Column, at: Column, n: int | Column) -> Column:
    """A number below n from two bytes of the stream."""
    start = (at % 128) * 4 + 1
    return (F.conv(F.substr(stream, start.cast("int"), F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n + 1, F.lit(1))


def _like(text: Column, stream: Column, keep_from: Column | None = None) -> Column:
    """Every character replaced by one of its class and script; those from
    ``keep_from`` on (0-based) are kept."""
    def one(c, i, keep):
        drawn = (F.when(c.rlike("[0-9]"), _pick("0123456789", _draw(stream, i, 10)))
                 .when(c.rlike("\\p{IsCyrillic}"), _pick(CYRILLIC, _draw(stream, i, len(CYRILLIC))))
                 .when(c.rlike("\\p{IsGreek}"), _pick(GREEK, _draw(stream, i, len(GREEK))))
                 .when(c.rlike("\\p{L}"), _pick(LATIN, _draw(stream, i, len(LATIN)))).otherwise(c))
        drawn = F.when(c.rlike("\\p{Lu}"), F.upper(drawn)).otherwise(drawn)
        return F.when(i >= keep, c).otherwise(drawn)
    return let(F.lit(1 << 30) if keep_from is None else keep_from, lambda keep: F.array_join(
        F.transform(F.split(text, "(?!^)"), lambda c, i: one(c, i, keep)), ""))


def _listed(words: list[str], n: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(words)), " "), n + 1)


def _surname(stream: Column, at: int, script: str, attempt: Column) -> Column:
    syl = SYLLABLES[script]
    parts = [_listed(syl, _draw(stream, F.lit(k), len(syl))) for k in (at, at + 1, at + 2, at + 3, at + 20, at + 21)]
    end = _listed(ENDINGS[script], _draw(stream, F.lit(at + 4), len(ENDINGS[script])))
    return F.initcap(F.concat(parts[0], parts[1], F.when(attempt >= LONGER, F.concat(parts[2], parts[3])).otherwise(""),
                              F.when(attempt >= 2 * LONGER, F.concat(parts[4], parts[5])).otherwise(""), end))


def _name_part(ident: Column, form: Column, stream: Column, attempt: Column) -> Column:
    def of(script):
        syl = SYLLABLES[script]
        more = [F.when(attempt >= GIVEN_LONGER * (k + 1), _listed(syl, _draw(stream, F.lit(102 + k), len(syl)))).otherwise("") for k in range(3)]

        def given(g):
            names = GIVEN[script, g].split()
            return F.concat(_listed(names, _draw(stream, F.lit(100), len(names))), *more)
        either = F.when(_draw(stream, F.lit(101), 2) == 0, given("m")).otherwise(given("f"))
        return (F.when(form == "given_m", given("m")).when(form == "given_f", given("f")).when(form == "given_x", either)
                .otherwise(_surname(stream, 0, script, attempt)))
    return (F.when(ident.rlike("\\p{IsCyrillic}"), of("cyrillic")).when(ident.rlike("\\p{IsGreek}"), of("greek"))
            .otherwise(of("latin")))


def surrogate(ident: Column, type_: Column, attempt: Column, s: Column) -> Column:
    """The surrogate identity of an entity, from its stream."""
    n = F.length(ident)
    more = F.when(attempt >= LONGER, F.concat(*[_pick(LATIN, _draw(s, F.lit(120 + k), 26)) for k in range(6)])).otherwise("")
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: _pick("0123456789", _draw(s, i, 10))), "")
    country = F.greatest(n - 10, F.lit(0))
    phone = F.concat(F.substr(ident, F.lit(1), country), F.substr(numbers, F.lit(1), n - country))
    front = F.substr(numbers, F.lit(1), n - 1)
    card = F.concat(front, F.element_at(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]),
                                                 lambda d: _luhn(F.concat(front, d))), 1))
    ip = F.concat_ws(".", *[(_draw(s, F.lit(k), 254) + 1).cast("string") for k in range(4)])
    top = n - F.length(F.substring_index(ident, ".", -1))
    hex_ = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick("0123456789abcdef", _draw(s, i, 16))), "")
    hex_ = F.when(ident.rlike("^[0-9A-F]+$"), F.upper(hex_)).otherwise(hex_)
    fixed = F.length(F.regexp_extract(ident, "^(?:AKIA|gh[pousr]_|sk-|xox[baprs]-)", 0))
    return (F.when(type_ == "email", F.concat(more, _like(ident, s, top)))
            .when(type_ == "ip", ip).when(type_ == "phone", phone).when(type_ == "card", card)
            .when(type_ == "ssn", F.substr(numbers, F.lit(1), n))
            .when(type_ == "key", F.concat(F.substr(ident, F.lit(1), fixed), _like(F.substr(ident, fixed + 1), s), more))
            .when(type_ == "secret", F.concat(F.when(ident.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), hex_).otherwise(_like(ident, s)), more))
            .otherwise(_name_part(ident, type_, s, attempt)))


def _written(value: Column, type_: Column, new: Column) -> Column:
    """The surrogate identity in the form of the mention."""
    chars = F.split(value, "(?!^)")
    index = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "\\D", "")))
    digits = F.array_join(F.zip_with(chars, index, lambda c, k: F.when(c.rlike("[0-9]"), F.substr(new, k, F.lit(1))).otherwise(c)), "")
    shaped = F.when(value == F.upper(value), F.upper(new)).otherwise(new)
    return (F.when(type_.isin("phone", "ssn", "card"), digits).when(type_ == "email", shaped)
            .otherwise(F.concat(_head(value, type_), new, _tail(value, type_))))


def mentions(text: Column) -> Column:
    """array<struct<value, type, ident>> of all matches; type null where a check fails."""
    def one(v):
        return F.struct(v.alias("value"), kind(v).alias("type"))
    # every pattern needs one of these
    may = text.rlike("[0-9@=:]|AKIA|gh[pousr]_|sk-|xox[baprs]-")
    for title in "|".join((MALE, FEMALE, EITHER)).split("|"):
        may = may | F.contains(text, F.lit(title))
    none = F.expr("cast(array() as array<string>)")
    typed = F.transform(F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.isNotNull(), none), one)
    return F.transform(typed, lambda m: F.struct(m["value"].alias("value"), m["type"].alias("type"),
                                                 identity(m["value"], m["type"]).alias("ident")))


def redrawn(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Distinct (space, ident) with their form -> (space, ident, form, attempt) of
    those whose first surrogate collides with another's or with a real entity."""
    def named(df, attempt):
        a = F.lit(attempt)
        drawn = df.withColumn("s", _stream(key, F.col("space"), F.col("ident"), a))
        return drawn.select("space", "ident", "form", surrogate(F.col("ident"), F.col("form"), a, F.col("s")).alias("new"))

    taken, later = [], []
    pending = entities.select("space", "ident", "form")
    for attempt in range(MAX_ATTEMPTS):
        drawn = scratch.keep(named(pending, attempt))
        real = entities.select(F.col("space").alias("_t"), F.col("ident").alias("_i"))
        free = drawn.join(real, (F.col("space") == F.col("_t")) & (F.lower("new") == F.lower("_i")), "left_anti")
        for t in taken:
            free = free.join(t.select(F.col("space").alias("_t"), F.col("new").alias("_n")),
                             (F.col("space") == F.col("_t")) & (F.col("new") == F.col("_n")), "left_anti")
        won = free.groupBy("space", "new").agg(F.min_by(F.struct("ident", "form"), "ident").alias("e")).select("space", "new", "e.ident", "e.form")
        won = scratch.keep(won)
        lost = scratch.keep(drawn.join(won.select(F.col("space").alias("_t"), F.col("ident").alias("_i")),
                                       (F.col("space") == F.col("_t")) & (F.col("ident") == F.col("_i")), "left_anti")
                            .select("space", "ident", "form"))
        taken.append(won)
        if attempt:
            later.append(won.select("space", "ident", "form", F.lit(attempt).alias("attempt")))
        if lost.isEmpty():
            break
        pending = lost
    else:
        raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")
    out = entities.select("space", "ident", "form").filter("false").withColumn("attempt", F.lit(0))
    for df in later:
        out = out.unionByName(df)
    return scratch.keep(out)


def anonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text and three more columns:
    n_entities (mentions replaced), entity_types, and surrogates
    (array<struct<type, value, surrogate>>, the mentions in order)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    text = F.col(text_col).cast("string")
    found = docs.withColumn("_tl_m", mentions(text))
    # a part that is a given name anywhere is one; the forms its mentions tell settle its gender
    man, woman = F.max(F.col("form") == "given_m"), F.max(F.col("form") == "given_f")
    settled = (F.when(F.col("space") != "person", F.min("form")).when(F.max("form") == F.min("form"), F.min("form"))
               .when(man & ~woman, "given_m").when(woman & ~man, "given_f").otherwise("given_x"))
    told_parts = (found.select(F.col(id_col).alias("_tl_id"), F.explode("_tl_m").alias("m")).where("m.type is not null")
                  .select("_tl_id", F.explode(parts(F.col("m.type"), F.col("m.ident"))).alias("p")).select("_tl_id", "p.*"))
    entities = scratch.keep(told_parts.groupBy("space", "ident").agg(
        settled.alias("form"), (F.min("form") != F.max("form")).alias("differ")))
    again = redrawn(entities, key, scratch)
    differ = entities.filter("differ").join(again.select(F.col("space").alias("_t"), F.col("ident").alias("_i")),
                                            (F.col("space") == F.col("_t")) & (F.col("ident") == F.col("_i")), "left_anti")
    again = scratch.keep(again.unionByName(differ.select("space", "ident", "form", F.lit(0).alias("attempt"))))

    attempts = F.lit(None).cast("map<string,struct<attempt:int,form:string>>")
    if not again.isEmpty():
        named = again.select(F.col("space").alias("_t"), F.col("ident").alias("_i"), "attempt", F.col("form").alias("settled"))
        per_doc = (told_parts.select("_tl_id", "space", "ident").distinct()
                   .join(small(named), (F.col("space") == F.col("_t")) & (F.col("ident") == F.col("_i")))
                   .groupBy("_tl_id").agg(F.map_from_entries(F.collect_list(F.struct(
                       F.concat_ws("\x1f", "space", "ident"), F.struct("attempt", F.col("settled").alias("form"))))).alias("_tl_a")))
        per_doc = scratch.keep(per_doc)
        found = found.join(small(per_doc), F.col(id_col).eqNullSafe(F.col("_tl_id")), "left")
        attempts = F.col("_tl_a")

    # one transform after the other, so that each step is computed once for a part
    def of_parts(step):
        return lambda m: F.struct(m["value"].alias("value"), m["type"].alias("type"), F.transform(m["parts"], step).alias("parts"))

    def with_parts(m):
        return F.struct(m["value"].alias("value"), m["type"].alias("type"), parts(m["type"], m["ident"]).alias("parts"))

    def with_attempt(p):
        told = F.element_at(attempts, F.concat_ws("\x1f", p["space"], p["ident"]))
        return F.struct(p["space"].alias("space"), p["ident"].alias("ident"), F.coalesce(told["attempt"], F.lit(0)).alias("attempt"),
                        F.coalesce(told["form"], p["form"]).alias("form"))

    def with_stream(p):
        return F.struct(*[p[c].alias(c) for c in ("space", "ident", "attempt", "form")],
                        _stream(key, p["space"], p["ident"], p["attempt"]).alias("s"))

    def with_new(p):
        return F.struct(p["ident"].alias("ident"), surrogate(p["ident"], p["form"], p["attempt"], p["s"]).alias("new"))

    def written(m):
        new = F.array_join(F.transform(m["parts"], lambda p: p["new"]), " ")
        new = F.when(m["type"].isNull(), m["value"]).otherwise(_written(m["value"], m["type"], new))
        # the parts of names, as they are looked up where no title stands
        names = F.when(m["type"].startswith("person"), m["parts"])
        return F.struct(m["type"].alias("type"), m["value"].alias("value"), new.alias("surrogate"), names.alias("names"))

    steps = F.col("_tl_m")
    for step in (with_parts, of_parts(with_attempt), of_parts(with_stream), of_parts(with_new), written):
        steps = F.transform(steps, step)
    found = found.withColumn("_tl_w", steps)
    known = F.array_distinct(F.flatten(F.filter(F.col("_tl_w.names"), lambda n: n.isNotNull())))
    found = found.withColumn("_tl_k", F.when(F.size(known) > 0, F.map_from_entries(known))).withColumn(
        "_tl_s", F.transform("_tl_w", lambda m: F.struct(m["type"].alias("type"), m["value"].alias("value"), m["surrogate"].alias("surrogate"))))

    def untitled(gap):
        """A stretch between mentions with the known name parts replaced."""
        def one(word):
            end = F.regexp_extract(word, "['’]s$", 0)
            new = F.element_at(F.col("_tl_k"), F.lower(F.substr(word, F.lit(1), F.length(word) - F.length(end))))
            return F.when(word.rlike("^\\p{Lu}"), F.coalesce(F.concat(new, end), word)).otherwise(word)
        words = F.regexp_extract_all(gap, F.lit("\\p{L}++(?:['’-]\\p{L}++)*+|[^\\p{L}]++"), F.lit(0))
        return F.array_join(F.transform(words, one), "")

    gaps = F.split(text, ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.concat(F.col("_tl_s.surrogate"), F.array(F.lit(""))), lambda g, s: F.concat(
        F.when(F.col("_tl_k").isNull(), g).otherwise(untitled(g)), s)), "")
    real = F.filter("_tl_s", lambda s: s["type"].isNotNull())
    keep = [c for c in docs.columns if c not in ("n_entities", "entity_types", "surrogates")]
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda s: F.substring_index(s["type"], "_", 1)))), ",")
    return found.select(
        *[F.when(F.size("_tl_s") > 0, rebuilt).otherwise(text).alias(c) if c == text_col else F.col(c) for c in keep],
        F.coalesce(F.size(real), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("entity_types"),
        real.alias("surrogates"))
