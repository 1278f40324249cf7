"""PII surrogates: keyed, type-consistent, in DataFrame functions only.

Entities (e-mail, IPv4, IPv6, card, phone, SSN, IBAN, access key, named secret, personal
names) are found by one regular expression. Personal names are one or two capitalised words after a title, a listed
given name and a word (both also in capitals), two capitalised words where the text around says that a person is meant (``BEFORE``, ``AFTER``) and neither
belongs to places, bodies or dates (``NO_NAMES``), or a Chinese family name with up to two characters by a form of address or a label.
Each distinct (kind, canonical value) of the corpus gets one surrogate from a keyed SHA-512
stream, so mentions stay coreferent over the whole corpus. Names are drawn by their parts: a given name and a family name
have a surrogate each, so a person keeps one name with a title, without, and by the surname alone; in a document that
names somebody, the parts standing alone are replaced too, other than behind an article. Surrogates keep kind,
format (digits for digits, case, separators, prefixes, a valid Luhn digit where the
card had one, octets in range), script and, for given names, gender.

Collision checks keep distinct entities distinct: while two entities share a
surrogate, or one equals a real value of the corpus, the later ones take the
next salt, which lengthens a name by one part each time, and all else by a digit once ``ROOM`` salts found no free value of the same length (at once where
there is no letter or digit to replace); this is repeated until no collision is left. The first salt
of names is such that a script's names have room for all of the corpus's, so few collide at once and no surrogate gathers many entities.

Only documents with an entity are shuffled (by doc_id and text hash); the
others pass straight through.

The key is an argument: whoever has it can tell which surrogate a guessed value gets, so it is kept apart from the data.

Defined cases: null and empty texts come back unchanged with 0 entities;
repeated rows come back each; a null doc_id stays null; a very long text is rewritten whole in its task (about 20 times its size); where two
kinds could match, the first of ``KINDS`` at the first place does; two spellings of one IPv6 address are two entities; an empty table gives no row; other
columns are kept by ``redact`` and dropped by the query.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm.common import stored, table

#: Spark setting that holds the key of the registered query; a public stand-in where it is unset and Spark runs on this machine alone, as in tests.
KEY_SETTING, STAND_IN = "spark.waveloom.pii.key", "public-stand-in"
_drawn_keys: dict[str, str] = {}  # by application
ROUNDS, ROOM = 60, 8
TASK_ENTITIES = 1000  # drawn by one task

#: Given names by script and gender, family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Greta Helen Irene Julia Karin Laura Lucia Maria Nadine Olivia Paula Rosa Sarah Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Bruno Carlos David Emil Felix Georg Henry Ivan James Karl Louis Marco Martin Oscar Paul Peter Robert Simon".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Иван Кирилл Максим Олег Пётр Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Νίκος Πέτρος".split(),
    ("han", "f"): "芳 丽 娜 静 敏 燕 玲 秀英 桂兰 美玉".split(),
    ("han", "m"): "伟 强 磊 军 杰 涛 明 建国 志强 文博".split(),
}
FAMILY = {
    "latin": "Adler Bauer Becker Castro Dubois Evans Ferrer Garner Hoffman Iversen Jansen Keller Lambert Moreau Navarro Ortega Palmer Quinn Renard Santos Thorne Ullman Vidal Weber Young Zeller".split(),
    "cyrillic": "Беляк Волк Гончар Демченко Зима Коваль Лысенко Мороз Орел Шевченко".split(),
    "greek": "Βλάχου Γεωργίου Δήμου Ιωάννου Μακρή".split(),
    "han": "王 李 张 刘 陈 杨 赵 黄 周 吴".split(),
}
#: Titles that introduce a name, by gender.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Mme Mlle Madame Señora Sra Doña Г-жа Κυρία".split(),
    "m": "Mr Sir Herr Monsieur Señor Sr Don Г-н Κύριος".split(),
    "": "Dr Prof Professor Doctor".split(),
}

_FIRST = sorted({n for names in GIVEN.values() for n in names} | set("Alice Bob John Jane Mary Michael William Elizabeth Thomas Susan Hans Pierre Jean Juan José Ana".split()))
_TITLE = sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)
_MALE = [n for (_, g), ns in GIVEN.items() if g == "m" for n in ns] + "Bob John Michael William Thomas Hans Pierre Jean Juan José".split()
_FEMALE = [*(n for (_, g), ns in GIVEN.items() if g == "f" for n in ns), *"Alice Jane Mary Elizabeth Susan Ana".split()]
#: Words that a person's name stands behind, and before.
BEFORE = "by from with contact dear regards sincerely signed cc attn hired met thanked named called".split()
AFTER = "wrote writes said says replied asked answered called emailed told reported explained added agreed lives lived works worked joined".split()
#: Capitalised words of places, bodies and dates, which are no part of a name that only the words around it tell.
NO_NAMES = """New North South East West Northern Southern Eastern Western Central United States State Republic Kingdom Union Federal National International World Global
European American British German French Spanish Russian Chinese Bank University College School Institute Academy Museum Hospital Church Ministry Department Office Council Committee
Commission Court Parliament Congress Senate Party Army Police Company Corporation Group Inc Ltd Press News Times Street Avenue Road Square Park Bridge Station Airport City Town County
Province Region District Island Islands Lake River Mount Mountain Bay Sea Ocean Beach Valley Saint San Santa Los Las El La Le Costa Puerto Rio Sri Hong Great Upper Lower Old
Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December
The This That These Those Best Kind Many Your Our My""".split()
#: Chinese family names, forms of address behind a name and labels before it.
HAN_FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
HAN_AFTER, HAN_BEFORE = "先生 女士 小姐 老师 教授 医生".split(), "姓名： 姓名: 联系人： 联系人: 我叫".split()
_HAN = "[\u4e00-\u9fff]"
_CAPITAL = r"(?=\p{Lu})\b"  # names begin with a capital: tested first, since nearly every place fails there
_PART = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
_NAMED = rf"(?!(?:{'|'.join(NO_NAMES)})\b){_PART}"
_LOUD = r"\p{Lu}[\p{Lu}'’-]*\p{Lu}\b(?!\p{Ll})"
_FIRST_LOUD = [n.upper() for n in _FIRST]
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}"),  # a host has no more labels, and Java's matcher goes a call deeper for each
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_.-]{6,}"),
    ("key", r"\b(?:AKIA|ASIA)[0-9A-Z]{12,20}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9_-]{16,}"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])"),
    # each rare form is tested behind a cheap look ahead
    ("name", rf"{_CAPITAL}(?:(?:{'|'.join(_TITLE)})\b\.?\s{_PART}(?:\s{_PART})?|(?:{'|'.join(_FIRST)})\s{_PART}|(?=\p{{Lu}}{{2}})(?:{'|'.join(_FIRST_LOUD)})\s{_LOUD}"
     rf"|(?={_PART}\s\p{{Lu}})(?:(?={_PART}\s{_PART}\s(?:and\s{_PART}\s{_PART}\s)?(?:{'|'.join(AFTER)})\b)|(?<=\b(?i:{'|'.join(BEFORE)}),?\s)){_NAMED}\s{_NAMED})"
     rf"|(?={_HAN})(?:[{HAN_FAMILIES}]{_HAN}{{0,2}}?(?={'|'.join(HAN_AFTER)})|(?<={'|'.join(HAN_BEFORE)})[{HAN_FAMILIES}]{_HAN}{{1,2}})"),
)
PARTS = "array<struct<old:string,new:string>>"
ENTITY = "|".join(f"(?:{p})" for _, p in KINDS)
#: A cheap test that every text with an entity passes: a character that all but names and keys need, a key's prefix, or a title or given name.
HINT = (
    rf"[0-9@=:]|AKIA|ASIA|gh[pousr]_|sk-|{_CAPITAL}(?:(?:{'|'.join([*_TITLE, *_FIRST])})\b|(?=\p{{Lu}}{{2}})(?:{'|'.join(_FIRST_LOUD)})\b)|(?={_HAN})(?:{'|'.join(HAN_AFTER)}|{'|'.join(sorted({h.rstrip(':：') for h in HAN_BEFORE}))})"
    rf"|\p{{Ll}}\s(?:{'|'.join(AFTER)})\b|\b(?i:{'|'.join(BEFORE)}),?\s\p{{Lu}}")


def stream(key: str, kind: Column, value: Column, salt: Column) -> Column:
    """512 hex digits keyed by key, kind, value and salt."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(k)), kind, value, salt.cast("string")), 512) for k in range(4)])


def byte(digits: Column, k: Column) -> Column:
    return F.conv(F.substring(digits, 2 * (k % 256) + 1, F.lit(2)), 16, 10).cast("int")


def respelt(body: Column, digits: Column) -> Column:
    """Each letter or digit replaced by the stream, counting those alone; all else stays. Hex stays hex."""
    hexed = body.rlike(r"^[0-9a-f]*[a-f][0-9a-f]*$")

    def swap(c: Column, i: Column) -> Column:
        k = F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), r"[^0-9A-Za-z]", ""))
        b = byte(digits, k)
        return (
            F.when(hexed, F.lower(F.conv((b % 16).cast("string"), 10, 16)))
            .when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(97 + b % 26)).when(c.rlike("[A-Z]"), F.char(65 + b % 26)).otherwise(c))

    return F.when(body == "", "").otherwise(F.array_join(F.transform(F.split(body, ""), swap), ""))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") < 5, 2 * c.cast("int")).otherwise(2 * c.cast("int") - 9)),
        F.lit(0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def surrogate(key: str, kind: Column, value: Column, norm: Column, salt: Column) -> Column:
    return let(stream(key, kind, norm, salt), lambda digits: drawn_from(key, digits, kind, value, salt))


def drawn_from(key: str, digits: Column, kind: Column, value: Column, salt: Column) -> Column:
    prefix = F.coalesce(
        F.when(kind == "secret", F.regexp_extract(value, r"^[A-Za-z_-]+\s*[=:]\s*[\"']?", 0))
        .when(kind == "key", F.regexp_extract(value, r"^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0))
        .when(kind == "phone", F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0))
        .when(kind == "iban", F.substring(value, 1, 2)), F.lit(""))
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    n_more = F.when(rest.rlike("[0-9A-Za-z]"), F.greatest(salt - ROOM, F.lit(0))).otherwise(salt + 1)
    more = F.when(n_more > 0, F.array_join(F.transform(F.sequence(F.lit(1), n_more), lambda k: (byte(digits, 255 - k) % 10).cast("string")), "")).otherwise("")
    plain = F.concat(prefix, respelt(rest, digits), more)
    ip = F.concat_ws(".", *[(byte(digits, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    host = F.lower(F.substring_index(value, "@", -1))
    email = F.concat(respelt(F.substring_index(value, "@", 1), digits), more, F.lit("@"), F.translate(let(stream(key, F.lit("host"), host, F.lit(0)), lambda d: respelt(F.regexp_replace(host, r"\.[^.]*$", ""), d)), ".", "-"), F.lit(".example."), F.regexp_extract(host, r"[^.]*$", 0))
    only = F.regexp_replace(value, "[^0-9]", "")
    body = F.regexp_replace(F.substring(plain, F.lit(1), F.length(plain) - 1), "[^0-9]", "")
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(luhn_sum(only) % 10 == 0, F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), check)).otherwise(plain)
    groups = F.transform(F.split(value, ":"), lambda g, i: F.substring(digits, 4 * i + 1, F.when(g == "", 0).otherwise(F.least(F.length(g) + n_more, F.lit(4)))))
    return F.when(kind == "ip", ip).when(kind == "ip6", F.array_join(groups, ":")).when(kind == "email", email).when(kind == "card", card).when(kind.isin("given", "family"), name_part(kind, value, digits, salt)).otherwise(plain)


def name_class(kind: Column, value: Column) -> Column:
    """kind, script and, of given names, gender of a part of a name."""
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(f"^{_HAN}"), "han").otherwise("latin")
    plain = F.initcap(F.lower(value))
    female = plain.isin(*_FEMALE) | (~plain.isin(*_MALE) & plain.rlike("(?:a|α|η|а|я|[芳丽娜静敏燕玲英兰玉梅])$"))
    return F.when(kind == "given", F.concat_ws("|", kind, script, F.when(female, "f").otherwise("m"))).otherwise(F.concat_ws("|", kind, script))


#: The names that a class draws from.
DRAWN_FROM = {**{f"given|{s}|{g}": o for (s, g), o in GIVEN.items()}, **{f"family|{s}": o for s, o in FAMILY.items()}}


def name_part(kind: Column, value: Column, digits: Column, salt: Column) -> Column:
    """A given name of the same script and gender, or a family name of the same script, in capitals where the value is; a salted one carries one more for each salt, so there is always room."""
    pick = lambda options, k: F.element_at(F.array(*[F.lit(x) for x in options]), (byte(digits, k) * 256 + byte(digits, k + 1)) % len(options) + 1)

    def of(cls: Column) -> Column:
        out = F.lit("")
        for c, options in DRAWN_FROM.items():
            joined = F.array_join(F.transform(F.sequence(F.lit(0), salt), lambda k: pick(options, 2 * k)), "" if "|han" in c else "-")  # noqa: B023
            out = F.when(cls == c, joined).otherwise(out)
        return F.when(value.rlike(r"^\p{Lu}[\p{Lu}'’-]*\p{Lu}$"), F.upper(out)).otherwise(out)

    return let(name_class(kind, value), of)


def name_parts(value: Column) -> Column:
    """title with the blank behind it, given and family name of a name as it stands; what is absent is empty."""
    title = F.regexp_extract(value, rf"^(?:{'|'.join(_TITLE)})\b\.?\s", 0)
    rest = F.split(F.substring(value, F.length(title) + 1, F.length(value)), r"\s")
    alone, han = F.size(rest) == 1, value.rlike(f"^{_HAN}")
    given = F.when(han, F.substring(value, F.lit(2), F.length(value))).when(~alone | F.initcap(F.lower(rest[0])).isin(*_FIRST), rest[0]).otherwise("")
    family = F.when(han, F.substring(value, 1, 1)).when(alone, F.when(given == "", rest[0]).otherwise("")).otherwise(F.element_at(rest, -1))
    return F.struct(title.alias("title"), given.alias("given"), family.alias("family"))


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for k, p in reversed(KINDS[:-1]):
        out = F.when(value.rlike(f"^(?:{p})$"), k).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What makes mentions the same entity: digits of numbers (a North American phone number with or without its country), lower case of addresses and names, the value of a secret."""
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(value, r"^\+1(?=[ .(-])", ""), "[^0-9]", ""))
        .when(kind.isin("given", "family"), F.lower(value))
        .when(kind.isin("email", "ip6"), F.lower(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(value, r"^[A-Za-z_-]+\s*[=:]\s*[\"']?", ""))
        .otherwise(value))


def found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """value, kind, surrogate, parts: a row for every distinct value; entities that differ get surrogates that differ. parts: what a
    name's given and family name become, for mentions of them alone."""
    kinds = stored(values.select("value").distinct().withColumn("kind", kind_of(F.col("value"))), "entities")
    names = kinds.filter("kind = 'name'").withColumn("p", name_parts(F.col("value"))).select("value", "p.*")
    parts = names.select(F.explode(F.array(*[F.struct(F.col(k).alias("value"), F.lit(k).alias("kind")) for k in ("given", "family")])).alias("x")).select("x.*").filter("value <> ''").distinct()
    made = drawn(kinds.filter("kind <> 'name'").select("value", "kind").unionByName(parts), key)
    plain = made.filter("kind NOT IN ('given', 'family')").select("value", "kind", "surrogate", F.array().cast(PARTS).alias("parts"))
    for k in ("given", "family"):
        names = names.join(made.filter(F.col("kind") == k).select(F.col("value").alias(k), F.col("surrogate").alias(f"{k}_new")), k, "left")
    whole = F.when(F.col("value").rlike(f"^{_HAN}"), F.concat_ws("", "family_new", "given_new")).otherwise(F.concat("title", F.concat_ws(" ", "given_new", "family_new")))
    alone = F.filter(F.array(*[F.struct(F.col(k).alias("old"), F.col(f"{k}_new").alias("new")) for k in ("given", "family")]), lambda x: F.length(x["old"]) >= 3)
    return plain.unionByName(names.select("value", F.lit("name").alias("kind"), whole.alias("surrogate"), alone.cast(PARTS).alias("parts")))


def first_salts(kinds: DataFrame) -> Column:
    """The salt at which a class of names has as many surrogates as the corpus has names of it; 0 for all else."""
    cls = name_class(F.col("kind"), F.col("value"))
    counts = kinds.filter(F.col("kind").isin("given", "family")).groupBy(cls.alias("cls")).agg(F.count_distinct("norm").alias("n")).collect()  # a row a class
    salt = F.lit(0)
    for r in counts:
        k = 0
        while len(DRAWN_FROM[r["cls"]]) ** (k + 1) < r["n"]:
            k += 1
        salt = F.when(cls == r["cls"], k).otherwise(salt) if k else salt
    return salt


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """value, kind -> surrogate by rounds of salts, until no two collide and none is a real value."""
    kinds = stored(entities.withColumn("norm", canonical(F.col("kind"), F.col("value"))), "norms")
    make = lambda df: df.withColumn("made", surrogate(key, F.col("kind"), F.col("value"), F.col("norm"), F.col("salt")))
    # spellings of one name (its case) share the salt of the first
    salted = kinds.join(kinds.withColumn("salt", first_salts(kinds)).groupBy("kind", "norm").agg(F.max("salt").alias("salt")), ["kind", "norm"])
    tasks = kinds.count() // TASK_ENTITIES + 1
    now = stored(make(salted.repartition(tasks, "norm")), "surrogates")
    for _ in range(ROUNDS):
        keyed = now.withColumn("made_norm", canonical(F.col("kind"), F.col("made")))
        first = keyed.groupBy("kind", "made_norm").agg(F.min("norm").alias("first"))
        real = now.select(F.col("kind").alias("real_kind"), F.col("norm").alias("real_norm")).distinct()
        marked = keyed.join(first, ["kind", "made_norm"]).join(real, (F.col("kind") == F.col("real_kind")) & (F.col("made_norm") == F.col("real_norm")), "left")
        clash = marked.withColumn("clash", (F.col("norm") != F.col("first")) | F.col("real_norm").isNotNull()).groupBy("kind", "norm").agg(F.max("clash").alias("clash")).filter("clash")
        if clash.isEmpty():
            return now.select("value", "kind", F.col("made").alias("surrogate"))
        again = now.join(clash, ["kind", "norm"])
        kept = now.join(clash, ["kind", "norm"], "left_anti")
        again = make(again.withColumn("salt", F.col("salt") + 1).drop("clash", "made").repartition(tasks, "norm"))
        now = stored(kept.unionByName(again), "surrogates")
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds")


#: What a part of a name that stands alone follows and precedes: no letter, digit or line, and no article before.
ALONE = (r"(?<![\p{L}\p{N}_])(?<!\b(?:[Aa]n?|[Tt]he)\s)", r"(?![\p{L}\p{N}_])")


def alone_pattern(parts: Column) -> Column:
    """One expression for all parts of a document's names, longer ones first; parts are letters, hyphens and apostrophes."""
    olds = F.transform(F.array_sort(F.transform(parts, lambda x: F.struct((-F.length(x["old"])).alias("n"), x["old"].alias("old")))), lambda x: x["old"])
    return F.concat(F.lit(f"{ALONE[0]}(?:"), F.array_join(olds, "|"), F.lit(f"){ALONE[1]}"))


def parts_replaced(piece: Column, parts: Column, pattern: Column) -> Column:
    """Parts of the document's names standing alone, replaced in one pass, so no surrogate is replaced again."""
    new = F.transform(F.regexp_extract_all(piece, pattern, F.lit(0)), lambda v: F.filter(parts, lambda x: x["old"] == v)[0]["new"])
    between = F.split(piece, pattern, -1)
    return F.array_join(F.flatten(F.transform(between, lambda t, i: F.array(t, F.coalesce(F.get(new, i), F.lit(""))))), "")


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting. Where it is unset, a cluster's application draws one for itself, which nobody can guess and which ends with it."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        key = _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return key or STAND_IN


def redact(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """docs with text rewritten, and column ``count`` (in place of one of that name; none for None). All other columns are kept."""
    columns, text = [c for c in docs.columns if c != count], F.col("text")
    others = [docs[c] for c in columns if c != "text"]
    docs = docs.select(F.struct(*others).alias("others"), docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text"))
    finished = lambda df, n: df.select(*(F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in columns), *([n.alias(count)] if count else []))
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    maybe, clean = docs.filter(hinted).withColumn("text_hash", F.xxhash64("text")), docs.filter(~hinted)
    mentions = stored(maybe.select("id", "text_hash", F.explode(F.array_distinct(found(text))).alias("value")), "mentions")
    maps = mentions.join(stored(surrogates(mentions, key), "replacements"), "value").groupBy(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(
        F.map_from_entries(F.collect_set(F.struct("value", "surrogate"))).alias("map"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("parts")))).alias("parts"))  # as many as the document has entities
    maps = maps.withColumn("pattern", alone_pattern(F.col("parts")))

    def rewritten(z: Column) -> Column:
        pieces = F.transform(z["between"], lambda part, i: F.array(F.when(F.size("parts") > 0, parts_replaced(part, F.col("parts"), F.col("pattern"))).otherwise(part), F.coalesce(F.try_element_at(F.col("map"), F.get(z["found"], i)), F.lit(""))))
        return F.struct(F.array_join(F.flatten(pieces), "").alias("text"), F.size(z["found"]).cast("long").alias("n"))

    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    out = let(F.struct(F.split(text, ENTITY, -1).alias("between"), found(text).alias("found")), rewritten)
    joined = maybe.join(maps, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    changed = joined.withColumn("out", F.when(F.col("map").isNull(), same).otherwise(out)).withColumn("text", F.col("out.text"))
    return finished(changed, F.col("out.n")).unionByName(finished(clean, F.lit(0).cast("long")))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key_of(spark))
