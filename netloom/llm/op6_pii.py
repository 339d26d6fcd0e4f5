"""PII surrogates, with DataFrame and SQL functions only.

Detected: e-mail addresses, card numbers (Luhn-valid), phone numbers, IPv4 addresses, social security numbers, secret tokens
(hexadecimal or with a known prefix) and names behind a title. Each type is sought on its own in the whole text, cards at
every digit where one may begin, so that digits that fail a check hide nothing; where valid entities of two types overlap,
the type that stands first in PATTERNS is taken. Cards are 13 to 19 digits without a break, or groups of 4-4-4-4, 4-4-4-4-3,
4-6-5, 4-6-4 or 4-3-3-3; a phone number ends before an address, card or social security number. Each entity has a normal form (case, spaces and marks folded), and its surrogate is made from sha2(key, type, normal form, attempt): the same
normal form gets the same surrogate everywhere. A surrogate keeps type and format: digits stay digits, letters stay letters
of their script and case (ASCII letters stand for scripts without a table), marks stay in place (but for addresses of marks
only, which get letters), cards stay Luhn-valid, country codes and top-level domains stay, addresses of one domain share their
surrogate domain, octets stay octets, and names keep their script and the gender that their title shows.

Collision check, over all entities of the table: where two entities of a type have one surrogate, or a surrogate is itself
an entity of the table, all but the first take the next attempt, until none is left. Names and addresses grow with the attempt, so there
are always enough of them; numbers keep their length.

Cases: null texts stay null, empty ones empty; documents without entities stay as they are; repeated rows are
replaced alike; an empty table gives no rows; a column n_entities is replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged, unstage, wide_key

#: Titles that show a gender, and given and family names to put in place of found ones.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"]
MALE = ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Niels", "Oscar", "Paul"]
FEMALE = ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"]
FAMILY = ["Abel", "Bauer", "Costa", "Dupont", "Ebert", "Ferrer", "Garcia", "Hansen", "Ibsen", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Perez"]
SYLLABLES = [c + v for c in "bdfghjklmnprstvz" for v in "aeiou"]
#: Characters by script, each with lower-case letters of that script; the first that fits is taken.
LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[à-öø-ÿß]": "àáâäèéêëìíîïòóôöùúûüñç",
    r"[\p{IsLatin}&&\P{ASCII}]": "ăąćčďđēęěğīłńňōőřśşšťūůűźżž",
    r"\p{IsCyrillic}": "абвгдежзийклмнопрстуфхцчшщыэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsArmenian}": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտ",
    r"\p{IsGeorgian}": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsDevanagari}": "अआइईउऊएकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    r"\p{IsBengali}": "অআইঈউকখগঘচছজঝটঠডঢণতথদধনপফবভমযরলশষসহ",
    r"\p{IsGurmukhi}": "ਅਆਇਈਉਕਖਗਘਚਛਜਝਟਠਡਢਣਤਥਦਧਨਪਫਬਭਮਯਰਲਵਸਹ",
    r"\p{IsGujarati}": "અઆઇઈઉકખગઘચછજઝટઠડઢણતથદધનપફબભમયરલવશષસહ",
    r"\p{IsTamil}": "அஆஇஈஉஊஎஏஐகஙசஞடணதநபமயரலவழளறன",
    r"\p{IsTelugu}": "అఆఇఈఉకఖగఘచఛజఝటఠడఢణతథదధనపఫబభమయరలవశషసహ",
    r"\p{IsKannada}": "ಅಆಇಈಉಕಖಗಘಚಛಜಝಟಠಡಢಣತಥದಧನಪಫಬಭಮಯರಲವಶಷಸಹ",
    r"\p{IsMalayalam}": "അആഇഈഉകഖഗഘചഛജഝടഠഡഢണതഥദധനപഫബഭമയരലവശഷസഹ",
    r"\p{IsThai}": "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวศสหอฮ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    r"\p{IsHan}": "安白成大德东方风高国海和华江金开兰乐林明南宁平青清仁山石水天文西小新雪阳玉元云正中子",
    r"[\p{L}\p{M}]": "abcdefghijklmnopqrstuvwxyz",
}
TOPS = 64  # attempts before the checks give up; each attempt is a fresh hash

TITLES = "|".join(MALE_TITLES + FEMALE_TITLES)
IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])"
NO_IP = rf"(?!(?<![\p{{L}}\p{{N}}.]){IP})"
GROUP = rf"{NO_IP}(?!(?<![\p{{L}}\p{{N}}\-]){SSN})(?!(?<![\p{{L}}\p{{N}}.])(?:(?:\d{{4}} ){{3}}|(?:\d{{4}}-){{3}}|\d{{12}})\d{{4}}(?!\d))\d{{2,4}}"
END = r"(?![\p{L}\p{N}])"
#: By priority. A blank joins a fourth group of a phone number only where a blank joined the third.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[\p{L}\p{M}\p{N}\-]++(?:\.[\p{L}\p{M}\p{N}\-]++)+",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![\p{L}\p{N}])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+1[ .\-]?(?:\(\d{{3}}\)|\d{{3}})[ .\-]?\d{{3}}[ .\-]?\d{{4}}{END}|\+\d{{1,3}}[ .\-]?\(?{NO_IP}\d{{2,4}}\)?[ .\-]?{NO_IP}\d{{2,4}}(?:[.\-]?{GROUP}(?:[.\-]?{GROUP})?| {GROUP}(?:[ .\-]?{GROUP})?){END})|(?<![\p{{L}}\p{{N}}])\(\d{{3}}\) ?\d{{3}}[ .\-]\d{{4}}{END}",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){IP}",
    "ssn": rf"(?<![\p{{L}}\p{{N}}\-]){SSN}",
    "card": rf"(?<![\p{{L}}\p{{N}}.])(?:\d{{4}}[ \-]?){{3}}\d{{4}}{END}",
    "card of other length": rf"(?<![\p{{L}}\p{{N}}.])(?:\d{{13,19}}|(?:\d{{4}}[ \-]){{4}}\d{{1,3}}|\d{{4}}[ \-]\d{{6}}[ \-]\d{{4,5}}|\d{{4}}(?:[ \-]\d{{3}}){{3}}){END}",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}[\p{{L}}\p{{M}}]++(?: (?!(?:{TITLES})(?!\p{{L}}))\p{{Lu}}[\p{{L}}\p{{M}}]++)?",
}
ANY = "|".join(PATTERNS.values())
SPAN = "struct<rank:int,at:int,len:int,kind:string,value:string>"
HINT = rf"[@\d]|(?:{TITLES})\.? \p{{Lu}}|[0-9a-fA-F]{{32}}|AKIA|gh[pousr]_|sk-"


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    back = F.split(F.reverse(digits), "")
    step = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def candidates(text: Column, rank: int, name: str) -> Column:
    """All that matches a pattern, at every place where one begins, as SPANs; digits that only look like a card are left out."""
    pattern, kind = PATTERNS[name], name.split()[0]
    found, parts = F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), 1), F.split(text, f"(?=(?:{pattern}))", -1)

    def placed(x: Column) -> Column:
        ahead = F.size(x["parts"]) - F.size(x["found"])  # a match at the very start has no part ahead of it
        at = lambda i: F.aggregate(F.slice(x["parts"], F.lit(1), i + ahead), F.lit(0), lambda n, p: n + F.length(p))
        return F.transform(x["found"], lambda v, i: F.struct(F.lit(rank).alias("rank"), at(i).alias("at"), F.length(v).alias("len"), F.lit(kind).alias("kind"), v.alias("value")))

    out = F.transform(F.array(F.struct(found.alias("found"), parts.alias("parts"))), placed)[0]
    if kind == "card":
        out = F.filter(out, lambda x: luhn_sum(F.regexp_replace(x["value"], r"\D", "")) % 10 == 0)
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(f"array<{SPAN}>"))


def apart(spans: Column) -> Column:
    """The spans by rank and place, without those that overlap an earlier one."""
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["at"] < x["at"] + x["len"]) & (x["at"] < k["at"] + k["len"]))
    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def normal(kind: Column, value: Column) -> Column:
    """What makes two spellings one entity. For names: gender and the words behind the title."""
    named = F.regexp_replace(value, rf"^(?:{TITLES})\.? ", "")
    gender = F.when(value.rlike(rf"^(?:{'|'.join(MALE_TITLES)})\.? "), "m").otherwise("f")
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, r"\D", "")).when(kind == "name", F.concat(gender, F.lit(":"), F.lower(named))).otherwise(F.lower(value))


def stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that depend on the key, the entity and the attempt."""
    part = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), F.lit(k)), 512)
    return F.concat(part("a"), part("b"))


def pick(bits: Column, at: Column, n: int | Column) -> Column:
    """A number below n from the stream; places beyond its end go round it."""
    return (F.conv(F.substring(bits, (at * 4) % 252 + 1, F.lit(5)), 16, 10).cast("int") + at) % n


def respell(value: Column, bits: Column) -> Column:
    """value with every letter and digit replaced by another one, script, case and marks kept."""

    def one(c: Column, i: Column) -> Column:
        low, out = F.lower(c), F.when(c.rlike(r"[0-9]"), ((c.try_cast("int") + 1 + pick(bits, i, 9)) % 10).cast("string")).when(c.rlike(r"\p{N}"), pick(bits, i, 10).cast("string"))
        for test, table in LETTERS.items():
            others = F.replace(F.lit(table), low, F.lit(""))
            new = F.substring(others, pick(bits, i, F.length(others)) + 1, F.lit(1))
            out = out.when(low.rlike(f"^{test}"), F.when(c == low, new).otherwise(F.upper(new)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def lettered(value: Column) -> Column:
    """value, or letters in the place of its marks where it has nothing but marks."""
    return F.when(value.rlike(r"[\p{L}\p{N}]"), value).otherwise(F.regexp_replace(value, r"[^.]", "a"))


def longer(value: Column, attempt: Column) -> Column:
    """value with its last letter or digit once more for each attempt after the second."""
    last = F.regexp_extract(value, r"([\p{L}\p{N}])[^\p{L}\p{N}]*$", 1)
    return F.concat(value, F.repeat(F.when(last == "", "a").otherwise(last), F.greatest(attempt - 1, F.lit(0))))


def digits_only(value: Column, bits: Column, keep: int) -> Column:
    """Digits of value replaced but for the first `keep`; for a fixed norm of digits only."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(i < keep, c).otherwise(pick(bits, i, 10).cast("string"))), "")


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, itself in normal form."""
    bits = stream(key, kind, norm, attempt)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.regexp_extract(domain, r"\.[^.]+$", 0)
    host = F.regexp_replace(domain, r"\.[^.]+$", "")
    email = F.concat(respell(longer(lettered(local), attempt), bits), F.lit("@"), respell(lettered(host), stream(key, F.lit("domain"), domain, F.lit(0))), top)
    body = F.substring(digits_only(norm, bits, 1), F.lit(1), F.length(norm) - 1)
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda c, i: F.when((i == 0) & c.isin("10", "127", "192", "172"), c).otherwise((pick(bits, i, 254) + 1).cast("string"))), ".")

    def names(table: list[str], at: int) -> Column:
        """A name of the table that is no part of what it replaces."""
        free = F.filter(F.array(*[F.lit(n) for n in table]), lambda n: ~F.array_contains(F.split(F.substring(norm, F.lit(3), F.length(norm)), " "), F.lower(n)))
        return free[pick(bits, F.lit(at), 1 << 20) % F.size(free)]

    latin = lambda word: word.rlike(r"^[\p{IsLatin}\p{M}]+$")
    words = F.substring(norm, F.lit(3), F.length(norm))
    first, last = F.substring_index(words, " ", 1), F.substring_index(words, " ", -1)
    given = F.when(~latin(first), respell(first, stream(key, F.lit("given"), norm, attempt))).when(norm.startswith("m:"), names(MALE, 0)).otherwise(names(FEMALE, 1))
    more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.array(*map(F.lit, SYLLABLES))[pick(bits, i + 8, len(SYLLABLES))]), "")).otherwise("")
    family = F.when(latin(last), F.concat(names(FAMILY, 2), more)).otherwise(respell(longer(last, attempt), bits))
    name = F.when(norm.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)
    secret = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(i < F.length(F.regexp_extract(norm, r"^(?:akia|gh[pousr]_|sk-)", 0)), c).when(norm.rlike("^[0-9a-f]+$"), F.lower(F.hex(pick(bits, i, 16)))).otherwise(respell_one(c, bits, i))), "")
    keep = F.when(kind == "phone", F.lit(1)).otherwise(F.lit(0))
    number = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(i < keep, c).when((i == keep), (pick(bits, i, 8) + 2).cast("string")).otherwise(pick(bits, i, 10).cast("string"))), "")
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", octets).when(kind == "name", F.concat(F.substring(norm, 1, 2), F.lower(name))).when(kind == "secret", secret).otherwise(number)


def respell_one(c: Column, bits: Column, i: Column) -> Column:
    table = "abcdefghijklmnopqrstuvwxyz"
    return F.when(c.rlike(r"\d"), pick(bits, i, 10).cast("string")).when(c.rlike("[a-z]"), F.substring(F.lit(table), pick(bits, i, 26) + 1, F.lit(1))).otherwise(c)


def dress(kind: Column, value: Column, sur: Column) -> Column:
    """The surrogate in the spelling of the value it replaces: its marks, its case, its title."""
    digits = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(sur, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    upper = F.array_join(F.transform(F.split(sur, ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)) != F.lower(F.substring(value, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(value, rf"^(?:{TITLES})\.? ", 0)
    named = F.initcap(F.substring(sur, F.lit(3), F.length(sur)))
    behind = F.substring(value, F.length(title) + 1, F.length(value))
    name = F.concat(title, F.when(behind == F.upper(behind), F.upper(named)).otherwise(named))
    return F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "name", name).when(kind == "ip", sur).otherwise(upper)


def settled(found: DataFrame, key: str) -> DataFrame:
    """found (kind, norm), distinct: plus sur, different for different entities and never an entity of the table."""
    table = staged(found.select("kind", "norm", F.lit(0).alias("attempt")), "entities")
    for _ in range(TOPS):
        table = staged(table.withColumn("sur", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"))), "surrogates")
        rank = F.row_number().over(Window.partitionBy("kind", "sur").orderBy("attempt", "norm"))
        own = table.select(F.col("kind").alias("k"), F.col("norm").alias("n"), F.lit(1).alias("own"))
        checked = table.withColumn("rank", rank).join(own, (F.col("kind") == F.col("k")) & (F.col("sur") == F.col("n")), "left")
        checked = staged(checked.select("kind", "norm", "sur", "attempt", ((F.col("rank") > 1) | F.col("own").isNotNull()).alias("bad")), "checked")
        unstage(table)
        if checked.where("bad").isEmpty():
            return checked.select("kind", "norm", "sur")
        table = checked.select("kind", "norm", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    raise ValueError(f"entities without a surrogate of their own after {TOPS} attempts")


def suspect(text: Column) -> Column:
    """Whether any pattern matches; null for null."""
    return text.rlike(HINT) & text.rlike(ANY)


def replace_pii(docs: DataFrame, key: str = "netloom") -> DataFrame:
    """docs with surrogates in text, and column n_entities (how many were replaced); key keeps surrogates apart between owners."""
    names = [n for n in docs.columns if n != "n_entities"]
    k1, k2 = wide_key(F.col("text"))
    body = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"), k1.alias("__k1"), k2.alias("__k2"))
    spans = apart(F.concat(*[candidates(F.col("__text"), rank, name) for rank, name in enumerate(PATTERNS)]))
    entity = body.where(F.col("__text").rlike(HINT)).select("__k1", "__k2", F.explode(spans).alias("x")).select("__k1", "__k2", "x.at", "x.len", "x.kind", "x.value").distinct()
    entity = staged(entity.withColumn("norm", normal(F.col("kind"), F.col("value"))), "found")
    table = settled(entity.select("kind", "norm").distinct(), key)
    new = entity.join(table, ["kind", "norm"]).select("__k1", "__k2", F.struct("at", "len", dress(F.col("kind"), F.col("value"), F.col("sur")).alias("new")).alias("x"))
    # A document's entities meet: bounded by its text.
    new = staged(new.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list("x")).alias("__new")), "replacements")
    release(docs.sparkSession)
    end = lambda x: x["at"] + x["len"]
    begin = lambda i: F.when(i == 0, 0).otherwise(end(F.col("__new")[i - 1]))
    filled = F.transform("__new", lambda x, i: F.concat(F.substring(F.col("__text"), begin(i) + 1, x["at"] - begin(i)), x["new"]))
    text = F.concat(F.array_join(filled, ""), F.substring(F.col("__text"), end(F.element_at("__new", -1)) + 1, F.length("__text")))
    changed = body.where(suspect(F.col("__text"))).join(new, ["__k1", "__k2"], "left")
    count = F.when(F.col("__new").isNull(), 0).otherwise(F.size("__new"))
    changed = changed.select("__row", F.when(count > 0, text).otherwise(F.col("__text")).alias("__out"), count.alias("__n"))
    same = body.where(~F.coalesce(suspect(F.col("__text")), F.lit(False))).select("__row", F.col("__text").alias("__out"), F.lit(0).alias("__n"))
    return changed.unionByName(same).select(*[F.col("__out").alias(n) if n == "text" else F.col(f"__row.`{n}`").alias(n) for n in names], F.col("__n").alias("n_entities"))
