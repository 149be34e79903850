"""Surrogates for personal data, in DataFrame functions only.

One pattern finds all entities of a text. An entity is taken apart into parts that name something of their own: a name
into given and family name, a mail address into its local part and its domain; all others are one part. A part's canonical
form (digits of a number, lower case of an address) is keyed by HMAC-SHA256 to a replacement of the same type and format:
numbers keep their separators and a valid Luhn digit, names keep gender and script. Numbers come from ranges that nobody
has: exchange 555 or area codes that begin with 0 or 1, social security numbers that begin with 9, addresses of
documentation, of benchmarks, or reserved ones. Distinct forms are drawn once over the whole table; forms whose draw meets
another's draw or any original are drawn again, from a space that grows with the attempts where the type allows it, so
surrogates are distinct, and equal parts have equal surrogates wherever they stand: Mrs. Clara Stone and Mrs. Stone stay
of one family, addresses of one domain stay so.

Defined cases: null and empty texts stay as they are; repeated rows get equal results; an empty table gives an empty
result; a mail host has at most 253 characters; all columns of the table are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import cut, fresh, hot_limit, met

#: Patterns by type, in order of precedence (fixed values).
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9][A-Za-z0-9.\-]{0,252}\.[A-Za-z]{2,24}",
    "phone": r"(?<![\d(])(?:\+\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\d)|(?<![\d\-.])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\dA-Za-z])\d{4}(?:[ \-]?\d{4}){3}(?![\dA-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "secret": r"(?<=\b(?:password|token|secret|api_key) ?[=:] ?\"?)[A-Za-z0-9_\-]{8,}",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?|(?<!\p{L})(?:Господин|Госпожа|Κύριος|Κυρία) \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
#: A text with none of these words, no @, no two digits in a row and no dot between two has no entity (fixed values).
HINTS = ("@", "AKIA", "password", "token", "secret", "api_key", "Mr", "Ms", "Miss", "Herr", "Frau", "Señor", "Monsieur", "Madame", "Господин", "Госпожа", "Κύριος", "Κυρία")
#: Titles of women (fixed values).
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "Κυρία")
#: Given names by script and gender (fixed values).
GIVEN = {
    "latin_f": ("Alice", "Clara", "Diana", "Elena", "Flora", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    "latin_m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    "cyrillic_f": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
    "cyrillic_m": ("Антон", "Борис", "Денис", "Иван", "Максим", "Олег", "Павел", "Роман"),
    "greek_f": ("Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Δήμητρα", "Νίκη", "Ζωή"),
    "greek_m": ("Αλέξης", "Γιάννης", "Δήμος", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Ηλίας"),
}
#: Syllables of family names by script (fixed values).
SYLLABLES = {
    "latin": ("ba", "den", "fo", "gar", "hel", "jo", "kin", "lam", "mor", "nel", "pen", "rus", "sol", "tam", "vin", "wes"),
    "cyrillic": ("ба", "ве", "го", "да", "жи", "за", "ки", "ло", "ма", "не", "по", "ро", "са", "то", "фе", "ша"),
    "greek": ("βα", "γε", "δο", "ζα", "θε", "κι", "λο", "μα", "νε", "πο", "ρι", "σα", "το", "φι", "χα", "ψε"),
}
#: Endings of given names that are made up, by script and gender (fixed values).
ENDINGS = {"latin_f": "a", "latin_m": "o", "cyrillic_f": "а", "cyrillic_m": "", "greek_f": "α", "greek_m": "ος"}
#: Attempts after which a type's space counts as used up, forms of a task, and bytes of a form that may be broadcast.
ATTEMPTS, FORMS, SHORT = 64, 512, 256
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DIGIT_TYPES = ("phone", "ssn", "card")


def kind_of(e: Column) -> Column:
    """The type of a hit: the first pattern that matches it all (context was checked when it was found)."""
    out = F.when(e.contains("@"), "email").when(e.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(e.rlike("^AKIA[A-Z0-9]{16}$"), "key")
    out = out.when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^\d{4}(?:[ \-]?\d{4}){3}$"), "card")
    return out.when(e.rlike(r"^[+(\d][\d() .\-]*$") & e.rlike(r"[() +.\-]"), "phone").when(e.rlike(r"^\p{Lu}\p{Ll}+\.? \p{Lu}"), "name").otherwise("secret")


def parts_of(kind: Column, e: Column) -> Column:
    """array<struct<lead, raw, part, canon>>: what stands before each part, the part, its type and canonical form."""
    part = lambda lead, raw, p, c: F.struct(lead.alias("lead"), raw.alias("raw"), p.alias("part"), c.alias("canon"))
    title = F.regexp_extract(e, r"^(\p{Lu}\p{Ll}+)\.? ", 1)
    lead, name = F.regexp_extract(e, r"^(\p{Lu}\p{Ll}+\.? )", 1), F.regexp_replace(e, r"^\p{Lu}\p{Ll}+\.? ", "")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(title.isin(*FEMALE), "f").otherwise("m")
    given, family = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    none = F.lit("")
    names = F.when(name.contains(" "), F.array(part(lead, given, F.concat_ws("_", F.lit("given"), script, gender), given), part(F.lit(" "), family, F.concat_ws("_", F.lit("family"), script), family)))
    names = names.otherwise(F.array(part(lead, name, F.concat_ws("_", F.lit("family"), script), name)))
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    mail = F.array(part(none, local, F.lit("local"), F.lower(local)), part(F.lit("@"), domain, F.lit("domain"), F.lower(domain)))
    digits = F.array(part(none, e, kind, F.regexp_replace(e, r"\D", "")))
    return F.when(kind == "name", names).when(kind == "email", mail).when(kind.isin(*_DIGIT_TYPES), digits).otherwise(F.array(part(none, e, kind, e)))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(c ^ x for c in k).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _numbers(key: str, message: Column) -> Column:
    """64 numbers of 0..255 that key and message decide."""
    hexes = F.concat(_hmac(key, message), _hmac(key, F.concat(message, F.lit("+"))))
    return _let(hexes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(h.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def _pick(values: tuple, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))))


def _masked(text: Column, r: Column) -> Column:
    """Letters and digits of text by others of their class."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    one = lambda c, i: F.when(
        c.rlike("[a-z]"),
        F.lit(low).substr(F.pmod(F.get(r, i % 64), F.lit(26)) + 1, F.lit(1)),
    ).when(c.rlike("[A-Z]"), F.lit(up).substr(F.pmod(F.get(r, i % 64), F.lit(26)) + 1, F.lit(1))).when(c.rlike("[0-9]"), F.lit(num).substr(F.pmod(F.get(r, i % 64), F.lit(10)) + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The digit that makes digits plus it valid."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("string")


def draw(kind: Column, canon: Column, r: Column, attempt: int) -> Column:
    """The surrogate of a part's canonical form by the numbers r of an attempt; later attempts draw from larger spaces."""
    masked = _masked(canon, r)
    at = lambda i: F.get(r, F.lit(i % 64))
    tail = F.concat(*[F.pmod(at(30 + i), F.lit(10)).cast("string") for i in range(attempt - 1)]) if attempt > 2 else F.lit("")
    # a secret of nearly no letters and digits has too few others of its format, or none: all its places are drawn
    few = (kind == "secret") & ((F.length(F.regexp_replace(canon, r"[_\-]", "")) < 4) | F.lit(attempt >= 6))
    other = F.when(few, _masked(F.regexp_replace(canon, r"[_\-]", "a"), r)).otherwise(masked)
    n = F.length(canon)
    card = F.concat(canon.substr(1, 1), masked.substr(F.lit(2), n - 2))
    # the last ten digits: exchange 555, later any in an area that begins with 0 or 1
    ten = lambda m: m.substr(n - 9, F.lit(10))
    local = F.concat(ten(masked).substr(1, 3), F.lit("555"), ten(masked).substr(7, 4)) if attempt < 6 else F.concat(F.pmod(at(50), F.lit(2)).cast("string"), ten(masked).substr(2, 9))
    phone = F.when(n >= 10, F.concat(canon.substr(F.lit(1), n - 10), local)).otherwise(masked)
    domain = F.concat(F.lit("m"), F.array_join(F.transform(F.slice(r, 40, 4 + min(attempt, 8)), lambda x: F.lower(F.hex(x + 256).substr(2, 2))), ""), F.lit(".example.net"))
    octet = lambda i, base, size: (F.lit(base) + F.pmod(at(i), F.lit(size))).cast("string")
    if attempt < 2:
        ip = F.concat(_pick(("192.0.2.", "198.51.100.", "203.0.113."), at(0)), octet(1, 1, 254))
    elif attempt < 4:
        ip = F.concat(_pick(("198.18.", "198.19."), at(0)), octet(1, 0, 256), F.lit("."), octet(2, 1, 254))
    else:
        ip = F.concat_ws(".", octet(0, 240, 15), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    syllables = lambda s, first, many: F.initcap(F.concat(*[_pick(SYLLABLES[s], at(first + i)) for i in range(many)]))

    def given(g):
        one = _pick(GIVEN[g], at(0))
        if attempt < 2:
            return one
        return F.concat(one, F.lit("-"), _pick(GIVEN[g], at(1)) if attempt < 4 else F.concat(syllables(g.split("_")[0], 2, 1 + attempt // 2), F.lit(ENDINGS[g])))

    out = F.when(kind == "card", F.concat(card, _luhn(card))).when(kind == "phone", phone).when(kind == "ssn", F.concat(F.lit("9"), masked.substr(F.lit(2), n - 1)))
    out = out.when(kind == "local", F.concat(masked, tail)).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "key", F.concat(F.lit("AKIA"), masked.substr(F.lit(5), n - 4)))
    for s in SYLLABLES:
        out = out.when(kind == f"family_{s}", syllables(s, 1, 5 + attempt // 3))
    for g in GIVEN:
        out = out.when(kind == f"given_{g}", given(g))
    return out.otherwise(other)


def surrogates(forms: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of the distinct forms (kind, canon); draws that collide are made again."""
    forms = cut(forms.select("kind", "canon").distinct())
    # a form costs much more than its bytes: tasks by rows
    spread = lambda df: df.repartition(1 + df.count() // FORMS, "kind", "canon")
    left, done = spread(forms), None
    for n in range(ATTEMPTS):
        message = F.concat_ws("\x1f", F.col("kind"), F.col("canon"), F.lit(n).cast("string"))
        drawn = left.select("kind", "canon", _let(_numbers(key, message), lambda r: draw(F.col("kind"), F.col("canon"), r, n)).alias("surrogate"), F.lit(False).alias("taken"))
        drawn = cut(drawn)
        every = drawn if done is None else drawn.unionByName(done.withColumn("taken", F.lit(True)))
        first = every.groupBy("kind", "surrogate").agg(F.max("taken").alias("was"), F.min(F.when(~F.col("taken"), F.col("canon"))).alias("owner"))
        drawn = drawn.join(first, ["kind", "surrogate"]).join(forms.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real")), ["kind", "surrogate"], "left")
        # a draw stands if nobody had it, it is the least form that drew it, and it is no original
        drawn = cut(drawn.withColumn("ok", ~F.col("was") & (F.col("owner") == F.col("canon")) & F.col("real").isNull()))
        good = drawn.where("ok").select("kind", "canon", "surrogate")
        done = good if done is None else done.unionByName(good)
        left = drawn.where("not ok").select("kind", "canon")
        if left.isEmpty():
            return done
        left = spread(left)
    raise ValueError("the space of surrogates is too small for these entities")


def poured(kind: Column, raw: Column, s: Column) -> Column:
    """The surrogate in the format of the occurrence: digits between its separators."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(
        c.rlike(r"\d"),
        F.struct(F.concat(a["out"], s.substr(a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i")),
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))
    return F.when(kind.isin(*_DIGIT_TYPES), F.aggregate(F.split(raw, ""), start, step, lambda a: a["out"])).otherwise(s)


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in their texts (and the number of entities in count_col); key is the secret of the draws."""
    hits, row, new = fresh(docs, "_hits", "_row", "_new")
    text = F.col(text_col)
    hint = text.rlike("[0-9][.]?[0-9]")
    for h in HINTS:
        hint = hint | text.contains(h)
    found = F.when(hint, F.regexp_extract_all(text, F.lit(_ALL), F.lit(0)))
    found = docs.withColumn(hits, F.coalesce(found, F.array().cast("array<string>")))
    extra = lambda df, n: df.withColumn(count_col, n.cast("long")) if count_col else df
    clean = extra(found.where(F.size(hits) == 0), F.lit(0)).drop(hits)
    dirty = cut(found.where(F.size(hits) > 0).withColumn(row, F.monotonically_increasing_id()))
    seen = dirty.select(F.col(row).alias("row"), F.posexplode(hits).alias("at", "e")).withColumn("type", kind_of(F.col("e")))
    seen = seen.select("row", "at", F.posexplode(parts_of(F.col("type"), F.col("e"))).alias("p", "x")).select("row", "at", "p", "x.lead", "x.raw", F.col("x.part").alias("kind"), "x.canon")
    forms = cut(seen.groupBy("kind", "canon").agg(F.count("*").alias("times")))
    table = surrogates(forms, key).join(forms, ["kind", "canon"])
    total = forms.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    filled = met(seen, cut(table), ["kind", "canon"], "times", hot_limit(total), F.octet_length("canon") <= SHORT)
    filled = filled.select("row", "at", "p", F.concat("lead", poured(F.col("kind"), F.col("raw"), F.col("surrogate"))).alias("s")).repartition("row")
    # one document's own hits, and an entity's own parts
    filled = filled.groupBy("row", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), "").alias("s"))
    filled = filled.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias(new)).withColumnRenamed("row", row)
    gaps = F.zip_with(F.split(text, _ALL, -1), F.col(new), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    done = dirty.join(filled, row).withColumn(text_col, F.array_join(gaps, ""))
    return clean.unionByName(extra(done, F.size(hits)).select(*[F.col(f"`{c}`") for c in clean.columns]))
