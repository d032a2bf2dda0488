"""Surrogates for personal data (DataFrame functions only).

Entities are found by one pattern, which runs once over each whole text: e-mail addresses, telephone numbers (international in any grouping of 8 to 15
digits, or as (555) 555-5555), payment cards (of a known issuer, with a valid check digit; a number that fails the check is passed over whole), IPv4
addresses, secrets (quoted hexadecimal strings, access keys) and persons named with a title. Persons without a title, national numbers in other
forms, IPv6 and postal addresses are not sought. Texts are written once, cut at the entities.

Each entity has a normal form, so that spellings of one entity share it; a person has one for the given name (with the title's gender) and one for the
surname, the last name given. A surrogate is drawn from a keyed hash of kind and normal form: the same everywhere, so that `Mr John Smith`
and `Mr Smith` keep one surname (coreference), not to be undone without the key, and of the same type: letters of the same script and case, digits for
digits, a card with its issuer's first digits and a valid check digit, a telephone number with its country code, an address from the reserved
240.0.0.0/4, a person with the same title, hence gender, script and number of names. Letters of scripts not named in SCRIPTS become Latin ones.

Collision checks: over all distinct entities, a surrogate that two entities share or that is an entity of the corpus itself is drawn
again for the later ones, until none is left, so distinct entities stay distinct. Few entities ever need this. Up to MAX_INLINE
of them are inlined in the plan; beyond it, surrogates are joined to the texts instead.

The text between entities is kept to the character. Defined results: a null text stays null, a text without entities stays as it is; repeated
rows are treated alike; other columns pass through, but one named like the column of counts gives way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, numbered

MAX_INLINE = 10_000
MAX_ROUNDS = 40
KINDS = ("email", "phone", "card", "ip", "secret", "person")
#: Stands around entities while a text is cut; a text that has this private character itself is cut another way.
MARK = ""

_MALE = ("Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "г-н", "Κύριος", "السيد", "מר")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа", "Κυρία", "السيدة", "גברת")
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}"
_PHONE = r"(?<![\p{N}+])(?:\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}|\(\d{3}\) ?\d{3}[ .\-]\d{4})(?!\d)"
_IP = r"(?<![\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_CARD = r"(?<!\p{N})(?<!\p{N}[.\-])(?:4\d|5[0-8]|2[2-7]|3[4-8]|6[0245])\d\d(?:[ \-]?\d{6}[ \-]?\d{4,5}|(?:[ \-]?\d{4}){2}[ \-]?\d{1,7})(?!\d)"
_SECRET = r"""(?<=["'])[0-9a-fA-F]{32,128}(?=["'])|\bAKIA[0-9A-Z]{16}\b|\bghp_[A-Za-z0-9]{36}\b"""
_NAME = r"(?:\p{Lu}[\p{L}\p{M}]+(?:['’\-]\p{L}[\p{L}\p{M}]*)*|\p{Lu}['’]\p{Lu}[\p{L}\p{M}]+|[\p{Lo}\p{M}]+)"
_PERSON = rf"(?<!\p{{L}})(?:{'|'.join(sorted((*_MALE, *_FEMALE), reverse=True))})\.? {_NAME}(?: {_NAME})?"
_ISSUER = r"^(4|5[0-8]|2[2-7]|3[4-8]|6[0245])"
PLAIN = "|".join((_PHONE, _IP, _CARD, _SECRET, _PERSON))
PATTERN = f"{_EMAIL}|{PLAIN}"

#: Letters of a script that stand for one another.
SCRIPTS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχω", "Armenian": "աբգդեզէթիլխկհմյնոպռսվտրքֆ",
    "Georgian": "აბგდევზთიკლმნოპრსტუფქღყშჩცძწჭხჯჰ", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Devanagari": "अआइउएकखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "Thai": "กขคงจชซดตถทนบปผพฟมยรลวสหอ", "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조호", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    "Han": "安白方高海和江金君乐李林明南宁平青仁山石水松天文武夏新星雅永玉云志中",
}
_SYLLABLES = {
    "Latin": "ba be bi bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne ra re ri ro sa se ta te vi vo".split(), "Cyrillic": "ба бе ви во га да де до за ка ки ла ле ли ло ма ме ми на не ра ре ри ро са се та те".split(),
    "Greek": "βα βε γα δα δε κα κε κο λα λε λι λο μα με μι μο να νε νι ρα ρε ρι ρο σα σε τα τε τι".split(),
}
_ENDS = {
    "Latin": {"m": ["n", "r", "s", "l", "o", "k"], "f": ["a", "ia", "na", "ra", "lia", "ma"]}, "Cyrillic": {"m": ["н", "р", "с", "л", "м", "к"], "f": ["а", "я", "на", "ра", "ла", "ма"]},
    "Greek": {"m": ["ος", "ης", "ας", "ων"], "f": ["α", "η", "ω", "ια"]},
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once and its expression written once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(digits: Column, odd: bool) -> Column:
    """Sum of the digits, every second one doubled, counted from the right; `odd`: the last one is doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == (0 if odd else 1), F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def kind_of(v: Column) -> Column:
    """The kind of a match; null if it is none after all."""
    octets = F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 255)
    card = let(_digits(v), lambda d: (F.length(d) >= 13) & (F.length(d) <= 19) & d.rlike(_ISSUER) & (_luhn(d, False) % 10 == 0))
    return (
        F.when(F.contains(v, F.lit("@")), "email").when(v.rlike(r"^[+(]"), F.when(F.length(_digits(v)).between(8, 15), "phone")).when(v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.when(octets, "ip"))
        .when(v.rlike(r"^[0-9 \-]+$") & ~v.rlike(r"^[0-9]{32,}$"), F.when(card, "card")).when(v.rlike(r"^(?:[0-9a-fA-F]{32,128}|AKIA.{16}|ghp_.{36})$"), "secret").otherwise("person")
    )


_TITLE = r"^(?:[^\s.]+)\.? "


def normal(kind: Column, v: Column) -> Column:
    """The normal form of a match that is no person."""
    hexa = v.rlike("^[0-9a-fA-F]+$")
    return F.when(kind == "phone", F.concat(F.regexp_extract(v, r"^\+?", 0), _digits(v))).when(kind == "card", _digits(v)).when((kind == "email") | ((kind == "secret") & hexa), F.lower(v)).otherwise(v)


def parts(kind: Column, v: Column) -> Column:
    """The entities of a match, as an array of (kind, norm): one, or a person's given name and surname."""
    part = lambda k, n: F.struct((k if isinstance(k, Column) else F.lit(k)).alias("kind"), n.alias("norm"))
    gender = F.when(v.rlike(rf"^(?:{'|'.join(_FEMALE)})\.? "), "f:").otherwise("m:")
    person = let(F.split(F.lower(F.regexp_replace(v, _TITLE, "")), " "), lambda names: F.when(F.size(names) > 1, F.array(part("given", F.concat(gender, F.get(names, F.lit(0)))), part("surname", F.element_at(names, -1)))).otherwise(F.array(part("surname", F.element_at(names, -1)))))
    return F.when(kind == "person", person).when(kind.isNotNull(), F.array(part(kind, normal(kind, v))))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    seed = F.concat(F.lit(key + "\x1f"), kind, F.lit("\x1f"), norm, F.lit("\x1f"), attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)])


def _byte(stream: Column, i: Column | int) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str | list[str], b: Column) -> Column:
    if isinstance(choices, str):
        return F.substring(F.lit(choices), b % len(choices) + 1, F.lit(1))
    return F.get(F.array(*[F.lit(c) for c in choices]), b % len(choices))


def _shaped(v: Column, stream: Column, hexa: bool = False) -> Column:
    """Each character replaced by one of its class: digit, letter of the same script and case; others kept."""

    def one(i: Column) -> Column:
        c, b = F.substring(v, i, F.lit(1)), _byte(stream, i)
        if hexa:
            return _pick("0123456789abcdef", b)
        letter = F.when(c.rlike(r"\p{IsLatin}"), _pick(SCRIPTS["Latin"], b))
        for script, letters in SCRIPTS.items():
            letter = letter.when(c.rlike(rf"\p{{Is{script}}}"), _pick(letters, b))
        letter = letter.otherwise(_pick(SCRIPTS["Latin"], b))
        return F.when(c.rlike("[0-9]"), _pick("0123456789", b)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), one), "")


def _name(name: Column, gender: Column, stream: Column, syllables: int, attempt: Column) -> Column:
    """A name in the script of `name`; with many attempts a longer one, as the short ones may be used up."""
    more = (attempt / 8).cast("int")

    def spoken(script: str) -> Column:
        body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(syllables) + more), lambda i: _pick(_SYLLABLES[script], _byte(stream, i))), "")
        return F.concat(body, F.when(gender == "f:", _pick(_ENDS[script]["f"], _byte(stream, 0))).otherwise(_pick(_ENDS[script]["m"], _byte(stream, 0))))

    letters = F.concat(name, F.repeat(F.substring(name, -1, 1), more))
    return F.when(name.rlike(r"\p{IsLatin}"), spoken("Latin")).when(name.rlike(r"\p{IsCyrillic}"), spoken("Cyrillic")).when(name.rlike(r"\p{IsGreek}"), spoken("Greek")).otherwise(_shaped(letters, stream))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate's normal form."""
    return let(_stream(key, kind, norm, attempt), lambda s: _drawn(key, kind, norm, attempt, s))


def _drawn(key: str, kind: Column, norm: Column, attempt: Column, s: Column) -> Column:
    n = F.length(norm)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    email = F.concat(_shaped(local, s), F.lit("@mail"), F.substring(F.sha2(F.concat(F.lit(key + "\x1fdomain\x1f"), domain), 256), 1, 8), F.lit(".example.org"))
    code = F.regexp_extract(norm, r"^(?:\+(?:[17]|\d\d))?", 0)  # one or two digits after a plus sign: the country code, or its first digits
    rest = F.substring(norm, F.length(code) + 1, n)
    drawn = F.concat(_pick("23456789", _byte(s, 0)), F.substring(_shaped(rest, s), F.lit(2), n))
    kept = (F.length(rest) == 10) & (F.substring(rest, 4, 3) == "555") & (attempt < 8)  # numbers set apart for fiction stay so
    phone = F.concat(code, F.when(kept, F.concat(F.substring(drawn, 1, 3), F.lit("555"), F.substring(drawn, 7, 4))).otherwise(drawn))
    issuer = F.regexp_extract(norm, _ISSUER, 1)
    body = F.concat(issuer, F.substring(_shaped(norm, s), F.length(issuer) + 1, n - 1 - F.length(issuer)))
    card = let(body, lambda b: F.concat(b, ((10 - _luhn(b, True) % 10) % 10).cast("string")))
    ip = F.concat_ws(".", (_byte(s, 0) % 15 + 240).cast("string"), _byte(s, 1).cast("string"), _byte(s, 2).cast("string"), (_byte(s, 3) % 254 + 1).cast("string"))
    lead = F.regexp_extract(norm, "^(AKIA|ghp_)", 1)
    secret = F.when(lead == "", _shaped(norm, s, hexa=True)).otherwise(F.concat(lead, _shaped(F.substring(norm, F.lit(5), n), s)))
    given = F.concat(F.substring(norm, 1, 2), _name(F.substring(norm, F.lit(3), n), F.substring(norm, 1, 2), s, 2, attempt))
    names = F.when(kind == "given", given).when(kind == "surname", _name(norm, F.lit("m:"), s, 4, attempt))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "secret", secret).otherwise(names)


def rendered(kind: Column, v: Column, canons: Column) -> Column:
    """The surrogates (normal forms, of a person one for each name) in the format of this occurrence."""
    canon, digits = F.get(canons, F.lit(0)), _digits(F.get(canons, F.lit(0)))
    at = lambda i: F.substring(digits, F.length(_digits(F.substring(v, F.lit(1), i))), F.lit(1))
    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.when(F.substring(v, i, F.lit(1)).rlike("[0-9]"), at(i)).otherwise(F.substring(v, i, F.lit(1)))), "")
    capitals = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    called, names = F.regexp_replace(v, _TITLE, ""), F.array_join(F.transform(canons, lambda c: F.initcap(F.regexp_replace(c, "^[mf]:", ""))), " ")
    person = F.concat(F.regexp_extract(v, _TITLE, 0), F.when(capitals(called), F.upper(names)).otherwise(names))
    return F.when(kind.isin("phone", "card"), spaced).when(kind == "person", person).when(capitals(v), F.upper(canon)).otherwise(canon)


def segments(text: Column) -> Column:
    """The text cut at its matches, which have the odd places. One run of the pattern; no e-mail is sought where there is no @."""
    marked = lambda pattern: F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array(F.lit("")))
    other = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found, lambda a, b: F.array(a, b)))
    other = F.slice(other, F.lit(1), F.size(other) - 1)
    return F.when(text.isNull(), None).when(F.contains(text, F.lit(MARK)), other).when(F.contains(text, F.lit("@")), marked(PATTERN)).otherwise(marked(PLAIN))


def _matches(cut: Column) -> Column:
    return F.filter(cut, lambda x, i: i % 2 == 1)


def entities(cut: DataFrame) -> DataFrame:
    """The distinct entities (kind, norm) of texts cut into segments, `__s`."""
    v = cut.select(F.explode(F.array_distinct(_matches(F.col("__s")))).alias("v")).select("v", kind_of(F.col("v")).alias("kind")).where("kind IS NOT NULL")
    return v.select(F.explode(parts(F.col("kind"), F.col("v"))).alias("e")).select("e.kind", "e.norm").distinct()


def assigned(known: DataFrame, key: str, kept: Written) -> DataFrame:
    """kind, norm, attempt, canon: surrogates without collisions."""
    known = kept.table(known)
    out = known.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ROUNDS):
        out = kept.table(out.select("kind", "norm", "attempt", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")).alias("canon")))
        # Of entities with one surrogate the one that was there before keeps it (most attempts), then the smallest.
        first = out.groupBy("kind", "canon").agg(F.min(F.struct((-F.col("attempt")).alias("a"), "norm")).alias("first"), F.count("*").alias("n"))
        real = known.select("kind", F.col("norm").alias("canon"), F.lit(True).alias("real"))
        clash = first.join(real, ["kind", "canon"], "left").where("n > 1 OR real").select("kind", "canon", "first.norm", F.coalesce("real", F.lit(False)).alias("real"))
        clash = kept.table(clash.withColumnRenamed("norm", "keeps"))
        if clash.isEmpty():
            return out
        again = F.col("keeps").isNotNull() & (F.col("real") | (F.col("norm") != F.col("keeps")))
        out = out.join(clash, ["kind", "canon"], "left").select("kind", "norm", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
    raise RuntimeError("too few surrogates for so many entities")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts_col: str = "pii", max_inline: int = MAX_INLINE) -> DataFrame:
    """`docs` with surrogates in `text_col`, and `counts_col`: a struct of the numbers of occurrences by kind. Whoever has `key` can test guesses;
    keep it as secret as the texts."""
    if not key:
        raise ValueError("surrogates need a secret key")
    kept = Written(docs.sparkSession, "pii")
    docs, back, (text_col,) = numbered(docs.drop(counts_col), text_col)
    columns = [c for c in docs.columns if c != text_col]
    cut = kept.table(docs.select(*columns, segments(F.col(text_col)).alias("__s"), F.monotonically_increasing_id().alias("__tag")))
    table = assigned(entities(cut), key, kept)
    odd = [r for r in table.where("attempt > 0").select(F.concat_ws(":", "kind", "norm"), "attempt").limit(max_inline + 1).collect()]
    if len(odd) <= max_inline:
        more = F.from_json(F.lit(json.dumps(dict(map(tuple, odd)))), "map<string,int>")
        attempt = lambda p: F.coalesce(more[F.concat_ws(":", p["kind"], p["norm"])], F.lit(0)) if odd else F.lit(0)
        canon = lambda p: let(attempt(p), lambda a: surrogate(key, p["kind"], p["norm"], a))
        shown = lambda k, v: let(F.transform(parts(k, v), canon), lambda c: rendered(k, v, c))
        put = lambda v: F.coalesce(let(kind_of(v), lambda k: F.when(k.isNotNull(), shown(k, v))), v)
        out = cut
    else:
        v = cut.select("__tag", F.explode(F.array_distinct(_matches(F.col("__s")))).alias("v")).select("__tag", "v", kind_of(F.col("v")).alias("k")).where("k IS NOT NULL")
        v = v.select("__tag", "v", "k", F.posexplode(parts(F.col("k"), F.col("v"))).alias("at", "e")).select("__tag", "v", "k", "at", "e.kind", "e.norm").join(table, ["kind", "norm"])
        v = v.groupBy("__tag", "v", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "canon"))), lambda x: x["canon"]).alias("c"))
        v = v.groupBy("__tag").agg(F.map_from_entries(F.collect_list(F.struct("v", rendered(F.col("k"), F.col("v"), F.col("c")).alias("s")))).alias("__new"))
        out = cut.join(v, "__tag", "left")
        put = lambda v: F.coalesce(F.col("__new")[v], v)
    new = F.array_join(F.transform(F.col("__s"), lambda x, i: F.when(i % 2 == 1, put(x)).otherwise(x)), "")
    kinds = F.transform(_matches(F.col("__s")), kind_of)
    number = lambda kinds, kind: F.size(F.filter(kinds, lambda x: x == kind))
    count = lambda kinds: F.struct(*[F.coalesce(number(kinds, k), F.lit(0)).alias(k) for k in KINDS])
    none = F.struct(*[F.lit(0).alias(k) for k in KINDS])
    return back(out.select(*columns, new.alias(text_col), F.when(F.size("__s") > 1, let(kinds, count)).otherwise(none).alias("__n")), F.col("__n").alias(counts_col))
