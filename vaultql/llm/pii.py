"""PII surrogates: keyed, type-consistent replacements with collision checks. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

# Forms of address by gender, in the languages that the names are looked for in.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Srta", "г-жа", "госпожа"]
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"]
NEUTRAL = ["Dr", "Prof"]

_TITLE = f"(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\\.?"
#: Words in small letters that are part of a name.
_PARTICLE = "(?:de|da|di|del|della|der|den|van|von|zu|zum|la|le|du|dos|das|bin|ibn|al|el|ten|ter|y)"
#: A word of a name, without a genitive's ending; an initial; a word of a script without capitals.
_WORD = r"(?:\p{Lu}[\p{L}\p{M}]++(?:['’-](?!s(?!\p{L}))[\p{L}\p{M}]++){0,6}|\p{Lo}[\p{L}\p{M}]*+)"
_NAME = rf"(?:(?:{_PARTICLE} +){{0,3}}(?:\p{{Lu}}\.|{_WORD}) +){{0,8}}(?:{_PARTICLE} +){{0,3}}{_WORD}"
#: Words after which a long run of letters and digits is a secret.
_KEYED = r"(?i:key|token|secret|password|passwd|pwd)"
#: Patterns by type; where two begin at one place, the first one wins. Groups repeat a bounded number of times (a domain
#: has 127 labels at most), as Java's regular expressions recurse for each repeated group.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]{1,63}\.){1,127}\p{L}{2,}",
    "secret": _B + r"[0-9a-fA-F]{32,}" + _E,
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "card": _B + r"(?:\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})" + _E,
    "ssn": _B + r"\d{3}-\d{2}-\d{4}" + _E,
    "ip": r"(?<![\p{L}\p{N}.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|(?<![.,:/-])0\d{2,4}[ /-]\d{5,8})" + _E,
    "name": _B + _TITLE + " +" + _NAME,
    "token": r"(?<=[:=\"' ])(?=[\p{L}_+/-]{0,64}\d)(?=[\p{L}\p{N}_+/-]{16})(?<=" + _KEYED + r"[\"']?[ ]?[:=][ ]?[\"']?)[\p{L}\p{N}_+/-]{16,}",
}
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without this holds no entity; it is a quick test.
_MAY = r"[0-9@]|::|:[0-9a-fA-F]{1,4}:|" + _B + _TITLE + rf" +(?:[\p{{Lu}}\p{{Lo}}]|{_PARTICLE} )"
#: Where a text is cut into words and what stands between them.
_CUTS = r"(?<=[\p{L}'’-])(?![\p{L}'’-])|(?<![\p{L}'’-])(?=\p{L})"


def detected(c: Column) -> Column:
    """The entities of a text in order."""
    return F.when(c.rlike(_MAY), F.regexp_extract_all(c, F.lit(EVERY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _type(s: Column) -> Column:
    """What a detected entity is; what is none of the types by itself was found by the word before it."""
    kinds = reduce(lambda w, p: w.when(s.rlike(f"^(?:{p[1]})$"), p[0]), [p for p in PATTERNS.items() if p[0] != "token"], F)
    return kinds.otherwise("token")


def _canonical(kind: Column, s: Column) -> Column:
    """One form for all ways in which an entity is written."""
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", F.replace(s, F.lit(" "), F.lit(""))).when(kind == "token", s).otherwise(F.lower(s))


#: Scripts that a name's surrogate keeps, and the letters of its syllables: sixteen that begin one, sixteen that end it.
SCRIPTS = {
    "latin": ("bdfgklmnprstvwzj", "aeioaeiouaeioaei"), "cyrillic": ("бвгдзклмнпрстфхш", "аеиоаеиоуаеиоаеи"), "greek": ("βγδζκλμνπρστφχθξ", "αειοαειουαειοαει"),
    "hebrew": ("אבגדהוזחטיכלמנסע",) * 2, "arabic": ("ابتثجحدرزسشصعفقك",) * 2, "devanagari": ("कखगघचछजझटठडढतथदध", "ािीुूेैोौािीुूेै"), "han": ("王李张刘陈杨黄赵周吴徐孙马朱胡郭",) * 2,
    "hangul": ("가나다라마바사아자차카타파하거너",) * 2, "hiragana": ("あかさたなはまやらわいきしちにひ",) * 2, "katakana": ("アカサタナハマヤラワイキシチニヒ",) * 2,
}
#: How given names end by gender, in the scripts where that shows.
ENDINGS = {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "o", "cyrillic": "ий", "greek": "ος"}, "n": {"latin": "en", "cyrillic": "ен", "greek": "ι"}}


def _script(c: Column) -> Column:
    out = F.lit("latin")
    for name in SCRIPTS:
        if name != "latin":
            out = F.when(c.rlike(rf"\p{{Is{name.title()}}}"), name).otherwise(out)
    return out


def _words(name: Column) -> Column:
    """The words of a name behind its form of address, particles and initials among them."""
    return F.split(F.regexp_replace(name, f"^{_TITLE} +", ""), " +")


def _is_word(w: Column) -> Column:
    return ~w.rlike(rf"^(?:{_PARTICLE}|\p{{Lu}}\.)$")


def _parsed(rows: DataFrame) -> DataFrame:
    """rows(row, pos, surface, kind) with what tells their entities apart: c0, the canonical form or a name's family
    name; c1, a name's given name if there is one; script and gender of a name; words, those of a name.
    """
    s, is_name = F.col("surface"), F.col("kind") == "name"
    words = F.filter(_words(s), _is_word)
    bare = F.rtrim(F.replace(F.regexp_extract(s, "^" + _TITLE, 0), F.lit("."), F.lit("")))
    gender = F.when(bare.isin(*FEMALE), "f").when(bare.isin(*MALE), "m").otherwise("n")
    last = F.try_element_at(words, F.lit(-1))
    return rows.withColumns({
        "c0": F.when(is_name, F.lower(last)).otherwise(_canonical(F.col("kind"), s)), "script": F.when(is_name, _script(last)), "gender": F.when(is_name, gender),
        "c1": F.when(is_name & (F.size(words) > 1), F.lower(F.try_element_at(words, F.lit(1)))), "words": F.when(is_name, words),
    })


def _genders(entities: DataFrame) -> DataFrame:
    """(script, c1, c0, gender) for each person with a given name: what their own forms of address say, wherever they
    occur, or else what those of all people with the given name say; n if that leaves it open.
    """
    has = lambda g: F.max((F.col("gender") == g).cast("int"))
    people = written(entities.where("c1 IS NOT NULL").groupBy("script", "c1", "c0").agg(has("f").alias("f"), has("m").alias("m")), "people")
    given = people.groupBy("script", "c1").agg(F.max("f").alias("any_f"), F.max("m").alias("any_m"))
    one = F.when(F.expr("f > m"), "f").when(F.expr("m > f"), "m").when(F.expr("f + m = 0 AND any_f > any_m"), "f").when(F.expr("f + m = 0 AND any_m > any_f"), "m").otherwise("n")
    return people.join(given, ["script", "c1"]).select("script", "c1", "c0", one.alias("gender"))


def _parts(entities: DataFrame) -> DataFrame:
    """A row for each entity, and for each word of a name: the last is its family name (part 0), the first of several its
    given name (part 1), those between are further given names.
    """
    kind = F.col("kind")
    one = lambda part, k, c, w: F.struct(F.lit(part).cast("int").alias("part") if isinstance(part, int) else part.cast("int").alias("part"), k.alias("kind"), c.alias("canonical"), w.alias("word"))
    # a Cyrillic family name shows its gender itself
    ending = lambda w: F.when(_script(w) != "cyrillic", "").when(F.lower(w).rlike("[ая]$"), "f").otherwise("m")
    hyphen = lambda w: F.when(w.contains("-"), "-").otherwise("")
    shows = lambda w: _script(w).isin(*ENDINGS["n"])
    n = F.size("words")

    def of_name(w: Column, i: Column) -> Column:
        family = F.concat(F.lit("family_"), _script(w), ending(w), hyphen(w))
        given = F.concat(F.lit("given_"), _script(w), F.when(shows(w), F.when(i == 0, F.col("gender")).otherwise("n")).otherwise(""), hyphen(w))
        return one(F.when(i == n - 1, 0).otherwise(i + 1), F.when(i == n - 1, family).otherwise(given), F.lower(w), w)

    each = F.when(kind != "name", F.array(one(0, kind, F.col("c0"), F.lit(None).cast("string")))).otherwise(F.transform("words", of_name))
    return entities.select("row", "pos", "surface", F.explode(each).alias("e")).select("row", "pos", "surface", "e.part", "e.kind", "e.canonical", "e.word")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _syllables(h: Column, script: Column, n: Column) -> Column:
    starts, ends = (F.try_element_at(F.create_map(*[F.lit(x) for name, rows in SCRIPTS.items() for x in (name, rows[k])]), script) for k in (0, 1))
    one = lambda at, rows: F.call_function("translate", F.substring(h, at, F.lit(1)), F.lit("0123456789abcdef"), rows)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(one(2 * k + 1, starts), one(2 * k + 2, ends))), "")


def _name(kind: Column, h: Column, attempt: int) -> Column:
    """A name's surrogate; its kind is role_script, then what its ending shows and a hyphen, if any: given_greekf-."""
    parts = F.split(F.regexp_extract(kind, "^((?:family|given)_.*?)-?$", 1), "_")
    script = F.regexp_extract(F.get(parts, 1), "^(" + "|".join(SCRIPTS) + ")", 1)
    role, shows = F.get(parts, 0), F.substring(F.get(parts, 1), F.length(script) + 1, F.lit(1))
    own = {f"given{g}{script}": end for g, by in ENDINGS.items() for script, end in by.items()} | {"familyfcyrillic": "ова", "familymcyrillic": "ов"}
    end = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.concat(role, shows, script)), F.lit(""))
    # two characters of these say as much as six letters
    n = F.when(script.isin("han", "hangul", "hiragana", "katakana"), 1).when((role == "family") & (shows == ""), 3).otherwise(2) + attempt
    return F.concat(F.when(kind.endswith("-"), F.concat(_syllables(F.reverse(h), script, n), F.lit("-"))).otherwise(""), _syllables(h, script, n), end)


def hashed(kind: Column, canonical: Column, key: str, attempt: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, F.lit(str(attempt))), 512)


def surrogate(kind: Column, canonical: Column, h: Column, attempt: int) -> Column:
    """A canonical replacement that `h`, the column of `hashed`, decides. Kept are: type, length and shape, the
    last label of an address, a country code, an IBAN's country, whether a card number's check digit is right, and for
    names gender and script. Later attempts may be longer where a short form could run out.
    """
    digit, letter = F.translate(h, "abcdef", "012345"), F.translate(h, "0123456789abcdef", "abcdefghklmnprst")
    n = F.length(canonical)
    shaped = lambda c: F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(x.rlike(r"\p{N}"), F.substring(digit, i % 128 + 1, F.lit(1))).when(x.rlike(r"\p{L}"), F.substring(letter, i % 128 + 1, F.lit(1))).otherwise(x)), "")
    local, domain, last = F.regexp_extract(canonical, "^([^@]*)@", 1), F.regexp_extract(canonical, r"@(.*)\.[^.]*$", 1), F.regexp_extract(canonical, r"\.[^.]*$", 0)
    more = F.substring(letter, 100, F.lit(min(28, 2 * attempt)))
    email = F.concat(shaped(F.concat(local, F.lit("@"), domain)), last)
    email = F.concat(F.substring_index(email, "@", 1), more, F.lit("@"), F.substring_index(email, "@", -1))
    code = F.greatest(n - 10, F.lit(0))
    phone = F.concat(F.substring(canonical, F.lit(1), code), F.when(n > code, F.translate(F.substring(digit, 1, F.lit(1)), "01", "23")), F.substring(digit, F.lit(2), n - code - 1))
    body = F.concat(F.translate(F.substring(digit, 1, F.lit(1)), "0", "4"), F.substring(digit, F.lit(2), n - 2))
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = (check + 1 + F.substring(digit, 60, F.lit(1)).cast("int") % 9) % 10
    card = F.concat(body, F.when(_luhn(canonical) % 10 == 0, check).otherwise(wrong).cast("string"))
    octet = lambda k: F.conv(F.substring(h, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    ip = F.concat_ws(".", (octet(0) % 223 + 1).cast("string"), *[octet(k).cast("string") for k in (1, 2, 3)])
    iban = F.concat(F.substring(canonical, 1, F.lit(2)), F.substring(digit, 1, F.lit(2)), F.upper(shaped(F.substring(canonical, F.lit(5), n))))
    out = F.when(kind == "email", email).when(kind == "secret", F.substring(F.repeat(h, F.ceil(n / 128).cast("int")), F.lit(1), n)).when(kind == "iban", iban).when(kind == "card", card)
    out = out.when(kind == "ssn", F.substring(digit, 1, F.lit(9))).when(kind == "ip", ip).when(kind == "phone", phone)
    hexed = F.array_join(F.transform(F.split(canonical, ""), lambda x, i: F.when(x == ":", x).otherwise(F.substring(h, i % 128 + 1, F.lit(1)))), "")
    cased = F.array_join(F.transform(F.split(canonical, ""), lambda x, i: F.when(x.rlike(r"\p{N}"), F.substring(digit, i % 128 + 1, F.lit(1))).when(x.rlike(r"\p{Lu}"), F.upper(F.substring(letter, i % 128 + 1, F.lit(1)))).when(x.rlike(r"\p{L}"), F.substring(letter, i % 128 + 1, F.lit(1))).otherwise(x)), "")
    out = out.when(kind == "ip6", hexed).when(kind == "token", cased)
    return out.when(kind.rlike("^(family|given)_"), _name(kind, h, attempt))


def assigned(entities: DataFrame, key: str, attempts: int = 14) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical): no two share a surrogate, and none gets the
    canonical form of another entity, or its own.

    Each round offers those still without a surrogate a new one. It is theirs unless it is an entity itself or taken;
    of several with the same offer the smallest canonical form gets it. So the outcome follows from the key and the set
    of entities. A type too small for its entities raises an error rather than let two become one.
    """
    left, done = entities, []
    real = entities.select("kind", F.col("canonical").alias("surrogate"))
    for attempt in range(attempts):
        offers = left.withColumn("_h", hashed(F.col("kind"), F.col("canonical"), key, attempt))  # a column, as it is used for each character
        offers = offers.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("_h"), attempt)).drop("_h").join(real, ["kind", "surrogate"], "left_anti")
        if done:
            offers = offers.join(reduce(DataFrame.unionByName, done).select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        done.append(written(offers.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")), f"surrogates{attempt}"))
        left = written(left.join(done[-1].select("kind", "canonical"), ["kind", "canonical"], "left_anti"), f"without{attempt}")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise ValueError("a type has too few surrogates for its entities")


def _filled(surface: Column, chars: Column) -> Column:
    """surface with its letters and digits replaced in turn by those of `chars`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a["out"], F.substring(chars, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
    return F.aggregate(F.split(surface, ""), start, step)["out"]


def _word(new: Column, old: Column) -> Column:
    """A name's surrogate in capitals like the name, on each side of a hyphen."""
    capital = F.array_join(F.transform(F.split(new, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "-")
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).otherwise(capital)


def _renamed(gap: Column, names: Column, ordinary: Column) -> Column:
    """Text between entities with the words that are found names replaced, a genitive's ending kept. A name that is an
    ordinary word of the text too is replaced only beside another word of a name.
    """
    bare = lambda w: F.regexp_replace(w, "['’]s$", "")
    known = lambda w: F.try_element_at(names, bare(w))

    def one(parts: Column) -> Column:
        beside = lambda i: (F.get(parts, i + 1).rlike("^ +$") & known(F.get(parts, i + 2)).isNotNull()) | (F.get(parts, i - 1).rlike("^ +$") & known(F.get(parts, i - 2)).isNotNull())
        new = lambda w, i: F.when(~F.array_contains(ordinary, F.lower(bare(w))) | F.coalesce(beside(i), F.lit(False)), F.concat(known(w), F.regexp_extract(w, "['’]s$", 0)))
        return F.array_join(F.transform(parts, lambda w, i: F.when(w.rlike(r"^[\p{Lu}\p{Lo}]"), F.coalesce(new(w, i), w)).otherwise(w)), "")

    return F.transform(F.array(F.split(gap, _CUTS, -1)), one)[0]


def _shown(kind: Column, surface: Column, value: Column, names: Column, key: str) -> Column:
    """An entity's surrogate in the format of its surface; of a name each word, particles stay, and an initial becomes
    another letter, which the name decides.
    """
    case = lambda c: F.when((surface == F.upper(surface)) & (surface != F.lower(surface)), F.upper(c)).otherwise(c)
    title = F.regexp_extract(surface, f"^{_TITLE} +", 0)
    drawn = lambda w: F.concat(F.upper(F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("initial"), F.lower(w), value), 256), 1, 1), "0123456789abcdef", "abcdefghklmnprst")), F.lit("."))
    pieces = F.split(F.regexp_replace(surface, f"^{_TITLE} +", ""), "(?<= )(?=[^ ])|(?<=[^ ])(?= )")
    name = F.concat(title, F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(names, w), F.when(w.rlike(r"^\p{Lu}\.$"), drawn(w)), w)), ""))
    return F.when(kind.rlike("^(family|given)"), name).when(kind.isin("card", "ssn", "phone", "iban"), _filled(surface, value)).otherwise(case(value))


def replace_pii(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """docs with every detected entity of `text` replaced, and n_entities and n_distinct (different ones in the text).

    The same entity has the same surrogate in all documents, however it is written (case, spaces, separators); different
    entities have different ones (see `assigned`). Texts without entities, most of them, stay where they are; the others
    are written to the shared folder, their entities reduced to distinct ones before any further step, and the lists of
    surrogates meet their texts by row number. A frequent entity's join is one that Spark may split.

    Names are found by their form of address, with up to nine words, initials and particles among them. A person keeps one
    surrogate with and without it: the words of a name that was found are replaced wherever else they stand in that text
    (of two people who share a given name the one who comes first there counts), and gender comes from all of a person's
    forms of address (see `_genders`). A word that the text has in small letters too, as in "Will" and "will", is taken for
    a name only beside another word of one. Surrogates keep a name's script, hyphen and capitals, and genitive endings.

    Edge cases: null and empty texts stay as they are, with 0 entities. Repeated rows are treated each. Columns named
    n_entities or n_distinct give way. Not found: names that never have a form of address in their text, street
    addresses, dates of birth, secrets of fewer than 32 hexadecimal digits or after no telling word, phone numbers of
    other than the forms above. The check digits of IBANs are drawn like other digits.
    """
    kept = [c for c in docs.columns if c not in ("n_entities", "n_distinct")]
    found = F.coalesce(F.size(detected(F.col(text))), F.lit(0))
    rows = docs.select(*kept)
    zero = F.lit(0).cast("long")
    without = rows.where(~(F.coalesce(found, F.lit(0)) > 0)).withColumns({"n_entities": zero, "n_distinct": zero})
    hits = written(rows.where(found > 0).withColumn("_vq_row", F.monotonically_increasing_id()), "hits")

    each = hits.select(F.col("_vq_row").alias("row"), F.posexplode(detected(F.col(text))).alias("pos", "surface"))
    entities = written(_parsed(each.withColumn("kind", _type(F.col("surface")))), "entities")
    with_gender = entities.drop("gender").join(_genders(entities), ["script", "c1", "c0"], "left")
    parts = written(_parts(with_gender), "parts")
    table = assigned(written(parts.select("kind", "canonical").distinct(), "distinct"), key)
    named = parts.join(table, ["kind", "canonical"])
    capital = _word(F.col("surrogate"), F.col("word"))
    named = named.withColumn("new_word", F.when(F.col("word").isNotNull(), capital))
    first = lambda c: F.max(F.when(F.col("part") == 0, F.col(c)))
    pairs = F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "new_word")))
    spots = named.groupBy("row", "pos").agg(F.first("surface").alias("surface"), first("kind").alias("kind"), first("surrogate").alias("s0"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x["surrogate"]), "|").alias("all"), pairs.alias("words"))
    # a word that is both a given and a family name of one person has one surrogate there, the first of the two
    once = F.filter("words", lambda x, i: ~F.exists(F.slice("words", 1, i), lambda y: y["word"] == x["word"]))
    spots = spots.withColumn("names", F.map_from_entries(once))
    spots = written(spots.select("row", "pos", _shown(F.col("kind"), F.col("surface"), F.col("s0"), F.col("names"), key).alias("new"), F.concat_ws("|", "kind", "all").alias("who"), "words"), "spots")
    each_word = spots.where(F.size("words") > 0).select("row", "pos", F.explode("words").alias("w")).groupBy("row", "w.word").agg(F.min_by("w.new_word", "pos").alias("new"))
    renamed = each_word.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("_vq_names"))
    lists = spots.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_vq_new"), F.count_distinct("who").alias("n_distinct"))
    joined = hits.join(lists.join(renamed, "row", "left").withColumnRenamed("row", "_vq_at"), F.col("_vq_row") == F.col("_vq_at"))
    plain = F.split(text, EVERY, -1)
    # names of which the text has the word in small letters too
    small = F.filter(F.transform(F.map_keys("_vq_names"), lambda w: F.when(F.lower(w) != w, F.lower(w))), lambda w: w.isNotNull())
    ordinary = F.when(F.col("_vq_names").isNotNull(), F.array_intersect(small, F.split(text, r"[^\p{L}\p{M}]+")))
    # both lists are made once for a row, as variables of a function, and not anew for each word
    held = F.array(F.struct(plain.alias("gaps"), ordinary.alias("ordinary")))
    replaced = F.transform(held, lambda x: F.transform(x["gaps"], lambda g: _renamed(g, F.col("_vq_names"), x["ordinary"])))[0]
    joined = joined.withColumn("_vq_gaps", F.when(F.col("_vq_names").isNull(), plain).otherwise(replaced))
    gaps = F.col("_vq_gaps")
    rest = F.transform("_vq_new", lambda x, i: F.concat(x["new"], F.get(gaps, i + 1)))
    new = F.concat(F.get(gaps, 0), F.array_join(rest, ""))
    changed = joined.withColumns({text: new, "n_entities": F.size("_vq_new").cast("long")}).select(*kept, "n_entities", "n_distinct")
    return without.unionByName(changed)
