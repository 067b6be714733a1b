"""Personal data replaced by keyed surrogates of the same type, in DataFrame functions only.

Entities. One pattern finds e-mail addresses, prefixed keys and hexadecimal tokens, bank account
(IBAN), card, identity and phone numbers, IPv4 and IPv6 addresses, and titled names. Separators
inside a phone number may be the signs that junk text puts behind every word. An entity's canonical
form drops what is only format (case, separators).

Surrogates. A canonical form and a secret key give a candidate by SHA-256: letters become letters of
the same script, digits digits; a card keeps its first two digits and whether its check digit holds, an
account its country and a right check number, a phone its country code, a key its prefix; addresses
come from reserved ranges and domains, identity numbers from the range 900 to 999 that is never
issued. Given and family names are entities of their own, in the script (Latin, Greek, Cyrillic) of
the original: "Dr. Anna Smith", "Ms Anna Smith" and "Dr Smith" share one new family name, the first
two one new given name. A given name has the gender that titles show for it anywhere in the data,
none if they differ. A surface form gets its surrogates in its own format (title, case, separators), so mentions
of one entity stay mentions of one entity in all documents. Names may have particles, apostrophes, hyphens, several
blanks or capitals throughout. Once a titled name stands in a document, its given and family name are
entities there without a title too: "Dr. Anna Smith ... Anna Smith ... Smith's". A number with the code +1 and the same one without it are one.

Collision checks. If two entities have one candidate, or a candidate is itself an entity of the
data, the later one (by attempt, then form) tries again with the next attempt number, until all
surrogates are distinct. Names, mail addresses and hosts grow longer with the attempts, so their room
does not run out; numbers of a fixed format have only the room of their format, and an error is
raised if MAX_ATTEMPTS do not do.

Scale. Texts without an entity are never shuffled, and a cheap pattern spares most texts the full
one. Rows with entities are written once and used for both the mentions and the new texts. Entities
are made distinct before anything is joined, texts are keyed by their digest, so copies are worked on
once; hot surfaces and hot texts are joined by broadcast. The table of entities grows with the data.

Defined cases. Null text: stays null, no entity. Empty text: unchanged. Null ids and repeated rows:
each row is replaced for itself. Empty table: no rows. Extra columns are kept; one with the name of
the count is replaced. Not found: names that stand in a document without any title, postal addresses,
dates of birth, and numbers in no known grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgraph.llm.common import columns_of, own, reliable, spread_join, without

KEY = "an example key; give your own"
MAX_ATTEMPTS = 32
_GAP = "[\\s#*$%&|!<>]{0,6}"
#: Titles by gender.
TITLES = {"f": "Mrs|MRS|Ms|MS|Miss|MISS|Frau|Madame|Mme|Señora|Sra|Κυρία|Госпожа", "m": "Mr|MR|Herr|Monsieur|Señor|Sr|Κύριος|Господин", "n": "Dr|DR|Prof|PROF|Professor|Doctor|Rev|Reverend|President|Senator"}
#: Particles of family names, and words that follow a title in small letters but are no name.
PARTICLES = "de|da|di|del|della|van|von|der|den|la|le|dos|du|af|zu|al|bin|ibn|ter|ten"
NO_NAMES = "and|or|the|who|is|was|has|had|have|did|does|do|will|would|can|could|should|may|not|in|on|at|of|to|for|with|from|are|were|be|said|that|this|as|but|so|und|oder|et|ou|y|e"
#: Common given names by script and gender, and syllables of made-up names.
NAMES = {
    "latin": {"f": "Ada Berta Clara Dora Emma Flora Greta Hanna Irma Julia Lena Maria", "m": "Adam Bruno Carl David Emil Felix Georg Hugo Igor Jonas Karl Leo", "n": "Alex Chris Dana Jean Kim Lou Noel Robin Sam Sasha Toni Uli"},
    "greek": {"f": "Άννα Ελένη Ειρήνη Ζωή Θάλεια Ιωάννα Κλειώ Λυδία Νίκη Ρέα Σοφία Φωτεινή", "m": "Άρης Βασίλης Γιάννης Δήμος Ηλίας Θάνος Κώστας Λουκάς Μάρκος Νίκος Πέτρος Τάσος", "n": "Αλκη Βαλ Γκι Ζω Λε Μελ Νικ Ρι Σαμ Τζο Φι Χαρ"},
    "cyrillic": {"f": "Алла Вера Галина Дарья Елена Зоя Инна Лидия Нина Ольга Рита Софья", "m": "Борис Виктор Глеб Денис Егор Захар Игорь Лев Марк Олег Павел Роман", "n": "Женя Саша Валя Паша Слава Шура Тоня Миша Лёша Стася Кира Гена"},
}
SYLLABLES = {"latin": "ba de fi go ku la me ni po ru sa te vi wo za bor den fal gun hol kas lin mor nes", "greek": "βα δε φι γο κου λα με νι πο ρου σα τε βι ζα κορ δεν φαλ γον χολ κας λιν μορ νες θα", "cyrillic": "ба де фи го ку ла ме ни по ру са те ви жо за бор ден фал гун хол кас лин мор нес"}
ENDINGS = {"latin": {"f": "a", "m": "o", "n": "i"}, "greek": {"f": "α", "m": "ος", "n": "ι"}, "cyrillic": {"f": "а", "m": "ан", "n": "и"}}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя"}
_SMALL = "mrs|mr|dr"
_TITLE = f"(?:{'|'.join(TITLES.values())}|{_SMALL})"
_BLANK = "[ \\t\\u00A0]+"
_WORD = "(?:(?:\\p{Lu}['’])?\\p{Lu}\\p{Ll}+(?:[-'’]\\p{Lu}\\p{Ll}+)*|(?:\\p{Lu}['’])?\\p{Lu}{2,}(?:[-'’]\\p{Lu}{2,})*)(?!\\p{L})"
_NAME = f"(?:(?:{PARTICLES}){_BLANK}){{0,3}}{_WORD}"
#: Marks a given name that stands alone, without a title.
_GIVEN = "\x01"
_PREFIX = "(?:sk-|AKIA|gh[pousr]_|xox[abprs]-|AIza)"
_HEX4 = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": "[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+",
    "key": "(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*[0-9])(?:sk-[0-9A-Za-z_-]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])",
    "token": "(?<![0-9A-Za-z])(?=[A-Fa-f]{0,26}[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": "(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|4[0-9]{12}|[456][0-9]{16,18})(?![0-9])",
    "id": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv6": f"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![0-9A-Za-z:])",
    "ip": "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?!\\.?[0-9])",
    "phone": f"\\+[0-9]{{1,3}}{_GAP}\\(?[0-9]{{3}}\\)?{_GAP}[ .-]?[0-9]{{3}}{_GAP}[ .-]?[0-9]{{4}}(?![0-9])"
    "|\\+[1-9][0-9]{0,2}[ -]?\\(?[0-9]{1,4}\\)?(?:[ -]?[0-9]{2,4}){1,3}(?![0-9])|\\+[1-9][0-9]{0,2}(?:\\.[0-9]{2,4}){2,4}(?![0-9])"
    "|(?<![0-9A-Za-z-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?<![0-9-])[0-9]{3}-[0-9]{4}(?![0-9-])",
    "name": f"(?<!\\p{{L}})(?:{_TITLE}\\.?{_BLANK}{_NAME}(?:{_BLANK}{_NAME})?|(?:{_SMALL})\\.?{_BLANK}(?!(?:{NO_NAMES})(?!\\p{{L}}))\\p{{Ll}}{{3,}}(?!\\p{{L}}))",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No entity is without a digit, an @ or a title; most places of a text fail at their first sign.
HINT = f"[0-9@]|(?=[{''.join(sorted({t[0] for t in '|'.join([*TITLES.values(), _SMALL]).split('|')}))}]){_TITLE}[. \\t\\u00A0]"


def entities(text: Column) -> Column:
    """The surface forms in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(surface: Column) -> Column:
    return reduce(lambda rest, k: F.when(surface.rlike("^(?:" + PATTERNS[k] + ")$"), k).otherwise(rest), reversed(PATTERNS), F.lit("name"))


def _gender(surface: Column) -> Column:
    return F.when(surface.rlike(f"^(?:{TITLES['f']})(?!\\p{{L}})"), "f").when(surface.rlike(f"^(?:{TITLES['m']})(?!\\p{{L}})"), "m").otherwise("n")


def _title(surface: Column) -> Column:
    return F.regexp_extract(surface, f"^{_TITLE}\\.?{_BLANK}", 0)


def name_words(surface: Column) -> Column:
    """The words of a name as they stand, without title and particles; the last is the family name."""
    return F.filter(F.split(F.substr(surface, F.length(_title(surface)) + 1), _BLANK), lambda w: (w != "") & ~w.rlike(f"^(?:{PARTICLES})$"))


def later_mentions(found: Column) -> Column:
    """A pattern of the names that a text's titled entities give it, for where they stand without a title; null if there are none.

    Names in capitals or with a capital; alone or two in a row, as whole words, also before an apostrophe and s.
    """
    titled = F.filter(found, lambda s: s.rlike(f"^{_TITLE}\\.?{_BLANK}"))
    names = F.array_distinct(F.filter(F.flatten(F.transform(titled, name_words)), lambda w: w.rlike("^\\p{Lu}.")))
    one = F.concat(F.lit("(?:"), F.array_join(F.transform(names, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|"), F.lit(")"))
    edge = "(?!\\p{L}|[-'’](?!s(?!\\p{L}))\\p{L})"
    return F.when(F.size(names) > 0, F.concat(F.lit("(?<!\\p{L}|\\p{L}[-'’])"), one, F.lit(f"{edge}(?:{_BLANK}"), one, F.lit(f"{edge})?")))


def roles_marked(found: Column, first: Column) -> Column:
    """found with a mark at given names that stand alone; first is what the titled names were found by."""
    words = F.transform(F.filter(first, lambda s: s.rlike(f"^{_TITLE}\\.?{_BLANK}")), name_words)
    families, givens = F.transform(words, lambda w: F.element_at(w, -1)), F.flatten(F.transform(words, lambda w: F.slice(w, 1, F.size(w) - 1)))
    return F.transform(found, lambda s: F.when(F.array_contains(givens, s) & ~F.array_contains(families, s), F.concat(F.lit(_GIVEN), s)).otherwise(s))


def parts(kind: Column, surface: Column) -> Column:
    """(kind, form, gender) of what a surface form is made of: a name of its words, all else of itself."""
    digits = F.regexp_replace(surface, "[^0-9]", "")
    form = (
        F.when(kind.isin("email", "token", "ipv6"), F.lower(surface))
        .when(kind.isin("card", "id"), digits)
        .when((kind == "phone") & surface.startswith("+1") & (F.length(digits) == 11), F.substr(digits, F.lit(2)))  # the same as without its country's code
        .when(kind == "phone", F.concat(F.when(surface.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
        .otherwise(surface)
    )
    one = lambda k, f, g: F.struct(k.alias("kind"), f.alias("form"), g.alias("gender"))
    alone = surface.startswith(_GIVEN)
    words = F.when(alone, F.array(F.substr(surface, F.lit(2)))).otherwise(name_words(surface))
    named = F.transform(words, lambda w, i: one(F.when((i == F.size(words) - 1) & ~alone, "family").otherwise("given"), F.lower(w), _gender(surface)))
    return F.when(kind == "name", named).otherwise(F.array(one(kind, form, F.lit("n"))))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def _number(hexes: Column, at, below: int) -> Column:
    """A number below a bound from 7 hex digits of a hash."""
    return F.conv(F.substr(hexes, F.lit(at), F.lit(7)), 16, 10).cast("long") % below


def _digits(seed: Column) -> Column:
    """64 decimal digits of a hash."""
    return F.translate(seed, "abcdef", "012345")


def _letters(text: Column, seed: Column) -> Column:
    """Each letter replaced by one of its script and case, each digit by a digit; other signs stay."""

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substr(_hash(seed, i.cast("string")), F.lit(1), F.lit(7)), 16, 10).cast("long")
        pick = lambda letters: F.substr(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))
        new = F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("\\p{IsGreek}"), pick(ALPHABETS["greek"])).when(c.rlike("\\p{IsCyrillic}"), pick(ALPHABETS["cyrillic"])).when(c.rlike("\\p{L}"), pick(ALPHABETS["latin"])).otherwise(c)
        return F.when(c != F.lower(c), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_digit(first: Column) -> Column:
    """The digit that makes a number pass the check; first is all its digits but the last."""
    doubled = F.transform(F.reverse(F.split(first, "")), lambda d, i: F.when(i % 2 == 0, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return ((10 - total % 10) % 10).cast("string")


def _check_number(country: Column, body: Column) -> Column:
    """The two check digits of an account number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda a, c: step(a, c).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _by_script(form: Column, of) -> Column:
    return F.when(form.rlike("\\p{IsGreek}"), of("greek")).when(form.rlike("\\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _syllables(script: str, seed: Column, n: Column) -> Column:
    """A made-up word of n syllables."""
    own_ = SYLLABLES[script].split()
    pick = lambda i: F.element_at(F.array(*[F.lit(s) for s in own_]), (F.conv(F.substr(_hash(seed, i.cast("string")), F.lit(1), F.lit(7)), 16, 10).cast("long") % len(own_) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), pick), "")


def _given(form: Column, gender: Column, seed: Column, attempt: Column) -> Column:
    """A common name at first, then made-up ones that grow; their endings show the gender."""

    def of(script: str) -> Column:
        def ours(g: str) -> Column:
            common = F.element_at(F.array(*[F.lit(n.lower()) for n in NAMES[script][g].split()]), (_number(seed, 1, len(NAMES[script][g].split())) + 1).cast("int"))
            return F.when(attempt == 0, common).otherwise(F.concat(_syllables(script, seed, (2 + attempt / 4).cast("int")), F.lit(ENDINGS[script][g])))

        return F.when(gender == "f", ours("f")).when(gender == "m", ours("m")).otherwise(ours("n"))

    return _by_script(form, of)


def candidate(kind: Column, form: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form at an attempt, itself in canonical form."""
    seed = _hash(F.lit(key), kind, form, attempt.cast("string"))
    longer = F.substr(_letters(F.lit("x" * (MAX_ATTEMPTS // 8)), _hash(seed)), F.lit(1), (attempt / 8).cast("int"))  # empty at first
    host = F.substr(F.translate(seed, "0123456789", "ghijklmnop"), F.lit(1), (7 + attempt / 8).cast("int"))
    email = F.concat(_letters(F.substring_index(form, "@", 1), seed), longer, F.lit("@d"), host, F.lit(".example"))
    token = F.substr(F.concat(seed, _hash(seed)), F.lit(1), F.length(form))
    prefix = F.regexp_extract(form, "^" + _PREFIX, 0)
    secret = F.concat(prefix, _letters(F.substr(form, F.length(prefix) + 1), seed))
    country = F.substr(form, F.lit(1), F.lit(2))
    account = F.upper(_letters(F.substr(form, F.lit(5)), seed))
    iban = F.concat(country, _check_number(country, account), account)
    body = F.concat(F.substr(form, F.lit(1), F.lit(2)), F.substr(_digits(seed), F.lit(1), F.length(form) - 3))
    check, had = _check_digit(body), F.substr(form, F.length(form), F.lit(1)) == _check_digit(F.substr(form, F.lit(1), F.length(form) - 1))
    last = F.when(had, check).otherwise(((check.cast("int") + 1 + _number(seed, 57, 9)) % 10).cast("string"))
    identity = F.concat(F.lit("9"), F.substr(_digits(seed), F.lit(1), F.length(form) - 1))
    ip = F.concat_ws(".", (240 + _number(seed, 1, 15)).cast("string"), *[_number(seed, 8 * i, 256).cast("string") for i in (1, 2, 3)])
    ipv6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substr(seed, F.lit(4 * i + 1), F.lit(4))) for i in range(6)])
    code = F.regexp_extract(form, "^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})", 0)  # fixed values: country codes
    phone = F.concat(code, F.substr(_digits(seed), F.lit(1), F.length(form) - F.length(code)))
    family = _by_script(form, lambda s: F.concat(_syllables(s, seed, (4 + attempt / 8).cast("int")), F.when(F.contains(form, F.lit("-")), F.concat(F.lit("-"), _syllables(s, _hash(seed), F.lit(2)))).otherwise("")))
    values = {"email": email, "key": secret, "token": token, "iban": iban, "card": F.concat(body, last), "id": identity, "ipv6": ipv6, "ip": ip, "phone": phone, "given": _given(form, gender, seed, attempt)}
    return reduce(lambda rest, k: F.when(kind == k, values[k]).otherwise(rest), reversed(values), family)


def in_format(kind: Column, surface: Column, news: Column) -> Column:
    """Canonical surrogates (of the parts, in order) in the format of a surface form."""
    new = F.get(news, F.lit(0))
    plain, had = F.regexp_replace(new, "[^0-9]", ""), F.regexp_replace(surface, "[^0-9]", "")
    signs = F.when(kind == "iban", new).when(kind == "phone", F.concat(F.substr(had, F.lit(1), F.length(had) - F.length(plain)), plain)).otherwise(plain)
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    walked = F.aggregate(
        F.split(surface, ""), zero,
        lambda s, c: F.when(c.rlike("[0-9]") | ((kind == "iban") & c.rlike("[A-Z]")), F.struct(F.concat(s["out"], F.substr(signs, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
    )["out"]
    cased = F.when(F.upper(surface) == surface, F.upper(new)).otherwise(new)
    rest = F.regexp_replace(F.substr(surface, F.length(_title(surface)) + 1), f"^{_GIVEN}", "")
    dressed = lambda w, n: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(n)).when(F.lower(w) == w, n).otherwise(F.array_join(F.transform(F.split(n, "-"), lambda x: F.initcap(x)), "-"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    kept = lambda w: w.rlike(f"^(?:{_BLANK}|{PARTICLES})$")
    named = F.aggregate(
        F.regexp_extract_all(rest, F.lit(f"{_BLANK}|[^ \\t\\u00A0]+"), F.lit(0)), begin,
        lambda s, w: F.struct(F.concat(s["out"], F.when(kept(w), w).otherwise(dressed(w, F.get(news, s["i"])))).alias("out"), (s["i"] + F.when(kept(w), 0).otherwise(1)).alias("i")),
    )["out"]
    return F.when(kind.isin("email", "token", "ipv6"), cased).when(kind.isin("ip", "key"), new).when(kind == "name", F.concat(_title(surface), named)).otherwise(walked)


def distinct_surrogates(forms: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, form, new) with pairwise distinct surrogates, none of which is a form itself; forms has kind, form and gender."""
    gender = F.min(F.when(F.col("gender") != "n", F.col("gender")))
    single = F.when(gender == F.max(F.when(F.col("gender") != "n", F.col("gender"))), gender).otherwise("n")
    forms = reliable(forms.groupBy("kind", "form").agg(F.coalesce(single, F.lit("n")).alias("gender")))
    now = forms.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        tried = reliable(now.withColumn("new", candidate(F.col("kind"), F.col("form"), F.col("gender"), F.col("attempt"), key)))
        first = tried.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "form")).alias("stays")).where("n > 1")
        twice = tried.join(first, ["kind", "new"]).where(F.struct("attempt", "form") != F.col("stays")).select("kind", "form")
        real = tried.join(forms.select("kind", F.col("form").alias("new")), ["kind", "new"], "left_semi").select("kind", "form")
        again = reliable(twice.unionByName(real).distinct())
        if again.isEmpty():
            return tried.select("kind", "form", "new")
        now = tried.drop("new").join(again.withColumn("_again", F.lit(1)), ["kind", "form"], "left").select("kind", "form", "gender", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt"))
    raise ValueError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def renamed(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(surface, n, new) of each distinct surface of mentions; n is its number of mentions."""
    surfaces = reliable(mentions.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind_of(F.col("surface"))))
    split = reliable(surfaces.select("surface", "n", F.col("kind").alias("_kind"), F.posexplode(parts(F.col("kind"), F.col("surface"))).alias("at", "part")).select("surface", "n", "_kind", "at", "part.*"))
    news = split.join(distinct_surrogates(split.select("kind", "form", "gender"), key), ["kind", "form"])
    whole = news.groupBy("surface", "n", "_kind").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news"))  # two parts at most
    return whole.select("surface", "n", in_format(F.col("_kind"), F.col("surface"), F.transform("news", lambda p: p["new"])).alias("new"))


def replace(docs: DataFrame, key: str = KEY, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with each entity of its text replaced, and (count) the number of replacements."""
    columns_of(docs, text)
    docs = without(docs, count)
    names = docs.columns
    found, digest, names_of = own(docs, "_entities"), own(docs, "_digest"), own(docs, "_names")
    hint = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    marked = docs.withColumn(found, F.when(hint, entities(F.col(text))).otherwise(F.array().cast("array<string>")))
    columns = [F.col(f"`{c}`") for c in names]
    plain = marked.where(F.size(found) == 0).select(*columns, F.lit(0).cast("long").alias(count))
    some = marked.where(F.size(found) > 0).withColumn(digest, F.sha2(F.col(text).cast("binary"), 256)).withColumn(names_of, later_mentions(F.col(found)))
    pattern = F.coalesce(F.concat(F.lit(ANY + "|"), F.col(names_of)), F.lit(ANY))
    # a text with titled names is searched again for the same names without a title
    whole = F.when(F.col(names_of).isNotNull(), roles_marked(F.regexp_extract_all(F.col(text), pattern, F.lit(0)), F.col(found))).otherwise(F.col(found))
    holding = reliable(some.withColumn(found, whole))

    texts = reliable(holding.groupBy(digest).agg(F.first(found).alias("found"), F.count(F.lit(1)).alias("copies")))
    mentions = texts.select(F.col(digest).alias("digest"), "copies", F.posexplode("found").alias("at", "surface"))
    placed = spread_join(mentions, reliable(renamed(mentions, key)), "surface", "n").groupBy("digest", "copies").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news"))
    placed = reliable(placed.select(F.col("digest").alias(digest), F.col("copies").alias("_copies"), F.transform("news", lambda n: n["new"]).alias("_news")))
    rows = holding.select(digest, F.struct(*columns).alias("_row"), pattern.alias("_pattern"))
    joined = spread_join(rows, placed, digest, "_copies")
    between = F.split(F.col(f"_row.`{text}`"), F.col("_pattern"), -1)
    new_text = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_news"), i), F.lit("")))), "")
    replaced = joined.select(*[new_text.alias(c) if c == text else F.col(f"_row.`{c}`") for c in names], F.size("_news").cast("long").alias(count))
    return plain.unionByName(replaced)


def op5_pii_surrogates(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return replace(docs.select("doc_id", "text"))
