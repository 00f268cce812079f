"""Format-preserving pseudonyms for personal data in page texts, as column expressions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let

#: Session setting that names the key; it is kept nowhere else.
KEY_SETTING = "spark.shopaudit.pseudonymKey"
ROUNDS = 8
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

# Every alternative starts where its token starts and repeats possessively, so a long run without blanks is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])"
PASSWORD = r"(?<=password=)[A-Za-z0-9]++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .()/-]{1,2}[0-9]{2,8}){2,5}(?![0-9])"
CARD = r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
KINDS = [("email", EMAIL), ("access_key", ACCESS_KEY), ("token", TOKEN), ("password", PASSWORD), ("iban", IBAN), ("date", DATE),
         ("address", ADDRESS), ("social", SOCIAL), ("phone", PHONE), ("abroad", ABROAD), ("card", CARD)]
ANY = "|".join(pattern for _, pattern in KINDS)
#: 400 years of days from 1800-03-01, split as a product for the two halves of the network.
FIRST_DAY, DAYS = "1800-03-01", (27, 5411)


def _noise(key: str, turn: Column, tweak: str, other: Column) -> Column:
    """60 keyed bits of a half of the value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), other.cast("string")), 256), 1, 15),
                  16, 10).cast("long")


def feistel(left: Column, right: Column, a: int | Column, b: int | Column, key: str, tweak: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs in [0, a) x [0, b). Each round adds noise of one half to the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))

    def turn(state, i):
        odd = i % 2 == 1
        noise = _noise(key, i, tweak, F.when(odd, state["r"]).otherwise(state["l"]))
        return F.struct(F.when(odd, (state["l"] + noise % a) % a).otherwise(state["l"]).cast("long").alias("l"),
                        F.when(odd, state["r"]).otherwise((state["r"] + noise % b) % b).cast("long").alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of digits of the same length (at most 36)."""
    half = F.floor((F.char_length(digits) + 1) / 2).cast("int")
    rest = F.char_length(digits) - half

    def power(n):
        return F.pow(F.lit(10.0), n).cast("long")

    left, right = F.left(digits, half), F.right(digits, rest)
    done = feistel(left, F.when(rest > 0, right).otherwise("0"), power(half), power(rest), key, tweak)
    return let(done, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"),
                                        F.when(rest > 0, F.lpad(s["r"].cast("string"), rest, "0")).otherwise("")))


def permuted_signs(text: Column, alphabets: list[str], key: str, tweak: str) -> Column:
    """A string in which each sign stays within its alphabet and signs outside all of them stay as they are."""
    half = F.floor((F.char_length(text) + 1) / 2).cast("int")

    def moved(part, noise):
        def sign(c, i):
            step = F.pmod(F.xxhash64(noise, i), F.lit(1_000_003))
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                out = F.when((c != "") & (at > 0), F.substring(F.lit(letters), (at - 1 + step) % len(letters) + 1, F.lit(1))).otherwise(out)
            return out
        return F.array_join(F.transform(F.split(part, ""), sign), "")

    def turn(state, i):
        odd = i % 2 == 1
        noise = _noise(key, i, tweak, F.when(odd, state["r"]).otherwise(state["l"]))
        new = moved(F.when(odd, state["l"]).otherwise(state["r"]), noise)
        return F.struct(F.when(odd, new).otherwise(state["l"]).alias("l"), F.when(odd, state["r"]).otherwise(new).alias("r"))

    start = F.struct(F.left(text, half).alias("l"), F.substring(text, half + 1, F.char_length(text)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda s: F.concat(s["l"], s["r"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def in_place(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order, by ``digits``."""
    def put(state, c):
        digit = (c >= "0") & (c <= "9") & (c != "")
        return F.struct(F.concat(state["out"], F.when(digit, F.substring(digits, state["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (state["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put)["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is the check digit."""
    signs = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def value(c, i):
        doubled = c.cast("int") * (i % 2 + 1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.transform(signs, value), F.lit(0), lambda s, x: s + x)


def card(text: Column, key: str) -> Column:
    """The network's digit stays, the account digits are permuted, the check digit follows."""
    def hidden(digits):
        body = F.concat(F.left(digits, F.lit(1)), permuted_digits(F.substring(digits, F.lit(2), F.char_length(digits) - 2), key, "card"))
        return let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return let(digits_of(text), lambda d: F.when(luhn_sum(d) % 10 == 0, in_place(text, hidden(d))).otherwise(text))


def _remainder(text: Column) -> Column:
    """Remainder by 97 of letters (A is 10) and digits read as one number."""
    def step(r, c):
        letter = F.ascii(c) - 55
        return F.when(c == "", r).when(c >= "A", (r * 100 + letter) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban(text: Column, key: str) -> Column:
    """Digits of the account are permuted, letters and country stay, the check digits follow."""
    def hidden(flat):
        account = F.substring(flat, F.lit(5), F.char_length(flat))
        new = in_place(account, permuted_digits(digits_of(account), key, "iban"))
        country = F.left(flat, F.lit(2))
        return let(new, lambda x: F.concat(F.lpad((98 - _remainder(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), digits_of(x)))

    def checked(flat):
        whole = F.concat(F.substring(flat, F.lit(5), F.char_length(flat)), F.left(flat, F.lit(4)))
        return F.when(_remainder(whole) == 1, in_place(text, hidden(flat))).otherwise(text)

    return let(F.regexp_replace(text, " ", ""), checked)


def date(text: Column, key: str) -> Column:
    """A valid day between 1800-03-01 and 2200-02-28 becomes another one; its order and zeros are kept."""
    parts = [("yyyy-MM-dd", r"^....-..-..$"), ("dd.MM.yyyy", r"^..\...\."), ("d.M.yyyy", r"\."), ("dd/MM/yyyy", r"^../../"), ("d/M/yyyy", "/")]
    out = text
    for form, shape in reversed(parts):
        day = F.datediff(F.try_to_date(text, form), F.lit(FIRST_DAY).cast("date"))

        def hidden(d, form=form):
            moved = feistel(F.floor(d / DAYS[1]), d % DAYS[1], *DAYS, key, "date")
            return let(moved, lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")), form))

        new = let(day, lambda d: F.when((d >= 0) & (d < DAYS[0] * DAYS[1]), hidden(d)).otherwise(text))
        out = F.when(text.rlike(shape), new).otherwise(out)
    return out


def address(text: Column, key: str) -> Column:
    """An IPv4 address becomes another one."""
    def hidden(parts):
        value = [parts[i].cast("int") for i in range(4)]
        moved = feistel(value[0] * 256 + value[1], value[2] * 256 + value[3], 65536, 65536, key, "address")
        new = let(moved, lambda s: F.concat_ws(".", *[F.floor(s[c] / 256).cast("string") if n == 0 else (s[c] % 256).cast("string")
                                                       for c in ("l", "r") for n in (0, 1)]))
        return F.when((value[0] < 256) & (value[1] < 256) & (value[2] < 256) & (value[3] < 256), new).otherwise(text)

    return let(F.split(text, r"\."), hidden)


def social(text: Column, key: str) -> Column:
    """A US social security number with a possible area, group and serial becomes another such number."""
    def hidden(d):
        area, group, serial = F.left(d, F.lit(3)).cast("int"), F.substring(d, 4, 2).cast("int"), F.right(d, F.lit(4)).cast("int")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = F.when(area < 666, area - 1).otherwise(area - 2)
        moved = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "social")

        def digits(s):
            number = F.floor(s["l"] / 99)
            number = F.when(number < 665, number + 1).otherwise(number + 2)
            return F.concat(F.lpad(number.cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"),
                            F.lpad((s["r"] + 1).cast("string"), 4, "0"))
        return F.when(valid, in_place(text, let(moved, digits))).otherwise(text)

    return let(digits_of(text), hidden)


def phone(text: Column, key: str) -> Column:
    """A North American number becomes another one; area and exchange keep to 2-9."""
    def hidden(d):
        ten = F.right(d, F.lit(10))
        area, line = F.left(ten, F.lit(3)).cast("long") - 200, F.right(ten, F.lit(7)).cast("long") - 2_000_000
        moved = feistel(area, line, 800, 8_000_000, key, "phone")
        return in_place(text, let(moved, lambda s: F.concat(F.left(d, F.char_length(d) - 10), (s["l"] + 200).cast("string"),
                                                            (s["r"] + 2_000_000).cast("string"))))

    return let(digits_of(text), hidden)


def abroad(text: Column, key: str) -> Column:
    """An international number of 8 to 15 digits keeps its first two digits."""
    return let(digits_of(text), lambda d: F.when(F.char_length(d).between(8, 15), in_place(text, F.concat(
        F.left(d, F.lit(2)), permuted_digits(F.substring(d, F.lit(3), F.char_length(d)), key, "abroad")))).otherwise(text))


def email(text: Column, key: str) -> Column:
    """The name before the @ changes within its letters and digits; the domain stays."""
    name = F.substring_index(text, "@", 1)
    return F.concat(permuted_signs(name, [LOWER, UPPER, DIGITS], key, "email"), F.substring(text, F.char_length(name) + 1, F.char_length(text)))


def pseudonym(text: Column, key: str) -> Column:
    """The pseudonym of one value found by ANY; values that do not hold up stay as they are."""
    whole = {
        "email": email(text, key), "token": permuted_signs(text, [HEX], key, "token"),
        "access_key": F.concat(F.left(text, F.lit(4)), permuted_signs(F.substring(text, F.lit(5), F.char_length(text)), [UPPER + DIGITS], key, "key")),
        "password": permuted_signs(text, [LOWER, UPPER, DIGITS], key, "password"),
        "iban": iban(text, key), "date": date(text, key), "address": address(text, key), "social": social(text, key),
        "phone": phone(text, key), "abroad": abroad(text, key), "card": card(text, key)}
    shape = {"email": text.contains("@"), "access_key": text.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$"), "token": text.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"),
             "iban": text.rlike("^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), "address": text.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"),
             "date": text.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4})$"),
             "social": text.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
             "phone": text.rlike(r"^(\+1[ .-]?)?(\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$"), "abroad": text.startswith("+"),
             "card": text.rlike("^[0-9]([ -]?[0-9]){12,18}$")}
    out = None
    for kind, test in shape.items():
        out = F.when(test, whole[kind]) if out is None else out.when(test, whole[kind])
    return out.otherwise(whole["password"])


def hidden(text: Column, key: str) -> Column:
    """struct(text, n_found): a whole text with pseudonyms, and how many values were replaced."""
    def rebuilt(gaps, found):
        def joined(new):
            return F.struct(F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "").alias("text"),
                            F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x).alias("n_found"))
        return let(F.transform(found, lambda m: pseudonym(m, key)), joined)

    untouched = F.struct(text.alias("text"), F.lit(0).alias("n_found"))
    with_found = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda found: F.when(F.size(found) == 0, untouched).otherwise(
        rebuilt(F.split(text, ANY, -1), found)))
    # Most texts have neither a digit nor an @, and need no search.
    return F.when(text.rlike("[0-9@]|password="), with_found).otherwise(untouched)


def pseudonymised(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with the personal data in ``text`` replaced, and the column n_hidden with the number of values.

    Found are e-mail names, payment cards (Luhn), IBANs (remainder 97), phone numbers, IPv4 addresses, US social security
    numbers, dates, passwords, access keys and tokens. Each is permuted by a Feistel network of ROUNDS rounds over
    SHA-256 with ``key``, within the values its format allows: separators, lengths, check digits and valid days hold,
    different values stay different, and equal values get equal pseudonyms in every document. Values that fail their
    check stay as they are, as does all other text. Limits: domains of e-mail addresses stay; a phone number without any
    separator, and a day before 1800-03-01, are not seen as such.

    Whoever knows ``key`` can undo the pseudonyms; it has no default and belongs into a session setting, not into code.
    One narrow projection of built-in functions. All other columns stay, whatever their names; an existing n_hidden is
    replaced. A null text stays null with n_hidden 0; rows that repeat are treated alike; an empty table stays empty.
    """
    found = documents.select("*", F.inline(F.array(F.struct(hidden(F.col("text"), key).alias("_hidden")))))
    return found.withColumns({"text": F.col("_hidden.text"), "n_hidden": F.coalesce("_hidden.n_found", F.lit(0))}).drop("_hidden")
