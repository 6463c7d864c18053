"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates of every kind at every place, overlapping ones
too, so one that fails its check hides no value inside it; a check decides whether a candidate
really is one (Luhn, mod 97, octets, calendar, number ranges), and a keyed
Feistel network permutes the value within its own format: a card number becomes
another valid card number with the same separators, a date another date in the
same notation, an address another address of the same shape. The permutation
depends on the key, the kind and the value alone, so equal values get equal
pseudonyms in every document, and different ones different pseudonyms, without
any table of values and without a shuffle.

Two networks do the work. Numbers split into a pair (A below a, B below b) are
permuted by adding a keyed hash of one half to the other, modulo its range.
Strings are split into halves of characters; each character of one half is
shifted within its own alphabet (digits, lower case, upper case, hex digits) by
a keyed hash of the other half. Both are bijections of the format.

Fixed choices: dates lie in the 400 years from 1700 (146,097 days = 189 x 773);
an IBAN keeps its country; a phone number keeps a country code that is set
apart; a social security number keeps to areas 1-899 without 666, groups 1-99
and serials 1-9999.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = "lakeward-pseudonyms"
ROUNDS = 8

_FIRST_DAY, _DAYS_A, _DAYS_B = "1700-01-01", 189, 773
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"

#: Countries of account numbers by length.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FO|FI|FK|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN_KNOWN = "|".join(
    rf"(?:{countries})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(length - 4) // 4}}}"
    + (rf" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else "")
    + "(?![A-Za-z0-9])"
    for length, countries in _IBAN_LENGTHS.items()
)
_LOCAL = r"(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:(?:1[.-])?\d{3}[.-])?\d{3}[.-]\d{4}(?![\d-])"

#: Kinds in the order in which the pattern tries them. Every alternative starts
#: at a border, so a long run of characters is entered once; every repeated group
#: is bounded, as Java's matcher recurses for each repetition.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,20}",
    "iban": "",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|:))(?![0-9A-Za-z:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}(?: \d{4} \d{4} |-\d{4}-\d{4}-)\d{4}|\d{4}(?: \d{6} |-\d{6}-)\d{5}|\d{13,19})(?!\d)",
    "phone": "",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{2}(?:\.\d{2}\.|/\d{2}/)\d{4}(?!\d)",
}
#: What a value that goes on across spaces must not run into.
_NEXT = "|".join(
    f"(?:{p})" + r"(?![ -]\d{4}(?!\d))" * (kind == "card")  # else the groups of four may be out of step
    for kind, p in (*PATTERNS.items(), ("phone", _LOCAL))
    if p
)
_IBAN_GROUP = rf"(?:(?! (?:{_NEXT})) ?[A-Z0-9]{{4}})"
PATTERNS["iban"] = (
    rf"(?<![A-Za-z0-9])(?:{_IBAN_KNOWN}|[A-Z]{{2}}\d{{2}}{_IBAN_GROUP}{{2,7}}"
    rf"(?:(?! (?:{_NEXT})) ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))"
)


def _international(group: str) -> str:
    """A number of 7 to 15 digits in all, counted back from its end to the plus sign."""
    start = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}"
    lengths = "|".join(r"\+" + r"[ ().-]{0,3}\d" * n for n in range(7, 16))  # Java repeats no group in a lookbehind
    return start + group + rf"{{1,4}}(?!\d)(?<={lengths})"


#: Country code 1 has 10 digits after it. Short of 7 digits a phone number goes on into what looks like another value.
_NORTH_AMERICA = r"(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
PATTERNS["phone"] = "|".join(
    [_NORTH_AMERICA, _international(rf"(?:(?![ .-](?:{_NEXT}))[ .-]?\d{{2,4}})"), _international(r"(?:[ .-]?\d{2,4})"), _LOCAL]
)
KINDS = list(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Where any kind can begin: after a letter or digit none but with a digit, a plus sign or a bracket.
_BORDER = "(?:(?<![A-Za-z0-9])|(?=[0-9+(]))"
_START = f"{_BORDER}(?={_ANY})"  # in front of a candidate; candidates can overlap
_FOUND = "__lakeward_found"
_GATE = "[0-9@]|[A-Fa-f]{32}|[A-Fa-f]:[A-Fa-f]"  # no value of any kind is without one of these
_CHUNK = 128  # hex digits of a secret that are permuted together
_BLOCK = 256  # candidates whose pieces of text are joined at once


def _hash_hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _hash_number(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(_hash_hex(key, *parts), 1, 14), 16, 10).cast("long")


def _permute_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Struct ``l, r`` of the permuted pair, ``l`` below ``a`` and ``r`` below ``b``."""

    def turn(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]
        new_l = F.pmod(l + _hash_number(key, F.lit(kind), i.cast("string"), r.cast("string")), F.lit(a).cast("long"))
        new_r = F.pmod(r + _hash_number(key, F.lit(kind), i.cast("string"), l.cast("string")), F.lit(b).cast("long"))
        even = i % 2 == 0
        return F.struct(
            F.when(even, new_l).otherwise(l).alias("l"), F.when(even, r).otherwise(new_r).alias("r")
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shift(char: Column, by: Column, alphabets: list[str]) -> Column:
    """The character moved within the alphabet that holds it; others stay."""
    out = char
    for letters in alphabets:
        at = F.instr(F.lit(letters), char)
        moved = F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def _permute_text(value: Column, alphabets: list[str], key: str, kind: str | Column) -> Column:
    """The string with every character of an alphabet permuted within it, the shape kept.

    Half a string of over 64 characters reuses the hash bytes of its other
    half, which keeps the network a bijection.
    """

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def moved(noise: Column) -> Column:
            return F.array_join(
                F.transform(
                    F.split(half, ""),
                    lambda c, at: _shift(
                        c, F.conv(F.substring(noise, (at % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int"), alphabets
                    ),
                ),
                "",
            )

        # An array of one hash: within the inner function it would be made again for every character.
        return F.transform(F.array(_hash_hex(key, tag, i.cast("string"), other)), moved)[0]

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, shifted(state["l"], state["r"], i)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(shifted(state["r"], state["l"], i)).alias("r"),
        )

    tag = F.lit(kind) if isinstance(kind, str) else kind
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r")
    )
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(done["l"], done["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _put_back(digits: Column, shape: Column) -> Column:
    """The digits in the places of the digits of ``shape``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("n"))

    def step(state: Column, char: Column) -> Column:
        is_digit = F.instr(F.lit(_DIGITS), char) > 0
        return F.struct(
            F.concat(state["s"], F.when(is_digit, F.substring(digits, state["n"], F.lit(1))).otherwise(char)).alias("s"),
            F.when(is_digit, state["n"] + 1).otherwise(state["n"]).alias("n"),
        )

    return F.aggregate(F.split(shape, ""), start, step)["s"]


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is the check digit."""

    def add(total: Column, char: Column, at: Column) -> Column:
        d = char.cast("int")
        return total + F.when(at % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    chars = F.split(F.reverse(digits), "")
    placed = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(placed, F.lit(0), lambda t, x: add(t, x["c"], x["i"]))


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    body = _permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), [_DIGITS], key, "card")
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    distinct = F.size(F.array_distinct(F.split(digits, ""))) > 1
    return distinct & (_luhn_sum(digits) % 10 == 0), _put_back(F.concat(body, check), value)


def _mod97(text: Column) -> Column:
    """Remainder of an account number read with A as 10 to Z as 35."""

    def step(rest: Column, char: Column) -> Column:
        at = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), char) - 1
        return F.pmod(rest * F.when(at > 9, 100).otherwise(10) + at, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(value: Column, key: str) -> tuple[Column, Column]:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country = F.substring(plain, 1, 2)
    rest = F.substring(plain, F.lit(5), F.length(plain))
    valid = (F.length(plain).between(15, 34)) & (_mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1)
    new = _permute_text(rest, [_DIGITS, _LOWER.upper()], key, "iban")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    fresh = F.concat(country, check, new)
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("n"))

    def step(state: Column, char: Column) -> Column:
        gap = char == " "
        return F.struct(
            F.concat(state["s"], F.when(gap, char).otherwise(F.substring(fresh, state["n"], F.lit(1)))).alias("s"),
            F.when(gap, state["n"]).otherwise(state["n"] + 1).alias("n"),
        )

    return valid, F.aggregate(F.split(value, ""), start, step)["s"]


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    valid = F.forall(octets, lambda o: o <= 255)
    pair = _permute_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, key, "ip")
    parts = [F.shiftright(pair["l"], 8), pair["l"] % 256, F.shiftright(pair["r"], 8), pair["r"] % 256]
    return valid, F.concat_ws(".", *[p.cast("string") for p in parts])


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(value, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    pair = _permute_pair(place, serial - 1, 898 * 99, 9999, key, "ssn")
    new = F.floor(pair["l"] / 99).cast("int")
    parts = [(F.when(new >= 665, new + 2).otherwise(new + 1), 3), (pair["l"] % 99 + 1, 2), (pair["r"] + 1, 4)]
    return valid, F.concat_ws("-", *[F.lpad(p.cast("string"), width, "0") for p, width in parts])


def _date(value: Column, key: str) -> tuple[Column, Column]:
    def permuted(day: Column, pattern: str) -> Column:
        n = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
        pair = _permute_pair(F.floor(n / _DAYS_B), n % _DAYS_B, _DAYS_A, _DAYS_B, key, "date")
        moved = F.date_add(F.lit(_FIRST_DAY).cast("date"), (pair["l"] * _DAYS_B + pair["r"]).cast("int"))
        return F.date_format(moved, pattern)

    out, valid = F.lit(None).cast("string"), F.lit(False)
    # Day first wins where both readings are dates.
    for pattern in ("MM/dd/yyyy", "MM.dd.yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"):
        shape = "^" + pattern.replace(".", "\\.").replace("dd", r"\d{2}").replace("MM", r"\d{2}").replace("yyyy", r"\d{4}") + "$"
        day = F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)).cast("date"))
        good = F.coalesce(F.year(day).between(1700, 2099), F.lit(False))
        out, valid = F.when(good, permuted(day, pattern)).otherwise(out), valid | good
    return valid, out


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    digits = _digits(rest)
    valid = F.length(_digits(value)).between(7, 15)
    return valid, F.concat(code, _put_back(_permute_text(digits, [_DIGITS], key, "phone"), rest))


def _text_kind(kind: str, *alphabets: str):
    def make(value: Column, key: str) -> tuple[Column, Column]:
        return F.lit(True), _permute_text(value, list(alphabets), key, kind)

    return make


def _written_out_or_short(value: Column) -> Column:
    """A whole IPv6 address, or a short one that is no name in a name space or time.

    A short one leaves out one group at least, and has three groups or a first
    group of four characters with a digit.
    """
    groups = F.filter(F.split(value, ":"), lambda g: F.length(g) > 0)
    telling = (F.size(groups) > 2) | value.rlike("^(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{4}:")
    digit = value.rlike("[0-9]")
    return ~F.contains(value, F.lit("::")) | ((F.size(groups) < 8) & telling & digit)


def _hex_kind(kind: str, valid=lambda value: F.length(value) > 0):
    def make(value: Column, key: str) -> tuple[Column, Column]:
        # Upper case is decided for the value as a whole; a value of digits only is lower case.
        upper = value.rlike("[A-F]")
        # A long value in chunks, each with its number in the key; a short one is a single chunk.
        chunks = F.regexp_extract_all(F.lower(value), F.lit(f".{{1,{_CHUNK}}}"), F.lit(0))

        def permuted(chunk: Column, n: Column) -> Column:
            tag = F.concat(F.lit(kind), F.when(n > 0, n.cast("string")).otherwise(""))
            return _permute_text(chunk, ["0123456789abcdef"], key, tag)

        new = F.array_join(F.transform(chunks, permuted), "")
        return valid(value), F.when(upper, F.upper(new)).otherwise(new)

    return make


_MAKERS = {
    "email": _text_kind("email", _DIGITS, _LOWER, _LOWER.upper()),
    "iban": _iban,
    "secret": _hex_kind("secret"),
    "ipv6": _hex_kind("ipv6", _written_out_or_short),
    "ssn": _ssn,
    "card": _card,
    "phone": _phone,
    "ip": _ip,
    "date": _date,
}


def _replaced(value: Column, key: str) -> Column:
    """Struct ``kind, new`` of a candidate; the kind is null and the value kept if it fails its check."""
    kind, new = F.lit(None).cast("string"), value
    for name in reversed(KINDS):
        valid, pseudonym = _MAKERS[name](value, key)
        # Alone, the candidate has no neighbours, so the borders hold.
        is_it = value.rlike(f"^(?:{PATTERNS[name]})$")
        good = F.when(is_it, valid).otherwise(F.lit(False))
        kind, new = F.when(good, F.lit(name)).otherwise(kind), F.when(good, pseudonym).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def _chosen(parts: Column, found: Column) -> Column:
    """Struct ``text, kinds`` after replacing, from the left, each valid value that overlaps no earlier one.

    Every part but one in front of the first candidate starts with a candidate,
    which can reach into the parts after it; ``skip`` counts the characters of
    the last replaced value that are still to come.
    """
    ahead = F.size(parts) - F.size(found)  # 1 where text stands in front of the first candidate
    no_text = F.array().cast("array<string>")
    start = F.struct(
        F.array(F.when(ahead > 0, parts[0]).otherwise("")).alias("out"),
        F.lit(0).alias("skip"),
        no_text.alias("kinds"),
    )
    zipped = F.zip_with(
        F.slice(parts, ahead + 1, F.size(found)), found, lambda p, v: F.struct(p.alias("part"), v.alias("v"))
    )
    # Lists that grow are copied at every step, so candidates are folded in blocks, and the
    # blocks then: n / _BLOCK short lists and one of n / _BLOCK texts.
    blocks = F.transform(
        F.array(zipped),
        lambda all_of_them: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")),
            lambda n: F.slice(all_of_them, n * _BLOCK + 1, F.lit(_BLOCK)),
        ),
    )[0]

    def step(state: Column, x: Column) -> Column:
        kind = x["v"]["as"]["kind"]
        take = (state["skip"] == 0) & kind.isNotNull()
        skip = F.when(take, x["v"]["length"]).otherwise(state["skip"])
        left = F.substring(x["part"], skip + 1, F.length(x["part"]))
        return F.struct(
            F.concat(
                state["out"], F.array(F.concat(F.when(take, x["v"]["as"]["new"]).otherwise(""), left))
            ).alias("out"),
            F.greatest(skip - F.length(x["part"]), F.lit(0)).alias("skip"),
            F.when(take, F.concat(state["kinds"], F.array(kind))).otherwise(state["kinds"]).alias("kinds"),
        )

    def block(state: Column, candidates: Column) -> Column:
        fresh = F.struct(no_text.alias("out"), state["skip"].alias("skip"), no_text.alias("kinds"))
        joined = F.aggregate(candidates, fresh, step, lambda done: F.struct(
            F.array_join(done["out"], "").alias("text"), done["skip"].alias("skip"), done["kinds"].alias("kinds")
        ))
        return F.transform(
            F.array(joined),
            lambda j: F.struct(
                F.concat(state["out"], F.array(j["text"])).alias("out"),
                j["skip"].alias("skip"),
                F.concat(state["kinds"], j["kinds"]).alias("kinds"),
            ),
        )[0]

    end = F.aggregate(blocks, start, block)
    return F.struct(F.array_join(end["out"], "").alias("text"), end["kinds"].alias("kinds"))


def pseudonymize(
    df: DataFrame, text_col: str = "text", key: str = KEY, found_col: str | None = None
) -> DataFrame:
    """``df`` with every validated value in ``text_col`` replaced by its pseudonym.

    Rows and all other columns stay. Only addresses of four octets can change the
    length of the text: their octets are numbers, not digits.
    Null and empty texts stay as they are. ``found_col`` names a new column with
    the kinds replaced, in text order (an empty array where there are none).
    A candidate that fails its check (a number with a wrong check digit, a day
    that does not exist) stays as it is.
    """
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(f"{_BORDER}(?=({_ANY}))"), F.lit(1))
    found = F.transform(found, lambda v: F.struct(F.length(v).alias("length"), _replaced(v, key).alias("as")))
    held = df.select("*", F.when(text.rlike(_GATE), found).alias(_FOUND))
    done = _chosen(F.split(text, _START, -1), F.col(_FOUND))
    changed = F.exists(_FOUND, lambda v: v["as"]["kind"].isNotNull())
    held = held.withColumn(_FOUND, F.when(F.coalesce(changed, F.lit(False)), done))
    columns = [
        F.coalesce(F.col(_FOUND)["text"], text).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns
    ]
    if found_col:
        columns.append(F.coalesce(F.col(_FOUND)["kinds"], F.array().cast("array<string>")).alias(found_col))
    return held.select(*columns)
