"""Format-preserving pseudonyms for personal data, in SQL functions.

Found numbers, dates and addresses are validated, permuted by a keyed Feistel
network within the set of their format, and written back in the format they had.
Validated means: card numbers pass Luhn's test, account numbers their remainder
of 97, North American telephone numbers have possible area and exchange codes,
internet addresses have octets, dates are days of the calendar.  A pseudonym is
again such a value, different values of a format never share one, and equal
values have equal pseudonyms in every document, so records stay linked.

Two kinds of set are permuted.  Numbers form a product of two ranges, Z_a x Z_b:
rounds add a keyed function of one half to the other, modulo its range, in turn,
which is a permutation for any a and b.  Strings of letters and digits have a
shape, the class of each character: rounds move each character of one half
within its class by a keyed function of the shape and the other half.

A run of digits is a card number if all its 13 to 19 digits pass.  Otherwise it
may hold card numbers next to other digits: its groups are searched for the
groupings in which cards are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read
from .spans_sql import let, split_matches

ROUNDS = 8
#: The query's key; in production it comes from a secret store.
DEMO_KEY = "spindrift-demo-key"

_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_SLASHED = r"[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
#: What a run of digit groups does not go on with.
_OTHER = rf"{_ISO}|{_SLASHED}|{_SSN}|{_IP}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9-])"
#: Kinds in the order in which a match is tried; a later alternative never starts inside an earlier match.
PATTERNS = {
    # begins a run of its characters, or follows another match: a long run without @ is read once
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": rf"(?<![0-9-]){_ISO}|(?<![0-9/]){_SLASHED}",
    "ssn": rf"(?<![0-9-]){_SSN}",
    "phone": r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])(?:\+1[ .-]?)?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_IP}",
    "card": rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_OTHER})[0-9]++)*+",
}
KINDS = tuple(PATTERNS)
# the telephone pattern's own group keeps its place: no other alternative has one
ANY = "|".join(PATTERNS[k] for k in KINDS)

#: 400 years of the calendar have 146,097 = 189 * 773 days, 88,497 = 9 * 9,833 of them after the 12th of a month.
_FIRST_DAY, _DAYS, _LATE_DAYS = "1700-01-01", (189, 773), (9, 9833)
#: Digits of the groups in which cards are written, and digits of a card by the order in which they are tried.
CARD_GROUPS = r"^(1[3-9]|4,4,4,4|4,6,5|4,6,4|4,4,4,[1-3]|4,4,4,4,[1-3])$"
CARD_SIZES = (16, 15, 14, 13, 19, 18, 17)
_AREAS, _REST = 800, 8_000_000


def _prf(key: str, kind: str, round_: Column, half: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_, half), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def permute(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """Struct (l, r) of the keyed permutation of Z_a x Z_b; `back` undoes it."""
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        l = F.when(odd, acc["l"]).otherwise(F.pmod(acc["l"] + sign * _prf(key, kind, i, acc["r"], a), a))  # noqa: E741
        r = F.when(odd, F.pmod(acc["r"] + sign * _prf(key, kind, i, acc["l"], b), b)).otherwise(acc["r"])
        return F.struct(l.alias("l"), r.alias("r"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if not back else F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def permute_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A string of up to 36 digits, permuted among those of its length, the length being part of the key."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10), k).cast("decimal(20,0)").cast("long")
        left, right = F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, n - u).cast("long")
        new = permute(left, right, ten(u), ten(n - u), key, kind, back)
        return let(new, lambda x: F.concat(F.lpad(x["l"].cast("string"), u, "0"), F.lpad(x["r"].cast("string"), n - u, "0")))

    return let(digits, halves)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def with_digits(m: Column, digits: Column) -> Column:
    """m with its digits replaced one by one."""
    places = F.sequence(F.lit(1), F.length(m))
    one = lambda i: F.when(F.substring(m, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(m, F.lit(1), i))), F.lit(1))).otherwise(F.substring(m, i, F.lit(1)))
    return F.array_join(F.transform(places, one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a number with its check digit."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _turned(half: Column, other: Column, key: str, kind: Column, round_: Column, sign: int) -> Column:
    """half with each letter and digit moved within its class by a keyed function of the other half."""
    chunks = F.sequence(F.lit(0), F.floor(F.length(half) / 16).cast("int"))
    digest = F.array_join(F.transform(chunks, lambda c: F.sha2(F.concat_ws("|", F.lit(key), kind, round_, c, other), 512)), "")

    def move(h: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            shift = F.conv(F.substring(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long") * sign
            within = lambda first, size: F.char(F.pmod(F.ascii(c) - first + shift, F.lit(size)) + first)
            return F.when(c.rlike("[0-9]"), within(48, 10)).when(c.rlike("[a-z]"), within(97, 26)).when(c.rlike("[A-Z]"), within(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    return let(digest, move)


def shape_of(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")


def permute_text(text: Column, key: str, kind: str, back: bool = False) -> Column:
    """A text permuted among those of its shape: letters stay letters of their case, digits digits, the rest as it is."""
    sign = -1 if back else 1

    def rounds(t: Column) -> Column:
        u = F.floor(F.length(t) / 2).cast("int")
        name = F.concat_ws(":", F.lit(kind), shape_of(t))

        def step(acc: Column, i: Column) -> Column:
            odd = i % 2 == 1
            left = F.when(odd, acc["l"]).otherwise(_turned(acc["l"], acc["r"], key, name, i, sign))
            right = F.when(odd, _turned(acc["r"], acc["l"], key, name, i, sign)).otherwise(acc["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        halves = F.struct(F.substring(t, F.lit(1), u).alias("l"), F.substring(t, u + 1, F.length(t)).alias("r"))
        return F.aggregate(order, halves, step, lambda a: F.concat(a["l"], a["r"]))

    return let(text, rounds)


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(F.lit(False))


def card_groups(m: Column) -> Column:
    """The card numbers in a run of digit groups: `(at, n)`, the first group's place and how many groups, in order."""
    none = F.array().cast("array<struct<at:int,n:int>>")

    def inside(g: Column) -> Column:
        size = F.size(g)
        part = lambda at, n: F.slice(g, at + 1, n)
        digits = lambda at, n: F.array_join(part(at, n), "")
        shape = lambda at, n: F.array_join(F.transform(part(at, n), F.length), ",")
        fits = lambda at, n: F.when(shape(at, n).rlike(CARD_GROUPS), _is_card(digits(at, n))).otherwise(F.lit(False))
        reach = lambda at: F.sequence(F.lit(1), F.least(F.lit(5), size - at))
        usual = F.transform(g, lambda x, at: F.get(F.filter(reach(at), lambda n: F.when(F.length(digits(at, n)) == 16, fits(at, n)).otherwise(F.lit(False))), F.lit(0)))

        def greedy(u: Column) -> Column:
            def other(at: Column) -> Column:
                # not across a number of the usual size that starts later
                free = F.filter(reach(at), lambda n: fits(at, n) & ~F.exists(F.slice(u, at + 2, F.greatest(n - 1, F.lit(0))), F.isnotnull))
                ranked = F.transform(free, lambda n: F.struct(F.array_position(F.array(*map(F.lit, CARD_SIZES)), F.length(digits(at, n))).alias("rank"), n.alias("n")))
                return F.array_min(ranked)["n"]

            def step(acc: Column, at: Column) -> Column:
                best = F.when(at >= acc["upto"], F.coalesce(F.get(u, at), other(at)))
                return let(best, lambda n: F.when(n.isNull(), acc).otherwise(F.struct((at + n).alias("upto"), F.array_append(acc["kept"], F.struct(at.alias("at"), n.alias("n"))).alias("kept"))))

            return F.aggregate(F.sequence(F.lit(0), size - 1), F.struct(F.lit(0).alias("upto"), none.alias("kept")), step, lambda a: a["kept"])

        whole = F.array(F.struct(F.lit(0).alias("at"), size.alias("n")))
        return F.when(_is_card(F.array_join(g, "")), whole).when(size > 1, let(usual, greedy)).otherwise(none)

    return let(F.regexp_extract_all(m, F.lit("([0-9]+)"), F.lit(1)), inside)


def _card(m: Column, cards: Column, key: str, back: bool) -> Column:
    """A run of digit groups with its card numbers replaced."""

    def new(text: Column) -> Column:
        d = digits_of(text)
        payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", back)
        checked = let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
        return with_digits(text, checked)

    def joined(f: Column) -> Column:
        """f.g: digit groups; f.s: what stands before each of them."""
        between = lambda at, n: F.array_join(F.zip_with(F.slice(f["s"], at + 1, n), F.slice(f["g"], at + 1, n), lambda s, g: F.concat(s, g)), "")

        def step(acc: Column, c: Column) -> Column:
            before = F.concat(between(acc["at"], c["at"] - acc["at"]), F.get(f["s"], c["at"]))
            own = F.concat(F.get(f["g"], c["at"]), between(c["at"] + 1, c["n"] - 1))
            return F.struct(F.concat(acc["out"], before, let(own, new)).alias("out"), (c["at"] + c["n"]).alias("at"))

        return F.aggregate(cards, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], between(a["at"], F.size(f["g"]) - a["at"])))

    return let(F.struct(F.regexp_extract_all(m, F.lit("([0-9]+)"), F.lit(1)).alias("g"), F.split(m, "[0-9]+", -1).alias("s")), joined)


def _remainder_97(text: Column) -> Column:
    """Of a number of digits and capital letters, letters counting 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[A-Z]"), F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97)))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str, back: bool) -> Column:
    """The longest leading part, in whole blocks, that passes; what follows it stays."""

    def valid(t: Column) -> Column:
        c = F.regexp_replace(t, " ", "")
        return F.length(c).between(15, 34) & (_remainder_97(F.concat(F.substring(c, F.lit(5), F.length(c) - 4), F.substring(c, 1, 4))) == 1) & F.substring(c, 3, 2).cast("int").between(2, 98)

    def new(t: Column) -> Column:
        def checked(body: Column) -> Column:
            country = F.substring(t, 1, 2)
            compact = F.concat(country, F.lpad((98 - _remainder_97(F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00")))).cast("string"), 2, "0"))
            return F.concat(compact, body)

        return let(permute_text(F.substring(t, F.lit(5), F.length(t) - 4), key, "iban", back), checked)

    def blocks(b: Column) -> Column:
        parts = F.transform(F.sequence(F.size(b), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(b, F.lit(1), n), " "))
        first = F.get(F.filter(parts, valid), F.lit(0))
        return let(first, lambda t: F.when(t.isNotNull(), F.concat(new(t), F.substring(m, F.length(t) + 1, F.length(m)))))

    return let(F.split(m, " "), blocks)


def _numbered(n: Column, size: tuple[int, int], key: str, kind: str, back: bool, found) -> Column:
    """`found` of the number to which n is moved, of all below the product of `size`; null for others."""
    moved = permute(F.floor(n / size[1]), n % size[1], _long(size[0]), _long(size[1]), key, kind, back)
    return F.when(n.between(0, size[0] * size[1] - 1), let(moved, lambda x: let(x["l"] * size[1] + x["r"], found)))


def _date(m: Column, key: str, back: bool) -> Column:
    """yyyy-MM-dd, dd/MM/yyyy, or MM/dd/yyyy where the former is no day: such a date, past the 12th of its month, stays one."""
    first = F.lit(_FIRST_DAY).cast("date")
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
    # days of the first 12 of each month left out, up to and with the month of a date
    left_out = lambda d: 12 * ((F.year(d) - 1700) * 12 + F.month(d))

    def late(n: Column) -> Column:
        month = lambda i: F.add_months(first, i.cast("int"))
        near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(n * 4800 / (_LATE_DAYS[0] * _LATE_DAYS[1])) + i)
        mine = F.get(F.filter(near, lambda i: n.between(F.datediff(month(i), first) - 12 * i, F.datediff(month(i + 1), first) - 12 * (i + 1) - 1)), F.lit(0))
        return let(mine, lambda i: F.date_add(first, (n + 12 * (i + 1)).cast("int")))

    def by_format(d: Column) -> Column:
        iso, slashed, american = (d[f"d{i}"] for i in range(3))
        plain = lambda day, form: _numbered(F.datediff(day, first).cast("long"), _DAYS, key, "date", back, lambda n: F.date_format(F.date_add(first, n.cast("int")), form))
        other = _numbered((F.datediff(american, first) - left_out(american)).cast("long"), _LATE_DAYS, key, "late date", back, lambda n: F.date_format(late(n), formats[2]))
        return F.when(iso.isNotNull(), plain(iso, formats[0])).when(slashed.isNotNull(), plain(slashed, formats[1])).when(american.isNotNull(), other)

    return let(F.struct(*(F.try_to_date(m, f).alias(f"d{i}") for i, f in enumerate(formats))), by_format)


def _phone(m: Column, key: str, back: bool) -> Column:
    def new(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange = F.substring(ten, 1, 3).cast("int") - 200, F.substring(ten, 4, 3).cast("int") - 200
        moved = permute(area, exchange * 10_000 + F.substring(ten, 7, 4).cast("int"), _long(_AREAS), _long(_REST), key, "phone", back)
        text = let(moved, lambda x: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (x["l"] + 200).cast("string"), (F.floor(x["r"] / 10_000) + 200).cast("string"), F.lpad((x["r"] % 10_000).cast("string"), 4, "0")))
        return F.when((area >= 0) & (exchange >= 0), with_digits(m, text))

    return let(digits_of(m), new)


def _ip(m: Column, key: str, back: bool) -> Column:
    def new(o: Column) -> Column:
        moved = permute(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), _long(65536), _long(65536), key, "ip", back)
        text = let(moved, lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))
        return F.when(F.forall(o, lambda x: x <= 255), text)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), new)


def _ssn(m: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = permute(index, (group - 1) * 9999 + serial - 1, _long(898), _long(99 * 9999), key, "ssn", back)
    text = let(moved, lambda x: F.concat_ws("-", F.lpad((x["l"] + 1 + F.when(x["l"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), text)


def _email(m: Column, key: str, back: bool) -> Column:
    """The local part is permuted within its shape, the domain stays."""
    domain = F.substring_index(m, "@", -1)
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email", back), F.lit("@"), domain)


_NEW = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip}


def kind_of(m: Column) -> Column:
    """Whole matches tell their kind by themselves."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def replaced(m: Column, key: str, back: bool = False) -> Column:
    """Struct `(kind, new, n)` of a match: its text with pseudonyms, null without a valid value, and how many there are."""

    def by_kind(kind: Column) -> Column:
        found = lambda new: let(new, lambda x: F.struct(kind.alias("kind"), x.alias("new"), x.isNotNull().cast("int").alias("n")))
        cards = let(card_groups(m), lambda c: F.struct(kind.alias("kind"), F.when(F.size(c) > 0, _card(m, c, key, back)).alias("new"), F.size(c).alias("n")))
        out = F.when(kind == "card", cards)
        for name, new in _NEW.items():
            out = out.when(kind == name, found(new(m, key, back)))
        return out

    return let(kind_of(m), by_kind)


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """A match with pseudonyms, or null if it holds no valid value; `back` gives the value of a pseudonym."""
    return replaced(m, key, back)["new"]


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with pseudonyms in their text and the number of each kind replaced, `n_email` and so on, in place of columns so named."""
    counts = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c.lower() not in counts]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    found = let(split_matches(F.col("text"), ANY), lambda f: F.when(f.isNotNull(), F.struct(f["g"].alias("g"), F.transform(f["m"], lambda m: let(replaced(m, key), lambda p: F.struct(F.coalesce(p["new"], m).alias("new"), p["kind"].alias("kind"), p["n"].alias("n")))).alias("v"))))
    held = held.withColumn("pii", found)
    joined = F.array_join(F.zip_with("pii.g", "pii.v", lambda g, v: F.concat(g, F.coalesce(v["new"], F.lit("")))), "")
    count = lambda k: F.coalesce(F.aggregate(F.filter("pii.v", lambda v: v["kind"] == k), F.lit(0), lambda a, v: a + v["n"]), F.lit(0)).cast("long")
    new = held.withColumns({"new": F.coalesce(joined, F.col("text")), **{f"n_{k}": count(k) for k in KINDS}})
    return new.select(*((F.col("new") if c == "text" else F.col("row").getField(c)).alias(c) for c in rest), *counts)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data, and how many of each kind.

    A null text stays null and has none; an invalid number or date stays as it
    is; repeated values have one pseudonym everywhere, repeated rows give repeated
    rows; a very long text counts whole; an empty table gives no rows; further
    columns are not read.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return pseudonymise(docs, DEMO_KEY).select("doc_id", *(f"n_{k}" for k in KINDS), "text")
