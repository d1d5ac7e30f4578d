"""Format-preserving pseudonyms of personal data.

Validated numbers, dates and addresses are permuted within their own format by a keyed Feistel network:
a card number becomes another valid card number, a date another date, an address of the host another of
the same host. The same value always gets the same pseudonym, so it stays linked across documents, and
different values never share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4  # each round changes both halves
WALK = 64
EPOCH, DAYS = "1900-01-01", (319, 229)  # 200 years from the epoch are 319 * 229 days

_START, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Patterns by kind, tried in this order at every place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": _START + r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _END + r"(?!\.[0-9])",
    "date": _START + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:(?=T[0-9])|" + _END + ")",
    "ssn": _START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END,
    "card": _START + r"[0-9][0-9 -]{11,}[0-9]" + _END,  # a run of digit groups, in which cards are searched
}
# A telephone number with + and country code has 8 to 15 digits; its groups end before another value.
_OTHER = "|".join([*(PATTERNS[k] for k in ("email", "ip", "date", "ssn", "phone")), r"(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _END])
_MORE = r"(?:(?:[ .-](?!" + _OTHER + "))?[0-9])"
PATTERNS["phone"] += r"|(?<![0-9A-Za-z+])\+[1-9](?:" + _MORE + r"{7,14}|[0-9]{0,2}[ .-]?\([0-9]{1,4}\)" + _MORE + "{5,10})" + _END
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"  # of ITU-T E.164
CARD_DIGITS = (13, 19)
#: Sizes of the digit groups as cards are printed: one group, fours with a shorter last one, 4-6-5 and 4-6-4.
USUAL = r"^(?:[0-9]+|4(?:,4)*,[1-4]|4,6,[45])$"


def _prf(key: Column, kind: str, i: Column, value: Column) -> Column:
    """60 keyed bits of a round and the other half."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the pairs with 0 <= x < a and 0 <= y < b, as struct ``x, y``."""
    def turn(s, i):
        nx = F.pmod(s["x"] + F.pmod(_prf(key, kind, 2 * i, s["y"]), a), a)
        return F.struct(nx.alias("x"), F.pmod(s["y"] + F.pmod(_prf(key, kind, 2 * i + 1, nx), b), b).alias("y"))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), 0)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``digits`` in place of the digits of ``m``, whatever stands between them."""
    return F.array_join(F.zip_with(F.split(m, "[0-9]", -1), F.concat(_chars(digits), F.array(F.lit(""))),
                                   lambda a, b: F.concat(a, b)), "")


def _permute_digits(d: Column, key: Column, kind: str) -> Column:
    """Digits (2 to 18) to as many digits."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    p = feistel(F.substring(d, F.lit(1), h), F.substring(d, h + 1, n - h),
                F.pow(F.lit(10), h).cast("long"), F.pow(F.lit(10), n - h).cast("long"), key, kind)
    # A struct that is used twice is computed once by passing it through a one-item transform.
    return F.transform(F.array(p), lambda r: F.concat(F.lpad(r["x"].cast("string"), h, F.lit("0")),
                                                      F.lpad(r["y"].cast("string"), n - h, F.lit("0"))))[0]


def luhn(d: Column) -> Column:
    """Luhn sum modulo 10; 0 for a valid number."""
    parts = F.transform(_chars(F.reverse(d)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda s, v: s + v) % 10


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _card(d: Column, key: Column) -> Column:
    """Digits of a valid card to those of another of the same length."""
    payload = _permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    return _once(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))


def _stretches(groups: Column) -> Column:
    """All valid cards made of neighbouring groups, by first group, longest first."""
    low, high = CARD_DIGITS

    def starting(i):
        def one(part):
            d = F.array_join(part, "")
            valid = F.when(F.length(d).between(low, high) & ~F.array_contains(part, ""), (luhn(d) == 0) & (d.cast("decimal(19,0)") > 0))
            usual = F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), ",").rlike(USUAL)
            return F.when(valid, F.struct(i.alias("at"), F.size(part).alias("len"), usual.alias("usual")))
        near = lambda g: F.transform(F.sequence(F.size(g), F.lit(1), F.lit(-1)), lambda n: _once(F.slice(g, F.lit(1), n), one))
        return F.filter(_once(F.slice(groups, i + 1, F.lit(high)), near), lambda c: c.isNotNull())
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), starting))


def _apart(found: Column) -> Column:
    """Those of ``found`` that start behind the one taken before."""
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,len:int,usual:boolean>>").alias("taken"))
    return F.aggregate(found, start, lambda s, c: F.when(c["at"] >= s["free"], F.struct(
        (c["at"] + c["len"]).alias("free"), F.concat(s["taken"], F.array(c)).alias("taken"))).otherwise(s), lambda s: s["taken"])


def _cards(m: Column, key: Column) -> Column:
    """A run of digit groups with its cards replaced, as struct ``new, n``.

    Cards grouped as usual come first, then any other stretches that do not overlap them.
    """
    def changed(groups, taken):
        def turn(s, c):
            part = F.slice(groups, c["at"] + 1, c["len"])
            new = F.split(_refill(F.array_join(part, " "), _card(F.array_join(part, ""), key)), " ")
            return F.struct((c["at"] + c["len"]).alias("done"), F.concat(
                s["out"], F.slice(groups, s["done"] + 1, c["at"] - s["done"]), new).alias("out"))
        out = F.aggregate(taken, F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("out")), turn,
                          lambda s: F.concat(s["out"], F.slice(groups, s["done"] + 1, F.size(groups) - s["done"])))
        gaps = F.concat(F.regexp_extract_all(m, F.lit("[ -]"), 0), F.array(F.lit("")))
        return F.struct(F.array_join(F.zip_with(out, gaps, lambda a, b: F.concat(a, b)), "").alias("new"), F.size(taken).alias("n"))

    def chosen(found):
        def others(usual):
            clear = lambda c: ~F.exists(usual, lambda u: (c["at"] < u["at"] + u["len"]) & (u["at"] < c["at"] + c["len"]))
            return F.array_sort(F.concat(usual, _apart(F.filter(found, lambda c: ~c["usual"] & clear(c)))))
        return _once(_apart(F.filter(found, lambda c: c["usual"])), others)
    same = F.struct(m.alias("new"), F.lit(0).alias("n"))
    return _once(F.split(m, "[ -]", -1), lambda groups: _once(_stretches(groups), lambda found: F.when(
        F.size(found) > 0, _once(chosen(found), lambda taken: changed(groups, taken))).otherwise(same)))


def _between(text: Column, key: Column) -> Column:
    """Text without values of the other kinds, with its cards replaced, as struct ``new, n``."""
    run = PATTERNS["card"]

    def joined(runs):
        return F.struct(F.array_join(F.zip_with(F.split(text, run, -1), F.concat(runs["new"], F.array(F.lit(""))),
                                                lambda a, b: F.concat(a, b)), "").alias("new"),
                        F.aggregate(runs["n"], F.lit(0), lambda s, n: s + n).alias("n"))
    return F.when(text.rlike(run), _once(F.transform(F.regexp_extract_all(text, F.lit(run), 0), lambda m: _cards(m, key)), joined)
                  ).otherwise(F.struct(text.alias("new"), F.lit(0).alias("n")))


def _phone(m: Column, key: Column) -> Column:
    """A country code stays; the other digits change."""
    d = _digits(m)
    keep = F.when(m.startswith("+"), F.length(F.regexp_extract(d, COUNTRY, 0))).otherwise(0)
    n = F.length(d) - keep
    return _refill(m, F.concat(F.substring(d, F.lit(1), keep), _permute_digits(F.substring(d, keep + 1, n), key, "phone")))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    p = feistel(x, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def write(r):
        a = F.floor(r["x"] / 99)
        a = a + 1 + F.when(a >= 665, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", a, r["x"] % 99 + 1, r["y"] + 1)
    return F.when(valid, F.transform(F.array(p), write)[0])


def _ip(m: Column, key: Column) -> Column:
    o = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    valid = F.greatest(*o) < 256
    p = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    return F.when(valid, F.transform(F.array(p), lambda r: F.concat_ws(
        ".", F.floor(r["x"] / 256), r["x"] % 256, F.floor(r["y"] / 256), r["y"] % 256))[0])


def _date(m: Column, key: Column) -> Column:
    """Every form has strings of its own: with slashes, those that are valid as day/month, and those that are only
    valid as month/day. The latter are permuted until another such string comes up, which is one-to-one among them."""
    epoch = F.lit(EPOCH).cast("date")

    def written(form, accept=None):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), epoch).cast("long")
        as_date = lambda n: F.date_add(epoch, n.cast("int"))

        def turn(n):
            return _once(feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date"), lambda r: r["x"] * DAYS[1] + r["y"])
        if accept is None:
            new = turn(day)
        else:
            # Three in five days are accepted: WALK turns fail once in 10^25 keys and days.
            start = F.struct(day.alias("n"), F.lit(False).alias("done"))
            step = lambda s, _: F.when(s["done"], s).otherwise(_once(turn(s["n"]), lambda n: F.struct(n.alias("n"), accept(as_date(n)).alias("done"))))
            new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: F.when(s["done"], s["n"]))
        return F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), F.date_format(_once(new, as_date), form))
    slashes = F.coalesce(written("dd/MM/yyyy"), written("MM/dd/yyyy", lambda d: F.dayofmonth(d) > 12))
    return F.coalesce(written("yyyy-MM-dd"), written("dd.MM.yyyy"), slashes)


def _email(m: Column, key: Column) -> Column:
    """Letters and digits of the local part change within their classes, by halves; all else stays."""
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    h = F.floor(n / 2).cast("int")

    def shift(s, other, i):
        pad = F.sha2(F.concat_ws("|", key, F.lit("email"), i.cast("string"), F.lower(host), other).cast("binary"), 256)

        def one(c, k):
            by = F.conv(F.substring(pad, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
            move = lambda low, size: F.char(F.lit(low) + F.pmod(F.ascii(c) - low + by, F.lit(size)))
            return (F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26))
                    .when(c.between("A", "Z"), move(65, 26)).otherwise(c))
        return F.array_join(F.transform(_chars(s), one), "")

    def turn(s, i):
        return F.transform(F.array(shift(s["x"], s["y"], 2 * i)), lambda nx: F.struct(
            nx.alias("x"), shift(s["y"], nx, 2 * i + 1).alias("y")))[0]
    start = F.struct(F.substring(local, F.lit(1), h).alias("x"), F.substring(local, h + 1, n - h).alias("y"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.transform(F.array(p), lambda r: F.concat(r["x"], r["y"], F.lit("@"), host))[0]


REWRITE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, plus ``n_found`` (values replaced) and ``kinds`` (comma-joined; both replace such columns).

    Cards are searched in what the other kinds leave: in a run of digit groups, parted by single blanks or hyphens, every
    stretch of whole groups with 13 to 19 digits is tried, those grouped as on cards first, then from the left and longest
    first; of overlapping valid ones one is replaced. A telephone number has + and a country code, 8 to 15 digits in all in
    any groups, or else three, three and four digits; ten digits without a break are not taken for one. Numbers and dates that fail validation (Luhn, ranges, calendar) stay as they are, as do secrets and names. A null
    text stays null with nothing found; an empty one stays empty. Rows are independent: repeated rows give repeated
    results, an empty table an empty one. The whole text is searched, whatever its length.
    """
    docs = docs.drop("n_found", "kinds")
    every = "|".join(PATTERNS[name] for name in REWRITE)
    secret = F.lit(key)

    def rewrite(m):
        out, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in reversed(REWRITE):
            whole = m.rlike("^(?:" + PATTERNS[name] + ")$")
            out, kind = F.when(whole, REWRITE[name](m, secret)).otherwise(out), F.when(whole, F.lit(name)).otherwise(kind)
        return F.transform(F.array(out), lambda o: F.struct(
            F.coalesce(o, m).alias("new"), F.when(o.isNotNull(), kind).alias("kind")))[0]
    maybe = F.col("text").rlike("[0-9@]")
    marked = docs.withColumn("__found", F.when(maybe, F.transform(F.regexp_extract_all("text", F.lit(every), 0), rewrite)))
    marked = marked.withColumn("__rest", F.when(maybe, F.transform(F.split("text", every, -1), lambda t: _between(t, secret))))
    cards = F.coalesce(F.aggregate(F.col("__rest.n"), F.lit(0), lambda s, n: s + n), F.lit(0))
    kinds = F.filter(F.col("__found.kind"), lambda k: k.isNotNull())
    names = F.concat(kinds, F.when(cards > 0, F.array(F.lit("card"))).otherwise(F.array().cast("array<string>")))
    text = F.when((F.size("__found") > 0) | (cards > 0), F.array_join(F.zip_with(
        F.col("__rest.new"), F.concat(F.col("__found.new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    ).otherwise(F.col("text"))
    return marked.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        (F.coalesce(F.size(kinds), F.lit(0)) + cards).cast("long").alias("n_found"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ","), F.lit("")).alias("kinds"))
