"""Scalar rules as pure Column expressions (C*, D*): no UDFs, all inside codegen.

They work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.plans.bounded import checked_broadcast, settled

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's lists for equal results).
# Title tokens, in the order they are tried (first substring match wins).
TITLES = ['Mr.', 'Mrs.', 'Master.', 'Miss.', 'Don.', 'Dr.', 'Rev.', 'Col.', 'Major.', 'Ms.', 'Mme.',
          'Lady.', 'Sir.', 'Mlle.', 'Countess.', 'Capt.', 'Jonkheer.']
# The later variant of the same list, with 'Dona.' tried before 'Sir.'.
TITLES_WITH_DONA = ['Mr.', 'Mrs.', 'Master.', 'Miss.', 'Don.', 'Dr.', 'Rev.', 'Col.', 'Major.', 'Ms.',
                    'Mme.', 'Lady.', 'Dona.', 'Sir.', 'Mlle.', 'Countess.', 'Capt.', 'Jonkheer.']
# Title → title group; missing titles are looked up under the key 'nan'.
TITLE_GROUPS = {
    'Sir.': 'MaleRarePos', 'Ms.': 'FemaleRarePos', 'Mme.': 'FemaleRarePos', 'Lady.': 'FemaleRarePos',
    'Mlle.': 'FemaleRarePos', 'Countess.': 'FemaleRarePos', 'Mrs.': 'Mrs', 'Miss.': 'Miss',
    'Master.': 'Master', 'Dona.': 'FemaleRarePos', 'Mr.': 'Mr', 'Col.': 'MaleRareMaybes',
    'Major.': 'MaleRareMaybes', 'Dr.': 'MaleRareMaybes', 'Don.': 'MaleRareNeg', 'Rev.': 'MaleRareNeg',
    'Capt.': 'MaleRareNeg', 'Jonkheer.': 'MaleRareNeg', 'nan': 'nan',
}
# Deck letters recognised in a cabin string.
DECKS = ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'T']
# Port of embarkation → ordinal code.
EMBARKED_CODES = {'C': 0, 'Q': 1, 'S': 2}
# Family-size flags (inclusive ranges).
FAMILY_FLAGS = {'Single': (1, 1), 'SmallF': (2, 2), 'MedF': (3, 4), 'LargeF': (5, None)}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# C5 ------------------------------------------------------------------------
def cast_cols(df: DataFrame, types: dict[str, str], truncate: bool = True) -> DataFrame:
    """Casts; float→int truncates toward zero; values that do not fit become null (try_cast)."""
    return df.withColumns({c: _c(c).try_cast(t) for c, t in types.items()})


# C6 ------------------------------------------------------------------------
def with_origin(df: DataFrame, tag: str, name: str = "origin") -> DataFrame:
    return df.withColumn(name, F.lit(tag))


# C7 ------------------------------------------------------------------------
def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN → NULL in every float column (one representation of 'missing')."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in fl}) if fl else df


# C8 / D2 / E9 ----------------------------------------------------------------
def map_values(col, mapping: dict, default=None, strict: bool = False) -> Column:
    """Dictionary lookup as a literal map (no join).

    ``strict``: an unknown non-null key raises (the reference's ``dict[x]``);
    otherwise unknown keys give ``default`` (null by default).
    """
    c = _c(col)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.try_element_at(m, c)
    if strict:
        return F.when(c.isNull(), F.lit(None)).when(F.map_contains_key(m, c), looked).otherwise(
            F.raise_error(F.concat(F.lit("unknown key: "), c.cast("string"))))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def map_values_join(df: DataFrame, col: str, mapping: DataFrame, out: str, key: str = "key", value: str = "value",
                    default=None, strict: bool = False) -> DataFrame:
    """``map_values`` for maps of any size: ``mapping`` is a table of (key, value), joined on the key.

    Same result and type as the literal form: a null stays null, an unknown key raises (``strict``) or gives ``default``.
    A map with a repeated or null key raises. It is broadcast only if its counted rows and bytes are few.
    """
    table = settled(mapping.select(F.col(key).alias("_key"), F.col(value).alias(out if out not in df.columns else "_value"), F.lit(True).alias("_known")))
    found = table.columns[1]
    n, keys = table.agg(F.count("*"), F.count_distinct("_key")).first()
    if n != keys:
        raise ValueError("repeated or null key in the map")
    j = df.join(checked_broadcast(table, 1_000_000), df[col] == table["_key"], "left")
    looked = F.col(found)
    if strict:
        looked = F.when(df[col].isNull() | F.col("_known"), looked).otherwise(
            F.raise_error(F.concat(F.lit("unknown key: "), df[col].cast("string"))))
    elif default is not None:
        looked = F.coalesce(looked, F.lit(default))
    return j.select(*[df[c] for c in df.columns if c != out], looked.alias(out))


# C9 ------------------------------------------------------------------------
def replace_value(col, sentinel) -> Column:
    return F.nullif(_c(col), F.lit(sentinel))


# C10 / D9 ----------------------------------------------------------------------
def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def range_flags(col, ranges: dict[str, tuple]) -> dict[str, Column]:
    """{name: 0/1 column} for inclusive ranges (None = open end)."""
    c = _c(col)
    out = {}
    for name, (lo, hi) in ranges.items():
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c <= hi)
        out[name] = flag(cond)
    return out


# C11 / C12 / C13 ---------------------------------------------------------------
def to_bool(col) -> Column:
    return _c(col).cast("boolean")


def log1p(col) -> Column:
    return F.log1p(_c(col))


def sigmoid(col) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(col)))


def stable_sigmoid(col) -> Column:
    x = _c(col)
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


# C15 -----------------------------------------------------------------------
def standardize(df: DataFrame, cols: list[str], by: str | None = None, suffix: str = "") -> DataFrame:
    """Z-score with the table's own mean and sample std (per ``by`` group when given).

    NULL where the table or group has no spread: one row, or one value.
    """
    z = lambda c, m, s: F.try_divide(F.col(c) - m, s.cast("double"))
    aggs = [e for c in cols for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    if by is None:
        st = df.agg(*aggs).first()
        return df.withColumns({c + suffix: z(c, F.lit(st[f"_m_{c}"]), F.lit(st[f"_s_{c}"])) for c in cols})
    st = df.groupBy(by).agg(*aggs)
    j = df.join(settled(st), on=by, how="left")
    j = j.withColumns({c + suffix: z(c, F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols})
    return j.drop(*[x for c in cols for x in (f"_m_{c}", f"_s_{c}")])


# C16 -----------------------------------------------------------------------
def frobenius_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Divide every listed column by one global norm sqrt(Σ x²) over all cells; NULL if they are all zero or NULL."""
    norm = df.agg(F.sqrt(reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.col(c).cast("double") ** 2), F.lit(0.0)) for c in cols]))).first()[0]
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), F.lit(norm)) for c in cols})


# D1 ------------------------------------------------------------------------
def first_match(col, tokens: list[str]) -> Column:
    """First token (in list order) contained in the text, else null."""
    c = _c(col)
    return F.coalesce(*[F.when(c.contains(t), F.lit(t)) for t in tokens])


def title(col, with_dona: bool = True) -> Column:
    return first_match(col, TITLES_WITH_DONA if with_dona else TITLES)


def title_group(title_col) -> Column:
    """Title → group; a missing title uses the 'nan' key; unknown titles raise."""
    c = F.coalesce(_c(title_col), F.lit("nan"))
    return map_values(c, TITLE_GROUPS, strict=True)


# D3 ------------------------------------------------------------------------
def family_name(col) -> Column:
    return F.substring_index(_c(col), ",", 1)


# D4 ------------------------------------------------------------------------
def parse_ticket(col) -> Column:
    """struct(header string, number long).

    all digits (after trimming blanks) → (null, n); all letters → (text, 0);
    otherwise drop '.' and '/', trim, split on ' ': header = all pieces but the
    last joined, number = last piece; a non-numeric last piece → (null, null).
    """
    c = _c(col)
    s = F.trim(c)
    pieces = F.split(F.trim(F.regexp_replace(c, r"[./]", "")), " ")
    n = F.size(pieces)
    last = F.element_at(pieces, -1)
    num = last.try_cast("long")
    head = F.array_join(F.slice(pieces, 1, F.greatest(n - 1, F.lit(0))), "")
    header = (F.when(s.rlike(r"^[0-9]+$"), F.lit(None).cast("string"))
               .when(s.rlike(r"^[A-Za-z]+$"), s)
               .when(num.isNotNull(), head))
    number = (F.when(s.rlike(r"^[0-9]+$"), s.try_cast("long"))
               .when(s.rlike(r"^[A-Za-z]+$"), F.lit(0).cast("long"))
               .otherwise(num))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(header.alias("header"), number.alias("number")))


# D5 / D6 ---------------------------------------------------------------------
def parse_cabin(col) -> Column:
    """struct(decks array<string> sorted, rooms array<int>); null in → null fields.

    Rooms are the blank-separated integers left after deleting deck letters;
    nothing left → null rooms; other leftovers → null rooms.
    """
    c = _c(col)
    decks = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([ABCDEFGT])"), 1)))
    rest = F.trim(F.regexp_replace(c, "[ABCDEFGT]", ""))
    ok = rest.rlike(r"^[0-9]+( +[0-9]+)*$")
    rooms = F.when(ok, F.transform(F.split(rest, " +"), lambda x: x.cast("int")))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(decks.alias("decks"), rooms.alias("rooms")))


def deck_label(col, na: str = "N/A") -> Column:
    """Sorted deck letters joined, 'N/A' when none (or null input)."""
    p = parse_cabin(col)
    j = F.array_join(p["decks"], "")
    return F.when(p.isNull() | (F.size(p["decks"]) == 0), F.lit(na)).otherwise(j)


def room_count(col) -> Column:
    """Number of rooms; null when the cabin has no rooms."""
    return F.size(parse_cabin(col)["rooms"])


# D7 ------------------------------------------------------------------------
def parse_cabin_simple(col) -> Column:
    """One letter a–g then only digits → struct(letter upper-case, number int); else null."""
    c = _c(col)
    ok = c.rlike(r"^[A-Ga-g][0-9]+$")
    return F.when(ok, F.struct(F.upper(F.regexp_extract(c, r"^([A-Ga-g])", 1)).alias("letter"),
                               F.regexp_extract(c, r"([0-9]+)$", 1).cast("int").alias("number")))


# D8 ------------------------------------------------------------------------
def sum_plus(cols: list, k: int = 0) -> Column:
    return reduce(lambda a, b: a + b, [_c(c) for c in cols]) + F.lit(k)
