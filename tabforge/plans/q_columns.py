"""Scalar-rule queries (C*, D*) over strings and numbers built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions import columns as C
from tabforge.plans.registry import register
from tabforge.plans.tables import MASKED_EVENTS_SQL, load, masked_events


def r4(c):
    return F.round(c, 4)


def sql_str_list(xs):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


# --- synthetic passenger names from customer (D1–D3) ----------------------
NAME_WORDS = C.TITLES_WITH_DONA + ["Nobody"]


def names(spark, sf):
    c = load(spark, sf, "customer")
    word = F.element_at(F.array(*[F.lit(w) for w in NAME_WORDS]), (F.col("c_custkey") % len(NAME_WORDS) + 1).cast("int"))
    return c.select("c_custkey", F.concat(F.lit("Fam"), F.col("c_custkey") % 97, F.lit(", "), word,
                                          F.lit(" X")).alias("name"))


NAMES_SQL = (f"(SELECT c_custkey, concat('Fam', c_custkey % 97, ', ', "
             f"[{sql_str_list(NAME_WORDS)}][c_custkey % {len(NAME_WORDS)} + 1], ' X') AS name FROM customer)")


def _title_case(col, tokens):
    return "CASE " + " ".join(f"WHEN position('{t}' IN {col}) > 0 THEN '{t}'" for t in tokens) + " END"


def _map_case(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@register("title_names", f"""
SELECT c_custkey, name, {_title_case('name', C.TITLES_WITH_DONA)} AS title,
       {_title_case('name', C.TITLES)} AS title_short,
       {_map_case(f"coalesce({_title_case('name', C.TITLES_WITH_DONA)}, 'nan')", C.TITLE_GROUPS)} AS title_group,
       split_part(name, ',', 1) AS family
FROM {NAMES_SQL}""")
def title_names(spark, sf):
    n = names(spark, sf)
    return n.select("c_custkey", "name", C.title("name").alias("title"),
                    C.title("name", with_dona=False).alias("title_short"),
                    C.title_group(C.title("name")).alias("title_group"), C.family_name("name").alias("family"))


# --- tickets from orders (D4) ----------------------------------------------
TICKET_PREFIXES = ["A/5. ", "STON/O 2. ", "PC ", "", "S.O./P.P. ", "SC/A.3 ", "W./C. "]


def tickets(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    pre = F.element_at(F.array(*[F.lit(p) for p in TICKET_PREFIXES]), (k % len(TICKET_PREFIXES) + 1).cast("int"))
    t = (F.when(k % 11 == 3, F.lit("LINE")).when(k % 13 == 5, F.lit("A/5 X"))
          .otherwise(F.concat(pre, k.cast("string"))))
    return o.select("o_orderkey", t.alias("ticket"))


TICKETS_SQL = (f"(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 3 THEN 'LINE' WHEN o_orderkey % 13 = 5 THEN 'A/5 X' "
               f"ELSE concat([{sql_str_list(TICKET_PREFIXES)}][o_orderkey % {len(TICKET_PREFIXES)} + 1], "
               f"CAST(o_orderkey AS VARCHAR)) END AS ticket FROM orders)")


@register("parse_ticket_orders", f"""
WITH t AS (SELECT o_orderkey, ticket, trim(ticket) AS s,
                  string_split(trim(regexp_replace(ticket, '[./]', '', 'g')), ' ') AS pieces FROM {TICKETS_SQL})
SELECT o_orderkey, ticket,
  CASE WHEN regexp_full_match(s, '[0-9]+') THEN NULL WHEN regexp_full_match(s, '[A-Za-z]+') THEN s
       WHEN TRY_CAST(pieces[-1] AS BIGINT) IS NOT NULL THEN array_to_string(pieces[1:len(pieces) - 1], '') END AS header,
  CASE WHEN regexp_full_match(s, '[0-9]+') THEN TRY_CAST(s AS BIGINT) WHEN regexp_full_match(s, '[A-Za-z]+') THEN 0
       ELSE TRY_CAST(pieces[-1] AS BIGINT) END AS number
FROM t""")
def parse_ticket_orders(spark, sf):
    t = tickets(spark, sf)
    p = C.parse_ticket("ticket")
    return t.select("o_orderkey", "ticket", p["header"].alias("header"), p["number"].alias("number"))


# --- cabins from lineitem (D5–D7) --------------------------------------------
def cabins(spark, sf):
    li = load(spark, sf, "lineitem")
    letter = F.element_at(F.array(*[F.lit(d) for d in C.DECKS]), (F.col("l_suppkey") % 8 + 1).cast("int"))
    num = (F.col("l_partkey") % 60).cast("string")
    num2 = (F.col("l_partkey") % 60 + 2).cast("string")
    kind = F.col("l_partkey") % 4
    cab = (F.when(F.col("l_orderkey") % 5 != 0, F.lit(None).cast("string"))
            .when(kind == 0, letter)
            .when(kind == 1, F.concat(letter, num))
            .when(kind == 2, F.concat(F.lit("F "), letter, num))
            .otherwise(F.concat(letter, num, F.lit(" "), letter, num2)))
    return li.select("l_orderkey", "l_linenumber", cab.alias("cabin"))


CABINS_SQL = f"""(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN NULL
  WHEN l_partkey % 4 = 0 THEN [{sql_str_list(C.DECKS)}][l_suppkey % 8 + 1]
  WHEN l_partkey % 4 = 1 THEN concat([{sql_str_list(C.DECKS)}][l_suppkey % 8 + 1], CAST(l_partkey % 60 AS VARCHAR))
  WHEN l_partkey % 4 = 2 THEN concat('F ', [{sql_str_list(C.DECKS)}][l_suppkey % 8 + 1], CAST(l_partkey % 60 AS VARCHAR))
  ELSE concat([{sql_str_list(C.DECKS)}][l_suppkey % 8 + 1], CAST(l_partkey % 60 AS VARCHAR), ' ',
              [{sql_str_list(C.DECKS)}][l_suppkey % 8 + 1], CAST(l_partkey % 60 + 2 AS VARCHAR)) END AS cabin
  FROM lineitem)"""


@register("parse_cabin_lineitem", f"""
WITH c AS (SELECT l_orderkey, l_linenumber, cabin,
                  list_sort(list_distinct(regexp_extract_all(cabin, '([ABCDEFGT])', 1))) AS decks,
                  trim(regexp_replace(cabin, '[ABCDEFGT]', '', 'g')) AS rest FROM {CABINS_SQL}),
     p AS (SELECT *, CASE WHEN regexp_full_match(rest, '[0-9]+( +[0-9]+)*')
                          THEN list_transform(string_split_regex(rest, ' +'), lambda x: CAST(x AS INTEGER)) END AS rooms
           FROM c)
SELECT l_orderkey, l_linenumber, cabin, CASE WHEN cabin IS NULL THEN NULL ELSE decks END AS decks,
       CASE WHEN cabin IS NULL THEN NULL ELSE rooms END AS rooms,
       CASE WHEN cabin IS NULL OR len(decks) = 0 THEN 'N/A' ELSE array_to_string(decks, '') END AS deck,
       CAST(len(rooms) AS INTEGER) AS n_rooms,
       CASE WHEN regexp_full_match(cabin, '[A-Ga-g][0-9]+') THEN upper(cabin[1]) END AS letter,
       CASE WHEN regexp_full_match(cabin, '[A-Ga-g][0-9]+') THEN CAST(cabin[2:] AS INTEGER) END AS number
FROM p""")
def parse_cabin_lineitem(spark, sf):
    c = cabins(spark, sf)
    p = C.parse_cabin("cabin")
    s = C.parse_cabin_simple("cabin")
    return c.select("l_orderkey", "l_linenumber", "cabin", p["decks"].alias("decks"), p["rooms"].alias("rooms"),
                    C.deck_label("cabin").alias("deck"), C.room_count("cabin").alias("n_rooms"),
                    s["letter"].alias("letter"), s["number"].alias("number"))


# --- family size and flags (D8, D9, C10) ---------------------------------------
FAMILY_SQL = ("(SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS sibsp, "
              "CAST(round(l_discount * 100) AS INTEGER) % 3 AS parch FROM lineitem)")


@register("family_flags_lineitem", f"""
SELECT l_orderkey, l_linenumber, sibsp + parch + 1 AS family_size,
  CASE WHEN sibsp + parch + 1 = 1 THEN 1 ELSE 0 END AS Single,
  CASE WHEN sibsp + parch + 1 = 2 THEN 1 ELSE 0 END AS SmallF,
  CASE WHEN sibsp + parch + 1 BETWEEN 3 AND 4 THEN 1 ELSE 0 END AS MedF,
  CASE WHEN sibsp + parch + 1 >= 5 THEN 1 ELSE 0 END AS LargeF
FROM {FAMILY_SQL}""")
def family_flags_lineitem(spark, sf):
    li = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("sibsp"),
        (F.round(F.col("l_discount") * 100).cast("int") % 3).alias("parch"))
    fam = C.sum_plus(["sibsp", "parch"], 1)
    return li.select("l_orderkey", "l_linenumber", fam.alias("family_size"),
                     *[v.alias(k) for k, v in C.range_flags(fam, C.FAMILY_FLAGS).items()])


# --- casts, nulls, maps, sentinels, scalar math (C5, C7–C13) -------------------------
@register("scalar_rules_lineitem", """
SELECT l_orderkey, l_linenumber,
  CAST(trunc(l_extendedprice) AS INTEGER) AS price_int,
  NULLIF(l_linenumber, 1) AS linenumber_or_null,
  CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status_code,
  CAST(l_returnflag = 'R' AS INTEGER) AS returned,
  CAST(CAST(l_returnflag = 'R' AS INTEGER) AS BOOLEAN) AS returned_bool,
  round(ln(1 + l_extendedprice), 4) AS log_price,
  round(1 / (1 + exp(-(l_quantity / 10 - 2.5))), 4) AS sig,
  round(CASE WHEN l_quantity / 10 - 2.5 >= 0 THEN 1 / (1 + exp(-(l_quantity / 10 - 2.5)))
             ELSE exp(l_quantity / 10 - 2.5) / (1 + exp(l_quantity / 10 - 2.5)) END, 4) AS sig_stable
FROM lineitem""")
def scalar_rules_lineitem(spark, sf):
    li = load(spark, sf, "lineitem")
    x = F.col("l_quantity") / 10 - 2.5
    casted = C.cast_cols(li.withColumn("_price", F.col("l_extendedprice")), {"l_extendedprice": "int"})
    return casted.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price_int"),
        C.replace_value("l_linenumber", 1).alias("linenumber_or_null"),
        C.map_values("l_linestatus", {"F": 0, "O": 1}, strict=True).alias("status_code"),
        C.flag(F.col("l_returnflag") == "R").alias("returned"),
        C.to_bool(C.flag(F.col("l_returnflag") == "R")).alias("returned_bool"),
        r4(C.log1p("_price")).alias("log_price"),
        r4(C.sigmoid(x)).alias("sig"), r4(C.stable_sigmoid(x)).alias("sig_stable"))


@register("normalize_nulls_events", f"""
SELECT event_id, value, value IS NULL AS missing FROM {MASKED_EVENTS_SQL}""")
def normalize_nulls_events(spark, sf):
    e = masked_events(spark, sf).select("event_id", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    n = C.normalize_nulls(e)
    return n.select("event_id", "value", F.col("value").isNull().alias("missing"))


@register("string_rules_part", """
SELECT p_partkey, lower(p_type) AS type_lower, CAST(strpos(p_name, ' ') AS INTEGER) AS first_blank,
  substring(p_brand, 7, 2) AS brand_no, contains(p_name, 'green') AS is_green,
  regexp_full_match(substring(p_brand, 7), '[0-9]+') AS brand_numeric,
  regexp_full_match(p_type, '[A-Za-z]+') AS type_alpha,
  array_to_string(string_split(p_name, ' ')[1:2], '_') AS name_head, trim('  ' || p_type || ' ') AS trimmed,
  replace(p_brand, '#', '-') AS brand_dash
FROM part""")
def string_rules_part(spark, sf):
    p = load(spark, sf, "part")
    return p.select(
        "p_partkey", F.lower("p_type").alias("type_lower"), F.locate(" ", "p_name").alias("first_blank"),
        F.substring("p_brand", 7, 2).alias("brand_no"), F.col("p_name").contains("green").alias("is_green"),
        F.substring("p_brand", 7, 100).rlike("^[0-9]+$").alias("brand_numeric"),
        F.col("p_type").rlike("^[A-Za-z]+$").alias("type_alpha"),
        F.array_join(F.slice(F.split("p_name", " "), 1, 2), "_").alias("name_head"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"),
        F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand_dash"))


@register("standardize_by_flag", """
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w, 4) AS z_qty,
  round((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w, 4) AS z_price
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def standardize_by_flag(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity",
                                            "l_extendedprice")
    z = C.standardize(li, ["l_quantity", "l_extendedprice"], by="l_returnflag", suffix="_z")
    return z.select("l_orderkey", "l_linenumber", r4("l_quantity_z").alias("z_qty"),
                    r4("l_extendedprice_z").alias("z_price"))


@register("standardize_global", """
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
                          / (SELECT stddev_samp(o_totalprice) FROM orders), 4) AS z_price FROM orders""")
def standardize_global(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.standardize(o, ["o_totalprice"]).select("o_orderkey", r4("o_totalprice").alias("z_price"))


@register("frobenius_scale_lineitem", """
WITH n AS (SELECT sqrt(sum(l_quantity * l_quantity) + sum(l_discount * l_discount) + sum(l_tax * l_tax)) AS nrm
           FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity / nrm, 6) AS q, round(l_discount / nrm, 6) AS d,
       round(l_tax / nrm, 6) AS t FROM lineitem, n""")
def frobenius_scale_lineitem(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    s = C.frobenius_scale(li, ["l_quantity", "l_discount", "l_tax"])
    return s.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("q"),
                    F.round("l_discount", 6).alias("d"), F.round("l_tax", 6).alias("t"))


@register("select_drop_rename_filter_orders", """
SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderpriority AS priority FROM orders
WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 50000 AND 250000 AND o_orderpriority IS NOT NULL""")
def select_drop_rename_filter_orders(spark, sf):
    o = load(spark, sf, "orders")
    picked = o.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey")  # C1
    kept = picked.where(F.col("o_orderstatus").isin("F", "P")  # C4: in-set, range, not-null
                        & F.col("o_totalprice").between(50000, 250000) & F.col("o_orderpriority").isNotNull())
    dropped = kept.drop("o_orderstatus", "o_custkey")  # C2
    return dropped.withColumnsRenamed({"o_orderkey": "order_id", "o_totalprice": "price",  # C3
                                       "o_orderpriority": "priority"})
