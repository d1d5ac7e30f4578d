"""Feature synthesis and pruning queries (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import features as FT
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_ORDERS_SQL, labelled_orders, load

PARENTS = ["o_orderpriority", "o_orderstatus", "c_nationkey"]
# sqrt / cbrt keep every mean away from exact decimal rounding ties (both engines round alike).
NUMERIC = ["price_root", "balance_root"]
CATEGORICAL = ["c_mktsegment"]
BOOLEAN = ["fulfilled"]


def dfs_base(spark, sf):
    o = labelled_orders(spark, sf)
    return o.select("o_orderkey", *PARENTS, F.sqrt("o_totalprice").alias("price_root"),
                    F.cbrt("c_acctbal").alias("balance_root"), *CATEGORICAL, (F.col("label") == 1).alias("fulfilled"))


BASE_SQL = (f"(SELECT o_orderkey, {', '.join(PARENTS)}, sqrt(o_totalprice) AS price_root, "
            f"cbrt(c_acctbal) AS balance_root, {', '.join(CATEGORICAL)}, "
            f"label = 1 AS fulfilled FROM {LABELLED_ORDERS_SQL})")

SQL_PRIM = {"sum": "sum({c})", "mean": "avg({c})", "max": "max({c})", "min": "min({c})", "std": "stddev_samp({c})",
            "skew": "skewness({c})", "num_unique": "count(DISTINCT {c})", "percent_true": "avg(CAST({c} AS DOUBLE))"}


def feature_columns():
    cols = []
    for p in PARENTS:
        cols.append(FT.feature_name(p, "count", "rows"))
        for c in NUMERIC:
            cols += [FT.feature_name(p, pr, c) for pr in FT.NUMERIC_PRIMITIVES]
        for c in CATEGORICAL:
            cols += [FT.feature_name(p, pr, c) for pr in FT.CATEGORICAL_PRIMITIVES]
        for c in BOOLEAN:
            cols += [FT.feature_name(p, pr, c) for pr in FT.BOOLEAN_PRIMITIVES]
    return cols


def _dfs_sql():
    ctes, joins, sel = [f"b AS {BASE_SQL}"], [], []
    for i, p in enumerate(PARENTS):
        aggs = [f"count(*) AS {FT.feature_name(p, 'count', 'rows')}"]
        for c in NUMERIC:
            aggs += [f"{SQL_PRIM[pr].format(c=c)} AS {FT.feature_name(p, pr, c)}" for pr in FT.NUMERIC_PRIMITIVES]
        for c in CATEGORICAL:
            aggs.append(f"count(DISTINCT {c}) AS {FT.feature_name(p, 'num_unique', c)}")
        for c in BOOLEAN:
            aggs.append(f"avg(CAST({c} AS DOUBLE)) AS {FT.feature_name(p, 'percent_true', c)}")
        ctes.append(f"g{i} AS (SELECT {p}, {', '.join(aggs)} FROM b GROUP BY {p})")
        for c in CATEGORICAL:
            ctes.append(f"m{i} AS (SELECT {p}, {c} AS {FT.feature_name(p, 'mode', c)} FROM ("
                        f"SELECT {p}, {c}, row_number() OVER (PARTITION BY {p} ORDER BY count(*) DESC, {c}) AS rn "
                        f"FROM b WHERE {c} IS NOT NULL GROUP BY {p}, {c}) WHERE rn = 1)")
            joins.append(f"LEFT JOIN m{i} USING ({p})")
        joins.append(f"LEFT JOIN g{i} USING ({p})")
    for col in feature_columns():
        if "__mode__" in col or "__count__" in col or "__num_unique__" in col:
            sel.append(col)
        else:
            sel.append(f"round({col}, 4) AS {col}")
    return (f"WITH {', '.join(ctes)} SELECT b.o_orderkey, {', '.join(sel)} FROM b " + " ".join(joins))


@register("dfs_orders", _dfs_sql())
def dfs_orders(spark, sf):
    out = FT.dfs(dfs_base(spark, sf), "o_orderkey", PARENTS, numeric=NUMERIC, categorical=CATEGORICAL,
                 boolean=BOOLEAN)
    sel = []
    for col in feature_columns():
        if "__mode__" in col or "__count__" in col or "__num_unique__" in col:
            sel.append(F.col(col))
        else:
            sel.append(F.round(col, 4).alias(col))
    return out.select("o_orderkey", *sel)


DEEP = ["mean", "max", "min", "std"]
DEEP_FEATURES = FT.define_features(PARENTS, NUMERIC, CATEGORICAL, BOOLEAN, depth=2, deep_primitives=DEEP)


def _signed_log(name):
    return f"sign({name}) * ln(1 + abs({name}))"


def _dfs_deep_sql():
    """Depth 2 by the definition: the features of depth 1 on every order, aggregated again by each other parent."""
    one, two = ([f for f in DEEP_FEATURES if f.depth == d] for d in (1, 2))

    def values(table, alias, p, features):
        return [f"{alias}{k} AS (SELECT {p}, {f.child if isinstance(f.child, str) else f.child.name} AS {f.name} FROM (SELECT {p}, {c}, "
                f"row_number() OVER (PARTITION BY {p} ORDER BY count(*) DESC, {c}) AS rn FROM {table} WHERE {c} IS NOT NULL GROUP BY {p}, {c}) WHERE rn = 1)"
                for k, f in enumerate(features) for c in [f.child if isinstance(f.child, str) else f.child.name]]
    ctes, joins, last = [f"b AS {BASE_SQL}"], [], []
    for i, p in enumerate(PARENTS):
        mine = [f for f in one if f.parent == p]
        aggs = [f"count(*) AS {f.name}" if f.child == "rows" else f"{SQL_PRIM[f.primitive].format(c=f.child)} AS {f.name}" for f in mine if not f.categorical]
        ctes.append(f"g{i} AS (SELECT {p}, {', '.join(aggs)} FROM b GROUP BY {p})")
        modes = [f for f in mine if f.categorical]
        ctes += values("b", f"m{i}_", p, modes)
        joins += [f"LEFT JOIN g{i} USING ({p})", *(f"LEFT JOIN m{i}_{k} USING ({p})" for k in range(len(modes)))]
    ctes.append("w AS (SELECT b.*, " + ", ".join(f.name for f in one) + " FROM b " + " ".join(joins) + ")")
    for i, p in enumerate(PARENTS):
        mine = [f for f in two if f.parent == p]
        ctes.append(f"h{i} AS (SELECT {p}, " + ", ".join(f"{SQL_PRIM[f.primitive].format(c=f.child.name)} AS {f.name}" for f in mine if not f.categorical)
                    + f" FROM w GROUP BY {p})")
        modes = [f for f in mine if f.categorical]
        ctes += values("w", f"n{i}_", p, modes)
        last += [f"LEFT JOIN h{i} USING ({p})", *(f"LEFT JOIN n{i}_{k} USING ({p})" for k in range(len(modes)))]
    sel = [f.name if f.categorical else f"round({_signed_log(f.name)}, 6) AS {f.name}" for f in DEEP_FEATURES]
    ctes.append(f"u AS (SELECT DISTINCT {', '.join([*PARENTS, *(f.name for f in one)])} FROM w)")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(PARENTS)}, {', '.join(sel)} FROM u " + " ".join(last)


@register("dfs_depth2_orders", _dfs_deep_sql())
def dfs_depth2_orders(spark, sf):
    """All features up to depth 2, once per combination of parent values."""
    out = FT.dfs(dfs_base(spark, sf), "o_orderkey", PARENTS, numeric=NUMERIC, categorical=CATEGORICAL, boolean=BOOLEAN,
                 depth=2, deep_primitives=DEEP, combinations=True)
    return out.select(*PARENTS, *[F.col(f.name) if f.categorical else F.round(F.expr(_signed_log(f.name)), 6).alias(f.name)
                                  for f in DEEP_FEATURES])


@register("normalize_priority_entity", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def normalize_priority_entity(spark, sf):
    return FT.normalize(load(spark, sf, "orders"), ["o_orderpriority"])["o_orderpriority"]


PRUNE_COLS = ["l_quantity", "l_extendedprice", "qty_x2", "l_discount", "net", "l_tax"]
PRUNE_SQL = """(SELECT l_quantity, l_extendedprice, l_quantity * 2 AS qty_x2, l_discount,
  l_extendedprice * (1 - l_discount) AS net, l_tax FROM lineitem)"""


def prune_base(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 2).alias("qty_x2"), "l_discount",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_tax")


def _pairs_sql(thr, strict):
    op = ">" if strict else ">="
    parts = []
    for i in range(len(PRUNE_COLS)):
        for j in range(i + 1, len(PRUNE_COLS)):
            a, b = PRUNE_COLS[i], PRUNE_COLS[j]
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {PRUNE_SQL}")
    return (f"SELECT a, b, round(r, 4) AS r FROM ({' UNION ALL '.join(parts)}) "
            f"WHERE abs(r) {op} {thr} AND NOT isnan(r)")


@register("collinear_pairs_lineitem", _pairs_sql(0.99, True))
def collinear_pairs_lineitem(spark, sf):
    p = FT.collinear_pairs(prune_base(spark, sf), PRUNE_COLS, 0.99, strict=True)
    return p.select("a", "b", F.round("r", 4).alias("r"))


@register("drop_collinear_lineitem", f"""
SELECT DISTINCT b AS dropped FROM ({_pairs_sql(0.9999, False)})""")
def drop_collinear_lineitem(spark, sf):
    _, dropped = FT.drop_collinear(prune_base(spark, sf), PRUNE_COLS, 0.9999, strict=False)
    return spark.createDataFrame([(d,) for d in dropped], "dropped string")


NONNEG_COLS = ["l_quantity", "l_discount", "disc_centered", "l_tax"]


@register("nonnegative_columns_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS column, bool_and(coalesce({e} >= 0, false)) AS nonnegative FROM lineitem"
    for c, e in zip(NONNEG_COLS, ["l_quantity", "l_discount", "l_discount - 0.05", "l_tax"])))
def nonnegative_columns_lineitem(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("disc_centered", F.col("l_discount") - 0.05)
    return FT.nonnegative_columns(li, NONNEG_COLS)


@register("select_from_model_svm")
def select_from_model_svm(spark, sf):
    base = labelled_orders(spark, sf).select("label", "o_totalprice", "c_acctbal", "c_nationkey")
    return FT.select_from_model(base, ["o_totalprice", "c_acctbal", "c_nationkey"], "label", "linear_svm")


@register("select_from_model_boosted")
def select_from_model_boosted(spark, sf):
    base = labelled_orders(spark, sf).select("label", "o_totalprice", "c_acctbal", "c_nationkey")
    return FT.select_from_model(base, ["o_totalprice", "c_acctbal", "c_nationkey"], "label", "boosted_trees")


@register("final_matrix_customer", """
SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS c_acctbal, c_nationkey FROM customer""")
def final_matrix_customer(spark, sf):
    c = load(spark, sf, "customer")
    return FT.final_matrix(c, "c_custkey", ["c_acctbal"], ["c_nationkey", "c_acctbal"])


@register("select_by_importance_forest")
def select_by_importance_forest(spark, sf):
    base = labelled_orders(spark, sf).select("label", "o_totalprice", "c_acctbal", "c_nationkey")
    return FT.select_from_model(base, ["o_totalprice", "c_acctbal", "c_nationkey"], "label", "forest")
