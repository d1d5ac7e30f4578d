"""Formula population queries (N*) over lineitem (label: returned)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions import symbolic as N
from tabforge.operators import symbolic as NS
from tabforge.plans.registry import register
from tabforge.plans.tables import load
from tabforge.session import ensure_checkpoint_dir

FEATURES = ["x1", "x2", "x3"]
POP = N.population(FEATURES, 40, seed=5, max_depth=4)


def data(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x1"),
                     (F.col("l_discount") * 10).alias("x2"), (F.col("l_tax") * 10).alias("x3"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


DATA_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3,
  CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""


def to_sql(t) -> str:
    """The same formula as DuckDB SQL (oracle side only)."""
    op = t[0]
    if op == "var":
        return t[1]
    if op == "const":
        return f"CAST({float(t[1])!r} AS DOUBLE)"
    if op in ("true", "false"):
        return op.upper()
    a = [to_sql(x) for x in t[1:]]
    return {
        "and": lambda: f"({a[0]} AND {a[1]})", "or": lambda: f"({a[0]} OR {a[1]})", "not": lambda: f"(NOT {a[0]})",
        "lt": lambda: f"({a[0]} < {a[1]})", "eq": lambda: f"({a[0]} = {a[1]})",
        "ifte": lambda: f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)",
        "add": lambda: f"({a[0]} + {a[1]})", "sub": lambda: f"({a[0]} - {a[1]})", "mul": lambda: f"({a[0]} * {a[1]})",
        "pdiv": lambda: f"(CASE WHEN {a[1]} = 0 THEN CAST(1 AS DOUBLE) ELSE {a[0]} / {a[1]} END)",
        "neg": lambda: f"(-{a[0]})", "tanh": lambda: f"tanh({a[0]})", "cos": lambda: f"cos({a[0]})",
        "sin": lambda: f"sin({a[0]})", "max": lambda: f"greatest({a[0]}, {a[1]})", "min": lambda: f"least({a[0]}, {a[1]})",
    }[op]()


def _score_sql():
    parts = []
    for i, t in enumerate(POP):
        s = to_sql(t)
        parts.append(
            f"SELECT {i} AS id, '{N.to_text(t)}' AS formula, "
            f"CAST(sum(CAST(CAST((1e-15 + 1 / (1 + exp(-({s})))) > 0.5 AS INTEGER) = label AS BIGINT)) AS BIGINT) AS correct, "
            f"round(avg(greatest({s}, 0) + ln(1 + exp(-abs({s}))) - label * ({s})), 4) AS cross_entropy FROM {DATA_SQL}")
    return " UNION ALL ".join(parts)


SCORE_SQL = _score_sql()


def scored(spark, sf):
    return NS.score_population(data(spark, sf), POP, "label", batch=25)


def scored_table(spark, sf):
    """The scored population written once to the shared checkpoint folder (it feeds several passes)."""
    ensure_checkpoint_dir(spark)
    return scored(spark, sf).withColumn("cross_entropy", F.round("cross_entropy", 4)).checkpoint(eager=True)


@register("score_population_lineitem", SCORE_SQL)
def score_population_lineitem(spark, sf):
    return scored(spark, sf).withColumn("id", F.col("id").cast("int")).withColumn(
        "cross_entropy", F.round("cross_entropy", 4))


@register("pareto_front_population", f"""
WITH s AS ({SCORE_SQL})
SELECT id, correct, cross_entropy FROM s a WHERE NOT EXISTS (
  SELECT 1 FROM s b WHERE b.correct >= a.correct AND b.cross_entropy <= a.cross_entropy
                      AND (b.correct > a.correct OR b.cross_entropy < a.cross_entropy))""")
def pareto_front_population(spark, sf):
    s = scored_table(spark, sf)
    return NS.pareto_front(s, "correct", "cross_entropy").select(F.col("id").cast("int").alias("id"), "correct",
                                                                 "cross_entropy")


@register("pareto_rank_population", f"""
WITH RECURSIVE s AS ({SCORE_SQL}),
     d AS (SELECT a.id AS above, b.id AS below FROM s a JOIN s b ON a.correct >= b.correct AND a.cross_entropy <= b.cross_entropy
           AND (a.correct > b.correct OR a.cross_entropy < b.cross_entropy)),
     r AS (SELECT id, 1 AS front FROM s UNION SELECT d.below AS id, r.front + 1 AS front FROM r JOIN d ON d.above = r.id)
SELECT id, correct, cross_entropy, CAST(max(front) AS INTEGER) AS front FROM r JOIN s USING (id) GROUP BY ALL""")
def pareto_rank_population(spark, sf):
    s = scored_table(spark, sf)
    return NS.pareto_rank(s, "id", "correct", "cross_entropy").select(F.col("id").cast("int").alias("id"), "correct", "cross_entropy", "front")


EVAL = POP


@register("evaluate_formulas_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({to_sql(t)}, 6) + 0.0 AS f{i}" for i, t in enumerate(EVAL)) + f" FROM {DATA_SQL}")
def evaluate_formulas_lineitem(spark, sf):
    d = data(spark, sf)
    # formulas round-trip through their text form, as saved populations do
    cols = [N.to_column(N.from_text(N.to_text(t))) for t in EVAL]
    return d.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(f"f{i}") for i, c in enumerate(cols)])
