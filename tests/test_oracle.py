"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import duckdb
import pytest

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

FAST = ["group_report_segment", "null_counts_events_masked", "describe_lineitem", "value_counts_mktsegment",
        "title_names", "parse_ticket_orders", "parse_cabin_lineitem", "cut_part_size", "qcut_extendedprice",
        "cat_codes_part_type", "dummies_pooled_quantity", "union_origin_customer", "value_sets_nations",
        "histogram_price_by_label", "kde_discount_by_label", "corr_matrix_lineitem", "ewm_events_value_fast",
        "trim_events", "split_orders_exact", "stratified_folds_orders", "auc_price_score",
        "knn_impute_balance", "dfs_orders", "robust_scale_lineitem", "anova_f_lineitem",
        "score_population_lineitem", "bernoulli_nb_lineitem", "soft_vote_orders", "csv_roundtrip_customer"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(dcols)
    assert _rows(cols, rows) == _rows(dcols, rel.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    # The corpus operators' queries are there exactly if their optional subpackage is.
    corpus = [n for n in qs if n.lower().startswith("op") or "pipeline" == n]
    assert len(corpus) == (0 if E.llm is None else 14)
