"""The notebook flow end to end on orders: split → union with origin → parse/bin/encode → impute → DFS →
two models → soft vote → submission (rows-checked; every step is a registered operator)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabforge.functions import columns as C
from tabforge.operators import combine as J
from tabforge.operators import encode as E
from tabforge.operators import features as FT
from tabforge.operators import impute as I
from tabforge.operators import models as L
from tabforge.operators import validate as V
from tabforge.plans.bounded import settled
from tabforge.plans.registry import register
from tabforge.plans.tables import labelled_orders


@register("classification_flow_orders")
def classification_flow_orders(spark, sf):
    # Every step reads rows that are written once: the join with the customers and the estimates are not sent out again.
    o = settled(labelled_orders(spark, sf).select(
        "o_orderkey", "label", "o_totalprice", "o_orderpriority", "c_mktsegment", "c_nationkey",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal")))
    parts = V.split(o, "o_orderkey", 0.8, seed=1)
    train = parts.where(F.col("part") == "train").drop("part")
    test = parts.where(F.col("part") == "test").drop("part", "label")
    data = J.union_origin(train, test)                                                # F1
    data = data.withColumns({"price_bin": E.floor_bin(F.col("o_totalprice") / 1000, 50),  # E1
                             "prio": C.map_values(F.substring("o_orderpriority", 1, 1),
                                                  {str(i): i for i in range(1, 6)})})  # C8
    data = E.cat_codes(data, "c_mktsegment", name="seg")                               # E6
    data = I.knn_impute(data, "o_orderkey", "c_acctbal", ["c_nationkey", "seg", "price_bin"], k=5)  # I2
    data = FT.dfs(settled(data), "o_orderkey", ["c_nationkey"], numeric=["o_totalprice", "c_acctbal"])  # J3
    feats = ["price_bin", "prio", "seg", "c_acctbal", "c_nationkey__mean__o_totalprice",
             "c_nationkey__mean__c_acctbal"]
    tr, te = J.split_origin(settled(data.select("o_orderkey", "label", "origin", *feats)), "label")  # F2
    tr = L.with_label(tr, "label")
    probs, scores = [], []
    for name, est in [("forest", L.forest(numTrees=20, maxDepth=5, seed=0)), ("logreg", L.logreg(maxIter=20))]:
        m = L.assembled(est, feats).fit(tr)                                             # L3, L1
        probs.append(m.transform(te).select(F.col("o_orderkey").alias("key"), F.lit(name).alias("model"),
                                            vector_to_array("probability")[1].alias("p")))
        scores.append(V.accuracy(m.transform(tr), "label", "prediction")
                       .select(F.lit(name).alias("model"), F.col("accuracy").alias("score")))
    vote = L.soft_vote(probs[0].unionByName(probs[1]), scores[0].unionByName(scores[1]), power=100)  # L14
    return V.submission(vote, "key", "prediction", key_name="o_orderkey", label_name="label")        # M14
