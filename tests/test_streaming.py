from pyspark.sql import functions as F

from tabforge.functions import columns as C
from tabforge.streaming.features import apply_rules, read_parquet_stream, write_parquet_stream

from tests.conftest import SF_SMALL


def test_rules_run_on_a_stream(spark, tmp_path):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    src = str(tmp_path / "src")
    orders.repartition(3).write.parquet(src)
    stream = read_parquet_stream(spark, src, orders.schema)
    ticket = F.concat(F.lit("A/5. "), F.col("o_orderkey").cast("string"))
    out = apply_rules(stream, {"tkt_num": C.parse_ticket(ticket)["number"],
                               "prio_flag": C.flag(F.col("o_orderpriority") == "1-URGENT")},
                      keep=["o_orderkey"])
    q = write_parquet_stream(out, str(tmp_path / "out"), "test_rules")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == orders.count()
    assert got.where(F.col("tkt_num") != F.col("o_orderkey")).count() == 0
