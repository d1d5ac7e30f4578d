"""Sources and sinks.

Files are listed through the Hadoop FileSystem of the session (works for
HDFS/S3/local alike); reads use explicit schemas where given, writes produce
the usual directory of part files so every executor writes its own share.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.session import ensure_checkpoint_dir

ROLE_KEY = "tabforge.role"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def scratch_dir(spark: SparkSession, name: str = "io") -> str:
    """A fresh folder inside the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabforge-{name}-{uuid.uuid4().hex[:12]}"


# A1 -------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
               encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """CSV with a header row; explicit schema (no inference pass) unless none is given."""
    r = spark.read.option("header", header).option("encoding", encoding).option("sep", sep)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


# A2 / A3 ---------------------------------------------------------------------
def read_tables(spark: SparkSession, directory: str, names: list[str], ext: str = ".csv",
                schemas: dict | None = None, skip_missing: bool = True) -> dict[str, DataFrame]:
    """Named files of a folder; absent ones are skipped (or raise when ``skip_missing`` is False)."""
    out = {}
    for n in names:
        path = f"{directory.rstrip('/')}/{n}{ext}"
        if not exists(spark, path):
            if skip_missing:
                continue
            raise FileNotFoundError(path)
        out[n] = read_table(spark, path, (schemas or {}).get(n))
    return out


def read_dir(spark: SparkSession, directory: str, ext: str = ".csv", schemas: dict | None = None) -> dict[str, DataFrame]:
    """Every ``*<ext>`` entry directly inside ``directory`` keyed by name; other sub-folders are skipped."""
    fs, p = _fs(spark, directory)
    out = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not name.endswith(ext) or name.startswith((".", "_")):
            continue
        key = name[: -len(ext)]
        out[key] = read_table(spark, st.getPath().toString(), (schemas or {}).get(key))
    return out


# A4 -------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> str:
    """Header + rows, no index column; one part file per task. Encoded as ``read_table`` reads by default."""
    df.write.mode(mode).option("header", True).option("encoding", encoding).csv(path)
    return path


# A5 -------------------------------------------------------------------------
def save_features(df: DataFrame, path: str, key: str, features: list[str], label: str | None = None,
                  origin: str | None = None) -> str:
    """Parquet with each column's role (key / label / origin / feature) in its metadata."""
    roles = {key: "key", **({label: "label"} if label else {}), **({origin: "origin"} if origin else {}),
             **{f: "feature" for f in features}}
    cols = [F.col(c).alias(c, metadata={ROLE_KEY: r}) for c, r in roles.items()]
    df.select(*cols).write.mode("overwrite").parquet(path)
    return path


def load_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The table plus {role: [columns]} read back from the column metadata (feature order kept)."""
    df = spark.read.parquet(path)
    roles: dict[str, list[str]] = {}
    for f in df.schema.fields:
        roles.setdefault(f.metadata.get(ROLE_KEY, "other"), []).append(f.name)
    return df, roles


# A6 -------------------------------------------------------------------------
def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def _write_json(spark: SparkSession, value, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_fitted(spark: SparkSession, model, path: str) -> str:
    """Any fitted model of ``operators.models``: a Spark ML model, a weighted ensemble of them, or a table of numbers.

    The folder holds a note of the kind (JSON), and the models or numbers; all of it goes through Spark's writers.
    """
    if isinstance(model, dict):  # linear discriminants, naive Bayes
        numbers = {k: [x.tolist() if hasattr(x, "tolist") else x for x in v] if isinstance(v, list) else v for k, v in model.items()}
        _write_json(spark, {"kind": "numbers", "model": numbers}, f"{path}/note")
    elif hasattr(model, "members"):  # an ensemble
        for k, (m, _) in enumerate(model.members):
            m.write().overwrite().save(f"{path}/member-{k}")
        _write_json(spark, {"kind": "ensemble", "weights": [w for _, w in model.members], "classes": model.classes,
                            "type": f"{type(model.members[0][0]).__module__}.{type(model.members[0][0]).__name__}"}, f"{path}/note")
    else:
        model.write().overwrite().save(f"{path}/model")
        _write_json(spark, {"kind": "ml", "type": f"{type(model).__module__}.{type(model).__name__}"}, f"{path}/note")
    return path


#: Where a saved model's class may come from.
MODEL_MODULES = ("pyspark.ml.", "tabforge.operators.")


def load_fitted(spark: SparkSession, path: str):
    """What ``save_fitted`` wrote."""
    import importlib
    note = json.loads(spark.read.text(f"{path}/note").first()["value"])
    if note["kind"] == "numbers":
        return note["model"]
    module, name = note["type"].rsplit(".", 1)
    if not f"{module}.".startswith(MODEL_MODULES):
        raise ValueError(f"not a model class: {note['type']}")
    cls = getattr(importlib.import_module(module), name)
    if note["kind"] == "ml":
        return cls.load(f"{path}/model")
    from tabforge.operators.models import Ensemble
    return Ensemble([(cls.load(f"{path}/member-{k}"), w) for k, w in enumerate(note["weights"])], note["classes"])


# A7 -------------------------------------------------------------------------
def read_xy(spark: SparkSession, path: str, sep: str = ",", target: str = "target") -> DataFrame:
    """Delimited numeric table: every column cast to double, ``target`` renamed ``target``."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(*[F.col(c).try_cast("double").alias("target" if c == target else c) for c in raw.columns])
