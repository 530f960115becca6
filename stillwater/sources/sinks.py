"""Files of results: parquet, CSV and JSON sinks and their readers, settings, and queries that write and read them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from stillwater.operators import evaluation, reports
from stillwater.sources import stored


def write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Training rows or out-of-fold scores as parquet, in folders by a column where one is named."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_scores(spark: SparkSession, path: str, needed: tuple[str, ...] = ("id", "t", "y")) -> DataFrame:
    """Scores from parquet; columns that are missing are an error."""
    rows = spark.read.parquet(path)
    if missing := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def write_table(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by its schema (no pass over the file to guess it); columns are taken by position."""
    return spark.read.option("header", True).schema(schema).csv(path)


def kept_or_made(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    """The table at `path` if it is there and has the schema's columns; else make() is written there and read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        header = spark.read.option("header", True).csv(path).columns
        if set(header) >= {part.split()[0] for part in schema.split(",")}:
            return read_table(spark, path, schema)
    write_table(make(), path)
    return read_table(spark, path, schema)


def write_results(rows: DataFrame, path: str) -> None:
    """Results as JSON, one object a line."""
    rows.write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings of a JSON or YAML file over nested defaults; a key that the defaults lack is an error."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ValueError("YAML settings need the yaml package; JSON needs nothing") from error
        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)

    def over(base: dict, new: dict, at: str) -> dict:
        out = dict(base)
        for k, v in new.items():
            if k not in base:
                raise ValueError(f"unknown setting {at}{k}")
            out[k] = over(base[k], v, f"{at}{k}.") if isinstance(base[k], dict) and isinstance(v, dict) else v
        return out

    return over(defaults, given, "")


def _path(spark: SparkSession, name: str) -> str:
    return f"{stored.shared_dir(spark)}/sinks/{name}-{uuid.uuid4().hex[:12]}"


_SCORES = "select id, t, y, bucket, score_a as oof_pred from scores"


def scores_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "scores")
    write_rows(stored.run(spark, sf_dir, _SCORES), path, "bucket")
    return read_scores(spark, path).select("id", "t", "y", "bucket", "oof_pred")


def census_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, schema = reports.QUERIES["census"][1], "id long, tau_index int, n_pre long, n_post long, " + ", ".join(f"{c} double" for c in (*reports.DELTAS, "ar_r2"))
    path = _path(spark, "census")
    make = lambda: stored.run(spark, sf_dir, body, reports.CENSUS)
    kept_or_made(spark, path, schema, make)
    return kept_or_made(spark, path, schema, make)  # the second call reads what the first wrote


def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    more, body = evaluation.QUERIES["ts_auc_bucket"]
    path = _path(spark, "results")
    write_results(stored.run(spark, sf_dir, body, more), path)
    return spark.read.schema("bucket string, ts_auc double, weight long").json(path)


QUERIES = {"scores_round_trip": scores_round_trip, "census_round_trip": census_round_trip, "results_round_trip": results_round_trip}
ORACLE = {"scores_round_trip": ("", _SCORES), "census_round_trip": reports.QUERIES["census"], "results_round_trip": evaluation.QUERIES["ts_auc_bucket"]}
