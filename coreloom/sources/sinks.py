"""Writers for result and feature tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """A small result table (rows per feature or class) as one headed CSV part."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feature_log_path(folder: str, suffix: str = "") -> str:
    """``feature_similarity_logs.csv``, or with a suffix such as ``pca`` or a node count."""
    tail = f"_{suffix}" if suffix else ""
    return f"{folder.rstrip('/')}/feature_similarity_logs{tail}.csv"


def flat_table(df: DataFrame, width: int, label: str = "label", label_name: str = "Value") -> DataFrame:
    """``features`` array to columns ``0..width-1`` followed by the label."""
    cells = [F.get("features", F.lit(i)).alias(str(i)) for i in range(width)]
    return df.select(*cells, F.col(label).alias(label_name))


def export_datasets(
    tables: Mapping[str, DataFrame],
    folder: str,
    widths: Mapping[str, int],
    label: str = "label",
    label_name: str = "Value",
    file_format: str = "csv",
) -> dict[str, str]:
    """Write each table under ``folder/<name>.<format>`` and return the paths."""
    paths = {}
    for name, table in tables.items():
        path = f"{folder.rstrip('/')}/{name}.{file_format}"
        writer = flat_table(table, widths[name], label, label_name).write.mode("overwrite")
        if file_format == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(file_format).save(path)
        paths[name] = path
    return paths


def export_for_tsne(full: DataFrame, core: DataFrame, stratified: DataFrame, folder: str, width: int, label: str = "label") -> dict[str, str]:
    """The three tables an external embedding tool reads, each with a ``label`` column."""
    tables = {"full_dataset": full, "core_dataset": core, "stratified_core_dataset": stratified}
    return export_datasets(tables, folder, dict.fromkeys(tables, width), label, "label")
