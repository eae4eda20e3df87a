"""Where results go: tables as Parquet, payloads as JSON lines, models as XML files. Each part of a result is a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pathloom.sources import model_files


def write_tables(tables: dict[str, DataFrame | None], folder: str, mode: str = "errorifexists") -> list[str]:
    """Each table as Parquet under its name; the names written."""
    done = []
    for name, df in tables.items():
        if df is not None:
            df.write.mode(mode).parquet(f"{folder}/{name}")
            done.append(name)
    return done


def write_payloads(documents: DataFrame, folder: str, column: str = "json", mode: str = "errorifexists") -> None:
    """One JSON text a line, as the reader of payloads takes them."""
    documents.select(column).write.mode(mode).option("compression", "gzip").text(folder)


def write_models(documents: DataFrame, folder: str, key: str = "pathway_id", column: str = "xml", mode: str = "append") -> None:
    """Model documents as XML files, one each; see :mod:`pathloom.sources.model_files`."""
    model_files.write(documents, folder, key, column, mode=mode)
