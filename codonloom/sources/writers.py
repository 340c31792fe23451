"""Sinks: JSON lines, JSON arrays, FASTA, CSV profiles and safe replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_fasta(rows: DataFrame, id_col: str, seq_col: str, path: str) -> None:
    """``>id`` and sequence lines of the rows that have a sequence."""
    rows.filter(F.length(seq_col) > 0).select(F.concat_ws("\n", F.concat(F.lit(">"), F.col(id_col)), F.col(seq_col)).alias("value")).write.mode("overwrite").text(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """Files that are JSON arrays each, one per partition: written in streams, never gathered."""

    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            out = []
            for text in b.column("j").to_pylist():
                out.append(("[" if first else ",") + text)
                first = False
            yield pa.RecordBatch.from_pydict({"value": out})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; the named columns with fixed decimals."""
    out = rows.withColumns({c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in (decimals or {}).items()})
    out.write.mode("overwrite").option("header", True).csv(path)


def replace_table(rows: DataFrame, path: str, write=write_jsonl) -> None:
    """Write beside ``path``, then rename over it, so that a table read by ``rows`` can be
    replaced by them and a failed write leaves it as it was."""
    spark = rows.sparkSession
    new = f"{path}.{uuid.uuid4().hex}.new"
    old = f"{path}.{uuid.uuid4().hex}.old"
    write(rows, new)
    if files.exists(spark, path):
        files.move(spark, path, old)
    files.move(spark, new, path)
    if files.exists(spark, old):
        files.remove(spark, old)


def bundle_to_json(bundle: Column) -> Column:
    return F.to_json(bundle)
