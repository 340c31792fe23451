"""Token counts with a public tokenizer, read from a path."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    home = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(home / VOCABULARY)


def encoding(path: str):
    import tiktoken

    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with ``n_tokens`` in place of the text column; null and empty texts have 0."""
    path = path or default_path()
    keep = [c for c in rows.columns if c != text_col]
    schema = _schema(rows, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.select(*keep, F.col(text_col)).mapInArrow(run, schema)


def _schema(rows: DataFrame, keep: list[str]) -> str:
    return ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"])
