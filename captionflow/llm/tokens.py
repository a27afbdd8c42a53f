"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionflow.session import spread

#: Folder of the public vocabulary files; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabulary cuts text before merging (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    path = f"{folder}/{name}"
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count(text: str | None, folder: str = TOKENIZERS) -> int:
    return len(encoder(folder).encode_ordinary(text)) if text else 0


def token_counts(df: DataFrame, id_col: str, text: str, keep: tuple[str, ...] = (), folder: str = TOKENIZERS) -> DataFrame:
    """(id, *keep, n_tokens); null and empty texts have 0 tokens, strings of special tokens count as ordinary text."""
    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text).alias("_text"))
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sizes, pa.int64())], names=[*kept, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*kept).schema)
    return spread(chosen, "doc_id").mapInArrow(run, f"{fields}, n_tokens long")
