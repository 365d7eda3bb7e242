"""Token counts of whole texts with a public tokenizer; its file is a parameter and never part of this repository."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@functools.cache
def encoder(path: str):
    """Function from a list of texts to their token counts, by the kind of file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        try:
            from public_tokenizers import PATTERN
        except ImportError:
            PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def with_tokens(df: DataFrame, text: str, keep: list, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and n_tokens of the whole text; null text counts 0. Texts go to Python in small batches."""
    slim = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes[:-1]) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for b in batches:
            texts = [t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if t else "" for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count(texts), pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return slim.mapInArrow(run, schema)
