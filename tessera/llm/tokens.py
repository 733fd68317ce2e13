"""Token counts with a public tokenizer, loaded once per Python worker."""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts a text into pieces before the byte pairs of this vocabulary are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str) -> Callable[[str], int]:
    """A function that counts a text's tokens; `path` is a ranks file of tiktoken, a tokenizers or a sentencepiece file."""
    known = sys.__dict__.setdefault("_token_counters", {})
    if path not in known:
        known[path] = _load(path)
    return known[path]


def _load(path: str) -> Callable[[str], int]:
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(processor.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def with_tokens(df: DataFrame, text: str, carry: dict[str, Column], path: str = DEFAULT, lead: bool = False) -> DataFrame:
    """The columns `carry` and `tokens`, the number of tokens of the whole text (0 for NULL or empty).

    With `lead`, also `lead_tokens`: those of the first paragraph (up to the first blank line), if others follow, else 0.
    """
    rows = df.select(*[c.alias(n) for n, c in carry.items()], F.col(text).alias("text_"))
    added = ["tokens", "lead_tokens"] if lead else ["tokens"]
    fields = [f for f in rows.schema.fields if f.name != "text_"]
    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in added]])

    def work(batches):
        count = counter(path)
        for batch in batches:
            texts = batch.column("text_").to_pylist()
            new = [pa.array([count(t) if t else 0 for t in texts], pa.int64())]
            if lead:
                cut = [t.find("\n\n") if t else -1 for t in texts]
                new.append(pa.array([count(t[:i]) if i > 0 and t[i:].strip() else 0 for t, i in zip(texts, cut, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *new], [*[f.name for f in fields], *added])

    return rows.mapInArrow(work, schema)
