"""Token counts by a public tokenizer: Arrow batches encoded in parts of about equal bytes; only lengths come back.

A text longer than PART bytes is split where a token boundary is certain: between a character that isn't white space and
a space, tab or line feed after it, for no pre-token has white space anywhere but at its start. Texts without such places stay whole.
Null counts as empty: 0 bytes, 0 tokens.
"""
from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

PART, BATCH, LIMIT = 1 << 16, 1 << 20, 512
_EDGE = re.compile(r"(?<=\S)(?=[ \t\n])")
_held: dict = {}


def tokenizer(path: str):
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _held[path] = t
    return _held[path]


def parts(text: str, most: int = PART):
    """The text in pieces of about `most` characters that encode as the whole does."""
    at = 0
    while len(text) - at > most:
        edge = _EDGE.search(text, at + most)
        if edge is None:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:] if at else text


def lengths(texts: list[str], path: str) -> list[int]:
    t, out, held, size = tokenizer(path), [0] * len(texts), [], 0

    def flush():
        encode = getattr(t, "encode_batch_fast", t.encode_batch)
        for (i, _), e in zip(held, encode([x for _, x in held], add_special_tokens=False), strict=True):
            out[i] += len(e)
        held.clear()

    for i, text in enumerate(texts):
        for piece in parts(text):
            held.append((i, piece))
            size += len(piece)
            if size >= BATCH:
                flush()
                size = 0
    flush()
    return out


def count(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = lengths(texts, path)
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > LIMIT for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
