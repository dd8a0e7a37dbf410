"""Token counts with the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come back as one token are
proven whole. A text is split into pre-tokens; those in the proven set count one, and only the rest is merged
(once per task and distinct pre-token). Nothing is shuffled.

A null or empty text has 0 bytes and 0 tokens. Rows are independent, so repeated rows repeat their result. Special
strings inside a text count as the library counts them by default. Texts with code points outside the plain
range are encoded whole by the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregame.llm import tokens as T
from pregame.llm.common import table

GROUP_CHARS = 2_000_000


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """Vocabulary strings that are one pre-token and encode alone as one token; the file's special strings."""
    tokenizer = T.load(path)
    special = tuple(sorted(t.content for t in tokenizer.get_added_tokens_decoder().values()))
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    strings = [s for s in strings if s and s not in special and "�" not in s and T.BYTE_PATTERN.fullmatch(s)]
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1), special


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, special = whole_tokens(path)
        split = T.regex.compile("|".join(map(T.regex.escape, special))) if special else None
        parts = T.Parts(path, lambda e: len(e.ids), dict.fromkeys(whole, 1))
        for batch in batches:
            text = batch.column(1).cast(pa.large_string()).fill_null("")
            size = pc.binary_length(text).cast(pa.int64())
            out = np.zeros(len(text), dtype=np.int64)
            held: list[tuple[int, list[str]]] = []
            chars = 0
            for i in range(len(text)):
                t = text[i].as_py()
                if not T.plain(t):
                    out[i] = len(parts.tokenizer.encode(t, add_special_tokens=False).ids)
                    continue
                pieces = split.split(t) if split and "<|" in t else [t]
                out[i] = len(pieces) - 1
                for p in pieces:
                    held.append((i, T.BYTE_PATTERN.findall(p)))
                chars += len(t)
                if chars > GROUP_CHARS:
                    _sum(held, parts, out)
                    held, chars = [], 0
            _sum(held, parts, out)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(out), pa.array(out > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def _sum(held: list[tuple[int, list[str]]], parts: T.Parts, out: np.ndarray) -> None:
    known = parts.learn(set().union(*(set(h) for _, h in held)))
    for i, found in held:
        out[i] += sum(map(known.__getitem__, found))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row; ``tokenizer`` is the path of a byte-level file."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
