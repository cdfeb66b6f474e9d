"""Token ids from a public vocabulary, and the exact length histogram.

A null or empty text has no tokens. Special tokens' strings in a text are ordinary text. Repeated rows count as often as
they occur; an empty table gives an empty result, and texts of any length are read whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, strings

#: Entries of a worker's cache of encoded words; a full cache is emptied, which costs time only.
CACHE = 300_000
_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranked(path: str):
    """A faster encoder of the same ids, if the vocabulary is a byte-level BPE whose ids follow its merges; else None."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, before = data["model"], data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or data.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such a vocabulary
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {x["content"] for x in data.get("added_tokens", [])}
    ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [model["vocab"][m] for m in merged] != sorted(model["vocab"][m] for m in merged):
        return None
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Parts(dict):
    """Ids of a stretch behind a space; None if it is empty or has white space at an end, where the split rules look further."""

    def __init__(self, raw) -> None:
        super().__init__()
        self.raw = raw

    def __missing__(self, part: str) -> bytes | None:
        plain = part and not (part[0].isspace() or part[-1].isspace())
        self[part] = got = self.raw(" " + part) if plain else None
        return got


class Encoder:
    """Ids of whole texts, those of ``tokenizers``, as little-endian unsigned 32-bit bytes.

    A byte-level BPE first splits a text so that a space that stands alone between two characters that are no space
    begins a part. Hence each stretch from one such space to the next is encoded on its own, and equal stretches have
    equal ids, which are kept. Texts with any other space are encoded as they are. Where a vocabulary's ids follow
    its merges, the same ids come faster from their ranks.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.fast = _ranked(path)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.encode_special_tokens = True
        self.kept = _Parts(self.raw)

    def raw(self, text: str) -> bytes:
        if self.fast is not None:
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.kept) > CACHE:
                self.kept = _Parts(self.raw)
            parts = text.split(" ")
            try:
                if parts[0] and parts[0][-1].isspace():
                    raise TypeError
                out.append((self.raw(parts[0]) if parts[0] else b"") + b"".join(map(self.kept.__getitem__, parts[1:])))
            except TypeError:  # join() met a None
                out.append(self.raw(text))
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens of every row's whole text."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x) // 4 for x in encoder(path).encode(strings(batch, text))]
            yield pa.record_batch({"n_tokens": pa.array(n, pa.int64())})

    return docs.select(text).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame, n: str = "n_tokens") -> DataFrame:
    """docs by exact length: as many rows as there are different lengths, combined before the shuffle."""
    return lengths.groupBy(F.col(n).alias("n_tokens")).agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """Per length L as context limit: documents and tokens at or above it, the total cut at L, and L's rank from below.

    Sums run in two levels, within blocks of lengths and over the blocks' totals, so no task reads the whole histogram.
    For a limit that is no length: total cut at L = tokens_below(next length) + L * docs_at_least(next length).
    An empty table has no rows.
    """
    h = histogram.withColumn("block", F.expr(f"n_tokens div {block}")).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    per = h.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("block", F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("d_above"), F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("t_above"),
                     F.sum("bd").over(Window.partitionBy(F.lit(1))).alias("all_docs"), F.sum("bt").over(Window.partitionBy(F.lit(1))).alias("all_tokens"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(per, "block").select(
        "n_tokens", "docs",
        (F.sum("docs").over(inner) + F.col("d_above")).alias("docs_at_least"),
        (F.sum("tokens").over(inner) + F.col("t_above")).alias("tokens_at_least"),
        "all_docs", "all_tokens",
    )
    return out.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        F.col("all_tokens").alias("total_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("quantile"),
    )


def limit_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Documents over each context limit and the total cut there, for any limits."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    at = sums.join(F.broadcast(asked), sums.n_tokens >= asked.context_limit)
    cutoff = F.col("total_tokens") - F.col("tokens_at_least") + F.col("context_limit") * F.col("docs_at_least")
    found = at.groupBy("context_limit").agg(F.max("docs_at_least").alias("docs_at_least"), F.min(cutoff).alias("truncated_total"))
    total = sums.agg(F.max("total_tokens").alias("total"))
    out = asked.join(found, "context_limit", "left").join(F.broadcast(total), F.lit(True))
    return out.select("context_limit", F.coalesce("docs_at_least", F.lit(0)).alias("docs_at_least"), F.coalesce("truncated_total", "total", F.lit(0)).alias("truncated_total"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    return suffix_sums(cut(length_histogram(token_lengths(docs, path)), "lengths"))
