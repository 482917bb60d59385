"""Token counts through a digest cache.

A cache is a folder of Parquet rows (content digest, count) with one subfolder per tokenizer version. Documents meet it by
equi-joins on the SHA-256 of their normalised content; only contents that the version's part does not hold are encoded,
each once, and their counts are appended. Repeated runs, grown corpora and other tokenizers share one cache.

- *Normalised content* is the text's UTF-8 bytes, with null as the empty text. Nothing else is folded: tokenizers look for
  special strings in the raw text, so any further folding could give two texts of unlike counts one digest.
- *Version digest* is the SHA-256 of the tokenizer file, its library's name and version and the encoding options. A new
  file, library or option never meets old counts.

A copy group may hold any share of the rows: distinct contents are found by a map-side combined aggregate, and the join
of counts to rows has nothing above it that forbids adaptive execution to split a hot digest.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import shared_folder, stored

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
ENTRY = "digest binary, n_tokens long"
#: Misses that may be broadcast (32 bytes each); more of them meet the texts by a shuffle.
BROADCAST_KEYS = 100_000
#: Distinct pieces a task remembers, and their greatest length: memory bounds only.
MAX_REMEMBERED, LONG_PIECE = 300_000, 200
#: A lone space between two characters that are no white space. The byte-level split rule never lets a match cross the
#: place before it, reads nothing to the left of a match, and special strings are not cut as long as they hold no space.
CUT = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?= [\w!-/:-@\[-`{-~])")


def tokenizer_path(name: str) -> str:
    """A path as it is, or the file of that name among the public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(name: str) -> str:
    """Hex SHA-256 of tokenizer file, library, library version and options."""
    path = tokenizer_path(name)
    if path.endswith(".json"):
        import tokenizers as library

        options = "add_special_tokens=False;truncation=None;padding=None"
    else:
        import sentencepiece as library

        options = "add_bos=False;add_eos=False"
    digest = hashlib.sha256(f"{library.__name__};{library.__version__};{options};".encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


def _cuts_hold(tokenizer: object) -> bool:
    """Whether texts may be encoded in parts cut at ``CUT``: byte-level split rule, nothing before it, no spaced specials."""
    import json

    spec = json.loads(tokenizer.to_str())
    before = spec["pre_tokenizer"] or {}
    specials = spec["added_tokens"]
    plain = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials)
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return bool(split and plain and spec["normalizer"] is None and spec["post_processor"] is None)


class PieceCounter:
    """Counts of texts from counts of their parts between cuts; a part that comes again is not encoded again."""

    def __init__(self, encode: Callable[[list[str]], list[int]]):
        self.encode = encode
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > MAX_REMEMBERED:
            self.known = {}
        found = [CUT.split(t) for t in texts]
        new = list(set().union(*found).difference(self.known))
        self.known.update(zip(new, self.encode(new), strict=True))
        out = [sum(map(self.known.__getitem__, parts)) for parts in found]
        for piece in new:
            if len(piece) > LONG_PIECE:
                del self.known[piece]
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts as the file's library gives them, without added tokens, truncation or padding."""
    if not path.endswith(".json"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return PieceCounter(encode) if _cuts_hold(tokenizer) else encode


def content(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content."""
    return F.unhex(F.sha2(content(text), 256))


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Stored counts of a tokenizer version, one per digest; None where the cache has none."""
    try:
        rows = spark.read.schema(ENTRY).parquet(f"{cache.rstrip('/')}/{version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(contents: DataFrame, name: str) -> DataFrame:
    """Counts of distinct contents (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path(name))
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, held = [], 0
                while lo + len(texts) < b.num_rows and len(texts) < 200 and held < 1_000_000:
                    texts.append(b.column(1)[lo + len(texts)].as_py())
                    held += len(texts[-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)), pa.array(count(texts), pa.int64())], names=["digest", "n_tokens"]
                )
                lo += len(texts)

    return contents.select("digest", "text").mapInArrow(run, ENTRY)


def fill(docs: DataFrame, cache: str, name: str = TOKENIZER) -> int:
    """Append the counts of all contents of ``docs`` (text) that the cache lacks; returns how many were encoded.

    An append is one Spark write: it shows whole or not at all, and a lost executor's tasks run again. Two writers that
    meet may store a digest twice; readers take one.
    """
    spark, version = docs.sparkSession, version_digest(name)
    texts = docs.select(content_digest(F.col("text")).alias("digest"), content(F.col("text")).alias("text"))
    have = cached(spark, cache, version)
    if have is not None:
        misses = stored(texts.select("digest").distinct().join(have, "digest", "left_anti"), "token-misses")
        n = misses.count()
        if not n:
            return 0
        texts = texts.join(F.broadcast(misses) if n <= BROADCAST_KEYS else misses, "digest", "left_semi")
    new = _encoded(texts.groupBy("digest").agg(F.first("text").alias("text")), name)
    batch = stored(new, "token-counts")
    batch.write.mode("append").parquet(f"{cache.rstrip('/')}/{version}")
    return batch.count()


def token_counts(docs: DataFrame, cache: str | None = None, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit, content_sha256.

    ``name`` is a public vocabulary or a path that every executor can open; ``cache`` a shared folder, kept between calls
    (a new one in the shared folder where it is None). Whole texts count. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows and copies are encoded once and all get their row; an empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    fill(docs, cache, name)
    rows = docs.select("doc_id", F.octet_length(content(F.col("text"))).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))
    have = cached(spark, cache, version_digest(name))
    # stored: below a plain scan, adaptive execution may split the rows of a hot digest
    have = spark.createDataFrame([], ENTRY) if have is None else stored(have, "token-counts-known")
    counted = rows.join(have, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("content_sha256"))
