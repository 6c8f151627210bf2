"""Token counts of texts, kept in a cache by digest so that a text is encoded once however often it comes.

The cache is a Parquet table of (version, digest, n_tokens): ``version`` is the digest of the tokenizer file and of the way counts are made, ``digest`` that of the
normalised text. A call computes the digests of its texts, joins the distinct ones to the counts of its version, encodes one text for each that is missing, appends the new
counts and joins all digests to the cache. Hot digests are joined by broadcast (``common.lookup``).

Normalising only removes what the tokenizer ignores: ASCII letters are lower-cased and runs of ASCII white space become one blank. Texts that hold ``<|``
stay as they are, as an added token's string counts only as it is written.

Encoding: the tokens of a text are those of its words (the tokenizer's own split), and few distinct words make up most texts, so the library encodes each distinct word
once a worker. That is done for texts of characters which Python and the library class, case and compose alike; all other texts, and those with an added token's string,
the library encodes whole.

Defined cases: a null text counts as empty (no bytes, no tokens); rows with null or repeated ids are counted each; an empty table gives no rows and appends nothing;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, saved, shared_folder, slices, table

#: to be changed with anything that changes digests or counts
COUNTING = "1"
#: a worker forgets its words beyond so many, and takes texts in pieces of about so many characters
MAX_WORDS, PIECE = 1_000_000, 1 << 20
CACHE = "version string, digest binary, n_tokens long"
#: Characters on which both sides agree, their lower case included: printable ASCII and its white space, Latin, Russian letters, common punctuation
_ALIKE = [(0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x17F), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]


def _class(wanted: str) -> str:
    """A character class of all alike characters whose Unicode category begins with one of ``wanted``."""
    return "".join(re.escape(chr(c)) for low, high in _ALIKE for c in range(low, high + 1) if unicodedata.category(chr(c))[0] in wanted)


def normalised(text: Column) -> Column:
    """The text without differences that no count depends on."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.regexp_replace(F.translate(text, upper, upper.lower()), r"[\x20\x09-\x0D]+", " ")
    return F.when(text.contains("<|"), text).otherwise(plain)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def tokenizer_version(tokenizer_file: str) -> str:
    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(COUNTING.encode() + f.read()).hexdigest()


class Words(dict):
    """Tokens of each word met so far. The library's model takes a word as it is; normalising and splitting are done when words come here."""

    def __init__(self, library):
        self.model = library.model
        self.as_bytes = library.pre_tokenizer

    def __missing__(self, word: str) -> int:
        # the model reads bytes as printable characters, which for printable ASCII are the same
        parts = [word] if word.isascii() else [p for p, _ in self.as_bytes.pre_tokenize_str(word)]
        n = self[word] = sum(len(self.model.tokenize(p)) for p in parts)
        return n


class Counting:
    """Counts tokens by a tokenizer file that lower-cases, drops white space and splits words as ``words`` does."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        alike = "".join(f"{re.escape(chr(low))}-{re.escape(chr(high))}" for low, high in _ALIKE)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([f"[^{alike}]", *added]))
        letter, number, space = _class("L"), _class("N"), r"\s"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.blank = re.compile(space)
        self.known = Words(self.library)

    def whole(self, text: str) -> int:
        return len(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def count(self, text: str) -> int:
        if self.other.search(text):
            return self.whole(text)
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        at = total = 0
        while at < len(text):
            blank = self.blank.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = blank.start() if blank else len(text)
            total += sum(map(self.known.__getitem__, self.words.findall(text[at:end].lower())))
            at = end
        return total


@lru_cache(2)
def counting_of(tokenizer_file: str) -> Counting:
    """One for all tasks of a worker process, so that the words which it knows are shared."""
    return Counting(tokenizer_file)


def encode(texts: DataFrame, tokenizer_file: str) -> DataFrame:
    """(digest, n_tokens) of texts (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = None
        for batch in (part for whole in batches for part in slices(whole)):
            counting = counting or counting_of(tokenizer_file)
            counts = [counting.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one version in the cache; a digest that two calls appended at once counts once."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing(texts: DataFrame, digests: DataFrame, cache: str, tokenizer_file: str) -> int:
    """Encodes one text (``texts`` has digest, text) of each of the distinct ``digests`` that the cache lacks, appends the counts and returns how many."""
    spark, version = texts.sparkSession, tokenizer_version(tokenizer_file)
    missing = saved(digests.select("digest").join(stored(spark, cache, version), "digest", "left_anti"))
    n = missing.count()
    if n:
        # copies meet in their task first; where few digests are missing they are broadcast and no other text is moved
        one = texts.groupBy("digest").agg(F.max("text").alias("text")).join(missing, "digest", "left_semi")
        encode(one, tokenizer_file).select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return n


def count_tokens(documents: DataFrame, cache: str, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``cache`` is a folder that the cluster shares, ``tokenizer_file`` is readable on driver and executors."""
    text = F.coalesce("text", F.lit(""))
    rows = saved(documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text_digest(text).alias("digest")))
    digests = saved(rows.groupBy("digest").agg(F.count("*").alias("n")))
    add_missing(documents.select(text_digest(text).alias("digest"), normalised(text).alias("text")), digests, cache, tokenizer_file)
    counts = digests.join(stored(documents.sparkSession, cache, tokenizer_version(tokenizer_file)), "digest")
    return lookup(rows, saved(counts), "digest", rows.count()).select("doc_id", "n_bytes", "n_tokens")


def op11_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Counts by a cache of this call's own, so that every distinct text is encoded in each call."""
    import public_tokenizers as P

    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    counted = count_tokens(table(spark, sf_dir, "documents"), cache, P.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
