"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file's protobuf is parsed here (pieces with scores and types, model type, normaliser settings), and the library's
parts are rebuilt from it: the normaliser (character map, spaces, the metaspace marker), a unigram model with its scores or a
BPE model with merges ranked by score, byte fallback, and the decoder. Whole texts are encoded and decoded by the library in batches, with as many threads as
Spark gives a task cores (``spark.task.cpus``): more only contend with the other tasks of the executor.

Ids and decoded text are always this backend's own. Parity is verified for every row: the sentencepiece library encodes the same whole text, and ``parity`` says whether the ids
are equal and the decoded text is the source text again or, where it isn't, what sentencepiece decodes from its ids. Sentencepiece's own decoder runs only in that second case.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null ids are encoded each; other
columns of the input are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_SURFACE = " \u2047 "


def wire_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message: ints, floats by 4 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            raise ValueError(f"wire type {kind}")


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type) and settings of a SentencePiece model file."""
    out = {"pieces": [], "type": UNIGRAM, "charsmap": b"", "dummy_prefix": True, "remove_extra": True, "escape": True, "byte_fallback": False}
    for field, value in wire_fields(data):
        if field == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(wire_fields(value))
            out["pieces"].append((piece[1].decode("utf-8"), float(piece[2]), piece[3]))
        elif field == 2:
            spec = dict(wire_fields(value))
            out["type"], out["byte_fallback"] = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif field == 3:
            spec = dict(wire_fields(value))
            out |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "remove_extra": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces whose joint text is a piece, best score first."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    found = []
    for p, s in score.items():
        found += [(-s, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    order = {p: i for i, (p, _, _) in enumerate(pieces)}
    found.sort(key=lambda x: (x[0], order[x[1]], order[x[2]]))
    return [(a, b) for _, a, b in found]


class Codec:
    def __init__(self, model_file: str | None = None, data: bytes | None = None):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if data is None:
            with open(model_file, "rb") as f:
                data = f.read()
        m = parse_model(data)
        pieces = m["pieces"]
        unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        if m["type"] == UNIGRAM:
            # control pieces stand for no text, so theirs becomes one that texts don't hold; byte pieces get a score that no path prefers
            least = min((s for _, s, kind in pieces if kind in (NORMAL, USER)), default=0.0) - 20
            named = [("\U0010ffff" + p if kind in (CONTROL, UNUSED) else p, s if kind in (NORMAL, USER) else least) for p, s, kind in pieces]
            model = models.Unigram(named, unk_id=unk, byte_fallback=m["byte_fallback"])
        elif m["type"] == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
            model = models.BPE(vocab, merges_of(pieces), unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
        else:
            raise ValueError("a unigram or BPE model is needed")
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["remove_extra"]:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if m["dummy_prefix"]:
            steps.append(normalizers.Prepend(MARK if m["escape"] else " "))
        if m["escape"]:
            steps.append(normalizers.Replace(" ", MARK))
        self.tokenizer = Tokenizer(model)
        #: without a character map and space removal, normalising is marking the spaces, which str.replace does some times faster
        self.plain = not m["charsmap"] and not m["remove_extra"] and m["escape"]
        self.prefix = MARK if m["dummy_prefix"] else ""
        if not self.plain:
            self.tokenizer.normalizer = normalizers.Sequence(steps)
        ends = [decoders.ByteFallback()] if m["byte_fallback"] else [decoders.Replace(pieces[unk][0], UNKNOWN_SURFACE)]
        #: the markers of the joined text are left to str.replace too
        self.tokenizer.decoder = decoders.Sequence([*ends, decoders.Fuse()])
        self.reference = SentencePieceProcessor(model_proto=data)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text by the tokenizers library."""
        full = [t for t in texts if t]
        if self.plain:
            full = [self.prefix + t.replace(" ", MARK) for t in full]
        ids = iter(self.tokenizer.encode_batch_fast(full, add_special_tokens=False))
        return [next(ids).ids if t else [] for t in texts]

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids by the tokenizers library."""
        said = (t.replace(MARK, " ") for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False))
        return [t.removeprefix(" ") if self.prefix else t for t in said]

    def round_trip(self, texts: list[str], threads: int = 1) -> list[tuple[list[int], str, bool]]:
        """Ids and decoded text of each text by the tokenizers library, and their parity with sentencepiece."""
        ids = self.encode_batch(texts)
        decoded = self.decode_batch(ids)
        want = self.reference.encode(texts, num_threads=threads)
        return [(own, said, own == other and (said == text or said == self.reference.decode(other))) for text, own, said, other in zip(texts, ids, decoded, want)]


def encode(documents: DataFrame, model_file: str, threads: int | None = None) -> DataFrame:
    """(doc_id, ids, ids_crc32, decoded, parity) of every row; ``model_file`` must be readable on the executors. ``threads`` of a task are its cores if not given."""
    kind = documents.schema["doc_id"].dataType
    threads = threads or int(documents.sparkSession.conf.get("spark.task.cpus", "1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = str(threads > 1).lower(), str(threads)
        codec = None
        for batch in batches:
            codec = codec or Codec(model_file)
            for part in slices(batch, 2 << 20):
                rows = codec.round_trip([t or "" for t in part.column("text").to_pylist()], threads)
                ids = [np.frombuffer(array("i", i), "<i4") for i, _, _ in rows]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array([d for _, d, _ in rows], pa.string()), pa.array([same for _, _, same in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "ids_crc32", "decoded", "parity"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, ids_crc32 long, decoded string, parity boolean")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and checksums of ids and decoded texts."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "parity")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(encode(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model")))
