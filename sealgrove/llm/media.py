"""Media columns: FLAC streams in binary columns, decoded to PCM blocks with seekable sample offsets.

decode_media reads Rice residuals and linear predictors, verifies checksums and gives the samples with an index of blocks; pcm_blocks
cuts the samples into a row for each block, which begins at a known sample and a known byte of the stream, so that a range of
samples can be read without what precedes it. encode_media stores bytes losslessly as 8-bit mono samples.

Edge cases: a null stream has null samples, no blocks and no error; a damaged or foreign one too, and says so in `media_error`;
an empty payload is stored as null. Each row is coded by itself, so repeated rows get equal values; an existing column of
an output's name is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sealgrove.llm.flac import Damaged, decode_streams, encode_streams
from sealgrove.llm.texts import appended, carried, others, unpacked
from sealgrove.sources.tables import read_table

UNIT = 64
INDEX = ArrayType(StructType([StructField("sample_offset", LongType()), StructField("byte_offset", LongType()), StructField("n_samples", IntegerType())]))


def payload_of(text: Column) -> Column:
    """A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    units = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / UNIT))
    return F.rpad(raw, (units * UNIT).cast("int"), F.lit(b"\x00"))


def encode_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """`df` with `media`: the payload's bytes as a FLAC stream of 8-bit mono samples."""

    def encoded(payloads: list) -> list[list]:
        full = [i for i, p in enumerate(payloads) if p]
        streams: list[bytes | None] = [None] * len(payloads)
        for i, s in zip(full, encode_streams([bytes(payloads[i]) for i in full]), strict=True):
            streams[i] = s
        return [streams]

    return appended(df, [StructField(media, BinaryType())], encoded, payload)


def feature_of(x: np.ndarray, blocks: int) -> str:
    """Peak, energy, sign changes and blocks of a signal; channels follow one another."""
    x = x.astype(np.int64).T.ravel()
    return f"peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};blocks={blocks}"


def _pcm(x: np.ndarray, bps: int) -> bytes:
    """Samples of up to 8 bits are stored unsigned, wider ones as signed little-endian integers; channels are interleaved."""
    if bps <= 8:
        return (x + 128).astype(np.uint8).tobytes()
    return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : (bps + 7) // 8].tobytes()


def _decoded(streams: list[bytes]) -> list:
    """Results of decode_streams, or the error in place of a damaged stream's."""
    try:
        return decode_streams(streams)
    except (Damaged, IndexError, ValueError, OverflowError, MemoryError) as e:  # whatever a damaged stream leads to is its own error
        if len(streams) == 1:
            return [str(e) or type(e).__name__]
        half = len(streams) // 2
        return _decoded(streams[:half]) + _decoded(streams[half:])


def decode_media(df: DataFrame, media: str = "media", pcm: str = "pcm", index: str = "blocks", feature: str = "feature", error: str = "media_error") -> DataFrame:
    """`df` with the stream's samples, its index of blocks, a feature string, and what is wrong with it."""
    fields = [StructField(pcm, BinaryType()), StructField(index, INDEX), StructField(feature, StringType()), StructField(error, StringType())]

    def decoded(streams: list) -> list[list]:
        full = [i for i, s in enumerate(streams) if s is not None]
        columns: list[list] = [[None] * len(streams) for _ in fields]
        for i, x in zip(full, _decoded([bytes(streams[i]) for i in full]), strict=True):
            if isinstance(x, str):
                columns[3][i] = x
            else:
                columns[0][i], columns[2][i] = _pcm(x[0], x[2]), feature_of(x[0], len(x[1]))
                columns[1][i] = [{"sample_offset": s, "byte_offset": b, "n_samples": n} for s, b, n in x[1]]
        return columns

    return appended(df, fields, decoded, media)


def pcm_blocks(df: DataFrame, pcm: str = "pcm", index: str = "blocks", width: int = 1) -> DataFrame:
    """A row for each block: df's other columns, block_no, sample_offset, byte_offset, n_samples and the block's `pcm` bytes. `width`: bytes of a sample of all channels."""
    keep = others(df, pcm, index, "block_no", "sample_offset", "byte_offset", "n_samples")
    rows = carried(df, _pcm=F.col(pcm), _index=F.col(index)).select("_row", "_pcm", F.posexplode("_index").alias("_no", "_b"))
    own = F.expr(f"substring(_pcm, cast(_b.sample_offset * {width} + 1 as int), cast(_b.n_samples * {width} as int))")
    return rows.select(*unpacked(rows, keep), F.col("_no").alias("block_no"), "_b.*", own.alias(pcm))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), payload_of(F.col("text")).alias("payload"))
    stored = encode_media(docs, "payload", "media").drop("payload")
    out = decode_media(stored, "media", "pcm")
    return out.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(pcm, -{UNIT}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {"op2_media": op2_media}
ORACLES: dict[str, str] = {}
