"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.shared import fresh_path, shared_dir, written  # noqa: F401  what operators here and the pipeline use

ASCII_SPACE = " \t\n\x0b\x0c\r"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def pack(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays, compressed; integers byte by byte, as their high bytes are mostly 0."""
    bodies = [x.tobytes() if x.dtype.kind == "f" else np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    head = " ".join(f"{x.dtype.char}{len(x)}" for x in arrays).encode("ascii")
    return bytes([len(head)]) + head + zstandard.ZstdCompressor(level=1).compress(b"".join(bodies))


def unpack(packed: bytes) -> list[np.ndarray]:
    at = packed[0] + 1
    body, begin, out = zstandard.ZstdDecompressor().decompress(packed[at:]), 0, []
    for part in packed[1:at].decode("ascii").split(" "):
        kind, n = np.dtype(part[0]), int(part[1:])
        raw = np.frombuffer(body, np.uint8, n * kind.itemsize, begin)
        out.append(raw.view(kind) if kind.kind == "f" else np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel())
        begin += n * kind.itemsize
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def trimmed(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(ASCII_SPACE))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of passage that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_of(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def bounded_ids(df: DataFrame, key: str, n: int, *where: Column) -> DataFrame:
    """At most ``n`` keys, those of smallest hash: the same ones however the rows lie. Only keys are sorted."""
    slim = df.filter(F.col(key).isNotNull())
    for w in where:
        slim = slim.filter(w)
    return slim.select(key).distinct().orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key).limit(n)
