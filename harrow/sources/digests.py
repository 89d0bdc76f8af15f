"""SHA-256 of files of any length through Spark: pieces of a file are read one after another, and only the digest's state goes from task to task."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import SparkSession

#: (bytes of a piece, bytes of a record). Records have one length, so what is left after a level's whole pieces goes to the next, and its end byte by byte.
LEVELS = ((64 << 20, 1 << 16), (4 << 20, 1 << 16), (1 << 18, 1 << 16), (1 << 16, 1))
#: Hadoop's readers would take such files for compressed ones.
CODECS = (".deflate", ".gz", ".bz2", ".lz4", ".snappy", ".zst")


class _State(ctypes.Structure):
    """``SHA256_CTX`` of openssl/sha.h; hashlib's own state cannot leave its process."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("length", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("size", ctypes.c_uint)]


@lru_cache(1)
def _crypto():
    """OpenSSL's libcrypto, as hashlib has it; None where that is built without these functions."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        return found if all(hasattr(found, f"SHA256_{f}") for f in ("Init", "Update", "Final")) else None
    except (ImportError, AttributeError, OSError):
        return None


def can_carry(file: str) -> bool:
    return _crypto() is not None and not file.endswith(CODECS)


def start() -> bytes:
    _crypto().SHA256_Init(ctypes.byref(s := _State()))
    return bytes(s)


def carried(state: bytes, parts: Iterable[bytes]) -> bytes:
    s = _State.from_buffer_copy(state)
    for p in parts:
        _crypto().SHA256_Update(ctypes.byref(s), bytes(p), ctypes.c_size_t(len(p)))
    return bytes(s)


def finish(state: bytes) -> str:
    s, out = _State.from_buffer_copy(state), ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(out, ctypes.byref(s))
    return out.raw.hex()


def escaped(path: str) -> str:
    """A path that Hadoop would take for a pattern, as itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _records(spark: SparkSession, file: str, piece: int, record: int):
    """(number, bytes) of the file's records; each partition is a piece, in order."""
    return spark.sparkContext.newAPIHadoopRDD(
        "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"mapreduce.input.fileinputformat.inputdir": re.sub(r"([\\,])", r"\\\1", escaped(file)), "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record),
              "mapreduce.input.fileinputformat.split.minsize": str(piece), "mapreduce.input.fileinputformat.split.maxsize": str(piece)})


def sha256_by_pieces(spark: SparkSession, file: str, length: int, levels: tuple[tuple[int, int], ...] = LEVELS) -> str:
    """The digest of one file. A task reads one piece; 112 bytes of state come back from it and go to the next.

    ``levels``: each piece a multiple of its records and of the next level's pieces, the last with records of one byte.
    """
    state, at = start(), 0
    for piece, record in levels:
        if at == length or length < record:
            continue
        rdd = _records(spark, file, piece, record)
        whole = rdd.getNumPartitions() - (record > 1)  # the last piece may end in half a record
        for k in range(at // piece, whole):

            def run(records, state=state):
                n, first = 0, None

                def parts():
                    nonlocal n, first
                    for number, p in records:
                        first = number if first is None else first
                        n += len(p)
                        yield p

                return [(carried(state, parts()), first, n)]

            state, first, n = spark.sparkContext.runJob(rdd, run, [k])[0]
            if (first or 0) * record != at:
                raise RuntimeError(f"{file}: piece {k} does not begin at byte {at}")
            at += n
    if at != length:
        raise RuntimeError(f"{file}: {at} of {length} bytes were read")
    return finish(state)
