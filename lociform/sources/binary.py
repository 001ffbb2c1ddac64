"""Data sources for BAM reads and FASTA reference chunks.

Register once per session with ``register(spark)``, then
``spark.read.format("bam").load(path)`` and ``spark.read.format("fasta").load(path)``.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lociform.operators.reference import CHUNK, OVERLAP

#: Compressed bytes of a BAM split, where an index allows splits; rows of a batch.
SPLIT, BATCH = 64 << 20, 8192
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(path) or ([path] if os.path.exists(path) else []))
    return [f for p in found for f in (sorted(glob.glob(os.path.join(p, "*"))) if os.path.isdir(p) else [p])]


class Blocks:
    """Bytes of a blocked gzip file from a virtual offset on, block by block."""

    def __init__(self, path: str, offset: int = 0) -> None:
        self.file = open(path, "rb")
        self.next, self.at, self.data, self.start = offset >> 16, 0, b"", 0
        self._fill()
        self.at = offset & 0xFFFF

    def _fill(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, size, k = head[12:18] + self.file.read(extra - 6), 0, 0
        while k + 4 <= extra:
            tag, n = fields[k : k + 2], struct.unpack_from("<H", fields, k + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", fields, k + 4)[0] + 1
            k += 4 + n
        self.data, self.at, self.start = zlib.decompress(self.file.read(size - 12 - extra - 8), -15), 0, self.next
        self.next += size
        return True

    def tell(self) -> int:
        while self.at >= len(self.data):
            if not self._fill():
                return 1 << 62
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.data) and not self._fill():
                break
            part = self.data[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out


def _header(blocks: Blocks) -> list[str]:
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        size = struct.unpack("<i", blocks.read(4))[0]
        names.append(blocks.read(size)[:-1].decode())
        blocks.read(4)
    return names


def _index_offsets(path: str) -> list[int]:
    """Virtual offsets of record starts from the linear part of a BAM index, if there is one."""
    index = next((p for p in (path + ".bai", path[:-4] + ".bai") if os.path.exists(p)), None)
    if index is None:
        return []
    raw = open(index, "rb").read()
    at, offsets = 8, set()
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(bins):
            at += 8 + 16 * struct.unpack_from("<i", raw, at + 4)[0]
        n = struct.unpack_from("<i", raw, at)[0]
        offsets.update(struct.unpack_from(f"<{n}Q", raw, at + 4))
        at += 4 + 8 * n
    return sorted(offsets - {0})


@dataclass
class BamSplit(InputPartition):
    path: str
    start: int
    end: int


class BamSource(DataSource):
    """Reads of BAM files. With an index beside it a file is read in splits of about 64 MB, else as one.

    ``path`` may name a file, a folder or a pattern. Unplaced
    reads have a null ``chrom`` and ``pos``, absent sequences and qualities are null.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "qname string, flag int, chrom string, pos bigint, mapq int, cigar string, seq string, qual array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"])


class BamReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[BamSplit]:
        out = []
        for path in (f for f in _files(self.path) if f.endswith(".bam")):
            cuts, last = [0], 0
            for offset in _index_offsets(path):
                if (offset >> 16) - last >= SPLIT:
                    cuts.append(offset)
                    last = offset >> 16
            out += [BamSplit(path, a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 62])]
        return out

    def read(self, split: BamSplit) -> Iterator[pa.RecordBatch]:
        top = Blocks(split.path)
        names = _header(top)
        blocks = Blocks(split.path, split.start) if split.start else top
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
        labels, rows = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq", "qual"), []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], labels)

        while blocks.tell() < split.end:
            size = blocks.read(4)
            if len(size) < 4:
                break
            raw = blocks.read(struct.unpack("<i", size)[0])
            ref, pos, n_name, mapq, _, n_ops, flag, n = struct.unpack_from("<iiBBHHHi", raw)
            at = 32 + n_name
            ops = struct.unpack_from(f"<{n_ops}I", raw, at)
            at += 4 * n_ops
            packed = raw[at : at + (n + 1) // 2]
            seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n]
            qual = raw[at + len(packed) : at + len(packed) + n]
            rows.append((
                raw[32 : 31 + n_name].decode(), flag, names[ref] if ref >= 0 else None, pos + 1 if pos >= 0 else None, mapq,
                "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or None, seq or None, None if not n or qual[0] == 255 else list(qual),
            ))
            if len(rows) == BATCH:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


@dataclass
class FastaSplit(InputPartition):
    path: str
    name: str
    offset: int
    length: int


class FastaSource(DataSource):
    """Reference chunks ``chrom, chunk, seq`` of FASTA files.

    With a ``.fai`` index beside it every sequence is a split of its own, else every file
    is. Names end at the first blank; a, c, g, t and n are upper-cased.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "chrom string, chunk bigint, seq string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastaReader(self.options["path"])


class FastaReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[FastaSplit]:
        out = []
        for path in (f for f in _files(self.path) if not f.endswith(".fai")):
            if os.path.exists(path + ".fai"):
                for line in open(path + ".fai"):
                    name, length, offset = line.split("\t")[:3]
                    out.append(FastaSplit(path, name, int(offset), int(length)))
            else:
                out.append(FastaSplit(path, "", 0, -1))
        return out

    def read(self, split: FastaSplit) -> Iterator[tuple]:
        name, number, held = split.name, 0, ""
        with open(split.path) as lines:
            lines.seek(split.offset)
            for line in iter(lines.readline, ""):
                if line.startswith(">"):
                    if held or number:
                        yield from self._rest(name, number, held)
                    if split.length >= 0:
                        return
                    name, number, held = (re.split(r"\s", line[1:].strip(), maxsplit=1) or [""])[0], 0, ""
                    continue
                held += line.strip().translate(str.maketrans("acgtn", "ACGTN"))
                while len(held) >= CHUNK + OVERLAP:
                    yield name, number, held[: CHUNK + OVERLAP]
                    held, number = held[CHUNK:], number + 1
            yield from self._rest(name, number, held)

    @staticmethod
    def _rest(name: str, number: int, held: str) -> Iterator[tuple]:
        while held:
            yield name, number, held[: CHUNK + OVERLAP]
            held, number = held[CHUNK:], number + 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.dataSource.register(FastaSource)
