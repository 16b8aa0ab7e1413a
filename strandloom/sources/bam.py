"""BAM: a Python data source that decodes records to Arrow, and a writer."""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandloom.functions.cigar import OPS
from strandloom.functions.nucleotide import NIBBLE_LETTERS
from strandloom.sources import READ_SCHEMA, bgzf
from strandloom.sources.fastq import FilePartition
from strandloom.sources.files import SPLIT, Folder, raw, splits

BATCH = 5000
_TURN = str.maketrans("ACGTacgt", "TGCAtgca")
_PAIRS = [a + b for a in NIBBLE_LETTERS for b in NIBBLE_LETTERS]
_NIBBLE = {c: i for i, c in enumerate(NIBBLE_LETTERS)}
_NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}
_TAG = pa.struct([("type", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("f", pa.float64()), ("ai", pa.list_(pa.int64())), ("af", pa.list_(pa.float64()))])
_ARROW = pa.schema(
    [
        ("_file", pa.string()), ("_ord", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("flags", pa.int32()),
        ("seqname", pa.string()), ("strand", pa.bool_()), ("pos", pa.int64()), ("map_qual", pa.int16()),
        ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("mate_seqname", pa.string()), ("mate_pos", pa.int64()),
        ("tlen", pa.int32()), ("aux", pa.map_(pa.string(), _TAG)),
    ]
)


def read_header(f: io.BufferedIOBase) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the references."""
    if f.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).split(b"\0", 1)[0].decode()
    names = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        name = f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode()
        names.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, names


def _tags(data: bytes, at: int) -> list[tuple[str, dict]]:
    out = []
    while at + 3 <= len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        tag: dict = {"type": kind, "s": None, "i": None, "f": None, "ai": None, "af": None}
        if kind == "A":
            tag["s"] = chr(data[at])
            at += 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            tag["s"] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = list(struct.unpack_from(f"<{n}{_NUMBER[sub]}", data, at + 5))
            tag["type"] = "B" + sub
            tag["af" if sub in "fd" else "ai"] = values
            at += 5 + n * struct.calcsize(_NUMBER[sub])
        else:
            (value,) = struct.unpack_from("<" + _NUMBER[kind], data, at)
            at += struct.calcsize(_NUMBER[kind])
            if kind in "fd":
                tag["f"] = value
            else:
                tag["type"], tag["i"] = "i", value
        out.append((key, tag))
    return out


def decode(data: bytes, names: list[str]) -> tuple:
    """A record's fields from id to aux, sequence and qualities as sequenced."""
    ref, pos, n_name, mapq, _, n_ops, flags, n, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + n_name
    ident = data[32 : at - 1].decode()
    cigar = [{"op": OPS[c & 15], "len": c >> 4} for c in struct.unpack_from(f"<{n_ops}I", data, at)]
    at += 4 * n_ops
    packed = data[at : at + (n + 1) // 2]
    seq = "".join([_PAIRS[b] for b in packed])[:n] or None
    at += len(packed)
    raw = data[at : at + n]
    qual = None if not n or raw[0] == 0xFF else bytes(q + 33 for q in raw).decode("ascii")
    reverse = bool(flags & 16)
    if reverse:
        seq = seq and seq[::-1].translate(_TURN)
        qual = qual and qual[::-1]
    name = lambda i: names[i] if 0 <= i < len(names) else None
    place = lambda p: p if p >= 0 else None
    return (ident, seq, qual, flags, name(ref), reverse, place(pos), mapq, cigar or None, name(mate), place(mate_pos), tlen, _tags(data, at + n))


#: Records in a row that must be sound where reading begins inside a file.
SOUND = 8


def _sound(data: bytes, at: int, references: int, whole: bool) -> bool:
    """Whether records follow each other from ``at`` on, SOUND of them or up to the end of the data."""
    for n in range(SOUND):
        if at + 36 > len(data):
            return n > 1 or whole and at == len(data)
        size, ref, pos, name, _, _, ops, _, letters, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        least = 32 + name + 4 * ops + (letters + 1) // 2 + letters
        if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name > 0 and letters >= 0 and least <= size < 1 << 28):
            return False
        end = at + 36 + name - 1
        if end < len(data) and (data[end] != 0 or not all(32 < c < 127 for c in data[at + 36 : end])):
            return False
        at += 4 + size
    return True


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(*x) for x in splits(self.path, self.split, packed_blocks=True)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        with raw(partition.path) as f:
            head = io.BufferedReader(bgzf.Reader(f), 1 << 16)
            names = [n for n, _ in read_header(head)[1]]
            stream = self._first(f, partition, len(names))
            rows: list[tuple] = []
            while stream is not None and stream.fill(4):
                place = stream.place()
                if place >> 16 >= partition.end:
                    break  # the next range's
                (size,) = struct.unpack("<i", stream.take(4))
                if not stream.fill(size):
                    raise ValueError(f"{partition.path} ends within a record")
                rows.append((partition.path, place, *decode(stream.take(size), names)))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    @staticmethod
    def _first(f, partition: FilePartition, references: int) -> bgzf.Placed | None:
        """The stream at the first record that begins in the range: behind the header, or where sound records begin."""
        if not partition.begin:
            stream = bgzf.Placed(f, 0)
            stream.fill(12)
            text = struct.unpack_from("<i", stream.data, 4)[0]
            stream.fill(12 + text)
            count = struct.unpack_from("<i", stream.data, 8 + text)[0]
            stream.take(12 + text)
            for _ in range(count):
                stream.fill(4)
                n = struct.unpack("<i", stream.take(4))[0] + 4
                stream.fill(n)
                stream.take(n)
            return stream
        begin = bgzf.first_block(f, partition.begin)
        if begin is None or begin >= partition.end:
            return None
        stream = bgzf.Placed(f, begin)
        while True:
            more = stream.fill(len(stream.data) + (1 << 18))
            for at in range(len(stream.data)):
                if _sound(stream.data, at, references, not more):
                    stream.at = at
                    return stream
            if not more:
                return None  # the rest of a record, or the end block


class BamSource(DataSource):
    """``spark.read.format("reads_bam").load(path)``, in ranges of ``splitBytes`` compressed bytes.

    ``_file`` is the whole path, ``_ord`` the place of the record: offset of its
    block times 65536 and place in the block.  A range begins at the first block
    and there at the first of several sound records in a row; ``splitBytes`` 0
    reads a file in one task.
    """

    @classmethod
    def name(cls) -> str:
        return "reads_bam"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def _bin(begin: int, end: int) -> int:
    """Smallest bin of the six-level scheme that holds [begin, end)."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def _narrow(value: int) -> str:
    if value < 0:
        return "c" if value >= -127 else "s" if value >= -32767 else "i"
    return "C" if value <= 255 else "S" if value <= 65535 else "I"


def _pack_tag(key: str, tag: dict) -> bytes:
    kind = tag["type"][0]
    head = key.encode()
    if kind == "B":
        sub = tag["type"][1:] or ("f" if tag["af"] is not None else "i")
        values = tag["af"] if sub in "fd" else tag["ai"]
        values = values if values is not None else []
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{_NUMBER[sub]}", len(values), *values)
    if kind in "ZH":
        return head + kind.encode() + tag["s"].encode() + b"\0"
    if kind == "A":
        return head + b"A" + tag["s"].encode("latin-1")[:1]
    if kind in "fd":
        return head + kind.encode() + struct.pack("<" + _NUMBER[kind], tag["f"])
    sub = _narrow(tag["i"])
    return head + sub.encode() + struct.pack("<" + _NUMBER[sub], tag["i"])


def encode(row: dict, index: dict[str, int]) -> bytes:
    """A record with its size; letters the 4-bit code lacks are an error."""
    seq, qual = row["seq"] or "", row["qual"]
    if row["strand"]:
        seq, qual = seq[::-1].translate(_TURN), qual and qual[::-1]
    try:
        codes = [_NIBBLE[c] for c in seq.upper()]
    except KeyError as e:
        raise ValueError(f"BAM has no letter {e.args[0]!r}") from e
    codes += [0] * (len(codes) & 1)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    cigar = row["cigar"] if row["cigar"] is not None else []
    span = sum(c["len"] for c in cigar if c["op"] in "MDN=X")
    pos = -1 if row["pos"] is None else int(row["pos"])
    place = lambda n: -1 if n is None else index[n]
    name = row["id"].encode() + b"\0"
    mapq = row["map_qual"] if row["map_qual"] is not None else 255
    mate_pos = -1 if row["mate_pos"] is None else int(row["mate_pos"])
    body = struct.pack(
        "<iiBBHHHiiii", place(row["seqname"]), pos, len(name), mapq, _bin(pos, pos + max(span, 1)) if pos >= 0 else 4680, len(cigar),
        row["flags"], len(seq), place(row["mate_seqname"]), mate_pos, row["tlen"] or 0,
    )
    body += name + struct.pack(f"<{len(cigar)}I", *(c["len"] << 4 | OPS.index(c["op"]) for c in cigar)) + packed
    body += b"\xff" * len(seq) if qual is None else bytes(q - 33 for q in qual.encode("ascii"))
    body += b"".join(_pack_tag(k, t) for k, t in sorted(row["aux"].items())) if row["aux"] else b""
    return struct.pack("<i", len(body)) + body


def write(df: DataFrame, path: str, references: DataFrame, text: str | None = None, order: list[str] | None = None, overwrite: bool = False) -> list[str]:
    """One BAM file a partition, each with the whole header; returns the files in order.

    ``references`` has seqname and length (or seq): the header itself, which
    every file repeats, so it is collected.  Files appear under their final name
    only when all of them are written.
    """
    folder = Folder(path)
    old = folder.names()
    if old and not overwrite:
        raise FileExistsError(f"{path} exists")
    names = [(r[0], int(r[1])) for r in references.selectExpr("seqname", "length" if "seq" not in references.columns else "length(seq)").orderBy("seqname").collect()]
    index = {n: i for i, (n, _) in enumerate(names)}
    text = text if text is not None else "@HD\tVN:1.0\tSO:unsorted\n" + "".join(f"@SQ\tSN:{n}\tLN:{s}\n" for n, s in names)
    head = b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(names))
    head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in names)
    order = order or ["_ord"]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    run_id = uuid.uuid4().hex[:8]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        hidden = f".part-{context.partitionId():05d}-{run_id}-{context.attemptNumber()}.bam"
        out = bgzf.Writer(folder.create(hidden))
        out.write(head)
        n = 0
        for batch in batches:
            for row in batch.to_pylist(maps_as_pydicts="strict"):
                out.write(encode(row, index))
                n += 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([hidden]), pa.array([n], pa.int64())], ["file", "records"])

    done = [r for r in rows.mapInArrow(store, "file string, records long").collect()]
    for name in old:
        folder.remove(name)
    final = [folder.show(name, re.sub(r"^\.(part-\d+-\w+)-\d+\.bam$", r"\1.bam", name)) for name in sorted(r["file"] for r in done)]
    for stray in folder.names():  # of attempts that failed
        if stray.startswith("."):
            folder.remove(stray)
    return final
