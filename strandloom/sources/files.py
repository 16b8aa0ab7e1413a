"""Finding files, peeking at them, and opening them plain or compressed."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import os
import re

#: Magic numbers, header records of SAM text, bytes looked at.
GZIP, BZIP2, BAM, PARQUET = b"\x1f\x8b", b"BZh", b"BAM\x01", b"PAR1"
SAM_RECORDS = (b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t")
PEEK = 1023


#: Bytes of one partition of a file that can be split.
SPLIT = 128 << 20


def _system(path: str):
    """(file system, path in it): the machine's own for plain paths, any that pyarrow knows for others (hdfs, s3, ..)."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def expand(paths: str) -> list[str]:
    """Files behind comma-separated paths, folders and patterns, sorted; hidden files are left out.

    Patterns are for plain paths only.  Paths are whole, so equal names in two
    folders stay apart.
    """
    from pyarrow import fs

    out, missing = [], []
    for path in paths.split(","):
        path = re.sub(r"^file:/+", "/", path.strip())
        found = sorted(glob.glob(path)) if "://" not in path and glob.has_magic(path) else [path]
        for item in found:
            system, inside = _system(item)
            root = item[: len(item) - len(inside)] if "://" in item and item.endswith(inside) else ""
            info = system.get_file_info(inside)
            if info.type == fs.FileType.Directory:
                below = system.get_file_info(fs.FileSelector(inside, recursive=True))
                shown = lambda x: not any(n.startswith(("_", ".")) for n in x.path[len(inside) :].split("/"))
                out += sorted(root + x.path for x in below if x.type == fs.FileType.File and shown(x))
            elif info.type == fs.FileType.NotFound:
                missing.append(item)
            else:
                out.append(root + info.path)
    if missing or not out:
        raise FileNotFoundError(f"no such file: {missing or paths}")
    return out


def raw(path: str):
    """The file's bytes as a seekable stream, on any file system."""
    system, inside = _system(path)
    return system.open_input_file(inside)


def size_of(path: str) -> int:
    system, inside = _system(path)
    return system.get_file_info(inside).size


class Folder:
    """A folder of any file system that parts are written to under hidden names and shown when all of them are whole."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self, name: str = ""):
        system, inside = _system(self.path)
        return system, f"{inside}/{name}" if name else inside

    def names(self) -> list[str]:
        from pyarrow import fs

        system, inside = self._at()
        if system.get_file_info(inside).type == fs.FileType.NotFound:
            return []
        return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inside)))

    def create(self, name: str):
        """A new file's stream."""
        system, inside = self._at()
        system.create_dir(inside, recursive=True)
        return system.open_output_stream(f"{inside}/{name}")

    def remove(self, name: str) -> None:
        from pyarrow import fs

        system, inside = self._at(name)
        if system.get_file_info(inside).type != fs.FileType.NotFound:
            system.delete_file(inside)

    def show(self, hidden: str, name: str) -> str:
        system, source = self._at(hidden)
        system.move(source, self._at(name)[1])
        return f"{re.sub(r'^file:/+', '/', self.path)}/{name}"


def packing_of(path: str) -> str:
    """none, gzip or bzip2, by content."""
    with raw(path) as f:
        head = f.read(3)
    return "gzip" if head[:2] == GZIP else "bzip2" if head == BZIP2 else "none"


def opened(path: str) -> io.BufferedIOBase:
    """The file's bytes, decompressed by content."""
    packing = packing_of(path)
    f = raw(path)
    if packing == "gzip":
        return io.BufferedReader(gzip.GzipFile(fileobj=f))
    if packing == "bzip2":
        return io.BufferedReader(bz2.BZ2File(f))
    return io.BufferedReader(f, 1 << 20)


def splits(paths: str, split: int, packed_blocks: bool = False) -> list[tuple[str, int, int]]:
    """(path, begin, end): byte ranges of about ``split`` bytes; compressed files are whole unless their blocks are known."""
    out = []
    for path in expand(paths):
        size = size_of(path)
        if split <= 0 or not packed_blocks and packing_of(path) != "none":
            out.append((path, 0, max(1, size)))
            continue
        out += [(path, at, min(at + split, size)) for at in range(0, max(1, size), split)]
    return out


class Lines:
    """Lines of a stream with the offset of each; lines can be put back."""

    def __init__(self, f: io.BufferedIOBase, at: int = 0):
        self.f, self.at, self.held = f, at, []

    def next(self) -> tuple[int, bytes] | None:
        """(offset, line without its end), or None at the end of the stream."""
        if self.held:
            return self.held.pop()
        line = self.f.readline()
        if not line:
            return None
        begin, self.at = self.at, self.at + len(line)
        return begin, line.rstrip(b"\r\n")

    def back(self, line: tuple[int, bytes]) -> None:
        self.held.append(line)


def lines_from(path: str, begin: int) -> Lines:
    """Lines that begin at or behind an offset of a plain file, or all of a compressed one."""
    f = opened(path)
    if begin == 0:
        return Lines(f)
    f.seek(begin - 1)
    skipped = f.readline()  # ends at begin if a line starts there
    return Lines(f, begin - 1 + len(skipped))


def looks_like_fastq(head: bytes) -> bool:
    """First line begins with @, third with +."""
    lines = [x for x in head.split(b"\n") if x.strip()]
    return len(lines) >= 3 and lines[0].startswith(b"@") and lines[2].startswith(b"+")


def looks_like_sam(head: bytes) -> bool:
    """A header record, or a first line of at least eleven fields."""
    return head.startswith(SAM_RECORDS) or head.split(b"\n", 1)[0].count(b"\t") >= 10


def sniff(path: str) -> tuple[str, str]:
    """(format, compression) by content: fastq, fasta, sam, bam or archive; none, gzip or bzip2.

    Anything else is an error.
    """
    if os.path.isdir(path):
        if os.path.isdir(os.path.join(path, "blocks")) and os.path.isdir(os.path.join(path, "reads")):
            return "archive", "none"
        raise ValueError(f"format of {path} is not known")
    packing = packing_of(path)
    with opened(path) as f:
        head = f.read(PEEK)
    if head.startswith(BAM):
        return "bam", packing
    if head.startswith(PARQUET):
        return "parquet", packing
    if looks_like_sam(head):
        return "sam", packing
    if looks_like_fastq(head):
        return "fastq", packing
    if head.lstrip().startswith(b">"):
        return "fasta", packing
    raise ValueError(f"format of {path} is not known")


#: Format by file name ending.
ENDINGS = {"fastq": "fastq", "fq": "fastq", "sam": "sam", "bam": "bam", "fa": "fasta", "fasta": "fasta", "reads": "archive"}


def format_of_name(name: str) -> str | None:
    """Format by the last ending that is not a compression; None if unknown."""
    parts = os.path.basename(name).lower().split(".")
    while parts and parts[-1] in ("gz", "bz2"):
        parts.pop()
    return ENDINGS.get(parts[-1]) if len(parts) > 1 else None


def output_name(source: str, target_format: str) -> str:
    """Where a conversion goes if nothing is said: an archive adds its ending, others replace it."""
    base = re.sub(r"\.(gz|bz2)$", "", source)
    if target_format == "archive":
        return base + ".reads"
    stem = re.sub(r"\.reads$", "", base) if base.endswith(".reads") else re.sub(r"\.[^.]+$", "", base)
    return stem if format_of_name(stem) == target_format else f"{re.sub(r'[.](fastq|fq|sam|bam)$', '', stem)}.{target_format}"
