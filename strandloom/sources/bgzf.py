"""BGZF: gzip members of at most 64 KiB whose extra field holds their size."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

#: Payload of a block, compression level, and the empty block that ends a file.
PAYLOAD, LEVEL = 0xFF00, 5
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def compress(data: bytes, level: int = LEVEL) -> bytes:
    """One block."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) + 26 > 0xFFFF:  # can't happen for a stored block of PAYLOAD bytes
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def blocks(f: io.BufferedIOBase) -> Iterator[bytes]:
    """Payloads of the blocks in order; damaged or plain gzip input is an error."""
    while head := f.read(12):
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = f.read(struct.unpack("<H", head[10:])[0])
        size, at = None, 0
        while at + 4 <= len(extra):
            tag, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0]
            at += 4 + n
        if size is None:
            raise ValueError("gzip member without block size")
        rest = f.read(size - 11 - len(extra))
        data = zlib.decompress(rest[:-8], -15)
        check, length = struct.unpack("<2I", rest[-8:])
        if len(data) != length or zlib.crc32(data) != check:
            raise ValueError("damaged BGZF block")
        yield data


class Reader(io.RawIOBase):
    """The concatenated payloads as a stream."""

    def __init__(self, f: io.BufferedIOBase):
        self.source, self.rest = blocks(f), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            block = next(self.source, None)
            if block is None:
                return 0
            self.rest = block
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def first_block(f, begin: int) -> int | None:
    """Offset of the first block at or behind ``begin``: one that another block or the end of the file follows."""
    f.seek(begin)
    data = f.read(3 << 16)
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        f.seek(begin + at)
        try:
            next(blocks(f))
            following = f.read(4)
            if not following or following == b"\x1f\x8b\x08\x04":
                return begin + at
        except (ValueError, zlib.error, struct.error, StopIteration):
            pass
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


class Placed:
    """Payload bytes from a block on, each with the offset of its block and its place there."""

    def __init__(self, f, begin: int):
        f.seek(begin)
        self.f, self.source = f, blocks(f)
        self.data, self.starts, self.at = b"", [], 0

    def fill(self, n: int) -> bool:
        """At least ``n`` bytes are at hand from the current place on."""
        while len(self.data) - self.at < n:
            offset = self.f.tell()
            block = next(self.source, None)
            if block is None:
                return False
            if self.at > 1 << 20:
                self.starts = [(a - self.at, o) for a, o in self.starts if a - self.at > -(1 << 16)]
                self.data, self.at = self.data[self.at :], 0
            self.starts.append((len(self.data), offset))
            self.data += block
        return True

    def place(self) -> int:
        """Offset of the block times 65536 and the place in it."""
        begin, offset = max((x for x in self.starts if x[0] <= self.at), key=lambda x: (x[0], x[1]))
        return (offset << 16) + self.at - begin

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class Writer:
    """Collects bytes into full blocks; closing adds the end block."""

    def __init__(self, f: io.BufferedIOBase):
        self.f, self.held = f, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= PAYLOAD:
            self.f.write(compress(bytes(self.held[:PAYLOAD])))
            del self.held[:PAYLOAD]

    def close(self) -> None:
        if self.held:
            self.f.write(compress(bytes(self.held)))
        self.f.write(END)
        self.f.close()
