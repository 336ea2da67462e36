"""Records in the bytes of container and legacy files: framing only, payloads stay packed."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

from ..functions import codes

PAYLOADS = {codes.BLOCK_TWO_BIT: ("2b", 2), codes.BLOCK_THREE_BIT: ("3b", 3), codes.BLOCK_FOUR_BIT: ("4b", 4)}
BATCH = 4 << 20
#: Whole bytes of a description, then a type marker.
LEGACY_START = re.compile(f"(?:..)*?(?={codes.LEGACY_DNA}|{codes.LEGACY_RNA})")
SOMETHING = re.compile("[^0]")


class Broken(ValueError):
    """A container that cannot be read on."""


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


class Bytes:
    """A stream of bytes with a place, of which the last ones taken may be put back. At most `limit` bytes are read."""

    def __init__(self, stream, place: int = 0, limit: int | None = None):
        self.stream, self.held, self.at, self.base, self.left = stream, b"", 0, place, limit

    @property
    def place(self) -> int:
        return self.base + self.at

    def some(self, n: int) -> bytes:
        """At most n bytes."""
        if len(self.held) - self.at < n:
            parts, have = [self.held[self.at :]], len(self.held) - self.at
            while have < n:
                want = max(n - have, BATCH)
                if self.left is not None:
                    want = min(want, self.left)
                if not want or not (more := self.stream.read(want)):
                    break
                if self.left is not None:
                    self.left -= len(more)
                parts.append(more)
                have += len(more)
            self.base, self.held, self.at = self.base + self.at, b"".join(parts), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def take(self, n: int, why: str = "Unexpected end") -> bytes:
        if len(out := self.some(n)) < n:
            raise Broken(why)
        return out

    def back(self, n: int) -> None:
        self.at -= n

    def passed(self, n: int, crc: int) -> int:
        """Goes n bytes on without keeping them, and their checksum after that of what came before."""
        while n:
            part = self.take(min(n, BATCH))
            n, crc = n - len(part), zlib.crc32(part, crc)
        return crc


def is_container(head: bytes) -> bool:
    """By magic and version; anything else is taken for a legacy stream."""
    return head[:5] == codes.MAGIC + bytes([codes.VERSION])


def listed_records(data: Bytes) -> int:
    """Checks a container's head, and how many records it lists."""
    head = data.some(12)
    if head[:4] != codes.MAGIC:
        raise Broken("Not a container")
    if len(head) < 12:
        raise Broken("Header is cut off")
    if head[4] != codes.VERSION:
        raise Broken(f"Version {head[4]} is not known")
    return struct.unpack_from("<I", head, 8)[0]


def placed_record(data: Bytes, most: int | None = None) -> tuple:
    """(description, tag, enc, n_bases, payload, its place, runs as bytes, their place, their size) of the next record, whose checksum is verified.

    most: payloads and runs of more bytes are not kept (None).
    """
    crc, description, tag, found, runs = 0, "", "", None, (b"", 0, 0)
    while True:
        kind, length = struct.unpack("<BI", start := data.take(5))
        size = -(-length * PAYLOADS[kind][1] // 8) if kind in PAYLOADS else length
        crc, place, body = zlib.crc32(start, crc), data.place, None
        if most is not None and size > most and kind not in (codes.BLOCK_DESCRIPTION, codes.BLOCK_TYPE):
            crc = data.passed(size, crc)
        else:
            body = data.take(size)
            crc = zlib.crc32(body, crc)
        if kind == codes.BLOCK_DESCRIPTION:
            description = str(body, "utf-8")
        elif kind == codes.BLOCK_TYPE:
            tag = str(body, "ascii")
        elif kind in PAYLOADS:
            found = (PAYLOADS[kind][0], length, body, place)
        elif kind == codes.BLOCK_RUNS:
            if length % 8:
                raise Broken("Case runs are not whole")
            runs = (body, place, size)
        end = data.some(4)
        if len(end) == 4 and struct.unpack("<I", end)[0] == crc:
            break
        data.back(len(end))
    if tag not in ("D", "R"):
        raise Broken("Record has no type")
    if found is None:
        raise Broken("Record has no sequence")
    return description, tag, *found, *(runs if found[0] == "4b" else (b"", 0, 0))


def container_record(data: Bytes) -> tuple:
    """(description, tag, enc, n_bases, payload, runs) of the next record; numbers of runs are cut at the record's length."""
    *record, _, runs, _, _ = placed_record(data)
    pairs = np.minimum(np.frombuffer(runs, "<u4"), record[3]).reshape(-1, 2).tolist()
    return *record, [{"start": a, "len": n} for a, n in pairs]


def container_records(data: Bytes) -> Iterator[tuple]:
    """All records of a file. Bytes after the last one are left alone."""
    for _ in range(listed_records(data)):
        yield container_record(data)


def legacy_records(data: Bytes, chunk: int = BATCH) -> Iterator[tuple]:
    """Records of a legacy stream. Descriptions are whole bytes of UTF-8 before a marker that begins on a byte of theirs.

    Digits are kept by chunks and dropped when more are needed, so the time does not depend on the chunk's size.
    """
    digits, at = "", 0

    def more() -> bool:
        nonlocal digits, at
        got = data.some(chunk)
        digits, at = digits[at:] + got.hex().upper(), 0
        return bool(got)

    while True:
        # an end marker ends in F; zeros after the last one fill a byte
        while not SOMETHING.search(digits, at):
            if not more():
                return
        seen = 0  # digits that hold no marker
        while not (mark := LEGACY_START.match(digits, at + seen)):
            seen = max(0, len(digits) - at - 2) // 2 * 2
            if not more():
                raise Broken("No type marker found")
        size = mark.end() - at
        begin = at + size + 3
        while (end := digits.find(codes.LEGACY_END, begin)) < 0:
            searched = max(size + 3, len(digits) - at - 2)
            if not more():
                raise Broken("No end marker found")
            begin = at + searched
        mark = at + size
        code = digits[mark + 3 : end]
        payload = bytes.fromhex(code + "0" * (len(code) % 2))
        yield str(bytes.fromhex(digits[at:mark]), "utf-8"), "R" if digits[mark : mark + 3] == codes.LEGACY_RNA else "D", "v1", len(code), payload, []
        at = end + 3
