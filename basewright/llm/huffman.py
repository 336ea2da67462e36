"""Token ids as length-limited canonical Huffman codes.

A file holds the code lengths of the whole vocabulary, then blocks that decode on their own, then the list of
its documents. Each block stores the bit offset of every 512th code. A decoder starts at all these checkpoints
at once and takes one code from each per step, by a table over the next ``limit`` bits.

File: ``BWHUF1`` | limit u8 | vocabulary u32 | packed lengths u32 + bytes (zlib) | blocks | documents (zlib) |
footer: offset of the documents u64, blocks u32, documents u32, tokens u64.
Block: ids u32 | checkpoints u32 | bytes u32 | checkpoint bit offsets u32 each | code bytes, 3 spare.
All numbers are little-endian; codes are packed from the highest bit.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

MAGIC = b"BWHUF1"
BLOCK, STEP = 1 << 16, 512
FOOTER = struct.Struct("<QIIQ")


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Code lengths that minimise the total size with no code above ``limit`` bits (package-merge); 0 where unused."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes above {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(np.cumsum(at < len(leaves)))
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for seen in reversed(levels):
        own = int(seen[take - 1]) if take else 0
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for n in np.unique(lengths[lengths > 0]).tolist():
        ids = np.flatnonzero(lengths == n)
        code <<= n - last
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code, last = code + len(ids), n
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    n = int(ends[-1] + 7) // 8 if len(ids) else 0
    at = starts >> 3
    # a code of up to 25 bits touches at most four bytes; no two codes share a bit, so sums are unions
    value = codes[ids].astype(np.uint64) << (32 - (starts & 7) - size).astype(np.uint64)
    data = np.zeros(n + 4)
    for k in range(4):
        part = (value >> np.uint64(24 - 8 * k)) & np.uint64(255)
        data += np.bincount(at + k, part, n + 4)
    checks = starts[::STEP].astype("<u4")
    body = data.astype(np.uint8)[:n].tobytes() + b"\0\0\0\0"
    return struct.pack("<III", len(ids), len(checks), len(body)) + checks.tobytes() + body


class Decoder:
    def __init__(self, lengths: np.ndarray, limit: int):
        codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
        self.limit = limit
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.length = np.ones(1 << limit, np.int64)
        used = used[np.lexsort((used, lengths[used]))]
        wide = np.int64(1) << (limit - lengths[used].astype(np.int64))
        first = codes[used].astype(np.int64) << (limit - lengths[used].astype(np.int64))
        if len(used):
            end = int(first[-1] + wide[-1])
            self.symbol[:end], self.length[:end] = np.repeat(used, wide), np.repeat(lengths[used], wide)

    def blocks(self, blocks: list[bytes]) -> np.ndarray:
        """Ids of some blocks, decoded side by side."""
        starts, counts, bodies, base = [], [], [], 0
        for b in blocks:
            n, k, size = struct.unpack_from("<III", b)
            starts.append(np.frombuffer(b, "<u4", k, 12).astype(np.int64) + 8 * base)
            counts.append(np.minimum(STEP, n - STEP * np.arange(k)))
            bodies.append(b[12 + 4 * k : 12 + 4 * k + size])
            base += size
        if not blocks or not sum(map(len, starts)):
            return np.empty(0, np.uint32)
        raw = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, count = np.concatenate(starts), np.concatenate(counts)
        begin = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        at, begin, count = at[order], begin[order], count[order]
        out = np.empty(int(count.sum()), np.uint32)
        alive = np.searchsorted(-count, -np.arange(int(count[0])), "left")
        drop, mask = np.uint32(32 - self.limit), (1 << self.limit) - 1
        for step, live in enumerate(alive.tolist()):
            p = at[:live]
            code = ((window[p >> 3] << (p & 7).astype(np.uint32)) >> drop) & mask
            out[begin[:live] + step] = self.symbol[code]
            p += self.length[code]
        return out


class Writer:
    """Streams documents into one file. ``write`` gets each document's id and token ids in order."""

    def __init__(self, output, lengths: np.ndarray, limit: int):
        self.out, self.lengths, self.codes = output, lengths.astype(np.int64), canonical_codes(lengths)
        packed = zlib.compress(lengths.astype(np.uint8).tobytes(), 6)
        output.write(MAGIC + struct.pack("<BII", limit, len(lengths), len(packed)) + packed)
        self.rest, self.held, self.n_blocks, self.tokens, self.docs = [], 0, 0, 0, []

    def write(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids)))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, most: int) -> None:
        ids = np.concatenate(self.rest)
        for k in range(0, most, BLOCK):
            self.out.write(encode_block(ids[k : min(k + BLOCK, most)], self.codes, self.lengths))
            self.n_blocks += 1
        self.rest, self.tokens = [ids[most:]], self.tokens + most
        self.held = len(ids) - most

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        at = self.out.size
        self.out.write(zlib.compress(np.array(self.docs, np.dtype("<i1,<i8,<u4")).tobytes(), 6))
        self.out.write(FOOTER.pack(at, self.n_blocks, len(self.docs), self.tokens))
        self.out.close()


def read_documents(file, at_once: int = 32) -> Iterator[tuple[int | None, int, Iterable[np.ndarray]]]:
    """(doc_id, tokens, token ids in runs) of each document of a file, in order; ``at_once`` blocks are held."""
    size = file.size()
    file.seek(size - FOOTER.size)
    where, n_blocks, n_docs, _ = FOOTER.unpack(file.read(FOOTER.size))
    file.seek(where)
    docs = np.frombuffer(zlib.decompress(file.read(size - FOOTER.size - where)), np.dtype("<i1,<i8,<u4"), n_docs)
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of Huffman-coded ids")
    limit, vocabulary, packed = struct.unpack("<BII", file.read(9))
    decoder = Decoder(np.frombuffer(zlib.decompress(file.read(packed)), np.uint8, vocabulary), limit)

    def runs() -> Iterator[np.ndarray]:
        for k in range(0, n_blocks, at_once):
            blocks = []
            for _ in range(k, min(k + at_once, n_blocks)):
                head = file.read(12)
                _, checks, body = struct.unpack("<III", head)
                blocks.append(head + file.read(4 * checks + body))
            yield decoder.blocks(blocks)

    source, run = runs(), np.empty(0, np.uint32)
    for null, doc_id, n in docs.tolist():
        parts, need = [], n
        while need:
            if not len(run):
                run = next(source)
            parts.append(run[:need])
            need -= len(parts[-1])
            run = run[len(parts[-1]) :]
        yield None if null else doc_id, n, parts
