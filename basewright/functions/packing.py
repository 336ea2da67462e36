"""Payloads of single records in numpy: linear in the sequence's length, for the container's source and sink.

The same results as the column functions in ``bases`` and ``wire``, which suit queries over many short sequences;
here a record may be a whole chromosome, of which no list of parts is made.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import codes

BITS = {"2b": 2, "3b": 3, "4b": 4}
NONE = 255


def table(symbols: str, digits: str) -> np.ndarray:
    """Digit of each byte; NONE for bytes that have none."""
    out = np.full(256, NONE, np.uint8)
    for symbol, digit in zip(symbols, digits):
        out[ord(symbol)] = int(digit, 16)
    return out


def inverse(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode("ascii"), np.uint8)


UPPER = np.arange(256, dtype=np.uint8)
UPPER[ord("a") : ord("z") + 1] -= 32
DIGITS = {
    "2b": table(codes.TWO_BIT_SYMBOLS, codes.TWO_BIT_DIGITS),
    "3b": table(codes.THREE_BIT_SYMBOLS, codes.THREE_BIT_DIGITS),
    "4b": table(codes.FOUR_BIT_SYMBOLS, codes.FOUR_BIT_DIGITS)[UPPER],
}
SYMBOLS = {"2b": inverse(codes.TWO_BIT_INVERSE), "3b": inverse(codes.THREE_BIT_INVERSE), "4b": inverse(codes.FOUR_BIT_INVERSE), "v1": inverse(codes.LEGACY_INVERSE)}
RNA = UPPER.copy()
RNA[:] = np.arange(256)
RNA[[ord("T"), ord("t")]] = [ord("U"), ord("u")]
VALID, DEGENERATE = np.zeros(256, bool), np.zeros(256, bool)
VALID[list(codes.VALID.encode())] = True
DEGENERATE[list((codes.DEGENERATE + codes.DEGENERATE.lower() + "-").encode())] = True


def lower_case(data: np.ndarray) -> np.ndarray:
    return (data >= ord("a")) & (data <= ord("z"))


def encoding_of(data: np.ndarray) -> str:
    """data: a sequence's bytes without line feeds. An error for symbols outside the alphabet."""
    bad = np.flatnonzero(~VALID[data])
    if len(bad):
        symbol = data[bad[0] :].tobytes().decode("utf-8", "replace")[0]
        raise ValueError(f"Unsupported symbol (amino acids?): {symbol}")
    return "4b" if DEGENERATE[data].any() else "3b" if lower_case(data).any() else "2b"


def packed(data: np.ndarray, enc: str) -> bytes:
    """data: a sequence's bytes without line feeds and blanks."""
    digits = DIGITS[enc][data]
    bits = BITS[enc]
    if bits == 3:
        return np.packbits(np.unpackbits(digits[:, None], axis=1)[:, 5:]).tobytes()
    per = 8 // bits
    digits = np.concatenate([digits, np.zeros(-len(digits) % per, np.uint8)]).reshape(-1, per)
    return np.bitwise_or.reduce(digits << np.arange(8 - bits, -1, -bits, dtype=np.uint8), axis=1).astype(np.uint8).tobytes()


def case_runs(data: np.ndarray) -> np.ndarray:
    """Rows of start and length of each run of lower-case letters."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], lower_case(data), [False]]).astype(np.int8)))
    return np.stack([edges[::2], edges[1::2] - edges[::2]], axis=1)


def block(kind: int, length: int, body: bytes) -> bytes:
    return struct.pack("<BI", kind, length) + body


def record(description: str | None, sequence: str | None, nuc: str | None) -> bytes:
    """A record's blocks and their checksum."""
    sequence = sequence or ""
    data = np.frombuffer(sequence.encode("utf-8"), np.uint8)
    enc = encoding_of(data[data != ord("\n")])
    data = data[(data != ord("\n")) & (data != ord(" "))]
    described = (description or "").encode("utf-8")
    tag = b"R" if (nuc or "")[:1] in ("R", "r") or "U" in sequence else b"D"
    body = block(codes.BLOCK_DESCRIPTION, len(described), described) + block(codes.BLOCK_TYPE, 1, tag)
    body += block(codes.BLOCK_OF[enc], len(data), packed(data, enc))
    if enc == "4b" and len(runs := case_runs(data)):
        body += block(codes.BLOCK_RUNS, 8 * len(runs), runs.astype("<u4").tobytes())
    return body + struct.pack("<I", zlib.crc32(body))


def unpacked(payload: bytes, n: int, enc: str, tag: str, runs: list | None = None) -> str:
    """The sequence of a payload of n bases; runs: pairs of start and length, whose ends are cut at the length."""
    data = np.frombuffer(payload, np.uint8)
    if enc == "3b":
        digits = np.packbits(np.unpackbits(data, count=3 * n).reshape(n, 3), axis=1, bitorder="big")[:, 0] >> 5
    else:
        bits = BITS.get(enc, 4)
        digits = ((data[:, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8)) & ((1 << bits) - 1)).ravel()[:n]
    out = SYMBOLS[enc][digits]
    if tag == "R":
        out = RNA[out]
    for start, length in runs if runs is not None else ():
        part = out[start : start + length]
        part[(part >= ord("A")) & (part <= ord("Z"))] += 32
    return out.tobytes().decode("ascii")
