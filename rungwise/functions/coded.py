"""The coded binary stream: 100-byte blocks, each closed by CR LF, behind a five-byte mark.

A stored byte is the plain one under exclusive or with a key that depends on the
number of plain bytes before it; bytes of value 1 are for synchronisation only.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
MARK = b"\x80 3.1"
BLOCK = 100
SYNC = 1


class FormatError(ValueError):
    """Source that can't be decoded: bad framing or an unknown marker."""


def key_stream(n: int) -> np.ndarray:
    return ((7 * np.arange(n, dtype=np.int64) + 8) % 128).astype(np.uint8)


def decode(data: bytes) -> str:
    """The program text, lines ending in CR; what follows the last CR is dropped."""
    if data[: len(MARK)] != MARK:
        raise FormatError("coded stream: missing mark")
    body = np.frombuffer(data, np.uint8)[len(MARK) + 2 :]
    if len(body) % (BLOCK + 2):
        raise FormatError(f"coded stream: payload is no multiple of {BLOCK + 2} bytes")
    frames = body.reshape(-1, BLOCK + 2)
    bad = np.flatnonzero((frames[:, BLOCK] != 13) | (frames[:, BLOCK + 1] != 10))
    if len(bad):
        raise FormatError(f"coded stream: block {bad[0]} has no CR LF")
    stored = frames[:, :BLOCK].reshape(-1)
    stored = stored[stored != SYNC]
    plain = (stored & 0x7F) ^ key_stream(len(stored))
    text = plain.tobytes().decode("ascii")
    cr = text.rfind("\r")
    return text if cr < 0 else text[:cr]


def encode(text: str) -> bytes:
    """A coded stream of ASCII text; a stored 1 would be taken for synchronisation, so its high bit is set."""
    plain = np.frombuffer((text + "\r").encode("ascii"), np.uint8)
    stored = plain ^ key_stream(len(plain))
    stored = np.where(stored == SYNC, stored | 0x80, stored).astype(np.uint8)
    filled = np.full(-(-len(stored) // BLOCK) * BLOCK, SYNC, np.uint8)
    filled[: len(stored)] = stored
    frames = np.empty((len(filled) // BLOCK, BLOCK + 2), np.uint8)
    frames[:, :BLOCK] = filled.reshape(-1, BLOCK)
    frames[:, BLOCK:] = (13, 10)
    return MARK + b"\r\n" + frames.tobytes()
