"""Words of texts, and compact bytes for numbers."""

from __future__ import annotations

import re

import numpy as np
import zstandard

# Unicode white space, as the pattern means it (U+001C to U+001F are none).
WHITE_SPACE = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What keeps a text from being cut before each of its blanks: other white space than single blanks and line ends.
ODD = tuple(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c) and c not in " \n") + ("  ", " \n", "\n ")
WORD = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


def squeeze(data: bytes, level: int = 5) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def pack_ids(numbers: np.ndarray, level: int = 5, planes: int = 4) -> bytes:
    """Numbers below 2**(8 * planes), planes 2 or 4, by byte planes: the high planes are nearly constant and compress away."""
    return squeeze(numbers.astype(f"<u{planes}").view(np.uint8).reshape(-1, planes).T.tobytes(), level)


def unpack_ids(data: bytes, planes: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(planes, -1).T).view(f"<u{planes}").reshape(-1)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + length[0]], then the next, and so on."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat((start - (end - length)).astype(np.int32), length) + np.arange(total, dtype=np.int32)]
