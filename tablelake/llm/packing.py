"""Several byte strings in one zstandard frame."""
from __future__ import annotations

import zstandard


def squeeze(*parts: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts))


def unsqueeze(packed: bytes) -> list[bytes]:
    data, out, at = zstandard.ZstdDecompressor().decompress(packed), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out
