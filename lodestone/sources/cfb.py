"""A reader of compound files, the container of HWP 5 and MSG."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA


def streams(data: bytes) -> dict[str, bytes]:
    """All streams by path, ``storage/name``."""
    if data[:8] != MAGIC:
        raise ValueError("not a compound file")
    size = 1 << struct.unpack_from("<H", data, 30)[0]
    mini_size = 1 << struct.unpack_from("<H", data, 32)[0]
    (directory,) = struct.unpack_from("<I", data, 48)
    cutoff, mini_first, _, more, n_more = struct.unpack_from("<5I", data, 56)
    sector = lambda k: data[size * (k + 1) : size * (k + 2)]
    fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < _END]
    for _ in range(n_more):
        if more >= _END:
            break
        block = struct.unpack(f"<{size // 4}I", sector(more))
        fat_sectors += [s for s in block[:-1] if s < _END]
        more = block[-1]
    fat: list[int] = []
    for s in fat_sectors:
        fat += struct.unpack(f"<{size // 4}I", sector(s).ljust(size, b"\xff"))

    def chain(first: int, table: list[int], read) -> bytes:
        out, seen = [], set()
        while first < _END and first < len(table) and first not in seen:
            seen.add(first)
            out.append(read(first))
            first = table[first]
        return b"".join(out)

    entries = []
    raw = chain(directory, fat, sector)
    for at in range(0, len(raw) - 127, 128):
        e = raw[at : at + 128]
        (n,) = struct.unpack_from("<H", e, 64)
        left, right, child = struct.unpack_from("<3I", e, 68)
        start, length = struct.unpack_from("<II", e, 116)
        entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length))
    if not entries:
        return {}
    mini = chain(entries[0][5], fat, sector)
    mini_raw = chain(mini_first, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw))
    out: dict[str, bytes] = {}
    stack, seen = [(entries[0][4], "")], set()
    while stack:
        k, prefix = stack.pop()
        if k >= len(entries) or k in seen:
            continue
        seen.add(k)
        name, kind, left, right, child, start, length = entries[k]
        stack += [(left, prefix), (right, prefix)]
        if kind == 1:
            stack.append((child, f"{prefix}{name}/"))
        elif kind == 2:
            body = chain(start, mini_fat, lambda s: mini[s * mini_size : (s + 1) * mini_size]) if length < cutoff else chain(start, fat, sector)
            out[prefix + name] = body[:length]
    return out
