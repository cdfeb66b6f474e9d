"""Media columns: progressive JPEG in and out, with numpy alone.

A DCT rounds, so samples can't carry arbitrary bytes without loss. The format's own unit can: the quantised
coefficient. ``store`` writes each payload byte as one coefficient of a valid 4:2:0 progressive JPEG with quantisers
of 1: a DC scan with restart intervals, spectral-selection scans with the upper bits, and successive-approximation
scans with the last bit. Byte b stands for the value b if b >= 128, else b - 255; these are the 256 values of
amplitude category 8, whose amplitude bits are b itself. DC values are sums of such differences within an MCU.

``decode`` reads any baseline-Huffman progressive JPEG of that sampling kind into coefficient arrays: entropy segments
in which every code is a zero bit of the same meaning are unpacked as arrays, all others symbol by symbol. ``pixels``
inverse-transforms the arrays, upsamples the chroma and returns the full-resolution RGB tensor.

A null text is empty; an empty text is one unit of 576 bytes 255. Equal texts, equal values: the transform works on
integers that doubles hold exactly, so a result doesn't depend on its batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups_of, utf8

UNIT = 576
FILL = 255
BLOCKS = 6  # of an MCU: four of luma, one of each chroma
MCU = 64 * BLOCKS
BANDS = ((1, 5), (6, 63))
MAX_MCUS = 4095  # of an image's column or row
#: JPEG's zigzag order, from its rule: diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Of the integer basis: 63 * 255 * SCALE / 4 and the DC term stay below 2**24, so 32-bit floats hold every sum exactly.
SCALE = 1 << 9


def _basis() -> np.ndarray:
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    two = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(two[ZIGZAG] * SCALE).astype(np.float32)


_BASIS = _basis()


def payload(text: bytes) -> bytes:
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text + bytes([FILL]) * (n - len(text))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman(kind: int, place: int, symbols: list[int]) -> bytes:
    """A table whose n-th symbol is n one bits and a zero bit."""
    return _segment(0xC4, bytes([kind << 4 | place]) + bytes([1 if i < len(symbols) else 0 for i in range(16)]) + bytes(symbols))


def _sos(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, t]) for c, t in components) + bytes([ss, se, ah << 4 | al]))


def _grid(mcus: int) -> tuple[int, int]:
    """Rows and columns of MCUs; more than one column only beyond the format's greatest height."""
    columns = -(-mcus // MAX_MCUS)
    return -(-mcus // columns), columns


def _by_component(units: np.ndarray, rows: int, columns: int) -> list[np.ndarray]:
    """(MCUs, 6, n) to each component's blocks in raster order."""
    luma = units[:, :4].reshape(rows, columns, 2, 2, -1).transpose(0, 2, 1, 3, 4)
    return [luma.reshape(4 * rows * columns, -1), units[:, 4], units[:, 5]]


def store(data: bytes) -> bytes:
    """A progressive JPEG whose coefficients are data; its length stands in a comment."""
    mcus = -(-len(data) // MCU)
    rows, columns = _grid(mcus)
    mcus = rows * columns
    units = np.full(mcus * MCU, FILL, np.uint8)
    units[: len(data)] = np.frombuffer(data, np.uint8)
    units = units.reshape(mcus, BLOCKS, 64)
    out = [
        b"\xff\xd8", _segment(0xFE, b"payload %d" % len(data)), _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * columns).to_bytes(2, "big") + b"\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _huffman(0, 0, [8]), _huffman(1, 0, [7]), _huffman(1, 1, [0]),
        _segment(0xDD, b"\x00\x01"), _sos([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0),
    ]
    bits = np.zeros((mcus, 56), np.uint8)
    bits[:, :54].reshape(mcus, 6, 9)[:, :, 1:] = np.unpackbits(units[:, :, 0]).reshape(mcus, 6, 8)
    bits[:, 54:] = 1
    parts = np.empty((mcus, 9), np.uint8)
    parts[:, :7] = np.packbits(bits.reshape(mcus, 7, 8), axis=2)[:, :, 0]
    parts[:, 7] = 0xFF
    parts[:, 8] = 0xD0 + np.arange(mcus) % 8
    stuffed = parts == 0xFF
    stuffed[:, 7] = False
    out.append(np.insert(parts.ravel(), np.flatnonzero(stuffed.ravel()) + 1, 0).tobytes()[:-2])
    out.append(_segment(0xDD, b"\x00\x00"))
    kinds = _by_component(units, rows, columns)
    for ss, se in BANDS:
        for c, blocks in enumerate(kinds):
            out += [_sos([(c + 1, 0)], ss, se, 0, 1), (blocks[:, ss : se + 1] >> 1).tobytes()]
    for c, blocks in enumerate(kinds):
        bits = np.zeros((len(blocks), 64), np.uint8)
        bits[:, 1:] = (blocks[:, 1:] & 1) ^ (blocks[:, 1:] < 128)
        out += [_sos([(c + 1, 1)], 1, 63, 1, 0), np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join(out) + b"\xff\xd9"


_next_marker = re.compile(rb"\xff[\x01-\xcf\xd8-\xff]").search
_restarts = re.compile(rb"\xff[\xd0-\xd7]").split


class _Bits:
    """Bits of one entropy-coded interval, one by one."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def bit(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def take(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = 2 * x + self.bit()
        return x

    def code(self, table: dict) -> int:
        x = n = 0
        while n < 16:
            x, n = 2 * x + self.bit(), n + 1
            if (n, x) in table:
                return table[n, x]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _scan_slow(parts: list[bytes], blocks: list[tuple[np.ndarray, int, dict, dict]], interval: int, ss: int, se: int, ah: int, al: int) -> None:
    """One scan, symbol by symbol. blocks: for each data unit in order its coefficients, component and tables, MCU by MCU."""
    for p, part in enumerate(parts):
        bits, before, skip = _Bits(part), {}, 0
        for mcu in blocks[p * interval : (p + 1) * interval] if interval else blocks:
            for c, comp, dc, ac in mcu:
                if ss == 0:
                    if ah:
                        c[0] |= bits.bit() << al
                    else:
                        before[comp] = before.get(comp, 0) + bits.value(bits.code(dc))
                        c[0] = before[comp] << al
                    continue
                k = ss
                if not ah:
                    if skip:
                        skip -= 1
                        continue
                    while k <= se:
                        r, s = divmod(bits.code(ac), 16)
                        if s:
                            k += r
                            c[k] = bits.value(s) * (1 << al)
                        elif r < 15:
                            skip = (1 << r) + bits.take(r) - 1
                            break
                        else:
                            k += 15
                        k += 1
                    continue

                def correct(k: int, c: np.ndarray = c) -> None:
                    if bits.bit() and not abs(int(c[k])) >> al & 1:
                        c[k] += (1 << al) if c[k] > 0 else -(1 << al)

                while k <= se and not skip:
                    r, s = divmod(bits.code(ac), 16)
                    new = 0
                    if s:
                        new = (1 << al) if bits.bit() else -(1 << al)
                    elif r < 15:
                        skip = (1 << r) + bits.take(r)
                        break
                    while k <= se:
                        if c[k]:
                            correct(k)
                        elif r:
                            r -= 1
                        else:
                            c[k] = new or c[k]
                            break
                        k += 1
                    k += 1
                if skip:
                    for j in range(k, se + 1):
                        if c[j]:
                            correct(j)
                    skip -= 1


def _first_zero(table: dict) -> int | None:
    """The symbol of the code that is one zero bit."""
    return table.get((1, 0))


def _scan_fast(parts: list[bytes], arrays: list[np.ndarray], layout: tuple, tables: list[tuple[dict, dict]], interval: int, ss: int, se: int, ah: int, al: int) -> bool:
    """One scan as arrays where each code is one zero bit; False if it is laid out otherwise."""
    if ss == 0:
        if ah or len(arrays) != 3 or interval != 1 or {_first_zero(dc) for dc, _ in tables} != {8}:
            return False
        n = layout[0] * layout[1]
        raw = b"".join(parts).replace(b"\xff\x00", b"\xff")
        if len(parts) != n or len(raw) != 7 * n:
            return False
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(n, 56)[:, :54].reshape(n, 6, 9)
        if bits[:, :, 0].any():
            return False
        b = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int64)
        d = np.where(b >= 128, b, b - 255)
        luma = np.cumsum(d[:, :4], axis=1).reshape(layout[0], layout[1], 2, 2).transpose(0, 2, 1, 3).ravel()
        for a, v in zip(arrays, (luma, d[:, 4], d[:, 5])):
            a[:, 0] = v * (1 << al)
        return True
    c, n, m = arrays[0], len(arrays[0]), se - ss + 1
    if len(parts) != 1:
        return False
    raw = np.frombuffer(parts[0].replace(b"\xff\x00", b"\xff"), np.uint8)
    ac = tables[0][1]
    if not ah:
        if _first_zero(ac) != 7 or len(raw) != n * m or (raw & 0x80).any():
            return False
        x = raw.reshape(n, m).astype(np.int32)
        x -= 127 * (x < 64)
        c[:, ss : se + 1] = x * (1 << al)
        return True
    if _first_zero(ac) != 0 or m != 63 or len(raw) != 8 * n or not c[:, 1:].all():
        return False
    bits = np.unpackbits(raw).reshape(n, 64)
    if bits[:, 0].any():
        return False
    add = bits[:, 1:].astype(np.int32)
    c[:, 1:] += np.where(c[:, 1:] > 0, add, -add) * (1 << al)
    return True


def decode(media: bytes, fast: bool = True) -> tuple[list[np.ndarray], tuple[int, int], bytes, list[np.ndarray]]:
    """Coefficients by component (blocks in raster order x 64 in zigzag order), MCU rows and columns, the comment, the quantisers."""
    at, tables, quant, interval, comment, arrays, layout, ids, which = 2, {}, {}, 0, b"", [], (0, 0), [], []
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                body = body[65:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC4:
            while body:
                counts, code, table, k = body[1:17], 0, {}, 17
                for n in range(16):
                    for _ in range(counts[n]):
                        table[n + 1, code] = body[k]
                        code, k = code + 1, k + 1
                    code *= 2
                tables[body[0]] = table
                body = body[k:]
        elif marker == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            layout = (-(-height // 16), -(-width // 16))
            ids = [body[6 + 3 * i] for i in range(body[5])]
            which = [body[8 + 3 * i] for i in range(body[5])]
            if [body[7 + 3 * i] for i in range(body[5])] != [0x22, 0x11, 0x11]:
                raise ValueError("only 4:2:0 is read")
            n = layout[0] * layout[1]
            arrays = [np.zeros((4 * n, 64), np.int32), np.zeros((n, 64), np.int32), np.zeros((n, 64), np.int32)]
        elif marker == 0xDA:
            comps = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            begin, at = at, _next_marker(media, at).start()
            parts = _restarts(media[begin:at])
            used = [(tables.get(t >> 4, {}), tables.get(0x10 | t & 15, {})) for _, t in comps]
            if not fast or not _scan_fast(parts, [arrays[c] for c, _ in comps], layout, used, interval, ss, se, ah, al):
                if len(comps) == 1:
                    units = [[(block, 0, *used[0])] for block in arrays[comps[0][0]]]
                else:
                    units, wide = [], 2 * layout[1]
                    for r in range(layout[0]):
                        for q in range(layout[1]):
                            mcu = [(arrays[0][(2 * r + i) * wide + 2 * q + j], 0, *used[0]) for i in (0, 1) for j in (0, 1)]
                            units.append(mcu + [(arrays[c][r * layout[1] + q], c, *used[c]) for c in (1, 2)])
                _scan_slow(parts, units, interval, ss, se, ah, al)
        elif marker not in range(0xE0, 0xF0):
            raise ValueError(f"marker {marker:x} isn't read")
    return arrays, layout, comment, [quant[q] for q in which]


def load(media: bytes, fast: bool = True) -> tuple[bytes, list[np.ndarray], tuple[int, int], list[np.ndarray]]:
    """The payload, read back from the coefficients that decode found, and what pixels() needs."""
    arrays, (rows, columns), comment, quant = decode(media, fast)
    n = rows * columns
    units = np.empty((n, BLOCKS, 64), np.int32)
    units[:, :4] = arrays[0].reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(n, 4, 64)
    units[:, 4], units[:, 5] = arrays[1], arrays[2]
    units[:, 1:4, 0] = np.diff(units[:, :4, 0], axis=1)
    units += 255 * (units < 0)
    data = units.astype(np.uint8).tobytes()
    return data[: int(comment.split()[1])], arrays, (rows, columns), quant


def _plane(blocks: np.ndarray, quant: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if (quant != 1).any():
        blocks = blocks * quant
    x = np.empty((len(blocks), 64), np.uint8)
    for i in range(0, len(blocks), 2048):
        y = blocks[i : i + 2048].astype(np.float32) @ _BASIS
        y *= np.float32(1 / SCALE)
        y += np.float32(128.5)
        np.clip(y, 0, 255, out=y)
        x[i : i + 2048] = y  # truncates, and all are positive
    return x.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)


def pixels(arrays: list[np.ndarray], layout: tuple[int, int], quant: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3, 8-bit RGB at full resolution."""
    rows, columns = layout
    y = _plane(arrays[0], quant[0], 2 * rows, 2 * columns).astype(np.int32)
    cb, cr = (_plane(arrays[k], quant[k], rows, columns).astype(np.int32) - 128 for k in (1, 2))
    # the colour terms at the chroma's resolution, then each for its four pixels
    terms = ((91881 * cr + 32768) >> 16, -((22554 * cb + 46802 * cr + 32768) >> 16), (116130 * cb + 32768) >> 16)
    out = np.empty((*y.shape, 3), np.uint8)
    wide = y.reshape(y.shape[0] // 2, 2, y.shape[1] // 2, 2)
    for k, t in enumerate(terms):
        v = wide + t[:, None, :, None]
        np.clip(v, 0, 255, out=v)
        out[..., k] = v.reshape(y.shape)
    return out


def feature(rgb: np.ndarray) -> str:
    """Height and width, the channels' sums, and the tensor's crc32."""
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{':'.join(map(str, sums.tolist()))}:{zlib.crc32(rgb)}"


# Many documents at once: images one MCU wide lie under one another, so all steps but the files' assembly and parsing
# run over a batch's blocks together. The files and features are those of store(), load() and feature().

_TABLES = (_segment(0xDB, b"\x00" + b"\x01" * 64), _huffman(0, 0, [8]) + _huffman(1, 0, [7]) + _huffman(1, 1, [0]) + _segment(0xDD, b"\x00\x01") + _sos([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0))
_SCRIPT = [(_sos([(c, 0)], ss, se, 0, 1), c - 1, ss, se) for ss, se in BANDS for c in (1, 2, 3)] + [(_sos([(c, 1)], 1, 63, 1, 0), c - 1, 0, 0) for c in (1, 2, 3)]


def store_many(payloads: list[bytes]) -> list[bytes]:
    mcus = np.array([-(-len(p) // MCU) for p in payloads])
    if mcus.max() > MAX_MCUS:
        return [store(p) for p in payloads]
    at = np.concatenate([[0], np.cumsum(mcus)])
    n = int(at[-1])
    units = np.frombuffer(b"".join(p.ljust(int(m) * MCU, bytes([FILL])) for p, m in zip(payloads, mcus)), np.uint8).reshape(n, BLOCKS, 64)
    bits = np.zeros((n, 56), np.uint8)
    bits[:, :54].reshape(n, 6, 9)[:, :, 1:] = np.unpackbits(units[:, :, 0]).reshape(n, 6, 8)
    bits[:, 54:] = 1
    parts = np.empty((n, 9), np.uint8)
    parts[:, :7] = np.packbits(bits.reshape(n, 7, 8), axis=2)[:, :, 0]
    parts[:, 7] = 0xFF
    parts[:, 8] = 0xD0 + (np.arange(n) - np.repeat(at[:-1], mcus)) % 8
    stuffed = parts == 0xFF
    stuffed[:, 7] = False
    dc = np.insert(parts.ravel(), np.flatnonzero(stuffed.ravel()) + 1, 0).tobytes()
    dc_at = 9 * at + np.concatenate([[0], np.cumsum(stuffed.sum(1))])[at]
    kinds = [units[:, :4].reshape(4 * n, 64), units[:, 4], units[:, 5]]
    scans = []
    for _, c, ss, se in _SCRIPT:
        blocks = kinds[c]
        if ss:
            scans.append(((blocks[:, ss : se + 1] >> 1).tobytes(), (4 if c == 0 else 1) * (se - ss + 1)))
        else:
            low = (blocks & 1) ^ (blocks < 128)
            low[:, 0] = 0
            scans.append((np.packbits(low, axis=1).tobytes(), (4 if c == 0 else 1) * 8))
    out = []
    for i, p in enumerate(payloads):
        a, b = int(at[i]), int(at[i + 1])
        file = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _TABLES[0], _segment(0xC2, b"\x08" + (16 * (b - a)).to_bytes(2, "big") + b"\x00\x10\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"), _TABLES[1], dc[dc_at[i] : dc_at[i + 1] - 2], _segment(0xDD, b"\x00\x00")]
        for (head, *_, se), (data, each) in zip(_SCRIPT, scans):
            part = data[a * each : b * each]
            file += [head, part if se else part.replace(b"\xff", b"\xff\x00")]
        out.append(b"".join([*file, b"\xff\xd9"]))
    return out


def _scans(media: bytes) -> tuple[list[bytes], int, int] | None:
    """The entropy segments of a file that is written by the script above, its MCUs and its payload's length; else None."""
    size = 4 + int.from_bytes(media[4:6], "big")
    head = size + len(_TABLES[0])
    if media[size:head] != _TABLES[0] or media[head + 7 : head + 19] != b"\x00\x10\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00" or media[head + 19 : head + 19 + len(_TABLES[1])] != _TABLES[1]:
        return None
    at, found = head + 19 + len(_TABLES[1]), []
    for marks in [b"", *(x[0] for x in _SCRIPT)]:
        if media[at : at + len(marks)] != marks:
            return None
        at += len(marks)
        end = _next_marker(media, at).start()
        found.append(media[at:end])
        at = end + (6 if not marks else 0)  # the end of restart intervals
    return found, int.from_bytes(media[head + 5 : head + 7], "big") // 16, int(media[14:size])


def load_many(medias: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and RGB tensors."""
    read = [_scans(m) for m in medias]
    if any(r is None for r in read):
        whole = [load(m) for m in medias]
        return [w[0] for w in whole], [pixels(*w[1:]) for w in whole]
    mcus = [r[1] for r in read]
    n = sum(mcus)
    arrays = [np.zeros((4 * n, 64), np.int32), np.zeros((n, 64), np.int32), np.zeros((n, 64), np.int32)]
    zero = [({(1, 0): 8}, {(1, 0): 7}), ({(1, 0): 8}, {(1, 0): 0})]
    ok = _scan_fast([x for r in read for x in _restarts(r[0][0])], arrays, (n, 1), zero[:1], 1, 0, 0, 0, 0)
    for k, (_, c, ss, se) in enumerate(_SCRIPT, 1):
        data = [b"".join([r[0][k] for r in read])]
        ok = ok and _scan_fast(data, [arrays[c]], (n, 1), zero[:1] if ss else zero[1:], 0, ss or 1, se or 63, 0 if ss else 1, 1 if ss else 0)
    if not ok:
        whole = [load(m) for m in medias]
        return [w[0] for w in whole], [pixels(*w[1:]) for w in whole]
    one = np.ones(64, np.int64)
    rgb = pixels(arrays, (n, 1), [one] * 3)
    units = np.empty((n, BLOCKS, 64), np.int32)
    units[:, :4] = arrays[0].reshape(n, 4, 64)
    units[:, 4], units[:, 5] = arrays[1], arrays[2]
    units[:, 1:4, 0] = np.diff(units[:, :4, 0], axis=1)
    units += 255 * (units < 0)
    data = units.astype(np.uint8).tobytes()
    at = np.concatenate([[0], np.cumsum(mcus)]).tolist()
    return [data[a * MCU : a * MCU + r[2]] for a, r in zip(at, read)], [rgb[16 * a : 16 * b] for a, b in zip(at, at[1:])]


def media_columns(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """Digests of what is stored and read back; with keep also the stored media and the RGB tensor with its shape."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if keep:
        names, kinds = [*names, "media", "rgb", "height", "width"], [*kinds, pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def many(texts: list[bytes]) -> Iterator[tuple]:
        medias = store_many([payload(t) for t in texts])
        for t, media, back, rgb in zip(texts, medias, *load_many(medias)):
            row = (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb))
            yield (*row, media, rgb.tobytes(), rgb.shape[0], rgb.shape[1]) if keep else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch, text)
            for i, j in groups_of([len(t) + UNIT for t in texts], 1 << 18):
                rows = list(many(texts[i:j]))
                yield pa.record_batch({"doc_id": batch.column(0).slice(i, j - i)} | {n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds))})

    key = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", text).mapInArrow(run, ddl + ", media binary, rgb binary, height long, width long" * keep)
