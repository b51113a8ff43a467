"""Provenance metadata in media files: images (PNG, JPEG, WebP, AVIF, HEIC, BMP, GIF, TIFF), sound and film (MP3, WAV, FLAC, MP4).

A reader for each format walks a file by the lengths it states and names its *parts*: where a part lies, what it says by
being there, which words to look for in it, and when it may go. One set of rules makes findings of parts, another cuts them
out, so what is reported and what is removed are the same parts. Pixels and samples are never looked at. Damaged files give
what was read before the damage; where a format's walk may end early its bytes are searched as a whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsieve.functions import fixed

MAX_TEXT_BYTES = 1 << 20
MAX_DIRECTORIES = 4096
PNG_START = b"\x89PNG\r\n\x1a\n"
META = [*fixed.AI_META_HINTS, *fixed.C2PA_MARKERS]
#: Words that tell a C2PA manifest; in PNG and in plain boxes without the last.
NARROW = ("c2pa", "contentcredentials", "jumb")
WIDE = (*NARROW, "contentauth")
XMP_BOX = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
C2PA_BOX = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
#: When a part goes: never, if it holds marks, also if all metadata is to go, always.
NEVER, MARKED, ALL, ALWAYS = range(4)
REPORT = "struct<format:string,has_c2pa:boolean,has_ai:boolean,findings:array<string>>"
CLEANED = "struct<content:binary,actions:array<string>,still_has_c2pa:boolean,still_has_ai:boolean>"


class Part(NamedTuple):
    at: int
    end: int
    name: str = ""
    value: bytes = b""
    #: Findings that its presence makes, and whether that is a manifest or a mark.
    said: tuple[str, ...] = ()
    manifest: bool = False
    ai: bool = False
    needles: list[str] = META
    labels: tuple[str, ...] = WIDE
    most: int = 8
    also: tuple[str, ...] = ()
    drop: int = NEVER
    action: str = ""
    #: Bytes of a box's header; such a part becomes free space of its size. None: it is cut out.
    header: int | None = None
    #: What is searched to decide whether it goes, if not ``value``.
    judged: bytes | None = None


class Walk(NamedTuple):
    parts: list[Part]
    #: Whether the walk saw the file's end.
    whole: bool = True
    #: Bytes from here on are left as they are.
    stop: int | None = None


def held(value: bytes, needles: list[str]) -> list[str]:
    """The needles that occur, whatever their case, in their order."""
    low = value.lower()
    return [n for n in needles if n.lower().encode() in low]


# PNG


def _inflated(value: bytes) -> bytes | None:
    """None if there is more than ``MAX_TEXT_BYTES`` of it; a broken stream is empty."""
    try:
        out = zlib.decompressobj().decompress(value, MAX_TEXT_BYTES + 1)
    except zlib.error:
        return b""
    return out if len(out) <= MAX_TEXT_BYTES else None


def png_text(kind: str, value: bytes) -> tuple[str, bytes] | None:
    """Keyword and text (UTF-8) of a text chunk; None if the text is too long to be read."""
    key, found, rest = value.partition(b"\0")
    packed, ok = kind == "zTXt", bool(found)
    if kind == "zTXt":
        rest, ok = rest[1:], ok and len(rest) > 1
    elif kind == "iTXt":
        packed, fields = rest[:1] == b"\1", rest[2:].split(b"\0", 2)
        rest, ok = fields[-1], ok and len(fields) == 3
    text = _inflated(rest) if packed and ok else rest
    if text is None:
        return None
    return key.decode("latin-1"), (text if kind == "iTXt" else text.decode("latin-1").encode()) if ok else b""


def _png(data: bytes) -> Walk:
    parts, at = [], len(PNG_START)
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        raw, end = data[at + 4 : at + 8], at + 12 + size
        name = raw.decode("latin-1")
        if end > len(data):
            return Walk([*parts, Part(at, len(data), said=(f"truncated chunk {raw!r}",), action=f"kept {len(data) - at} bytes of truncated chunk {name} tail (file truncated)")], False)
        value = data[at + 8 : end - 4]
        said = (f"PNG chunk {name} (possible C2PA container)",) if raw in (b"caBX", b"juMB", b"jumb") or raw.startswith(b"c2") else ()
        part = Part(at, end, f"PNG {name}", said=said, manifest=bool(said), labels=NARROW, action=f"drop chunk {name}")
        if name in ("tEXt", "zTXt", "iTXt"):
            text = png_text(name, value)
            if text is None:
                parts.append(part._replace(said=(*said, f"PNG {name}: not fully inspected (decompressed text exceeds cap)"), drop=ALWAYS, action=f"drop chunk {name} (decompressed text exceeds cap)"))
            else:
                key = text[0].strip()
                products = [f"{key}={p}" for p in held(text[1], fixed.PRODUCTS)] if key.lower() in fixed.GENERATOR_TEXT_KEYS else []
                parts.append(part._replace(value=value + b"\n" + text[1], also=tuple(products), drop=ALL))
        elif name == "eXIf":
            parts.append(part._replace(value=value, drop=ALWAYS))
        elif raw == b"caBX" or raw.startswith(b"c2"):
            parts.append(part._replace(drop=ALWAYS))
        elif name not in fixed.PNG_PICTURE_CHUNKS:
            parts.append(part._replace(needles=fixed.C2PA_MARKERS, judged=raw + value, drop=MARKED, most=0, action=f"drop chunk {name} (C2PA marker in payload)"))
        at = end
        if name == "IEND":
            return Walk([*parts, Part(at, len(data), drop=ALWAYS)])
    return Walk(parts, at == len(data))


# JPEG


def _jpeg(data: bytes) -> Walk:
    parts, at, n, stop = [], 2, len(data), None
    while at + 4 <= n:
        if data[at] != 0xFF:
            if stop is None:
                stop = at
                parts.append(Part(at, at, action="copied remainder after non-marker byte"))
            at += 1
            continue
        first = at
        while at < n and data[at] == 0xFF:
            at += 1
        marker, at = data[at] if at < n else 0xD9, at + 1
        if marker == 0xDA:
            parts.append(Part(first, first, action="preserved entropy-coded scan (SOS→EOF)"))
            break
        if marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if at + 2 > n:
            break
        if size < 2 or at + size > n:
            return Walk([*parts, Part(first, n, said=(f"bad segment length at marker 0x{marker:02X}",), action="truncated segment; copied remainder")], False, stop)
        value, at = data[at + 2 : at + size], at + size
        if marker == 0xFE:
            parts.append(Part(first, at, "JPEG COM", value, needles=fixed.JPEG_COMMENT_HINTS, drop=ALL, action="drop COM comment"))
        elif 0xE0 <= marker <= 0xEF:
            app = f"APP{marker - 0xE0}"
            part = Part(first, at, f"JPEG {app}", value, most=8 if app in ("APP1", "APP2", "APP11", "APP13", "APP14") else 0, drop=MARKED if app == "APP0" else ALL, action=f"drop {app}" + " (AI/C2PA markers)" * (app == "APP0"))
            parts.append(part._replace(said=("JPEG APP11 segment (JUMBF/C2PA common)",), manifest=True, drop=ALWAYS, action="drop APP11 (C2PA/JUMBF)") if app == "APP11" else part)
    return Walk(parts, True, stop)


# RIFF: WebP and WAV


def riff_chunks(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """``(name, start, value's end, end)``; the last one may end behind the data."""
    at = 12
    while at + 8 <= len(data):
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4].decode("latin-1"), at, end, end + end % 2
        at = end + end % 2


def _webp(data: bytes) -> Walk:
    parts, at, damage = [], 12, ()
    declared = int.from_bytes(data[4:8], "little") + 8
    if declared != len(data):
        damage += (f"RIFF size mismatch: header={declared} actual={len(data)}",)
    for name, start, value_end, end in riff_chunks(data):
        if end > len(data):
            damage += (f"truncated WebP chunk {name}",)
            break
        value, at = data[start + 8 : value_end], end
        if name.upper() == "C2PA":
            parts.append(Part(start, end, said=("WebP C2PA chunk",), manifest=True, drop=ALWAYS, action=f"drop WebP chunk {name}"))
        elif name in fixed.WEBP_FLAGS:
            parts.append(Part(start, end, f"WebP {name}", value, most=0 if name == "ICCP" else 8, drop=ALL, action=f"drop WebP chunk {name}"))
    else:
        if at != len(data):
            damage += (f"trailing WebP bytes: {len(data) - at}",)
    if damage:  # its sizes can't be put right
        return Walk([Part(0, 0, said=damage, action="malformed WebP: " + "; ".join(damage)), *parts], False, 0)
    return Walk(parts)


def _webp_sizes(out: bytearray, gone: list[bytes]) -> None:
    out[4:8] = struct.pack("<I", len(out) - 8)
    flags = sum(fixed.WEBP_FLAGS[name] for name in {raw[:4].decode("latin-1") for raw in gone} if name in fixed.WEBP_FLAGS)
    if out[12:16] == b"VP8X" and len(out) > 20:
        out[20] &= ~flags & 0xFF


def _wav(data: bytes) -> Walk:
    parts, name = [], "WAV"
    for chunk, start, value_end, end in riff_chunks(data):
        if value_end > len(data):
            return Walk(parts, False)
        value = data[start + 8 : value_end]
        part = Part(start, min(end, len(data)), needles=fixed.AI_META_HINTS, drop=ALL)
        if chunk == "C2PA":
            parts.append(part._replace(said=("WAV C2PA-related manifest chunk",), manifest=True, drop=ALWAYS, action="drop WAV C2PA chunk"))
        elif chunk == "LIST" and value[:4] == b"INFO":
            parts.append(part._replace(name=f"{name} LIST INFO chunk", value=value, action="drop WAV LIST INFO chunk"))
        elif chunk in ("id3 ", "ID3 "):
            parts.append(part._replace(judged=value, most=0, action="drop WAV id3 chunk"))
            inner = _found(_mp3(value), NO_SCAN, value)
            if inner[1]:
                parts.append(Part(start, start, said=tuple(f"WAV id3 chunk / {x}" for x in inner[2]), manifest=inner[0], ai=True))
    return Walk(parts)


def _riff_size(out: bytearray, gone: list[bytes]) -> None:
    out[4:8] = struct.pack("<I", len(out) - 8)


# Boxes: AVIF, HEIC, MP4


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """``(type, start, value's start, end)`` of the boxes that end inside ``[at, end)``."""
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield data[at + 4 : at + 8], at, at + head, at + size
        at += size


def _is_manifest(kind: bytes) -> bool:
    return kind == b"jumb" or kind.lower().startswith(b"c2")


def _has_c2pa_type(value: bytes) -> bool:
    return C2PA_BOX in (value[:16], value[4:20])


def _boxed(data: bytes, fmt: str) -> Walk:
    parts, at = [], 0
    for kind, start, inner, end in boxes(data, 0, len(data)):
        at, name, value = end, kind.decode("latin-1"), data[inner:end]
        part = Part(start, end, header=inner - start)
        where, top = f"{fmt} ", f"drop top-level {name} box"
        if _is_manifest(kind):
            parts.append(part._replace(said=(f"{where}top-level box {name} (C2PA/JUMBF manifest)",), manifest=True, drop=ALWAYS, action=f"{top} (C2PA/JUMBF)"))
        elif kind == b"uuid" and value.startswith(XMP_BOX):
            marks = held(value[16:], META)
            parts.append(part._replace(name=f"{where}XMP uuid box", value=value[16:], said=() if marks else (f"{where}XMP uuid box",), ai=True, drop=ALWAYS, action=f"{top} (XMP metadata)"))
        elif kind == b"uuid" and _has_c2pa_type(value):
            parts.append(part._replace(said=(f"{where}uuid box (C2PA content-provenance manifest, user type d8fec3d6...)",), manifest=True, drop=ALWAYS, action=f"{top} (C2PA content-provenance manifest)"))
        elif kind == b"uuid":
            parts.append(part._replace(name=f"{where}uuid box", value=value, labels=NARROW, drop=ALL, action=f"{top} (UUID metadata)"))
        elif kind == b"meta":
            parts += _meta_boxes(data, inner + 4, end, where)
        elif kind == b"moov" and fmt == "MP4":
            for sub, s_start, s_inner, s_end in boxes(data, inner, end):
                if sub == b"udta":
                    parts.append(Part(s_start, s_end, "MP4 moov/udta box", data[s_inner:s_end], needles=fixed.AI_META_HINTS, drop=ALL, header=s_inner - s_start, action="drop moov/udta box (generator/user-data tags)"))
    if len(data) - at >= 8:
        parts.append(Part(at, at, action=f"kept {len(data) - at} bytes of truncated tail (file truncated)"))
    # Sound and film list their user data last.
    return Walk(sorted(parts, key=lambda p: p.name == "MP4 moov/udta box"), at == len(data))


def _meta_boxes(data: bytes, at: int, stop: int, where: str) -> Iterator[Part]:
    for kind, start, inner, end in boxes(data, at, stop):
        name, value = kind.decode("latin-1"), data[inner:end]
        part, action = Part(start, end, header=inner - start, labels=NARROW), f"drop meta sub-box {name}"
        if _is_manifest(kind):
            yield part._replace(said=(f"{where}meta sub-box {name} (C2PA/JUMBF container)",), manifest=True, drop=ALWAYS, action=f"{action} (C2PA/JUMBF)")
        elif kind == b"uuid" and value.startswith(XMP_BOX):
            yield part._replace(name=f"{where}meta XMP uuid", value=value[16:], said=() if held(value[16:], META) else (f"{where}meta XMP uuid box",), ai=True, drop=ALWAYS, action=f"{action} (XMP metadata)")
        elif kind == b"uuid" and _has_c2pa_type(value):
            yield part._replace(said=(f"{where}meta uuid box (C2PA content-provenance manifest)",), manifest=True, drop=ALWAYS, action=f"{action} (C2PA content-provenance manifest)")
        elif kind == b"uuid":
            yield part._replace(name=f"{where}meta uuid", value=value, labels=(), drop=ALL, action=f"{action} (UUID metadata)")
        elif kind in (b"iinf", b"infe", b"iref", b"iloc", b"xml ", b"bxml"):
            xml = kind in (b"xml ", b"bxml")
            yield part._replace(name=f"{where}meta/{name}", value=value, drop=ALL if xml else NEVER, action=f"{action} (XML metadata)" if xml else "")


# BMP, GIF


def _bmp(data: bytes) -> Walk:
    """Pixels end where the header says; what is behind them is no picture."""
    if len(data) < 38:
        return Walk([Part(0, 0, said=("BMP has no metadata (header-only raster format)",), action="BMP header not fully parsed; left unchanged")])
    pixels, head, width, height, _, depth, packed, size = struct.unpack("<IIiiHHII", data[10:38])
    if not packed:
        size = (width * depth + 31) // 32 * 4 * abs(height)
    known = head >= 40 and 14 + head <= len(data) and width > 0 and depth and pixels <= len(data) and (size or not packed)
    end = min(len(data), pixels + size) if known else len(data)
    if end == len(data):
        return Walk([Part(0, 0, said=("BMP has no metadata (header-only raster format)",), action="no BMP trailing metadata to strip" if known else "BMP header not fully parsed; left unchanged")])
    rest = data[end:]
    marks = held(rest, META)
    why = f" ({', '.join(marks[:4])})" if marks else ""
    return Walk([Part(end, len(data), "BMP trailing metadata", rest, () if marks else (f"BMP has {len(rest)} unrecognized trailing byte(s)",), most=6, drop=ALL, action=f"drop {len(rest)} BMP trailing byte(s){why}")])


def _bmp_size(out: bytearray, gone: list[bytes]) -> None:
    out[2:6] = struct.pack("<I", len(out))


def _gif_blocks(data: bytes, at: int) -> tuple[int, bytes] | None:
    """Where a chain of sub-blocks ends, and their bytes joined; None if the file ends first."""
    joined = bytearray()
    while at < len(data):
        size = data[at]
        if not size:
            return at + 1, bytes(joined)
        joined += data[at + 1 : at + 1 + size]
        at += 1 + size
    return None


def _gif(data: bytes) -> Walk:
    if len(data) < 13:
        return Walk([Part(0, 0, said=("truncated GIF header",))], False, 0)
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    at, parts = 13 + table(data[10]), []
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            chain = _gif_blocks(data, at + 2)
            if not chain:
                return Walk([*parts, Part(at, at, said=("truncated GIF extension",))], False)
            end, value = chain
            part = Part(at, end, value=value, labels=(), most=6, drop=ALL)
            if label == 0xFE:
                parts.append(part._replace(name="GIF comment", said=("GIF comment extension present",), action="drop GIF comment extension"))
            elif label == 0xFF:
                owner = value[:11]
                if owner == b"XMP DataXMP":
                    parts.append(part._replace(name="GIF XMP", said=("GIF XMP application extension present",), action="drop GIF XMP application extension"))
                else:
                    manifest = any(m in owner for m in (b"c2pa", b"jumb", b"C2PA", b"JUMB"))
                    control = owner.decode("latin-1") in fixed.GIF_CONTROL
                    parts.append(part._replace(most=0, said=("GIF application extension (possible C2PA)",) if manifest else (), manifest=manifest, drop=MARKED if control else ALL, action=f"drop GIF {'control ' * control}application extension"))
            at = end
        elif data[at] == 0x2C:
            chain = _gif_blocks(data, at + 11 + table(data[at + 9])) if at + 10 <= len(data) else None
            if not chain:
                return Walk([*parts, Part(at, at, said=("truncated GIF image block",))], False)
            at = chain[0]
        else:
            at += 1
    return Walk(parts)


# TIFF


class _Entry(NamedTuple):
    tag: int
    raw: bytes
    at: int | None
    size: int
    value: bytes | None
    pointer: int


class _Tiff:
    """The directories of a file: chains, and what ``fixed.TIFF_POINTERS`` point to, each once."""

    def __init__(self, data: bytes):
        order = "little" if data[:2] == b"II" else "big"
        self.number = lambda raw: int.from_bytes(raw, order)
        self.write = lambda n, size: n.to_bytes(size, order)
        big = 43 in data[2:4]
        self.count, self.entry, self.word = (8, 20, 8) if big else (2, 12, 4)
        self.data, self.found = data, {}
        todo = [self.number(data[8:16] if big else data[4:8])]
        while todo and len(self.found) < MAX_DIRECTORIES:
            at = todo.pop()
            if not at or at in self.found:
                continue
            n = self.number(data[at : at + self.count])
            last = at + self.count + n * self.entry
            if at + self.count > len(data) or last > len(data):
                raise ValueError("directory outside of the file")
            entries = [self._read(data[k : k + self.entry]) for k in range(at + self.count, last, self.entry)]
            after = self.number(data[last : last + self.word])
            self.found[at] = (entries, last, after)
            todo += [after, *(e.pointer for e in entries if e.tag in fixed.TIFF_POINTERS)]

    def _read(self, raw: bytes) -> _Entry:
        kind, n = self.number(raw[2:4]), self.number(raw[4 : 4 + self.word])
        size, slot = fixed.TIFF_SIZES.get(kind, 1) * n, raw[4 + self.word :]
        pointer = self.number(slot)
        if size <= self.word:
            return _Entry(self.number(raw[:2]), raw, None, size, slot[:size], pointer)
        return _Entry(self.number(raw[:2]), raw, pointer, size, self.data[pointer : pointer + size] if pointer + size <= len(self.data) else None, pointer)

    def marked(self, e: _Entry) -> bool:
        below = self.found.get(e.pointer) if e.tag in fixed.TIFF_POINTERS else None
        return bool(held(e.value or b"", META)) or bool(below) and any(held(x.value or b"", META) for x in below[0])


def _tiff(data: bytes) -> Walk:
    try:
        t = _Tiff(data)
    except ValueError:
        return Walk([Part(0, 0, said=("not a valid TIFF",))], False, 0)
    if not t.found:
        return Walk([Part(0, 0, said=("TIFF with no image file directories",))], False, 0)
    parts = []
    for _, (entries, _, _) in sorted(t.found.items()):
        for e in entries:
            name = fixed.TIFF_TAGS.get(e.tag)
            parts.append(Part(0, 0, f"TIFF tag {e.tag}", e.value or b"", most=6))
            if name:
                parts.append(Part(0, 0, said=(f"TIFF {'sub-IFD' if e.tag in fixed.TIFF_POINTERS else 'tag'} {e.tag} ({name}) present",)))
    return Walk(parts)


def strip_tiff(data: bytes, everything: bool = True) -> tuple[bytes, list[str]]:
    """Entries go, what they alone refer to becomes zeros, and nothing else moves."""
    t = _Tiff(data)
    out, actions, kept = bytearray(data), [], {}
    for at, (entries, last, after) in sorted(t.found.items()):
        kept[at] = []
        for e in entries:
            marked = t.marked(e)
            if not (marked and (e.tag in fixed.TIFF_TAGS or not _structural(e.tag)) or everything and e.tag in fixed.TIFF_TAGS):
                kept[at].append(e)
            else:
                actions.append(f"drop TIFF tag {e.tag} ({fixed.TIFF_TAGS.get(e.tag, 'AI markers')})")
        body = b"".join(e.raw for e in kept[at]) + t.write(after, t.word)
        out[at : at + t.count] = t.write(len(kept[at]), t.count)
        out[at + t.count : last + t.word] = body.ljust(last + t.word - at - t.count, b"\0")
    # What is still reached from the first directory stays as it is.
    live, todo = set(), [t.number(data[8:16] if t.word == 8 else data[4:8])]
    while todo:
        at = todo.pop()
        if at in t.found and at not in live:
            live.add(at)
            todo += [t.found[at][2], *(e.pointer for e in kept[at] if e.tag in fixed.TIFF_POINTERS)]
    used = bytearray(len(data))
    spans = lambda e: range(e.at, min(len(data), e.at + e.size)) if e.at is not None else range(0)
    for at in live:
        used[at : t.found[at][1] + t.word] = b"\1" * (t.found[at][1] + t.word - at)
        for e in kept[at]:
            s = spans(e)
            used[s.start : s.stop] = b"\1" * len(s)
            if e.tag in fixed.TIFF_STRIPS and e.value:  # pixels: offsets with counts beside them
                other = next((x for x in kept[at] if x.tag == fixed.TIFF_STRIPS[e.tag]), None)
                for place, size in zip(_numbers(t, e), _numbers(t, other) if other else [], strict=False):
                    used[place : min(len(data), place + size)] = b"\1" * max(0, min(len(data), place + size) - place)
    for at, (entries, last, _) in t.found.items():
        gone = [e for e in entries if at not in live or e not in kept[at]]
        for s in [range(at, last + t.word)] * (at not in live) + [spans(e) for e in gone]:
            for k in s:
                if k < len(out) and not used[k]:
                    out[k] = 0
    return bytes(out[: len(data)]), actions


def _numbers(t: _Tiff, e: _Entry) -> list[int]:
    width = fixed.TIFF_SIZES.get(t.number(e.raw[2:4]), 1)
    return [t.number((e.value or b"")[k : k + width]) for k in range(0, len(e.value or b""), width)]


def _structural(tag: int) -> bool:
    return any(low <= tag <= high for low, high in fixed.TIFF_STRUCTURE)


# ID3: MP3 and FLAC


def _seven(raw: bytes) -> int:
    return sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(raw))


def id3_frames(data: bytes) -> tuple[int, list[tuple[str, int, int]]] | None:
    """The tag's size and ``(frame, start, end)``; None if it isn't well formed. Tags of version 2.2 have no frames here."""
    major, flags, end = data[3], data[5], 10 + _seven(data[6:10])
    total = end + (10 if major == 4 and flags & 0x10 else 0)
    if total > len(data) or total > end and data[end:total] != b"3DI" + data[3:10]:
        return None
    if major < 3:
        return total, []
    size_of = _seven if major == 4 else lambda raw: int.from_bytes(raw, "big")
    at, frames = 10, []
    if flags & 0x40:
        at += size_of(data[10:14]) + (0 if major == 4 else 4)
    if at > end:
        return None
    while at + 10 <= end and data[at : at + 4] != b"\0\0\0\0":
        stop = at + 10 + size_of(data[at + 4 : at + 8])
        if stop > end:
            return None
        frames.append((data[at : at + 4].decode("latin-1"), at, stop))
        at = stop
    return None if any(data[at:end]) else (total, frames)


def _mp3(data: bytes) -> Walk:
    if data[:3] != b"ID3" or len(data) < 10:
        return Walk([])
    major, total = data[3], 10 + _seven(data[6:10])
    if total > len(data):
        sound = next((k for k in range(10, len(data) - 3) if data[k] == 0xFF and data[k + 1] >> 5 == 7 and data[k + 1] & 6 and data[k + 2] >> 4 not in (0, 15) and data[k + 2] >> 2 & 3 != 3 and data[k + 1] >> 3 & 3 != 1), None)
        action = f"cannot locate valid audio frame in truncated ID3v2.{major} tag; preserving file" if sound is None else f"drop truncated ID3v2.{major} tag (found audio frame at offset {sound})"
        said = f"truncated ID3v2.{major} tag detected ({len(data)} bytes present, {total} declared) — metadata may be incomplete"
        return Walk([Part(0, sound or 0, f"partial ID3v2.{major} tag markers", data, (said,), needles=fixed.AI_META_HINTS, drop=NEVER if sound is None else ALWAYS, action=action)], False)
    tag = id3_frames(data)
    if not tag:
        return Walk([])
    whole = Part(0, tag[0], f"ID3v2.{major} tag", data[: tag[0]] if not tag[1] else b"", needles=fixed.AI_META_HINTS, drop=ALL, action=f"drop ID3v2.{major} tag ({tag[0]} bytes)")
    marks = lambda a, b: ", ".join(held(data[a:b], fixed.AI_META_HINTS)[:8])
    return Walk([whole, *(Part(a, b, f"ID3v2 frame {name}", data[a + 10 : b], needles=fixed.AI_META_HINTS, drop=MARKED, action=f"drop ID3v2 frame {name}: {marks(a + 10, b)}") for name, a, b in tag[1])])


def is_c2pa_object(value: bytes) -> bool:
    """An encapsulated object of the manifest's type: encoding, type, file name, description, then the object."""
    if not value or value[0] > 3:
        return False
    kind, found, rest = value[1:].partition(b"\0")
    if not found or kind.lower() != b"application/c2pa":
        return False
    step = 1 if value[0] in (0, 3) else 2
    for _ in range(2):
        end = next((k for k in range(0, len(rest) - step + 1, step) if not any(rest[k : k + step])), None)
        if end is None:
            return False
        rest = rest[end + step :]
    return bool(rest)


def _flac(data: bytes) -> Walk:
    tag = id3_frames(data) if data[:3] == b"ID3" and len(data) >= 10 else None
    if not tag:
        return Walk([])
    manifests = [Part(a, b, drop=ALWAYS, action="drop FLAC ID3v2 frame GEOB: application/c2pa") for name, a, b in tag[1] if name == "GEOB" and is_c2pa_object(data[a + 10 : b])]
    if manifests:
        manifests[0] = manifests[0]._replace(said=("C2PA-related manifest in ID3v2 frame GEOB: application/c2pa",), manifest=True)
    return Walk([Part(0, tag[0], drop=ALL, needles=[], action=f"drop FLAC ID3v2.{data[3]} tag ({tag[0]} bytes)"), *manifests])


def _tag_size(out: bytearray, gone: list[bytes]) -> None:
    """Frames went, their tag stays: its size follows; a footer, which repeats the size, goes."""
    if out[:3] != b"ID3" or not gone or gone[0][:3] == b"ID3":
        return
    size = _seven(out[6:10]) - sum(map(len, gone))
    if out[3] == 4 and out[5] & 0x10:
        del out[10 + size : 20 + size]
        out[5] &= ~0x10 & 0xFF
    if not any(out[10 : 10 + size]):
        del out[: 10 + size]
    else:
        out[6:10] = bytes(size >> 7 * (3 - k) & 0x7F for k in range(4))


# Formats


class Format(NamedTuple):
    read: Callable[[bytes], Walk]
    #: Words to look for in the whole file if the parts hold no manifest, and whether only if the walk ended early.
    scan: list[str] = []
    only_if_cut: bool = False
    sizes: Callable[[bytearray, list[bytes]], None] | None = None
    nothing: str = ""
    idle: str = ""


NO_SCAN = Format(_mp3)
FORMATS = {
    "png": Format(_png, fixed.C2PA_MARKERS, idle="no PNG metadata chunks removed (already clean or none matched)"),
    "jpeg": Format(_jpeg, fixed.JPEG_C2PA_MARKERS, idle="no JPEG APP segments removed"),
    "webp": Format(_webp, sizes=_webp_sizes, idle="no WebP metadata chunks removed (already clean or none matched)"),
    "avif": Format(lambda d: _boxed(d, "AVIF"), fixed.C2PA_MARKERS, True, idle="no AVIF metadata boxes removed (already clean or none matched)"),
    "heic": Format(lambda d: _boxed(d, "HEIC"), fixed.C2PA_MARKERS, True, idle="no HEIC metadata boxes removed (already clean or none matched)"),
    "bmp": Format(_bmp, sizes=_bmp_size, idle="BMP trailing bytes kept (keep-non-ai-metadata)"),
    "gif": Format(_gif, fixed.C2PA_MARKERS, nothing="no GIF metadata extensions found", idle="no GIF metadata blocks removed (already clean or none matched)"),
    "tiff": Format(_tiff, fixed.C2PA_MARKERS, nothing="no TIFF metadata tags found", idle="no TIFF metadata tags removed (already clean or none matched)"),
    "mp4": Format(lambda d: _boxed(d, "MP4"), fixed.C2PA_MARKERS, True, idle="no MP4 metadata boxes removed (already clean or none matched)"),
    "mp3": Format(_mp3, sizes=_tag_size, idle="no ID3v2 tag removed (no AI/C2PA markers found)"),
    "wav": Format(_wav, sizes=_riff_size, idle="no WAV metadata chunks removed (already clean or none matched)"),
    "flac": Format(_flac, sizes=_tag_size, idle="no FLAC ID3v2 metadata removed (already clean or none matched)"),
}


def format_of(data: bytes) -> str | None:
    """By first bytes; a leading ID3 tag is a FLAC file's if FLAC follows it. None if it is none of ``FORMATS``."""
    if data.startswith(PNG_START):
        return "png"
    if data.startswith(b"\xff\xd8"):
        return "jpeg"
    if data[:4] == b"RIFF" and data[8:12] in (b"WEBP", b"WAVE"):
        return "webp" if data[8:12] == b"WEBP" else "wav"
    if data[4:8] == b"ftyp" and len(data) >= 12:
        size = int.from_bytes(data[:4], "big")
        brands = data[8 : min(size if size >= 8 else 64, 64)]
        for kind, names in fixed.BOX_BRANDS.items():
            if any(b.encode() in brands for b in names):
                return kind
        return "mp4"
    if data[:2] == b"BM":
        return "bmp"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    if data[:4] == b"fLaC":
        return "flac"
    if data[:3] == b"ID3" and len(data) >= 10:
        end = 10 + _seven(data[6:10]) + (10 if data[3] == 4 and data[5] & 0x10 else 0)
        return "flac" if data[end : end + 4] == b"fLaC" else "mp3"
    return "mp3" if len(data) > 1 and data[0] == 0xFF and data[1] >> 5 == 7 and data[1] & 6 else None


def _found(walk: Walk, form: Format, data: bytes) -> tuple[bool, bool, list[str]]:
    c2pa = ai = False
    findings: list[str] = []
    for p in walk.parts:
        findings += p.said
        c2pa, ai = c2pa or p.manifest, ai or p.ai
        marks = held(p.value, p.needles) if p.value and p.most else []
        if marks or p.also:
            ai = True
            c2pa = c2pa or any(m.lower() in p.labels for m in marks)
            lists = [", ".join(marks[: p.most])] * bool(marks) + [f"AI generator ({', '.join(p.also[:8])})"] * bool(p.also)
            findings.append(f"{p.name}: {'; '.join(lists)}")
    if form.scan and not c2pa and not (form.only_if_cut and walk.whole):
        marks = held(data, form.scan)
        if marks:
            c2pa = True
            findings.append(f"byte-scan C2PA markers: {', '.join(marks[:6])}")
        elif form.only_if_cut and _c2pa_type_anywhere(data):
            c2pa = True
            findings.append("byte-scan C2PA BMFF content-provenance user type")
    return c2pa, ai or c2pa, findings


def _c2pa_type_anywhere(data: bytes) -> bool:
    at = data.find(b"uuid")
    while at >= 0:
        if _has_c2pa_type(data[at + 4 : at + 24]):
            return True
        at = data.find(b"uuid", at + 4)
    return False


def inspect(data: bytes) -> dict:
    """Format (null if it is unknown), findings, and whether any of them is a C2PA or AI mark; C2PA implies AI."""
    kind = format_of(data)
    if not kind:
        return {"format": None, "has_c2pa": False, "has_ai": False, "findings": []}
    form = FORMATS[kind]
    walk = form.read(data)
    c2pa, ai, findings = _found(walk, form, data)
    if form.only_if_cut and not next(boxes(data, 0, len(data)), None):
        findings.append(f"not a valid {kind.upper()} (no ISOBMFF boxes found)")
    return {"format": kind, "has_c2pa": c2pa, "has_ai": ai, "findings": findings or [form.nothing] * bool(form.nothing)}


def strip(data: bytes, everything: bool = True) -> tuple[bytes, list[str]]:
    """The file without its metadata (``everything=False``: without what carries marks), and what was done."""
    kind = format_of(data)
    if not kind:
        return data, []
    form = FORMATS[kind]
    if kind == "tiff":
        try:
            out, actions = strip_tiff(data, everything)
        except ValueError:
            return data, ["not a valid TIFF"]
        return out, actions or [form.idle]
    walk = form.read(data)
    out, gone, actions, end = bytearray(), [], [], 0
    for p in sorted(walk.parts, key=lambda p: p.at):
        marked = p.drop in (MARKED, ALL) and bool(p.also or held(p.value if p.judged is None else p.judged, p.needles))
        goes = p.end > p.at and (p.drop == ALWAYS or p.drop == ALL and everything or marked) and p.at >= end and not (walk.stop is not None and p.at >= walk.stop)
        if p.action and (goes or p.drop == NEVER):
            actions.append(p.action)
        if goes:
            out += data[end : p.at]
            end = p.end
            if p.header is not None:
                size = p.end - p.at
                head = struct.pack(">I4sQ", 1, b"free", size) if p.header == 16 else struct.pack(">I4s", size, b"free")
                out += head.ljust(size, b"\0")
            else:
                gone.append(data[p.at : p.end])
    out += data[end:]
    if form.sizes and gone:
        form.sizes(out, gone)
    return bytes(out), actions or [form.idle]


def clean(data: bytes, everything: bool = True) -> dict:
    """The stripped file, what was done, and what a second inspection still finds in it."""
    out, actions = strip(data, everything)
    after = inspect(out)
    return {"content": out, "actions": actions, "still_has_c2pa": after["has_c2pa"], "still_has_ai": after["has_ai"]}


_KIND = pa.struct([("format", pa.string()), ("has_c2pa", pa.bool_()), ("has_ai", pa.bool_()), ("findings", pa.list_(pa.string()))])
_CLEAN = pa.struct([("content", pa.binary()), ("actions", pa.list_(pa.string())), ("still_has_c2pa", pa.bool_()), ("still_has_ai", pa.bool_())])


def report(content: Column | str) -> Column:
    """A report per binary; null for null."""

    @F.arrow_udf(REPORT)
    def of(contents: pa.Array) -> pa.Array:
        return pa.array([None if x is None else inspect(x) for x in contents.to_pylist()], _KIND)

    return of(content)


def cleaned(content: Column | str, everything: bool = True) -> Column:
    """``clean`` per binary; null for null."""

    @F.arrow_udf(CLEANED)
    def of(contents: pa.Array) -> pa.Array:
        return pa.array([None if x is None else clean(x, everything) for x in contents.to_pylist()], _CLEAN)

    return of(content)
