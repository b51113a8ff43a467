"""Small well-formed files of each media and container format, plain or with a mark in them: what queries and tests look into."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

MEDIA = ["png", "jpeg", "webp", "avif", "heic", "bmp", "gif", "tiff", "mp4", "mp3", "wav", "flac"]
ZIPS = ["docx", "xlsx", "pptx", "odt", "epub"]
NONE, AI, C2PA = range(3)


def chunk(kind: bytes, value: bytes) -> bytes:
    return struct.pack(">I", len(value)) + kind + value + struct.pack(">I", zlib.crc32(kind + value))


def png(*parts: tuple[bytes, bytes]) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\10\0\0\0\0") + b"".join(chunk(*p) for p in parts) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def jpeg(*parts: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(v) + 2) + v for m, v in [(0xE0, b"JFIF\0"), *parts]) + b"\xff\xda\0\2pixels\xff\xd9"


def riff(kind: bytes, *parts: tuple[bytes, bytes]) -> bytes:
    body = kind + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind: bytes, *parts: bytes) -> bytes:
    value = b"".join(parts)
    return struct.pack(">I", len(value) + 8) + kind + value


def bmp(tail: bytes = b"") -> bytes:
    return b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 0, 0, 0, 0, 0) + b"\1\2\3\0" + tail


def gif(*extensions: tuple[int, bytes]) -> bytes:
    blocks = b"".join(b"\x21" + bytes([label]) + b"".join(bytes([len(v[k : k + 255])]) + v[k : k + 255] for k in range(0, len(v), 255)) + b"\0" for label, v in extensions)
    return b"GIF89a\1\0\1\0\x80\0\0" + b"\0\0\0\xff\xff\xff" + blocks + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b"


def tiff(entries: list[tuple[int, bytes]], order: str = "<") -> bytes:
    """One directory of byte strings behind two bytes of pixels."""
    entries = sorted(entries)
    first = 10
    at = first + 2 + 12 * (len(entries) + 2) + 4
    rows, values = [(273, 4, 1, struct.pack(order + "I", 8)), (279, 4, 1, struct.pack(order + "I", 2))], b""
    for tag, value in entries:
        rows.append((tag, 2, len(value), value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", at + len(values))))
        values += value if len(value) > 4 else b""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", first) + b"\7\7"
    return head + struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHI", *r[:3]) + r[3] for r in sorted(rows)) + b"\0\0\0\0" + values


def id3(*frames: tuple[bytes, bytes], sound: bytes = b"\xff\xfb\x90\x64" + b"\0" * 32) -> bytes:
    body = b"".join(k + struct.pack(">I", len(v)) + b"\0\0" + v for k, v in frames)
    return (b"ID3\3\0\0" + bytes(len(body) >> 7 * (3 - k) & 0x7F for k in range(4)) + body if frames else b"") + sound


XMP = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
SOURCE = b"<x>trainedAlgorithmicMedia</x>"
GEOB = b"\0application/c2pa\0manifest\0about\0xyz"


def media(fmt: str, mark: int) -> bytes:
    pick = lambda *options: options[mark]
    if fmt == "png":
        return png(*pick([], [(b"tEXt", b"Software\0Midjourney 6")], [(b"caBX", b"xyz")]))
    if fmt == "jpeg":
        return jpeg(*pick([], [(0xE1, b"Exif\0\0OpenAI")], [(0xEB, b"xyz")]))
    if fmt == "webp":
        return riff(b"WEBP", (b"VP8X", pick(b"\0", b"\4", b"\0") + b"\0" * 9), (b"VP8 ", b"abc"), *pick([], [(b"XMP ", SOURCE)], [(b"C2PA", b"xyz")]))
    if fmt in ("avif", "heic", "mp4"):
        brand = {"avif": b"avif", "heic": b"heic", "mp4": b"isom"}[fmt]
        moov = box(b"moov", box(b"mvhd", b"\0" * 8), *pick([], [box(b"udta", b"AIGC")], [])) if fmt == "mp4" else b""
        return box(b"ftyp", brand, b"\0\0\0\0") + moov + pick(b"", b"" if fmt == "mp4" else box(b"uuid", XMP, SOURCE), box(b"jumb", b"xyz")) + box(b"mdat", b"samples")
    if fmt == "bmp":
        return bmp(pick(b"", b"SynthID", b"c2pa"))
    if fmt == "gif":
        return gif((0xFF, b"NETSCAPE2.0\1\0\0"), *pick([], [(0xFE, b"AIGC")], [(0xFF, b"c2pa-storexyz")]))
    if fmt == "tiff":
        return tiff(pick([], [(305, b"digitalSourceType\0")], [(700, b"c2pa manifest")]))
    if fmt == "mp3":
        return id3(*pick([(b"TIT2", b"\0Song")], [(b"TIT2", b"\0Song"), (b"TXXX", b"\0AIGC")], [(b"TIT2", b"\0Song"), (b"TXXX", b"\0contentauth contentcredentials")]))
    if fmt == "wav":
        return riff(b"WAVE", (b"fmt ", b"\0" * 16), (b"data", b"\1\2\3\4"), *pick([], [(b"LIST", b"INFOISFT\4\0\0\0AIGC")], [(b"C2PA", b"xyz")]))
    return id3(*pick([], [(b"TIT2", b"\0Song")], [(b"GEOB", GEOB)]), sound=b"fLaC" + b"\0" * 38)


CORE = '<cp:coreProperties xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"><dc:title>A title</dc:title><dc:creator>{}</dc:creator></cp:coreProperties>'


def archive(*members: tuple[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, value in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), value)
    return out.getvalue()


def zipped(fmt: str, mark: int, body: str = "some words") -> bytes:
    """A document of one part; ``body`` goes into its text as it is."""
    pick = lambda *options: options[mark]
    if fmt == "odt":
        tool = pick("", "<meta:generator>Midjourney</meta:generator>", "<meta:generator>c2pa</meta:generator>")
        meta = f'<office:document-meta xmlns:office="o" xmlns:meta="m"><office:meta>{tool}</office:meta></office:document-meta>'
        return archive(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", f'<office:document-content xmlns:office="o" xmlns:text="t"><text:p>{body}</text:p></office:document-content>'), ("meta.xml", meta))
    if fmt == "epub":
        tool = pick("", '<meta name="generator" content="Claude"/>', '<meta name="generator" content="c2pa"/>')
        opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata>{tool}</metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest></package>'
        return archive(("mimetype", "application/epub+zip"), ("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>'), ("c.opf", opf), ("a.xhtml", f"<html><body><p>{body}</p></body></html>"))
    part, tag = {"docx": ("word/document.xml", "w:t"), "xlsx": ("xl/sharedStrings.xml", "t"), "pptx": ("ppt/slides/slide1.xml", "a:t")}[fmt]
    return archive(("[Content_Types].xml", "<Types/>"), (part, f"<doc><{tag}>{body}</{tag}></doc>"), ("docProps/core.xml", CORE.format(pick("Somebody", "OpenAI", "c2pa"))))
