"""Provenance in document containers: zipped ones (DOCX, XLSX, PPTX, ODT, EPUB) and PDF.

A zipped container is a stream of members under one budget of decompressed bytes, which is charged for what comes out and not
for what the archive declares. For each member a rule by format and name says how it is read (picture, page, package document,
metadata or plain bytes) and what cleaning does to it. Members that can't be read end the walk; what was found before stays.
Bodies are cleaned of invisible code points run by run, character references included. PDF is read without its streams.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions import codepoints, fixed

from . import images, markup

MAX_BYTES = 128 << 20
BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError, zlib.error)
ZIPPED = ("docx", "xlsx", "pptx", "odt", "epub")
_PICTURE = re.compile(r"(?i)^(?:word|xl|ppt)/media/.+\.(?:png|jpe?g|webp|avif|heic|gif|bmp|tiff?|svg)$")
_REFERENCE = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_RELATION = re.compile(r"(?i)<Relationship\b[^>]*/>")
_ENTRY = re.compile(r"(?i)<manifest:file-entry\b[^>]*/>")
_ITEM, _ITEMREF = re.compile(r"(?i)<item\b[^>]*/>"), re.compile(r"(?i)<itemref\b[^>]*/>")
_XMP = (re.compile(rb"<\?xpacket begin"), re.compile(rb"<\?xpacket end[^>]*\?>"))


class OverBudget(ValueError):
    """A container that would decompress to more than the budget."""


def members(data: bytes, limit: int = MAX_BYTES) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
    """The members of an archive in order, at most ``limit`` bytes together."""
    left = limit
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            parts = []
            if info.file_size > limit:
                raise OverBudget(f"zip decompressed size exceeds cap ({limit} bytes); refusing to process")
            with z.open(info) as stream:
                while part := stream.read(1 << 16):
                    left -= len(part)
                    if left < 0:
                        raise OverBudget(f"zip decompressed size exceeds cap ({limit} bytes); refusing to process")
                    parts.append(part)
            yield info, b"".join(parts)


def format_of(data: bytes) -> str | None:
    """pdf, svg, html or the kind of a zipped document, by its bytes; None for others."""
    if data.startswith(b"%PDF"):
        return "pdf"
    if data[:2] == b"PK":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                kind = z.open("mimetype").read(256) if "mimetype" in names else b""
        except BROKEN:
            return None
        if b"epub" in kind:
            return "epub"
        if b"opendocument" in kind or b"oasis" in kind:
            return "odt"
        return next((f for f, (folder, _) in fixed.OFFICE_BODIES.items() if any(n.startswith(folder) for n in names)), None)
    head = data[:500].lower()
    return ("svg" if b"svg" in head else "html" if b"<html" in head or b"<!doctype html" in head else None) if data[:100].lstrip().startswith(b"<") else None


def blob_hits(blob: bytes) -> tuple[bool, bool, list[str]]:
    """Whether bytes hold C2PA or AI words, and which; a word that both lists hold is listed once."""
    marks = images.held(blob, fixed.C2PA_MARKERS)
    hints = images.held(blob, fixed.AI_META_HINTS)
    said = [f"marker:{m}" for m in marks] + [f"ai:{h}" for h in hints if h not in marks]
    return bool(marks), bool(marks or hints), said[:30]


# invisible code points in bodies


def decode_references(text: str) -> str:
    """Character references and the five names that XML has; what is no character stays as it is."""

    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3]]
        cp = int(m[1], 16) if m[1] else int(m[2])
        return chr(cp) if 0 < cp < 0x110000 and not 0xD800 <= cp < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


def _is_body(name: str, fmt: str) -> bool:
    return name == "content.xml" if fmt == "odt" else fmt in fixed.OFFICE_BODIES and name.startswith(fixed.OFFICE_BODIES[fmt][0]) and name.endswith(".xml")


def runs(text: str, fmt: str) -> Iterator[tuple[int, int]]:
    """Spans of a body's text: what the format's text elements hold, between their tags."""
    tag = "text:p" if fmt == "odt" else fixed.OFFICE_BODIES[fmt][1]
    for _, start, end, _ in markup.blocks(text, tag):
        at = start
        for m in re.finditer(r"<[^>]*>", text[start:end]):
            if start + m.start() > at:
                yield at, start + m.start()
            at = start + m.end()
        if end > at:
            yield at, end


def scrub_runs(text: str, fmt: str, spaces: bool = True) -> tuple[str, int, int]:
    """The body without carriers, and how many were removed and replaced. Runs without any stay as they were written."""
    out, end, removed, replaced = [], 0, 0, 0
    for a, b in runs(text, fmt):
        said = decode_references(text[a:b])
        clean, gone, changed = codepoints.clean(said, spaces=spaces)
        if gone or changed:
            out += [text[end:a], clean.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")]
            end, removed, replaced = b, removed + sum(gone.values()), replaced + sum(changed.values())
    return "".join([*out, text[end:]]), removed, replaced


# inspection


def encrypted_parts(data: bytes) -> set[str]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            text = z.read("META-INF/encryption.xml").decode("utf-8", "replace")
    except (*BROKEN, KeyError):
        return set()
    uris = re.findall(r'(?i)CipherReference\s+URI="([^"]+)"', text)
    return {posixpath.normpath(p) for u in uris for p in (posixpath.join("META-INF", u), u, u.removeprefix("../"))}


def _picture(name: str, value: bytes) -> tuple[bool, bool, list[str]]:
    if images.format_of(value):
        r = images.inspect(value)
    elif name.lower().endswith(".svg") or value.lstrip().startswith(b"<"):
        r = markup.inspect(value.decode("utf-8", "surrogateescape"), "svg")
    else:
        return False, False, []
    return r["has_c2pa"], r["has_ai"], r["findings"]


def _member(fmt: str, name: str, value: bytes) -> tuple[bool, bool, list[str]]:
    """What a member says: C2PA, AI, findings behind its name."""
    if fmt in fixed.OFFICE_BODIES:
        if _PICTURE.search(name):
            return _picture(name, value)
        if not name.startswith(("docProps/", "customXml/")):  # what a body says is no metadata
            return False, False, []
    c2pa, ai, hits = blob_hits(value)
    said = [", ".join(hits[:6])] if hits else []
    if fmt == "epub" and name.lower().endswith((".xhtml", ".html", ".htm")):
        r = markup.inspect(value.decode("utf-8", "surrogateescape"), "html")
        return r["has_c2pa"], r["has_ai"], r["findings"]
    if fmt == "epub" and name.lower().endswith(".opf") and markup.AI_NAME.search(value.decode("utf-8", "replace")):
        return c2pa, True, ["AI-ish metadata in package document", *said]
    return c2pa, ai, said


def inspect_zip(data: bytes, fmt: str, limit: int = MAX_BYTES) -> dict:
    c2pa = ai = False
    found: list[str] = []
    layer: list[dict] = []
    names: list[str] = []
    locked = encrypted_parts(data) if fmt == "epub" else set()
    meta = b""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
        for info, value in members(data, limit):
            name = info.filename
            if name in locked:
                found.append(f"{name}: encrypted content (skipped)")
                continue
            one_c2pa, one_ai, said = _member(fmt, name, value)
            c2pa, ai = c2pa or one_c2pa, ai or one_ai
            found += [f"{name}: {x}" for x in said]
            if fmt == "odt" and name == "meta.xml":
                meta = value
            if _is_body(name, fmt):
                text = value.decode("utf-8", "replace")
                hits = [h for a, b in runs(text, fmt) for h in codepoints.inspect(decode_references(text[a:b]))]
                if hits:
                    layer.append({"part": name, "total": sum(h["count"] for h in hits)})
    except OverBudget as e:
        return {"has_c2pa": c2pa, "has_ai": c2pa or ai, "findings": [*found, str(e)], "layer_a": layer}
    except BROKEN as e:
        if not found:
            return {"has_c2pa": False, "has_ai": False, "findings": [f"not a valid {fmt.upper()} zip"], "layer_a": []}
        return {"has_c2pa": c2pa, "has_ai": c2pa or ai, "findings": [*found, f"partial read of {fmt.upper()} zip ({type(e).__name__}); evidence above survives, later members were not scanned"], "layer_a": layer}
    if re.search(rb"(?i)generator|claude|openai|anthropic|gemini", meta):
        ai = True
        found.append("meta.xml generator-like fields")
    custom = sum(n.startswith("customXml/") for n in names)
    if custom and fmt in fixed.OFFICE_BODIES:
        found.append(f"customXml parts: {custom}")
    return {"has_c2pa": c2pa, "has_ai": c2pa or ai, "findings": found, "layer_a": layer}


def _packets(data: bytes) -> list[tuple[int, int]]:
    return [(a, d) for a, _, _, d in markup.between(data, *_XMP)]


def inspect_pdf(data: bytes) -> dict:
    """Dictionaries and XMP packets; what lies in streams may hold any bytes by chance. Attachments are streams and are not opened."""
    out, end = [], 0
    for a, _, _, d in markup.between(data, re.compile(rb"\bstream\r?\n"), re.compile(rb"\bendstream\b")):
        out += [data[end:a], b"stream endstream"]
        end = d
    xmp = b"\n".join(data[a:b] for a, b in _packets(data))
    c2pa, ai, hits = blob_hits(b"".join([*out, data[end:]]) + b"\n" + xmp)
    ai = ai or bool(re.search(rb"(?i)digitalSourceType|trainedAlgorithmicMedia|SoftwareAgent|c2pa", xmp))
    return {"has_c2pa": c2pa, "has_ai": c2pa or ai, "findings": [f"pdf-structured:{h}" for h in hits] + ["XMP packet present"] * bool(xmp), "layer_a": []}


def embedded_jpegs(data: bytes) -> list[dict]:
    """The JPEGs that a file holds as they are: where, whether with application segments, and whether with provenance."""
    out, at = [], data.find(b"\xff\xd8\xff")
    while at >= 0:
        marks = [p for p in images.FORMATS["jpeg"].read(data[at : at + (1 << 20)]).parts if p.name]
        out.append({"at": at, "metadata": any(p.name != "JPEG APP0" for p in marks), "provenance": any(p.manifest or images.held(p.value, ["jumb", "c2pa", "digitalSourceType", "trainedAlgorithmicMedia"]) for p in marks)})
        at = data.find(b"\xff\xd8\xff", at + 3)
    return out


def inspect(data: bytes, fmt: str | None = None) -> dict:
    """``format, has_c2pa, has_ai, findings, layer_a`` of a container; the format is told by the bytes if it isn't given."""
    kind = fmt or format_of(data)
    if kind in ZIPPED:
        return {"format": kind, **inspect_zip(data, kind)}
    if kind == "pdf":
        return {"format": kind, **inspect_pdf(data)}
    if kind in markup.LANGUAGES:
        text = data.decode("utf-8", "surrogateescape")
        hits = codepoints.inspect(text) if kind != "svg" else []
        r = markup.inspect(text, kind)
        said = [f"layer-a: {h['label'].split(' ', 1)[0]} {h['label']} x{h['count']} ({h['kind']})" for h in hits]
        return {"format": kind, **r, "findings": [*r["findings"], *said], "layer_a": [{"part": "", "total": sum(h["count"] for h in hits)}] if hits else []}
    return {"format": None, "has_c2pa": False, "has_ai": False, "findings": [], "layer_a": []}


# cleaning


def _attribute(tag: str, name: str) -> str:
    m = re.search(rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return (m[1] or m[2] or "") if m else ""


def _without(text: str, pattern: re.Pattern, gone) -> tuple[str, int]:
    """The text without the tags that ``gone`` names, and how many they were."""
    kept, n = [], 0
    end = 0
    for m in pattern.finditer(text):
        if gone(m[0]):
            kept.append(text[end : m.start()])
            end, n = m.end(), n + 1
    return "".join([*kept, text[end:]]), n


def _emptied(text: str, tag: str, when=lambda block: True) -> tuple[str, int]:
    """The text with the contents of a tag's elements taken out, and how many had any."""
    out, end, n = [], 0, 0
    for a, b, c, _ in markup.blocks(text, tag):
        if b < c and when(text[a:c]):
            out.append(text[end:b])
            end, n = c, n + 1
    return "".join([*out, text[end:]]), n


def _office_member(name: str, value: bytes, actions: list[str]) -> bytes | None:
    """A member after cleaning; None if it goes."""
    if _PICTURE.search(name):
        if images.format_of(value):
            out, done = images.strip(value)
        elif name.lower().endswith(".svg") or value.lstrip().startswith(b"<"):
            r = markup.clean(value.decode("utf-8", "surrogateescape"), "svg")
            out, done = r["text"].encode("utf-8", "surrogateescape"), r["actions"]
        else:
            return value
        if out != value and any("drop" in a for a in done):
            actions.append(f"clean embedded media in {name} ({', '.join(done[:2])})")
            return out
        return value
    if name.startswith("customXml/") or name.startswith("docProps/") and name.endswith("custom.xml"):
        actions.append(f"drop part {name}")
        return None
    if name.startswith("docProps/") and name.lower().endswith(".xml"):
        text = value.decode("utf-8", "replace")
        for tag in fixed.OFFICE_FIELDS:
            text, n = _emptied(text, tag)
            actions += [f"scrub {name} field {tag}"] * n
        return text.encode()
    if name == "[Content_Types].xml":
        text = value.decode("utf-8", "replace")
        for what, path in (("customXml overrides", r"/customXml/[^\"]*"), ("custom.xml override", r"/docProps/custom\.xml")):
            text, n = _without(text, re.compile(rf'<Override\b[^>]*PartName="{path}"[^>]*/>'), lambda _: True)
            actions += [f"drop Content_Types {what} x{n}"] * bool(n)
        return text.encode()
    return value


def _odt_member(name: str, value: bytes, actions: list[str]) -> bytes | None:
    if name == "meta.xml":
        text = value.decode("utf-8", "replace")
        spans = [(a, d) for a, _, _, d in markup.blocks(text, "meta:generator")]
        creators = [(a, d) for a, _, _, d in markup.blocks(text, r"(?:dc:creator|meta:initial-creator)") if markup.AI_NAME.search(text[a:d])]
        actions += ["drop meta:generator"] * bool(spans) + ["scrub creator-like meta"] * len(creators)
        return markup.cut(text, [markup.Mark(a, d, "") for a, d in [*spans, *creators]])[0].encode()
    if name not in ("mimetype", "content.xml", "styles.xml", "META-INF/manifest.xml") and blob_hits(value)[1]:
        if images.format_of(value):
            out, _ = images.strip(value)
            if not images.inspect(out)["has_ai"]:
                actions.append(f"clean embedded media in {name}")
                return out
        actions.append(f"drop part {name}")
        return None
    return value


def _epub_member(name: str, value: bytes, actions: list[str]) -> bytes | None:
    low = name.lower()
    if low.endswith(".opf"):
        text, n = _without(value.decode("utf-8", "surrogateescape"), re.compile(r"(?i)<meta\b[^>]*/>"), markup.AI_NAME.search)
        spans = [(a, d) for a, _, _, d in markup.blocks(text, "meta") if markup.AI_NAME.search(text[a:d])]
        text, _ = markup.cut(text, [markup.Mark(a, d, "") for a, d in spans])
        actions += ["drop OPF meta tag"] * (n + len(spans))
        for tag in fixed.EPUB_FIELDS:
            text, n = _emptied(text, tag, markup.AI_NAME.search)
            actions += [f"scrub {tag} (AI vendor name)"] * n
        return text.encode("utf-8", "surrogateescape")
    if low.endswith((".xhtml", ".html", ".htm")):
        text = value.decode("utf-8", "surrogateescape")
        r = markup.clean(text, "html")
        done = [] if r["text"] == text else r["actions"]
        clean, removed, replaced = codepoints.clean(r["text"])
        if removed or replaced:
            done = [*done, f"layer A text: removed={sum(removed.values())} replaced={sum(replaced.values())}"]
        actions += [f"{name}: {a}" for a in done]
        return clean.encode("utf-8", "surrogateescape") if done else value
    if images.format_of(value) and images.inspect(value)["has_ai"]:
        out, _ = images.strip(value)
        actions.append(f"clean embedded media in {name}")
        return out
    return value


def _pruned(name: str, value: bytes, kept: set[str], gone: set[str], actions: list[str]) -> bytes:
    """Lists of members without those that went."""
    text = value.decode("utf-8", "surrogateescape")
    if name.endswith(".rels"):
        base = posixpath.dirname(posixpath.dirname(name))

        def dangles(tag: str) -> bool:
            target = _attribute(tag, "Target")
            path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target))
            return not re.search(r"(?i)\bTargetMode\s*=", tag) and path not in ("", ".") and path not in kept

        text, n = _without(text, _RELATION, dangles)
        actions += [f"prune dangling relationships x{n} in {name}"] * bool(n)
    elif name == "META-INF/manifest.xml" and gone:
        text, n = _without(text, _ENTRY, lambda tag: posixpath.normpath(_attribute(tag, "full-path").lstrip("/")) in gone)
        actions += [f"prune manifest entries x{n}"] * bool(n)
    elif name.lower().endswith(".opf") and gone:
        base, ids = posixpath.dirname(name), set()

        def listed(tag: str) -> bool:
            hit = posixpath.normpath(posixpath.join(base, _attribute(tag, "href"))) in gone
            ids.update([_attribute(tag, "id")] * hit)
            return hit

        text, n = _without(text, _ITEM, listed)
        text, _ = _without(text, _ITEMREF, lambda tag: _attribute(tag, "idref") in ids)
        actions += [f"prune OPF manifest items x{n}"] * bool(n)
    else:
        return value
    return text.encode("utf-8", "surrogateescape")


_MEMBERS = {"docx": _office_member, "xlsx": _office_member, "pptx": _office_member, "odt": _odt_member, "epub": _epub_member}


def clean_zip(data: bytes, fmt: str, layer_a: bool = True, spaces: bool = True, limit: int = MAX_BYTES) -> tuple[bytes, list[str]]:
    """The container without provenance and, with ``layer_a``, carriers in its bodies; and what was done. Broken ones stay as they are."""
    kept: list[tuple[zipfile.ZipInfo, bytes]] = []
    gone, actions, removed, replaced = set(), [], 0, 0
    locked = encrypted_parts(data) if fmt == "epub" else set()
    try:
        for info, value in members(data, limit):
            name = info.filename
            out = value if name in locked else _MEMBERS[fmt](name, value, actions)
            if out is None:
                gone.add(name)
                continue
            if layer_a and _is_body(name, fmt):
                text, r, c = scrub_runs(out.decode("utf-8", "replace"), fmt, spaces)
                removed, replaced = removed + r, replaced + c
                out = text.encode() if r or c else out
            kept.append((info, out))
    except BROKEN as e:
        return data, [f"not cleaned: {e}"]
    names = {info.filename for info, _ in kept}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for info, value in kept:
            z.writestr(info, _pruned(info.filename, value, names, gone, actions))
    if removed or replaced:
        actions.append(f"layer A text: removed={removed} replaced={replaced}")
    return buffer.getvalue(), actions or [f"no {fmt.upper()} metadata parts removed"]


def clean_pdf(data: bytes) -> tuple[bytes, list[str]]:
    """XMP packets become spaces, so that every offset stays valid. Structure and pictures are left to external tools."""
    spans, out = _packets(data), bytearray(data)
    for a, b in spans:
        out[a:b] = b" " * (b - a)
    return bytes(out), [f"blank XMP packets x{len(spans)}"] if spans else ["no PDF XMP packets removed"]


def clean(data: bytes, fmt: str | None = None, layer_a: bool = True) -> dict:
    """``content, actions``, and what a second inspection still finds."""
    kind = fmt or format_of(data)
    if kind in ZIPPED:
        out, actions = clean_zip(data, kind, layer_a)
    elif kind == "pdf":
        out, actions = clean_pdf(data)
    elif kind in markup.LANGUAGES:
        r = markup.clean(data.decode("utf-8", "surrogateescape"), kind)
        text, actions = r["text"], r["actions"]
        if layer_a and kind != "svg":
            text, removed, replaced = codepoints.clean(text)
            actions += [f"layer A text: removed={sum(removed.values())} replaced={sum(replaced.values())}"] * bool(removed or replaced)
        out = text.encode("utf-8", "surrogateescape")
    else:
        return {"content": data, "actions": [], "still_has_c2pa": False, "still_has_ai": False}
    after = inspect(out, kind)
    return {"content": out, "actions": actions, "still_has_c2pa": after["has_c2pa"], "still_has_ai": after["has_ai"]}


_PART = pa.struct([("part", pa.string()), ("total", pa.int64())])
_KIND = pa.struct([("format", pa.string()), ("has_c2pa", pa.bool_()), ("has_ai", pa.bool_()), ("findings", pa.list_(pa.string())), ("layer_a", pa.list_(_PART))])
_CLEAN = pa.struct([("content", pa.binary()), ("actions", pa.list_(pa.string())), ("still_has_c2pa", pa.bool_()), ("still_has_ai", pa.bool_())])
_MEMBER = pa.struct([("member", pa.string()), ("content", pa.binary())])


def report(content: Column | str) -> Column:
    """``inspect`` per container; null for null."""

    @F.arrow_udf("struct<format:string,has_c2pa:boolean,has_ai:boolean,findings:array<string>,layer_a:array<struct<part:string,total:bigint>>>")
    def of(contents: pa.Array) -> pa.Array:
        return pa.array([None if x is None else inspect(x) for x in contents.to_pylist()], _KIND)

    return of(content)


def cleaned(content: Column | str, layer_a: bool = True) -> Column:
    """``clean`` per container; null for null."""

    @F.arrow_udf("struct<content:binary,actions:array<string>,still_has_c2pa:boolean,still_has_ai:boolean>")
    def of(contents: pa.Array) -> pa.Array:
        return pa.array([None if x is None else clean(x, layer_a=layer_a) for x in contents.to_pylist()], _CLEAN)

    return of(content)


def unzipped(rows: DataFrame, content: str = "content", limit: int = MAX_BYTES) -> DataFrame:
    """``rows`` with a row per member (``member, member_content``) in place of ``content``; those that can't be read have none."""

    @F.arrow_udf("array<struct<member:string,content:binary>>")
    def of(contents: pa.Array) -> pa.Array:
        out = []
        for x in contents.to_pylist():
            found = []
            try:
                found.extend({"member": i.filename, "content": v} for i, v in members(x or b"", limit))
            except BROKEN:
                pass
            out.append(found)
        return pa.array(out, pa.list_(_MEMBER))

    return rows.withColumn("__gs_m", F.explode(of(content))).drop(content).select("*", F.col("__gs_m.member").alias("member"), F.col("__gs_m.content").alias("member_content")).drop("__gs_m")
