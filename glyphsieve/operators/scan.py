"""Files of any kind as audit items: one pass over their bytes, errors kept in their rows, and the spans that a text's findings lie in."""

from __future__ import annotations

import base64
import binascii
import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from glyphsieve.functions import codepoints, findings, fixed, routing, stylometry

from . import documents, images, markup

ITEM = "struct<kind:string,format:string,has_c2pa:boolean,has_ai:boolean,suspicious_total:bigint,findings:array<string>,error:string>"
_ITEM = pa.struct([("kind", pa.string()), ("format", pa.string()), ("has_c2pa", pa.bool_()), ("has_ai", pa.bool_()), ("suspicious_total", pa.int64()), ("findings", pa.list_(pa.string())), ("error", pa.string())])
_CONTAINERS = {"htm": "html", "md": "markdown", "mdx": "markdown", "tex": "latex", "ltx": "latex"}
_SPAN = "array<struct<start:int,end:int,kind:string,said:string>>"


def kind_of(path: str, data: bytes) -> tuple[str, str | None]:
    """Kind and format: by suffix where it is known, else by the bytes; ``text`` if they are no binary, else ``unknown``."""
    suffix = posixpath.splitext(path)[1][1:].lower()
    for kind, known in fixed.SUFFIXES.items():
        if suffix in known:
            return kind, _CONTAINERS.get(suffix, suffix) if kind == "container" else None
    if fmt := images.format_of(data):
        return "av" if fmt in ("mp4", "mp3", "wav", "flac") else "image", fmt
    if fmt := documents.format_of(data):
        return "container", fmt
    return ("text" if not binary_reason(data) else "unknown"), None


def binary_reason(data: bytes) -> str | None:
    """Why bytes are no text: a known beginning, NUL bytes, or many control bytes in the first 8 KiB."""
    for start, name in fixed.BINARY_MAGIC:
        if data.startswith(start):
            return name
    head = data[:8192]
    if b"\0" in head:
        return "nul bytes"
    return "control bytes" if head and sum(b < 9 or 14 <= b < 27 or 27 < b < 32 for b in head) / len(head) > 0.05 else None


def scan(path: str, data: bytes) -> dict:
    """One file's item. A text that is none is reported as an error; bytes that are no UTF-8 don't count as carriers."""
    kind, fmt = kind_of(path, data)
    item = {"kind": kind, "format": fmt, "has_c2pa": False, "has_ai": False, "suspicious_total": 0, "findings": [], "error": None}
    if kind in ("image", "av"):
        r = images.inspect(data)
        return {**item, **r, "format": r["format"], "findings": r["findings"] if r["format"] else ["format not recognized"]}
    if kind == "container":
        r = documents.inspect(data, fmt)
        return {**item, "has_c2pa": r["has_c2pa"], "has_ai": r["has_ai"], "findings": r["findings"], "suspicious_total": sum(x["total"] for x in r["layer_a"])}
    if kind == "text":
        if reason := binary_reason(data):
            return {**item, "error": f"looks like {reason}, not text"}
        hits = codepoints.inspect(data.decode("utf-8", "surrogateescape"))
        return {**item, "suspicious_total": sum(h["count"] for h in hits), "findings": [f"layer-a: {h['label'].split(' ', 1)[0]} {h['label']} x{h['count']} ({h['kind']})" for h in hits]}
    return item


def scanned(path: Column | str, content: Column | str) -> Column:
    """``scan`` per file; what goes wrong with one is said in its ``error`` and stops no other. Null for null."""

    @F.arrow_udf(ITEM)
    def of(paths: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for p, x in zip(paths.to_pylist(), contents.to_pylist(), strict=True):
            try:
                out.append(None if x is None else scan(p or "", x))
            except Exception as e:  # any file may be broken in its own way
                out.append({"kind": "unknown", "format": None, "has_c2pa": False, "has_ai": False, "suspicious_total": 0, "findings": [], "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, _ITEM)

    return of(path, content)


def items(files: DataFrame, check_stylometry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Audit items of ``(path, content)``, and the files that could not be read ``(path, reason)``.

    With ``check_stylometry`` a text of formulaic style has one more finding. Nothing is shuffled.
    """
    rows = files.select("path", scanned("path", "content").alias("s"), "content")
    found = F.coalesce("s.findings", F.array().cast("array<string>"))
    if check_stylometry:
        rows = stylometry.with_stylometry(rows.withColumn("text", F.when(F.col("s.kind") == "text", F.make_valid_utf8(F.col("content").cast("string")))))
        found = F.concat(found, F.when(F.col("score") >= stylometry.HIGH, F.array(F.format_string("stylometry: AI-style score %.2f", "score"))).otherwise(F.array().cast("array<string>")))
    read = rows.where("s.error IS NULL").withColumn("findings", found)
    columns = ["path", F.col("s.kind").alias("kind"), F.col("s.has_c2pa").alias("has_c2pa"), F.col("s.has_ai").alias("has_ai"), F.col("s.suspicious_total").alias("suspicious_total"), "findings", F.transform("findings", findings.confidence).alias("confidence")]
    return read.select(*columns), rows.where("s.error IS NOT NULL").select("path", F.col("s.error").alias("reason"))


def text_input(content: Column, limit: int = 256 << 20) -> Column:
    """``struct<text,reason>`` of a file's bytes: its text, or why it is refused. Bytes that are no UTF-8 become replacement signs."""
    reason = F.when(F.length(content) > limit, "too large").otherwise(routing.binary_reason(content))
    return F.struct(F.when(reason.isNull(), F.make_valid_utf8(content.cast("string"))).alias("text"), reason.alias("reason"))


def payloads(requests: DataFrame, name: str = "name", data: str = "data_base64", limit: int = 50) -> DataFrame:
    """Items of a batch of requests with base64 contents, an error per row where one can't be decoded; a batch holds ``limit`` at most."""

    @F.arrow_udf(ITEM)
    def of(names: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for n, text in zip(names.to_pylist(), contents.to_pylist(), strict=True):
            try:
                out.append(scan(n or "", base64.b64decode(text or "", validate=True)))
            except (binascii.Error, ValueError) as e:
                out.append({"kind": "unknown", "format": None, "has_c2pa": False, "has_ai": False, "suspicious_total": 0, "findings": [], "error": f"not base64: {e}"})
        return pa.array(out, _ITEM)

    if requests.limit(limit + 1).count() > limit:
        raise ValueError(f"a batch holds {limit} files at most")
    return requests.select(name, of(name, data).alias("item")).select(name, "item.*")


def flagged_spans(text: Column | str, with_phrases: bool = True) -> Column:
    """``array<struct<start,end,kind,said>>``: invisible code points by the full rules, and formulaic phrases if they are asked for, in order of place."""
    phrases = [(label, markup.re.compile(pattern, markup.re.IGNORECASE)) for pattern, label, _ in fixed.PHRASES if with_phrases]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("said", pa.string())]))

    @F.arrow_udf(_SPAN)
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = [{"start": at, "end": at + 1, "kind": why, "said": codepoints.label(ch)} for at, ch, _, why in codepoints.walk(t or "", strip_bidi=True) if why]
            spans += [{"start": m.start(), "end": m.end(), "kind": "phrase", "said": label} for label, p in phrases for m in p.finditer(t or "")]
            out.append(None if t is None else sorted(spans, key=lambda s: (s["start"], s["end"], s["said"])))
        return pa.array(out, kind)

    return of(text)


# Table functions, for SQL: ``SELECT ... FROM t, LATERAL unzip_members(t.content)``


@udtf(returnType="member string, content binary")
class UnzipMembers:
    """A row per member of a zipped container; none for broken ones."""

    def eval(self, content: bytes):
        try:
            for info, value in documents.members(bytes(content or b"")):
                yield info.filename, value
        except documents.BROKEN:
            pass


@udtf(returnType="codepoint int, label string, kind string, count long")
class LayerAHits:
    """A row per invisible code point and kind of a text."""

    def eval(self, text: str):
        for h in codepoints.inspect(text or ""):
            yield h["codepoint"], h["label"], h["kind"], h["count"]


@udtf(returnType="start int, end int, phrase string")
class PhraseSpans:
    """A row per formulaic phrase of a text."""

    def eval(self, text: str):
        for pattern, label, _ in fixed.PHRASES:
            for m in markup.re.finditer("(?i)" + pattern, text or ""):
                yield m.start(), m.end(), label


TABLE_FUNCTIONS = {"unzip_members": UnzipMembers, "layer_a_hits": LayerAHits, "ai_phrase_spans": PhraseSpans}


def register(spark) -> None:
    """The table functions under their SQL names."""
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)


def sarif(results: list[Row], version: str = "1") -> dict:
    """The SARIF document around results (``audit.sarif_results``, collected: a report)."""
    rules = {"AI-WATERMARK-C2PA": "error", "AI-WATERMARK-METADATA": "warning", "AI-WATERMARK-UNICODE-LAYER-A": "warning", "AI-STYLES-HIGH-PROBABILITY": "note"}
    place = lambda r: {"physicalLocation": {"artifactLocation": {"uri": r["path"]} | ({} if r["path"].startswith(("http://", "https://")) else {"uriBaseId": "SRCROOT"})}}
    found = [{"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [place(r)], "properties": {"confidence": r["confidence"]}} for r in results]
    tool = {"driver": {"name": "glyphsieve", "version": version, "rules": [{"id": k, "defaultConfiguration": {"level": v}} for k, v in rules.items()]}}
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": tool, "results": found}]}
