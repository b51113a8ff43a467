r"""Provenance marks in sources of text documents (HTML, Markdown, SVG, LaTeX): what is reported is what cleaning removes.

For each language a finder lists *marks*: spans of the source with a finding and the action that removes them. Inspecting
lists them, cleaning cuts them out or puts what they are to become in their place. Finders read a source from left to right
and never look for a closing part twice, so unclosed parts don't cost more.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple
from urllib.parse import quote_from_bytes, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsieve.functions import fixed

from . import images

AI_NAME, COMMENT_WORDS, C2PA = re.compile(fixed.AI_META_NAME), re.compile(fixed.PROVENANCE_COMMENT), re.compile(r"(?i)c2pa|content.?credential")
_FREE, _VENDOR, _JSONLD = re.compile(fixed.AI_FREE_TEXT_MARKER), re.compile(fixed.GENERATOR_AI), re.compile(fixed.JSONLD_EXTRA)
_HINTS = re.compile("(?i)" + "|".join(re.escape(h) for h in fixed.AI_META_HINTS[:12]))
_PRODUCT = re.compile("(?i)" + "|".join(re.escape(p) for p in fixed.PRODUCTS))
_META = re.compile(r"(?i)<meta\b[^>]*>")
_PAIR = re.compile(r"""(?i)\b(name|property|content|generator)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_JSON_TYPE = re.compile(r"""(?i)\btype\s*=\s*["']?application/ld\+json""")
_DATA_AI = re.compile(r"""(?i)\sdata-ai[\w-]*\s*=\s*["'][^"']*["']""")
_URI = re.compile(r"(?i)data:image/([a-z0-9.+-]+)((?:;[a-z0-9=._-]+)*),")
_KEY = re.compile(r"([A-Za-z0-9_.-]+)\s*:(.*)")
_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$", re.M)


class Mark(NamedTuple):
    start: int
    end: int
    finding: str
    action: str = ""
    ai: bool = True
    c2pa: bool = False
    #: What stands there afterwards.
    becomes: str = ""
    #: Actions of one name are counted: ``action x3``.
    counted: bool = False


def between(text: str, opening: str | re.Pattern, closing: str | re.Pattern, at: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """``(start, inner start, inner end, end)`` of parts from an opening to the next closing; an opening without one ends the search."""
    opening, closing = (re.compile(re.escape(x)) if isinstance(x, str) else x for x in (opening, closing))
    while (a := opening.search(text, at)) and (b := closing.search(text, a.end())):
        yield a.start(), a.end(), b.start(), b.end()
        at = b.end()


def blocks(text: str, tag: str) -> Iterator[tuple[int, int, int, int]]:
    return between(text, re.compile(rf"(?i)<{tag}(?=[\s>/])[^>]*(?<!/)>"), re.compile(rf"(?i)</{tag}\s*>"))


def comments(text: str, spans: Iterable[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, str]]:
    """Comments inside the spans; ``--!>`` ends one, too."""
    for low, high in [(0, len(text))] if spans is None else spans:
        for start, _, _, end in between(text, "<!--", re.compile("--!?>"), low):
            if end > high:
                break
            yield start, end, text[start:end]


def _provenance(text: str, spans=None) -> Iterator[Mark]:
    for start, end, said in comments(text, spans):
        if COMMENT_WORDS.search(said):
            yield Mark(start, end, f"comment: {said[:120]}", "drop AI provenance comment", c2pa=bool(C2PA.search(said)), counted=True)


def named_value_is_ai(name: str, value: str) -> bool:
    return bool(AI_NAME.search(value) or _PRODUCT.search(value)) if name.lower() in fixed.GENERATOR_NAME_KEYS else bool(_FREE.search(value))


# images inside of text


def data_uris(text: str) -> Iterator[tuple[int, int, str, str, bytes]]:
    """``(start, end, subtype, parameters, bytes)`` of the images that a text holds."""
    for m in _URI.finditer(text):
        packed = ";base64" in m[2].lower()
        end = re.compile(r"[A-Za-z0-9+/=]*" if packed else r"[^\s\"'<>)]*").match(text, m.end()).end()
        try:
            value = base64.b64decode(text[m.end() : end].rstrip("=") + "=" * (-len(text[m.end() : end].rstrip("=")) % 4)) if packed else unquote_to_bytes(text[m.end() : end])
        except binascii.Error:
            continue
        if value:
            yield m.start(), end, m[1], m[2], value


def _is_svg(kind: str, value: bytes) -> bool:
    return "svg" in kind.lower() or value.lstrip().startswith(b"<")


def _pictures(text: str, nested: bool = False) -> Iterator[Mark]:
    for start, end, kind, options, value in data_uris(text):
        if images.format_of(value):
            found, (out, actions) = images.inspect(value), images.strip(value)
            findings, ai, c2pa = found["findings"], found["has_ai"], found["has_c2pa"]
        elif _is_svg(kind, value) and not nested:
            source = value.decode("utf-8", "surrogateescape")
            marks = list(svg_marks(source, nested=True))
            findings, ai, c2pa = [m.finding for m in marks if m.finding], any(m.ai for m in marks), any(m.c2pa for m in marks)
            cleaned, actions = cut(source, marks)
            out = cleaned.encode("utf-8", "surrogateescape")
        else:
            continue
        changed = out != value and any("drop" in a for a in actions)
        packed = ";base64" in options.lower()
        becomes = f"data:image/{kind}{options}," + (base64.b64encode(out).decode() if packed else quote_from_bytes(out))
        if findings or changed:
            said = "; ".join(f"embedded data:image/{kind}: {f}" for f in findings)
            yield Mark(start, end, said, f"cleaned embedded data:image/{kind} ({', '.join(actions[:2])})" if changed else "", ai, c2pa, becomes if changed else text[start:end])


# HTML


def _pairs(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] for m in _PAIR.finditer(tag)}


def html_marks(text: str) -> Iterator[Mark]:
    for m in _META.finditer(text):
        tag, named = m[0], _pairs(m[0])
        name, content = named.get("name") or named.get("property") or named.get("generator") or "", named.get("content", "")
        if name.lower() == "generator" and not _VENDOR.search(tag):
            yield Mark(m.start(), m.start(), f"info: cms generator: {tag[:120]}", ai=False, c2pa=bool(C2PA.search(tag)))
            continue
        bare = tag.replace(content, "") if content else tag
        if AI_NAME.search(bare) or _HINTS.search(bare) or named_value_is_ai(name, content):
            yield Mark(m.start(), m.end(), f"meta: {tag[:120]}", f"drop meta: {tag[:80]}", c2pa=bool(C2PA.search(tag)))
    for start, inner, _, end in blocks(text, "script"):
        block = text[start:end]
        if _JSON_TYPE.search(text[start:inner]) and (AI_NAME.search(block) or _JSONLD.search(block)):
            yield Mark(start, end, "json-ld provenance-like block", "drop json-ld provenance-like script", c2pa=bool(C2PA.search(block)))
    yield from _provenance(text)
    for m in _DATA_AI.finditer(text):
        yield Mark(m.start(), m.end(), f"attr: {m[0].strip()[:80]}", "drop data-ai* attributes", counted=True)
    yield from _pictures(text)


# Markdown


def prose_spans(text: str, at: int = 0) -> list[tuple[int, int]]:
    """What is outside of fenced code; a fence that isn't closed lasts to the end."""
    spans, fence = [], None
    for m in _FENCE.finditer(text, at):
        if fence is None:
            if m[1][0] == "~" or "`" not in m[2]:
                spans.append((at, m.start()))
                fence = m[1]
        elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence, at = None, m.end()
    return spans if fence else [*spans, (at, len(text))]


def markdown_marks(text: str) -> Iterator[Mark]:
    """Front matter keys go with the lines below them, the whole block if nothing is left of it."""
    front = _FRONT.match(text)
    if front:
        lines = front[1].splitlines(keepends=True)
        heads = [_KEY.match(x) if not x[:1].isspace() and x[:1] not in "-#" else None for x in lines]
        keys = {m[1].lower() for m in heads if m}
        agent = {"name", "description"} <= keys and bool(keys & {"tools", "allowed-tools"})
        ends = [*(k for k, m in enumerate(heads) if m or lines[k].strip() and not lines[k][0].isspace() and lines[k][0] not in "-#"), len(lines)]
        at = [front.start(1)]
        for line in lines:
            at.append(at[-1] + len(line))
        gone = []
        for k, after in pairwise(ends):
            if not (m := heads[k]):
                continue
            by_name = not (agent and m[1].lower() in fixed.AGENT_KEYS) and (m[1].lower() in fixed.AI_FRONTMATTER_KEYS or AI_NAME.search(m[1]))
            if by_name or named_value_is_ai(m[1], m[2]):
                said = f"frontmatter: {m[1]}={m[2].strip()[:80]}"
                gone.append(Mark(at[k], at[after], said, f"drop frontmatter key{'' if by_name else ' (value hit)'}: {m[1]}", c2pa=bool(re.search("(?i)c2pa|content", said))))
        cut_at = {g.start: g.end for g in gone}
        kept = [k for k in range(len(lines)) if lines[k].strip() and not any(g.start <= at[k] < g.end for g in gone)]
        if gone and not kept:
            yield from (g._replace(start=0, end=0) for g in gone)
            yield Mark(0, len(text) - len(text[front.end() :].lstrip("\n")), "", "removed empty frontmatter block", ai=False)
        else:
            yield from gone
            if gone and at[kept[-1] + 1] in cut_at and gone[-1].end == front.end(1):  # the line break before the last lines that go
                line_end = at[kept[-1] + 1]
                yield Mark(line_end - len(re.search(r"\r?\n\Z", text[:line_end])[0]), line_end, "", ai=False)
    for m in _provenance(text, prose_spans(text, front.end() if front else 0)):
        yield m._replace(c2pa=bool(re.search("(?i)c2pa|content", m.finding)))
    yield from _pictures(text)


# SVG


def svg_marks(text: str, nested: bool = False) -> Iterator[Mark]:
    low = text.lower()
    marks = [m for m in fixed.C2PA_MARKERS if m.lower() in low]
    for m in marks:
        yield Mark(0, 0, f"marker:{m}", c2pa=True)
    for h in fixed.AI_META_HINTS:
        if h.lower() in low and h not in marks:
            yield Mark(0, 0, f"ai:{h}")
    if re.search(r"<metadata[\s>]", low):
        yield Mark(0, 0, "svg <metadata> present")
    if re.search("xmpmeta|rdf:rdf|contentcredentials", low):
        yield Mark(0, 0, "XMP/RDF-like content in SVG", c2pa="c2pa" in low or "jumbf" in low)
    literal = [(a, d) for a, _, _, d in between(text, "<![CDATA[", "]]>")]
    inside = lambda at: any(a <= at < b for a, b in literal)
    for start, _, _, end in blocks(text, "metadata"):
        yield Mark(start, end, "", "drop <metadata>", False, counted=True)
    for start, _, _, end in blocks(text, r"(?:\w+:)?xmpmeta"):
        yield Mark(start, end, "", "drop xmpmeta", False, counted=True)
    quiet = [(a, b) for a, b, _ in comments(text)]
    for m in re.finditer(r"(?i)<!(?:DOCTYPE|ENTITY)\b(?:[^>\[\"']|\"[^\"]*\"|'[^']*'|\[[^\]]*\])*>", text):
        if not inside(m.start()) and not any(a <= m.start() < b for a, b in quiet):
            yield Mark(m.start(), m.end(), "", "drop DOCTYPE/entity declarations", False, counted=True)
    for start, end, said in comments(text):
        if AI_NAME.search(said) and not inside(start):
            yield Mark(start, end, "", "drop SVG comment with AI markers", False)
    if not nested:
        yield from _pictures(text)
    skipped = [*literal, *quiet, *((a, d) for a, _, _, d in between(text, "<?", "?>"))]
    root = next((m for m in re.finditer(r"(?i)<svg(?![\w:.-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", text) if not any(a <= m.start() < b for a, b in skipped)), None)
    if root:
        for m in re.finditer(r"""(?i)\s(?:inkscape:version|sodipodi:docname|generator)\s*=\s*(?:"[^"]*"|'[^']*')""", root[0]):
            yield Mark(root.start() + m.start(), root.start() + m.end(), "", "drop generator-like attrs", False, counted=True)


# LaTeX

_VERBATIM = "|".join(map(re.escape, sorted(fixed.LATEX_VERBATIM, key=len, reverse=True)))
_TEX = re.compile(rf"\\begin\{{({_VERBATIM})\}}|\\(?:verb\*?|lstinline\*?)([^A-Za-z\s])|\\(hypersetup|pdfinfo)\s*\{{|\\.|%[^\n]*|[{{}}]", re.S)
_INFO = re.compile(r"(/[^\s(<]+)\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\([^()]*\))*\))*\)|<[^>]*>|[^\s/]*)", re.S)
_MAGIC = re.compile(r"%\s*!\s*(?:TEX|TeX|BIB|LaTeX)\b")


def _close(text: str, at: int) -> int:
    """Behind the brace that closes the one before ``at``; -1 if none does."""
    depth = 1
    while depth:
        m = _TEX.search(text, at)
        if not m:
            return -1
        at = m.end()
        depth += (m[0][-1] == "{" and m[0][:1] in "{\\" and len(m[0]) != 2) - (m[0] == "}")
    return at


def _items(arg: str) -> Iterator[tuple[int, int]]:
    """Spans between the commas that stand outside of braces and comments."""
    depth = start = 0
    for m in re.finditer(r"\\.|%[^\n]*|[{},]", arg, re.S):
        depth += (m[0] == "{") - (m[0] == "}")
        if m[0] == "," and depth == 0:
            yield start, m.start()
            start = m.end()
    yield start, len(arg)


def latex_entry(key: str, value: str) -> tuple[bool, bool, bool]:
    """Whether an entry of the document's metadata is a mark of AI, of C2PA, or always to be cleared."""
    name = key.lower().lstrip("/")
    return bool(AI_NAME.search(key) or AI_NAME.search(value)), bool(C2PA.search(key) or C2PA.search(value)), name in fixed.LATEX_CLEAR_KEYS or name in fixed.LATEX_CLEAR_NAMES


def _command(text: str, name: str, start: int, inner: int, end: int) -> Iterator[Mark]:
    arg = text[inner : end - 1]
    if name == "hypersetup":
        entries = [(a, b, *(x.strip() for x in arg[a:b].partition("=")[::2]), "=" in arg[a:b]) for a, b in _items(arg) if arg[a:b].strip()]
    else:
        entries = [(m.start(), m.end(), m[1], m[2], True) for m in _INFO.finditer(arg)]
    kept, gone = [], []
    for a, b, key, value, has_value in entries:
        ai, c2pa, clear = latex_entry(key, value) if has_value else (False, False, False)
        if ai or c2pa or clear:
            gone.append(Mark(start, start, f"{'latex ai:' if ai or c2pa else 'info: latex'} {name} {key}", f"drop {name} {key.lower().lstrip('/')}", ai or c2pa, c2pa))
        else:
            kept.append(arg[a:b].strip())
    if gone and not kept:
        yield from (g._replace(action="") for g in gone)
        yield Mark(start, end, "", f"drop {name} block", False)
    elif gone:
        yield from gone
        yield Mark(start, end, "", "", False, becomes=f"\\{name}{{{(', ' if name == 'hypersetup' else ' ').join(kept)}}}")


def latex_marks(text: str) -> Iterator[Mark]:
    r"""Entries of ``\hypersetup`` and ``\pdfinfo``, and comment lines; what is verbatim or commented out holds no commands."""
    at = 0
    while m := _TEX.search(text, at):
        at = m.end()
        if m[1]:
            stop = text.find(f"\\end{{{m[1]}}}", at)
            at = len(text) if stop < 0 else stop
        elif m[2]:
            stop = re.compile(rf"[{re.escape(m[2])}\n]").search(text, at)
            at = stop.end() if stop else len(text)
        elif m[3]:
            end = _close(text, at)
            if end > 0:
                yield from _command(text, m[3], m.start(), at, end)
                at = end
        elif m[0][0] == "%":
            line = text.rfind("\n", 0, m.start()) + 1
            if text[line : m.start()].strip():
                continue
            said = m[0]
            kind = "AI markers" if AI_NAME.search(said) else "magic comment" if _MAGIC.search(said) else "editor modeline" if "-*-" in said or re.search(r"(?i)\bvim\s*:", said) else ""
            if kind:
                ai = kind == "AI markers"
                yield Mark(line, min(len(text), m.end() + 1), f"{'latex ai:' if ai else 'info: latex'} comment ({kind})", f"drop comment: {kind}", ai)


class Language(NamedTuple):
    marks: Callable[[str], Iterable[Mark]]
    idle: str


LANGUAGES = {
    "html": Language(html_marks, "no HTML AI meta removed"),
    "markdown": Language(markdown_marks, "no AI frontmatter keys or embedded data URIs removed"),
    "svg": Language(svg_marks, "no SVG metadata removed"),
    "latex": Language(latex_marks, "no LaTeX metadata removed"),
}


def cut(text: str, marks: Iterable[Mark]) -> tuple[str, list[str]]:
    """The source with its marks cut out, and what was done. Of marks that overlap the first one that begins wins."""
    marks, out, end = list(marks), [], 0
    counts: dict[str, int] = {}
    for m in marks:
        if m.action:
            counts[m.action] = counts.get(m.action, 0) + 1
    for m in sorted(marks, key=lambda m: (m.start, -m.end)):
        if m.start >= end and m.end > m.start:
            out += [text[end : m.start], m.becomes]
            end = m.end
    counted = {m.action for m in marks if m.counted}
    actions = [x for a, n in counts.items() for x in ([f"{a} x{n}"] if a in counted else [a] * n)]
    return "".join([*out, text[end:]]), actions


def inspect(text: str, language: str) -> dict:
    """``findings, has_ai, has_c2pa``; C2PA implies AI."""
    marks = list(LANGUAGES[language].marks(text))
    c2pa = any(m.c2pa for m in marks)
    return {"findings": [m.finding for m in marks if m.finding], "has_ai": c2pa or any(m.ai and m.finding for m in marks), "has_c2pa": c2pa}


def clean(text: str, language: str) -> dict:
    """``text, actions``, and what a second inspection still finds."""
    out, actions = cut(text, LANGUAGES[language].marks(text))
    after = inspect(out, language)
    return {"text": out, "actions": actions or [LANGUAGES[language].idle], "still_has_ai": after["has_ai"], "still_has_c2pa": after["has_c2pa"]}


_REPORT = pa.struct([("findings", pa.list_(pa.string())), ("has_ai", pa.bool_()), ("has_c2pa", pa.bool_())])
_CLEANED = pa.struct([("text", pa.string()), ("actions", pa.list_(pa.string())), ("still_has_ai", pa.bool_()), ("still_has_c2pa", pa.bool_())])


def report(text: Column | str, language: str) -> Column:
    """``inspect`` per source; null for null. Pages in bulk have native forms in ``functions.markup``."""

    @F.arrow_udf("struct<findings:array<string>,has_ai:boolean,has_c2pa:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else inspect(t, language) for t in texts.to_pylist()], _REPORT)

    return of(text)


def cleaned(text: Column | str, language: str) -> Column:
    """``clean`` per source; null for null."""

    @F.arrow_udf("struct<text:string,actions:array<string>,still_has_ai:boolean,still_has_c2pa:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(t, language) for t in texts.to_pylist()], _CLEANED)

    return of(text)
