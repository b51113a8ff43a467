"""Provenance marks in HTML, Markdown and SVG sources, as columns: arrays of findings, and what they say together."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

HINTS = "(?i)" + "|".join(fixed.AI_META_HINTS[:12])
C2PA = r"(?i)c2pa|content.?credential"
JSONLD = fixed.AI_META_NAME + "|" + fixed.JSONLD_EXTRA.removeprefix("(?i)")
COMMENT = r"(?s)<!--.*?--!?>"
PRODUCT = "(?i)" + "|".join(re.escape(p) for p in fixed.PRODUCTS)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def named_value_is_ai(name: Column, value: Column) -> Column:
    """Under a name that names a tool any product counts; under other names only words that are no ordinary prose."""
    return F.when(F.lower(name).isin(*fixed.GENERATOR_NAME_KEYS), F.regexp_like(value, F.lit(fixed.AI_META_NAME)) | F.regexp_like(value, F.lit(PRODUCT))).otherwise(F.regexp_like(value, F.lit(fixed.AI_FREE_TEXT_MARKER)))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute's value; empty if there is none."""
    double = F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*'([^']*)'", 1))


def _meta_name(tag: Column) -> Column:
    name, prop = attribute(tag, "name"), attribute(tag, "property")
    return F.when(name != "", name).otherwise(prop)


def is_cms_meta(tag: Column) -> Column:
    """A generator tag that names no AI vendor."""
    return (F.lower(_meta_name(tag)) == "generator") & ~F.regexp_like(tag, F.lit(fixed.GENERATOR_AI))


def is_ai_meta(tag: Column) -> Column:
    """The tag without its content by names, the content by the rules for named values."""
    bare = F.regexp_replace(F.regexp_replace(tag, r'(?i)\bcontent\s*=\s*"[^"]*"', "content"), r"(?i)\bcontent\s*=\s*'[^']*'", "content")
    return F.regexp_like(bare, F.lit(fixed.AI_META_NAME)) | F.regexp_like(bare, F.lit(HINTS)) | named_value_is_ai(_meta_name(tag), attribute(tag, "content"))


def html_findings(html: Column) -> Column:
    """``struct<findings,has_ai,has_c2pa>`` of a page."""
    tags = _all(html, r"(?i)<meta\b[^>]*>")
    ld = F.filter(_all(html, r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>.*?</script>"""), lambda b: F.regexp_like(b, F.lit(JSONLD)))
    comments = F.filter(_all(html, COMMENT), lambda c: F.regexp_like(c, F.lit(fixed.PROVENANCE_COMMENT)))
    data = _all(html, r"""(?i)\bdata-ai[A-Za-z0-9_-]*\s*=\s*["'][^"']*["']""")
    shown = lambda prefix, x, n: F.concat(F.lit(prefix), F.substring(x, 1, n))
    cms, ai = F.filter(tags, is_cms_meta), F.filter(tags, lambda t: ~is_cms_meta(t) & is_ai_meta(t))
    found = F.concat(F.transform(cms, lambda t: shown("info: cms generator: ", t, 120)), F.transform(ai, lambda t: shown("meta: ", t, 120)), F.transform(ld, lambda b: F.lit("json-ld provenance-like block")), F.transform(comments, lambda c: shown("comment: ", c, 120)), F.transform(data, lambda a: shown("attr: ", a, 80)))
    c2pa = F.exists(F.concat(tags, ld, comments), lambda x: F.regexp_like(x, F.lit(C2PA)))
    return F.struct(found.alias("findings"), (F.size(F.concat(ai, ld, comments, data)) > 0).alias("has_ai"), c2pa.alias("has_c2pa"))


def html_cleaned(html: Column) -> Column:
    """``struct<text,removed>``: the page without what ``html_findings`` flags as AI marks, and how many parts went; pictures stay as they are."""
    tags = F.filter(_all(html, r"(?i)<meta\b[^>]*>"), lambda t: ~is_cms_meta(t) & is_ai_meta(t))
    ld = F.filter(_all(html, r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>.*?</script>"""), lambda b: F.regexp_like(b, F.lit(JSONLD)))
    comments = F.filter(_all(html, COMMENT), lambda c: F.regexp_like(c, F.lit(fixed.PROVENANCE_COMMENT)))
    data = _all(html, r"""(?i)\sdata-ai[A-Za-z0-9_-]*\s*=\s*["'][^"']*["']""")
    gone = F.concat(tags, ld, comments, data)
    return F.struct(F.aggregate(gone, html, lambda text, part: F.replace(text, part, F.lit(""))).alias("text"), F.size(gone).alias("removed"))


def front_matter(text: Column) -> Column:
    """``array<struct<key,value>>`` of the top-level keys of a ``---`` block."""
    block = F.regexp_extract(text, r"\A---\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^[A-Za-z0-9_-]+\s*:")))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[A-Za-z0-9_-]+\s*:", "")).alias("value")))


def markdown_findings(text: Column) -> Column:
    """``struct<findings,has_ai,has_c2pa>``: front matter keys and values, and provenance comments outside fenced code."""
    pairs = front_matter(text)
    keys = F.transform(pairs, lambda p: F.lower(p["key"]))
    agent = F.array_contains(keys, "name") & F.array_contains(keys, "description") & F.arrays_overlap(keys, F.array(F.lit("tools"), F.lit("allowed-tools")))
    exempt = lambda k: agent & k.isin("model", "tools", "name", "description")
    flagged = F.filter(pairs, lambda p: (~exempt(F.lower(p["key"])) & (F.lower(p["key"]).isin(*fixed.AI_FRONTMATTER_KEYS) | F.regexp_like(p["key"], F.lit(fixed.AI_META_NAME)))) | named_value_is_ai(p["key"], p["value"]))
    prose = F.regexp_replace(text, r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", "")
    comments = F.filter(_all(prose, COMMENT), lambda c: F.regexp_like(c, F.lit(fixed.PROVENANCE_COMMENT)))
    found = F.concat(F.transform(flagged, lambda p: F.concat(F.lit("frontmatter: "), p["key"], F.lit("="), F.substring(p["value"], 1, 80))), F.transform(comments, lambda c: F.concat(F.lit("comment: "), F.substring(c, 1, 120))))
    return F.struct(found.alias("findings"), (F.size(found) > 0).alias("has_ai"), F.exists(found, lambda f: F.regexp_like(f, F.lit("(?i)c2pa|content"))).alias("has_c2pa"))


def svg_findings(svg: Column) -> Column:
    """``struct<findings,has_ai,has_c2pa>`` of an SVG source."""
    low = F.lower(svg)
    marks = F.filter(F.array(*[F.lit(m) for m in fixed.C2PA_MARKERS]), lambda m: F.contains(low, F.lower(m)))
    hints = F.filter(F.array(*[F.lit(m) for m in fixed.AI_META_HINTS]), lambda m: F.contains(low, F.lower(m)))
    one = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.transform(marks, lambda m: F.concat(F.lit("marker:"), m)), F.transform(hints, lambda m: F.concat(F.lit("ai:"), m)), one(F.regexp_like(svg, F.lit(r"(?i)<metadata[\s>]")), "svg <metadata> present"), one(F.regexp_like(svg, F.lit("(?i)xmpmeta|rdf:RDF|contentcredentials")), "XMP/RDF-like content in SVG"))
    return F.struct(found.alias("findings"), (F.size(found) > 0).alias("has_ai"), ((F.size(marks) > 0) | F.regexp_like(svg, F.lit("(?i)c2pa|jumbf"))).alias("has_c2pa"))


def data_uris(text: Column) -> Column:
    """``array<struct<mime,content>>`` of the base64 images in a text."""
    found = _all(text, r"data:image/[A-Za-z0-9.+-]+(?:;[A-Za-z0-9=._-]+)*;base64,[A-Za-z0-9+/=]+")
    return F.transform(found, lambda u: F.struct(F.regexp_extract(u, r"^data:(image/[A-Za-z0-9.+-]+)", 1).alias("mime"), F.try_to_binary(F.regexp_extract(u, r"base64,(.*)$", 1), F.lit("base64")).alias("content")))
