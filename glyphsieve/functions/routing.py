"""Routes artifacts and URLs by name and by their first bytes, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SKIPPED_DIRS = r"/(" + "|".join(re.escape(d) for d in fixed.SKIPPED_DIRS) + r"|\.[^/]+)/"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.]\.([A-Za-z0-9]+)$", 1))


def kind_by_suffix(path: Column) -> Column:
    """The kind that a known suffix says; null for others. Bytes are not read."""
    ext, out = suffix(path), F.when(F.lit(False), "")
    for kind, known in fixed.SUFFIXES.items():
        out = out.when(ext.isin(*known), kind)
    return out


def _head(content: Column, n: int, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, n))


def image_format(content: Column) -> Column:
    """png, jpeg, webp, avif, heic, bmp, gif, tiff; null for other bytes."""
    h, brands = _head(content, 16), _head(content, 56, 9)
    brand = lambda names: F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda k: F.substring(brands, k * 8 + 1, F.lit(8)).isin(*[n.encode().hex().upper() for n in names])), True)
    ftyp = F.substring(h, 9, 8) == "66747970"
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8"), "jpeg").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when(ftyp & brand(["avif", "avis"]), "avif").when(ftyp & brand(["heic", "heix", "hevc", "hevx", "mif1", "msf1"]), "heic")
        .when(h.startswith("424D"), "bmp").when(h.startswith("47494638"), "gif").when(h.rlike("^(49492A00|4D4D002A|49492B00|4D4D002B)"), "tiff")
    )


def av_format(content: Column) -> Column:
    """mp4, wav, flac, mp3; null for other bytes. An ID3 tag is mp3 unless FLAC follows it."""
    h = _head(content, 12)
    octet = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")
    after = 10 + octet(6) * 2097152 + octet(7) * 16384 + octet(8) * 128 + octet(9)
    return (
        F.when(F.substring(h, 9, 8) == "66747970", "mp4").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), "wav").when(h.startswith("664C6143"), "flac")
        .when(h.startswith("494433") & (F.length(h) >= 20), F.when(F.hex(F.substring(content, after + 1, F.lit(4))) == "664C6143", "flac").otherwise("mp3")).when(h.rlike("^FF[EF][0-9A-F]"), "mp3")
    )


def binary_reason(content: Column) -> Column:
    """Why bytes are no text: a known beginning, NUL bytes, or many control bytes in the first 8 KiB; null for text and for nothing."""
    h, out = _head(content, 16), F.when(F.length(content) == 0, F.lit(None).cast("string"))
    for start, name in fixed.BINARY_MAGIC:
        out = out.when(h.startswith(start.hex().upper()), name)
    octets = F.regexp_replace(_head(content, 8192), "(..)", "$1 ")
    controls = F.regexp_count(octets, F.lit("(0[0-8EF]|1[0-9A-F]) ")) - F.regexp_count(octets, F.lit("1B "))
    return out.when(F.regexp_like(octets, F.lit("(^| )00 ")), "nul bytes").when(controls / F.least(F.length(content), F.lit(8192)) > 0.05, "control bytes")


def kind(path: Column, content: Column) -> Column:
    """image, container, text, av or unknown: by suffix, else by the first bytes. Zip containers other than by suffix need ``container_format``."""
    sniffed = F.when(image_format(content).isNotNull(), "image").when(av_format(content).isNotNull(), "av").when(_head(content, 4) == "25504446", "container")
    return F.coalesce(kind_by_suffix(path), sniffed, F.lit("unknown"))


# Kinds by content type and by a URL's suffix.
_TYPES = {
    "image/png": "png", "image/jpeg": "jpeg", "application/pdf": "pdf", "text/plain": "text", "image/webp": "webp", "image/avif": "avif", "image/heic": "heic", "image/heif": "heic", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tiff",
    "application/epub+zip": "epub", "video/mp4": "mp4", "video/quicktime": "mp4", "audio/x-m4a": "mp4", "audio/mp4": "mp4", "audio/wav": "wav", "audio/x-wav": "wav", "audio/mpeg": "mp3", "audio/mp3": "mp3",
}
_URL_SUFFIX = {
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "avif": "avif", "heic": "heic", "heif": "heic", "gif": "gif", "bmp": "bmp", "tiff": "tiff", "tif": "tiff", "svg": "svg", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx",
    "odt": "odt", "epub": "epub", "mp4": "mp4", "mov": "mp4", "m4a": "mp4", "wav": "wav", "mp3": "mp3", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for value in sorted(set(table.values())):
        out = out.when(key.isin(*[k for k, v in table.items() if v == value]), value)
    return out


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_kind(url: Column, content: Column, content_type: Column) -> Column:
    """Kind of a download: by content type, then by the path's suffix, then by the bytes; ``text`` if nothing tells."""
    ct = F.trim(F.element_at(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";"), 1))
    has = lambda x: F.contains(ct, F.lit(x))
    by_type = F.when(has("html"), "html").when(has("svg"), "svg").when(has("wordprocessingml"), "docx").when(has("spreadsheetml.sheet"), "xlsx").when(has("presentationml.presentation"), "pptx").when(has("opendocument.text"), "odt").when(has("markdown"), "markdown")
    start = F.lower(F.decode(F.make_valid_utf8(F.substring(content, 1, 2000).cast("string")).cast("binary"), "utf-8"))
    marked = F.ltrim(F.substring(start, 1, 100)).startswith("<")
    by_bytes = F.coalesce(image_format(content), F.when(_head(content, 4) == "25504446", "pdf"), F.when(F.hex(F.substring(content, 5, 4)) == "66747970", "mp4"), F.when(marked & F.contains(F.substring(start, 1, 500), F.lit("svg")), "svg"), F.when(F.contains(start, F.lit("<html")) | marked, "html"))
    return F.coalesce(_lookup(ct, _TYPES), by_type, _lookup(F.regexp_extract(F.lower(url_path(url)), r"\.([a-z0-9]+)$", 1), _URL_SUFFIX), by_bytes, F.lit("text"))


def url_origin(url: Column) -> Column:
    """``scheme://host:port`` in lower case, with the scheme's usual port; null without a host."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:([0-9]+)", 1)
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80")))


def is_loopback(url: Column) -> Column:
    return F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://(localhost|127(\.[0-9]{1,3}){3}|\[::1\])(:[0-9]+)?([/?#]|$)"))


def cleaned_path(path: Column) -> Column:
    """``x.ext`` as ``x.cleaned.ext``."""
    return F.regexp_replace(path, r"(\.[^./]+)?$", ".cleaned$1")


def is_mutating(action: Column) -> Column:
    return ~F.regexp_like(F.lower(action), F.lit(r"^no |^nothing|unchanged|already clean|not removed|skipped|unavailable|^note:|^kept|^preserved|no changes"))
