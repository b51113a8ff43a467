"""Queries over constructed files: media and containers of every format, plain or marked by id, inspected and cleaned; and cleaned sources."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import markup as native
from glyphsieve.functions import routing
from glyphsieve.operators import documents, images, markup

from . import specimens
from .common import MARKED_SQL, marked_pages, quoted, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _made(make) -> Column:
    """Files by ``doc_id``."""

    @F.arrow_udf("binary")
    def of(ids: pa.Array) -> pa.Array:
        return pa.array([make(i) for i in ids.to_pylist()], pa.binary())

    return of("doc_id")


def _list(names: list[str]) -> str:
    return "[" + ", ".join(map(quoted, names)) + "]"


# Format by id, mark by id and format: none, one of AI, one of C2PA.
_N, _Z = len(specimens.MEDIA), len(specimens.ZIPS)
_MEDIA_SQL = f"media AS (SELECT doc_id, {_list(specimens.MEDIA)}[doc_id % {_N} + 1] AS format, doc_id // {_N} % 3 AS mark FROM documents)"
_ZIP_SQL = f"zipped AS (SELECT doc_id, {_list(specimens.ZIPS)}[doc_id % {_Z} + 1] AS format, doc_id // {_Z} % 3 AS mark, doc_id % 7 = 0 AS carrier FROM documents)"


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _made(lambda i: specimens.media(specimens.MEDIA[i % _N], i // _N % 3)).alias("content"))


def _zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(lambda i: specimens.zipped(specimens.ZIPS[i % _Z], i // _Z % 3, f"a{'&#x200B;' if i % 7 == 0 else ''}b &amp; {i}"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("content"))


#: What each format's specimens say: plain, with a mark of AI, with one of C2PA.
_SAID = {
    "png": ["", "PNG tEXt: AI generator (Software=Midjourney)", "PNG chunk caBX (possible C2PA container)"],
    "jpeg": ["", "JPEG APP1: OpenAI", "JPEG APP11 segment (JUMBF/C2PA common)"],
    "webp": ["", "WebP XMP : trainedAlgorithmicMedia, algorithmicMedia", "WebP C2PA chunk"],
    "avif": ["", "AVIF XMP uuid box: trainedAlgorithmicMedia, algorithmicMedia", "AVIF top-level box jumb (C2PA/JUMBF manifest)"],
    "heic": ["", "HEIC XMP uuid box: trainedAlgorithmicMedia, algorithmicMedia", "HEIC top-level box jumb (C2PA/JUMBF manifest)"],
    "bmp": ["BMP has no metadata (header-only raster format)", "BMP trailing metadata: SynthID", "BMP trailing metadata: c2pa, C2PA, c2pa, C2PA"],
    "gif": ["no GIF metadata extensions found", "GIF comment extension present|GIF comment: AIGC, aigc", "GIF application extension (possible C2PA)"],
    "tiff": ["no TIFF metadata tags found", "TIFF tag 305: digitalSourceType|TIFF tag 305 (Software) present", "TIFF tag 700: c2pa, C2PA, c2pa, C2PA|TIFF tag 700 (XMP) present"],
    "mp4": ["", "MP4 moov/udta box: AIGC, aigc", "MP4 top-level box jumb (C2PA/JUMBF manifest)"],
    "mp3": ["", "ID3v2 frame TXXX: AIGC, aigc", "ID3v2 frame TXXX: contentcredentials, ContentCredentials"],
    "wav": ["", "WAV LIST INFO chunk: AIGC, aigc", "WAV C2PA-related manifest chunk"],
    "flac": ["", "", "C2PA-related manifest in ID3v2 frame GEOB: application/c2pa"],
}
#: What cleaning does to specimens with marks, and the bytes that it leaves of each.
_DONE = {
    "png": ["drop chunk tEXt", "drop chunk caBX"], "jpeg": ["drop APP1|preserved entropy-coded scan (SOS→EOF)", "drop APP11 (C2PA/JUMBF)|preserved entropy-coded scan (SOS→EOF)"], "webp": ["drop WebP chunk XMP ", "drop WebP chunk C2PA"],
    "avif": ["drop top-level uuid box (XMP metadata)", "drop top-level jumb box (C2PA/JUMBF)"], "heic": ["drop top-level uuid box (XMP metadata)", "drop top-level jumb box (C2PA/JUMBF)"],
    "bmp": ["drop 7 BMP trailing byte(s) (SynthID)", "drop 4 BMP trailing byte(s) (c2pa, C2PA, c2pa, C2PA)"], "gif": ["drop GIF comment extension", "drop GIF application extension"], "tiff": ["drop TIFF tag 305 (Software)", "drop TIFF tag 700 (XMP)"],
    "mp4": ["drop moov/udta box (generator/user-data tags)", "drop top-level jumb box (C2PA/JUMBF)"], "mp3": ["drop ID3v2.3 tag (40 bytes)", "drop ID3v2.3 tag (66 bytes)"], "wav": ["drop WAV LIST INFO chunk", "drop WAV C2PA chunk"], "flac": ["drop FLAC ID3v2.3 tag (25 bytes)", "drop FLAC ID3v2.3 tag (56 bytes)"],
}
_SAID_SQL = "said(format, mark, findings) AS (VALUES " + ", ".join(f"({quoted(f)}, {k}, {quoted(x)})" for f, xs in _SAID.items() for k, x in enumerate(xs)) + ")"
_DONE_SQL = "done(format, mark, actions) AS (VALUES " + ", ".join(f"({quoted(f)}, {k}, {quoted(x)})" for f, xs in _DONE.items() for k, x in enumerate(xs, 1)) + ")"


@query(f"WITH {_MEDIA_SQL}, {_SAID_SQL} SELECT doc_id, format, mark = 2 AS has_c2pa, mark = 2 OR mark = 1 AND format <> 'flac' AS has_ai, findings FROM media JOIN said USING (format, mark)")
def media_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _media(spark, sf_dir).select("doc_id", images.report("content").alias("r"))
    return r.select("doc_id", "r.format", "r.has_c2pa", "r.has_ai", F.array_join("r.findings", "|").alias("findings"))


@query(f"WITH {_MEDIA_SQL}, {_DONE_SQL} SELECT doc_id, format, actions, false AS still_has_ai, format NOT IN ('avif', 'heic', 'mp4', 'tiff') AS shorter FROM media JOIN done USING (format, mark)")
def media_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked files only. Boxes become free space and tags zeros, so that what stays keeps its place; other parts are cut out."""
    made = _media(spark, sf_dir).where(F.floor(F.col("doc_id") / _N) % 3 > 0)
    r = made.select("doc_id", F.length("content").alias("before"), images.report("content").alias("r"), images.cleaned("content").alias("c"))
    return r.select("doc_id", "r.format", F.array_join("c.actions", "|").alias("actions"), "c.still_has_ai", (F.length("c.content") < F.col("before")).alias("shorter"))


@query(f"""WITH {_MEDIA_SQL} SELECT doc_id, CASE WHEN format IN ('mp4', 'mp3', 'wav', 'flac') THEN NULL ELSE format END AS image, CASE WHEN format IN ('avif', 'heic', 'mp4') THEN 'mp4' WHEN format IN ('mp3', 'wav', 'flac') THEN format END AS av, 'binary' AS said FROM media
    UNION ALL SELECT -1 - doc_id, NULL, NULL, 'text' FROM documents WHERE text <> '' AND left(text, 2) <> 'BM'""")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media files and, under negative ids, the documents' own bytes."""
    texts = table(spark, sf_dir, "documents").where("text <> '' AND left(text, 2) <> 'BM'").select((-1 - F.col("doc_id")).alias("doc_id"), F.col("text").cast("binary").alias("content"))
    c = F.col("content")
    return _media(spark, sf_dir).unionByName(texts).select("doc_id", routing.image_format(c).alias("image"), routing.av_format(c).alias("av"), F.when(routing.binary_reason(c).isNull() & routing.av_format(c).isNull(), "text").otherwise("binary").alias("said"))


@query(f"""WITH {_ZIP_SQL} SELECT doc_id, format, mark = 2 AS has_c2pa, mark > 0 AS has_ai, CASE WHEN carrier AND format <> 'epub' THEN 1 ELSE 0 END::BIGINT AS layer_a,
    CASE WHEN mark = 0 THEN '' WHEN format = 'odt' THEN CASE mark WHEN 2 THEN 'meta.xml: marker:c2pa, marker:C2PA|' ELSE '' END || 'meta.xml generator-like fields'
         WHEN format = 'epub' THEN 'c.opf: AI-ish metadata in package document|c.opf: ' || CASE mark WHEN 1 THEN 'ai:Claude' ELSE 'marker:c2pa, marker:C2PA' END
         ELSE 'docProps/core.xml: ' || CASE mark WHEN 1 THEN 'ai:OpenAI' ELSE 'marker:c2pa, marker:C2PA' END END AS findings FROM zipped""")
def container_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _zipped(spark, sf_dir).select("doc_id", documents.report("content").alias("r"))
    total = F.coalesce(F.try_element_at("r.layer_a", F.lit(1))["total"], F.lit(0).cast("long"))
    return r.select("doc_id", "r.format", "r.has_c2pa", "r.has_ai", total.alias("layer_a"), F.array_join("r.findings", "|").alias("findings"))


_CORE_SQL = quoted(specimens.CORE.format(""))


@query(f"""WITH {_ZIP_SQL}, body AS (SELECT *, 'ab &amp; ' || doc_id AS said, 'a' || CASE WHEN carrier AND format = 'epub' THEN '&#x200B;' ELSE '' END || 'b &amp; ' || doc_id AS page FROM zipped),
    parts AS (SELECT doc_id, CASE format WHEN 'docx' THEN 'word/document.xml' WHEN 'xlsx' THEN 'xl/sharedStrings.xml' WHEN 'pptx' THEN 'ppt/slides/slide1.xml' WHEN 'odt' THEN 'content.xml' ELSE 'a.xhtml' END AS member,
        CASE format WHEN 'docx' THEN '<doc><w:t>' || said || '</w:t></doc>' WHEN 'xlsx' THEN '<doc><t>' || said || '</t></doc>' WHEN 'pptx' THEN '<doc><a:t>' || said || '</a:t></doc>'
        WHEN 'odt' THEN '<office:document-content xmlns:office="o" xmlns:text="t"><text:p>' || said || '</text:p></office:document-content>' ELSE '<html><body><p>' || page || '</p></body></html>' END AS content FROM body
      UNION ALL SELECT doc_id, CASE format WHEN 'odt' THEN 'meta.xml' WHEN 'epub' THEN 'c.opf' ELSE 'docProps/core.xml' END,
        CASE format WHEN 'odt' THEN '<office:document-meta xmlns:office="o" xmlns:meta="m"><office:meta></office:meta></office:document-meta>'
        WHEN 'epub' THEN '<package xmlns="http://www.idpf.org/2007/opf"><metadata></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest></package>' ELSE {_CORE_SQL} END FROM body)
    SELECT doc_id, member, sha256(content) AS content_sha256 FROM parts""")
def container_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and metadata of each cleaned container, unzipped again."""
    out = documents.unzipped(_zipped(spark, sf_dir).select("doc_id", documents.cleaned("content")["content"].alias("content")))
    kept = out.where(F.col("member").isin("word/document.xml", "xl/sharedStrings.xml", "ppt/slides/slide1.xml", "content.xml", "a.xhtml", "meta.xml", "c.opf", "docProps/core.xml"))
    return kept.select("doc_id", "member", F.sha2("member_content", 256).alias("content_sha256"))


_PDF = "%PDF-1.7\n1 0 obj\n<< /Title (A) /Producer (@) >>\nendobj\n2 0 obj\n<< /Length 9 >>\nstream\nAIGC c2pa\nendstream\nendobj\n"
_PACKET = "<?xpacket begin='' id='x'?><rdf>digitalSourceType</rdf><?xpacket end='w'?>\n"


@query("""SELECT doc_id, doc_id % 3 = 2 AS has_c2pa, doc_id % 3 > 0 OR doc_id % 2 = 1 AS has_ai, concat_ws('|', CASE WHEN doc_id % 3 = 2 THEN 'pdf-structured:marker:c2pa|pdf-structured:marker:C2PA' END, CASE WHEN doc_id % 2 = 1 THEN 'pdf-structured:ai:digitalSourceType' END, CASE WHEN doc_id % 3 = 1 THEN 'pdf-structured:ai:OpenAI' END, CASE WHEN doc_id % 2 = 1 THEN 'XMP packet present' END) AS findings,
    CASE WHEN doc_id % 2 = 1 THEN 'blank XMP packets x1' ELSE 'no PDF XMP packets removed' END AS actions, doc_id % 3 > 0 AS still_has_ai FROM documents""")
def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A producer by id, and a packet for odd ids; the marks in the stream are no findings."""
    d = F.col("doc_id")
    tool = F.when(d % 3 == 0, "a printer").when(d % 3 == 1, "OpenAI").otherwise("c2pa tool")
    content = F.concat(F.replace(F.lit(_PDF), F.lit("@"), tool), F.when(d % 2 == 1, _PACKET).otherwise("")).cast("binary")
    r = table(spark, sf_dir, "documents").select("doc_id", documents.report(content).alias("r"), documents.cleaned(content).alias("c"))
    return r.select("doc_id", "r.has_c2pa", "r.has_ai", F.array_join("r.findings", "|").alias("findings"), F.array_join("c.actions", "|").alias("actions"), "c.still_has_ai")


# Sources


@query(f"WITH {MARKED_SQL} SELECT page_id, CASE WHEN m.page_id % 5 = 1 THEN sha256(m.html) WHEN m.page_id % 5 = 4 THEN sha256(replace(m.html, ' data-ai-model=\"none\"', '')) ELSE sha256(p.html) END AS clean_sha256, CASE WHEN m.page_id % 5 = 1 THEN 0 ELSE 1 END AS removed FROM marked m JOIN pages p USING (page_id)")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked pages without their marks; a content system's name stays."""
    c = marked_pages(spark, sf_dir).select("page_id", native.html_cleaned(F.col("html")).alias("c"))
    return c.select("page_id", F.sha2("c.text", 256).alias("clean_sha256"), "c.removed")


_KEYS = ["generator: Midjourney\n  version: 6\n  more: [a]\n", "description: a note\n", "model: x\n# said of it\n", "author: made with love\n", "c2pa: yes\n"]
_COMMENT = "<!-- written with ChatGPT -->"
_CODE = f"```\n{_COMMENT}\n```\n"


@query(f"""WITH m AS (SELECT doc_id, replace(coalesce(text, ''), '<!--', '') AS t, {_list(_KEYS)}[doc_id % 5 + 1] AS k FROM documents)
    SELECT doc_id, sha256('---' || chr(10) || 'title: ' || doc_id || chr(10) || CASE WHEN doc_id % 5 = 1 THEN k ELSE '' END || '---' || chr(10) || {quoted(_CODE)} || 'x  y' || chr(10) || t) AS clean_sha256,
        CASE doc_id % 5 WHEN 0 THEN 'drop frontmatter key: generator|' WHEN 2 THEN 'drop frontmatter key: model|' WHEN 3 THEN 'drop frontmatter key (value hit): author|' WHEN 4 THEN 'drop frontmatter key: c2pa|' ELSE '' END || 'drop AI provenance comment x1' AS actions,
        doc_id % 5 = 4 AS has_c2pa FROM m""")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter keys go with what hangs on them; comments go outside of code only."""
    d = F.col("doc_id")
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (d % 5 + 1).cast("int"))
    text = F.concat(F.lit("---\ntitle: "), d.cast("string"), F.lit("\n"), key, F.lit(f"---\n{_CODE}x {_COMMENT} y\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("<!--"), F.lit("")))
    r = table(spark, sf_dir, "documents").select("doc_id", markup.cleaned(text, "markdown").alias("c"), markup.report(text, "markdown").alias("r"))
    return r.select("doc_id", F.sha2("c.text", 256).alias("clean_sha256"), F.array_join("c.actions", "|").alias("actions"), "r.has_c2pa")


@query("""SELECT doc_id, sha256('<?xml version="1.0"?><svg width="' || doc_id || '"><text>' || doc_id || '</text><![CDATA[<!-- Claude -->]]></svg>') AS clean_sha256,
    CASE WHEN doc_id % 2 = 0 THEN 'drop <metadata> x1|' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'drop DOCTYPE/entity declarations x1|' ELSE '' END || 'drop SVG comment with AI markers|drop generator-like attrs x1' AS actions, doc_id % 2 = 0 AS has_c2pa FROM documents""")
def clean_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, doc = F.col("doc_id"), F.col("doc_id").cast("string")
    text = F.concat(F.lit('<?xml version="1.0"?>'), F.when(d % 3 == 0, '<!DOCTYPE svg [<!ENTITY a "b">]>').otherwise(""), F.lit('<svg generator="x" width="'), doc, F.lit('">'), F.when(d % 2 == 0, "<metadata>c2pa</metadata>").otherwise(""), F.lit("<!-- Claude --><text>"), doc, F.lit("</text><![CDATA[<!-- Claude -->]]></svg>"))
    r = table(spark, sf_dir, "documents").select("doc_id", markup.cleaned(text, "svg").alias("c"), markup.report(text, "svg").alias("r"))
    return r.select("doc_id", F.sha2("c.text", 256).alias("clean_sha256"), F.array_join("c.actions", "|").alias("actions"), "r.has_c2pa")


_TEX_END = "\\verb|\\hypersetup{pdfauthor=x}|\n\\begin{verbatim}\n% Claude\n\\pdfinfo{/Author (x)}\n\\end{verbatim}\n"


@query(f"""SELECT doc_id, sha256('\\hypersetup{{pdftitle={{T, ' || doc_id || '}}, colorlinks=true}}' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '\\pdfinfo{{/Title (T)}}' ELSE '' END || chr(10) || {quoted(_TEX_END)}) AS clean_sha256,
    concat_ws('|', 'info: latex hypersetup pdfauthor', CASE WHEN doc_id % 2 = 0 THEN 'latex ai: pdfinfo /Creator' ELSE 'info: latex pdfinfo /Author' END, CASE WHEN doc_id % 3 = 0 THEN 'info: latex comment (magic comment)' WHEN doc_id % 3 = 1 THEN 'latex ai: comment (AI markers)' ELSE 'info: latex comment (editor modeline)' END) AS findings,
    doc_id % 2 = 0 OR doc_id % 3 = 1 AS has_ai FROM documents""")
def clean_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    line = F.when(d % 3 == 0, "% !TEX program = x").when(d % 3 == 1, "  % by Claude").otherwise("% -*- mode: latex -*-")
    info = F.when(d % 2 == 0, r"\pdfinfo{/Title (T) /Creator (Claude (x))}").otherwise(r"\pdfinfo{/Author (A \) b)}")
    text = F.concat(F.lit(r"\hypersetup{pdftitle={T, "), d.cast("string"), F.lit("}, pdfauthor={A, B}, colorlinks=true}\n"), info, F.lit("\n"), line, F.lit("\n" + _TEX_END))
    r = table(spark, sf_dir, "documents").select("doc_id", markup.cleaned(text, "latex").alias("c"), markup.report(text, "latex").alias("r"))
    return r.select("doc_id", F.sha2("c.text", 256).alias("clean_sha256"), F.array_join("r.findings", "|").alias("findings"), "r.has_ai")


_URI = ["data:image/png;base64," + base64.b64encode(specimens.media("png", k)).decode() for k in range(3)]


@query(f"""WITH u AS (SELECT doc_id, doc_id % 3 AS k, {_list(_URI)} AS uris FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN '' WHEN 1 THEN {quoted("embedded data:image/png: " + _SAID["png"][1])} ELSE {quoted("embedded data:image/png: " + _SAID["png"][2])} END AS findings, k = 2 AS has_c2pa, sha256('<p>' || doc_id || '<img src="' || uris[1] || '"></p>') AS clean_sha256 FROM u""")
def data_uri_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a picture inside; cleaned ones hold the picture without its marks."""
    uri = F.element_at(F.array(*map(F.lit, _URI)), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.lit('<img src="'), uri, F.lit('"></p>'))
    r = table(spark, sf_dir, "documents").select("doc_id", markup.report(text, "html").alias("r"), markup.cleaned(text, "html").alias("c"))
    return r.select("doc_id", F.array_join("r.findings", "|").alias("findings"), "r.has_c2pa", F.sha2("c.text", 256).alias("clean_sha256"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, len(coalesce(text, ''))::BIGINT AS n FROM documents")
def xml_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written with character references for every letter e and space, read back."""

    @F.arrow_udf("string")
    def decoded(texts: pa.Array) -> pa.Array:
        return pa.array([documents.decode_references(t) for t in texts.to_pylist()], pa.string())

    text = F.coalesce("text", F.lit(""))
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("e", "&#x65;"), (" ", "&#32;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    out = table(spark, sf_dir, "documents").select("doc_id", decoded(text).alias("t"))
    return out.select("doc_id", F.sha2("t", 256).alias("decoded_sha256"), F.length("t").cast("long").alias("n"))
