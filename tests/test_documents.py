import time

import pytest

from glyphsieve.functions import codepoints
from glyphsieve.operators import documents, markup
from glyphsieve.plans import specimens
from glyphsieve.plans.specimens import archive, media, zipped


@pytest.mark.parametrize("mark", range(3))
@pytest.mark.parametrize("fmt", specimens.ZIPS)
def test_containers(fmt, mark):
    data = zipped(fmt, mark, "a&#x200B;b &amp; c&#8203;")
    got = documents.inspect(data)
    assert (got["format"], got["has_c2pa"], got["has_ai"]) == (fmt, mark == 2, mark > 0)
    assert got["layer_a"] == ([] if fmt == "epub" else [{"part": got["layer_a"][0]["part"], "total": 2}])
    out = documents.clean(data)
    again = documents.inspect(out["content"])
    assert not out["still_has_ai"] and not again["layer_a"] and again["findings"] == []
    body = dict((i.filename, v) for i, v in documents.members(out["content"]))
    assert fmt == "epub" or any(b"ab &amp; c<" in v for v in body.values())


def test_parts_that_go_are_listed_no_more():
    rels = '<Relationships><Relationship Id="a" Target="../customXml/item1.xml"/><Relationship Id="b" Target=\'media/a.png\'/><Relationship Id="c" Target="http://x" TargetMode="External"/></Relationships>'
    types = '<Types><Override PartName="/customXml/item1.xml" ContentType="x"/><Override PartName="/word/document.xml"/></Types>'
    data = archive(("[Content_Types].xml", types), ("word/document.xml", "<w:t>Claude wrote</w:t>"), ("word/_rels/document.xml.rels", rels), ("word/media/a.png", media("png", 1)), ("customXml/item1.xml", "<a>c2pa</a>"), ("docProps/thumbnail.jpeg", b"\xff\xd8\xff\xfe"))
    got = documents.inspect(data)
    assert got["findings"] == ["word/media/a.png: PNG tEXt: AI generator (Software=Midjourney)", "customXml/item1.xml: marker:c2pa, marker:C2PA", "customXml parts: 1"]
    out = dict((i.filename, v) for i, v in documents.members(documents.clean(data)["content"]))
    assert sorted(out) == ["[Content_Types].xml", "docProps/thumbnail.jpeg", "word/_rels/document.xml.rels", "word/document.xml", "word/media/a.png"]
    assert out["word/media/a.png"] == media("png", 0) and out["docProps/thumbnail.jpeg"] == b"\xff\xd8\xff\xfe" and b"customXml" not in out["[Content_Types].xml"] + out["word/_rels/document.xml.rels"] and b"media/a.png" in out["word/_rels/document.xml.rels"]


def test_budget_and_broken_archives():
    bomb = archive(("word/document.xml", b"\0" * 100_000))
    assert "exceeds cap" in documents.inspect_zip(bomb, "docx", limit=1000)["findings"][0] and documents.clean_zip(bomb, "docx", limit=1000)[0] == bomb
    assert documents.inspect_zip(b"PK\3\4", "docx")["findings"] == ["not a valid DOCX zip"]
    core = specimens.CORE.format("OpenAI")
    data = bytearray(archive(("docProps/core.xml", core), ("docProps/app.xml", "<Application>x</Application>" * 50)))
    at = data.index(b"docProps/app.xml") + 16
    data[at : at + 8] = b"\xff" * 8
    got = documents.inspect_zip(bytes(data), "docx")
    assert got["has_ai"] and got["findings"][0] == "docProps/core.xml: ai:OpenAI" and got["findings"][1].startswith("partial read of DOCX zip")
    assert documents.inspect(b"plain")["format"] is None and documents.clean(b"plain")["content"] == b"plain"


def test_epub_skips_encrypted_parts():
    lock = '<encryption><CipherReference URI="a.xhtml"/></encryption>'
    data = archive(("mimetype", "application/epub+zip"), ("META-INF/encryption.xml", lock), ("a.xhtml", "<!-- ChatGPT -->"), ("b.xhtml", "<!-- ChatGPT -->"))
    assert documents.inspect(data)["findings"] == ["a.xhtml: encrypted content (skipped)", "b.xhtml: comment: <!-- ChatGPT -->"]


def test_pdf_streams_and_packets():
    pdf = b"%PDF-1.4\n<< /Producer (OpenAI) >>\nstream\nc2pa\nendstream\n<?xpacket begin='' ?>SoftwareAgent<?xpacket end='w'?>\n" + specimens.jpeg((0xE1, b"jumb"))
    got, out = documents.inspect(pdf), documents.clean(pdf)
    assert got["findings"][0] == "pdf-structured:marker:jumb" and "pdf-structured:ai:OpenAI" in got["findings"] and got["findings"][-1] == "XMP packet present"
    assert len(out["content"]) == len(pdf) and b"xpacket" not in out["content"] and out["content"].count(b"OpenAI") == 1
    assert documents.embedded_jpegs(pdf) == [{"at": pdf.index(b"\xff\xd8"), "metadata": True, "provenance": True}]


def test_references_are_read_as_a_parser_does():
    assert documents.decode_references("&#x41;&#66;&amp;&lt;&#0;&#xD800;&#x110000;&nbsp;&amp;lt;") == "AB&<&#0;&#xD800;&#x110000;&nbsp;&lt;"


@pytest.mark.parametrize("text, want", [
    ("---\ntitle: x\ngenerator: Claude\n  - sub\nauthor: y\nmodel: z\n---\nb", "---\ntitle: x\nauthor: y\n---\nb"),
    ("---\r\ntitle: x\r\nai: yes\r\n---\r\nb", "---\r\ntitle: x\r\n---\r\nb"), ("---\nai: yes\n---\n\nb", "b"), ("a <!-- by ChatGPT --!> b", "a  b"), ("~~~\n<!-- ChatGPT -->\n", "~~~\n<!-- ChatGPT -->\n"),
    ("---\nname: a\ndescription: Generated with x\ntools: b\nmodel: c\n---\n", "---\nname: a\ntools: b\nmodel: c\n---\n"), ("no front matter", "no front matter"),
])
def test_markdown(text, want):
    out = markup.clean(text, "markdown")
    assert out["text"] == want
    assert not out["still_has_ai"] or "tools" in text  # an agent's definition that lost its description is none any more


def test_what_is_flagged_goes_and_nothing_else():
    page = '<meta name="generator" content="WordPress"><meta name=\'description\' content="Bob\'s page"><meta property="x" content="made with C2PA"><script type="application/ld+json">{"a": "SoftwareAgent"}</script><script>x="SoftwareAgent"</script><!-- plain --><p data-ai-x="1" id=a>t</p>'
    out = markup.clean(page, "html")
    assert out["text"] == '<meta name="generator" content="WordPress"><meta name=\'description\' content="Bob\'s page"><script>x="SoftwareAgent"</script><!-- plain --><p id=a>t</p>'
    assert out["actions"] == ['drop meta: <meta property="x" content="made with C2PA">', "drop json-ld provenance-like script", "drop data-ai* attributes x1"]


@pytest.mark.parametrize("language", sorted(markup.LANGUAGES))
@pytest.mark.parametrize("part", ["<script>", "<!--", "<meta ", "<metadata>", "\\hypersetup{", "\\begin{verbatim}", "---\n", "```\n", "<svg ", "data:image/png;base64,", "<![CDATA[", "a: b\n", "%\n", "<!DOCTYPE ["])
def test_repeated_parts_take_linear_time(language, part):
    text, began = part * (200_000 // len(part)), time.process_time()
    markup.clean(text, language)
    assert time.process_time() - began < 20


def test_all_noncharacters_go_and_joiners_look_at_their_input():
    every = [*range(0xFDD0, 0xFDF0), *(p << 16 | k for p in range(17) for k in (0xFFFE, 0xFFFF))]
    assert len(every) == 66
    for cp in every:
        assert codepoints.clean(f"a{chr(cp)}b")[0] == "ab" and codepoints.inspect(chr(cp))[0]["kind"] == "noncharacter"
    assert codepoints.clean("ب‌‌ن")[0] == "بن" or codepoints.clean("ب‌‌ن")[0].count("‌") == 0
    assert codepoints.clean("ب‌ن")[0] == "ب‌ن"
    assert codepoints.inspect("\U0010ffff")[0]["label"] == "U+10FFFF UNKNOWN (Cn)"
