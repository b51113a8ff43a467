import struct
import zlib

import pytest

from glyphsieve.operators import images
from glyphsieve.plans import specimens
from glyphsieve.plans.media import _SAID
from glyphsieve.plans.specimens import box, chunk, gif, id3, jpeg, media, png, riff, tiff


@pytest.mark.parametrize("mark", range(3))
@pytest.mark.parametrize("fmt", specimens.MEDIA)
def test_each_format(fmt, mark):
    data = media(fmt, mark)
    got = images.inspect(data)
    assert got["format"] == fmt and "|".join(got["findings"]) == _SAID[fmt][mark]
    assert got["has_c2pa"] == (mark == 2) and got["has_ai"] == (mark == 2 or mark == 1 and fmt != "flac")
    out, actions = images.strip(data)
    again = images.clean(out)
    assert not again["still_has_ai"] and again["content"] == out and (mark == 0) <= (out == data or fmt == "mp3")
    if fmt in ("png", "jpeg", "webp", "bmp", "gif", "wav", "flac"):
        assert out == media(fmt, 0)
    if fmt in ("avif", "heic", "mp4", "tiff"):
        assert len(out) == len(data)
    soft, _ = images.strip(data, everything=False)
    assert not images.inspect(soft)["has_ai"] and (mark > 0) >= (soft != data)


CASES = [
    (png((b"tEXt", b"Comment\0Midjourney 6")), False, False), (png((b"zTXt", b"parameters\0\0" + zlib.compress(b"SDXL"))), False, True), (png((b"iTXt", b"a\0\1\0\0\0" + zlib.compress(b"digitalSourceType"))), False, True), (png((b"vpAg", b"has jumb in it")), True, True),
    (jpeg((0xFE, b"Claude Monet")), False, False), (jpeg((0xFE, b"AIGC")), False, True), (jpeg((0xE5, b"OpenAI")), False, False), (jpeg((0xE1, b"contentauth contentcredentials")), True, True),
    (gif((0xFE, b"c2pa" + b"x" * 300)), True, True), (tiff([(270, b"AIGC")], ">"), False, True), (tiff([(65000, b"contentcredentials")]), True, True),
    (riff(b"WAVE", (b"id3 ", id3((b"TXXX", b"\0SynthID"), sound=b""))), False, True), (id3((b"TXXX", b"\0Claude"), (b"TIT2", b"\0Song")), False, True),
    (box(b"ftyp", b"heic", b"\0" * 4) + box(b"meta", b"\0" * 4, box(b"xml ", b"trainedAlgorithmicMedia"), box(b"jumb", b"x")) + box(b"mdat", b"c2pa"), True, True),
    (box(b"ftyp", b"avif", b"\0" * 4) + box(b"uuid", b"\0" * 4 + images.C2PA_BOX, b"xyz"), True, True), (box(b"ftyp", b"avif", b"\0" * 4) + box(b"mdat", b"c2pa"), False, False), (box(b"ftyp", b"avif", b"\0" * 4) + b"\0\0\1\0mdatc2pa", True, True),
]


@pytest.mark.parametrize("data, c2pa, ai", CASES)
def test_reports_and_stripping(data, c2pa, ai):
    got = images.inspect(data)
    assert (got["has_c2pa"], got["has_ai"]) == (c2pa, ai)
    clean, actions = images.strip(data)
    if not data.endswith(b"\0\0\1\0mdatc2pa"):
        assert not images.inspect(clean)["has_ai"] and images.strip(clean)[0] == clean


def test_soft_stripping_keeps_what_has_no_marks():
    out, actions = images.strip(id3((b"TXXX", b"\0Claude"), (b"TIT2", b"\0Song")), everything=False)
    assert out == id3((b"TIT2", b"\0Song")) and actions == ["drop ID3v2 frame TXXX: Claude"]
    assert images.strip(png((b"tEXt", b"Comment\0a"), (b"tEXt", b"Comment\0AIGC")), everything=False)[0] == png((b"tEXt", b"Comment\0a"))
    kept = tiff([(270, b"a caption"), (305, b"OpenAI tool")])
    out, actions = images.strip(kept, everything=False)
    assert actions == ["drop TIFF tag 305 (Software)"] and b"a caption" in out and b"OpenAI" not in out and images.inspect(out)["findings"] == ["TIFF tag 270 (ImageDescription) present"]
    assert images.strip(jpeg((0xE1, b"Exif")), everything=False)[0] == jpeg((0xE1, b"Exif"))


def test_tiff_pixels_stay_and_damage_is_no_tiff():
    data = tiff([(306, b"2026:01:01 00:00:00\0"), (700, b"x" * 30)])
    out, _ = images.strip(data)
    assert out[8:10] == b"\7\7" and b"2026" not in out and len(out) == len(data)
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 34665, 4, 1, 8) + struct.pack("<I", 8)
    assert images.inspect(loop)["findings"] == ["TIFF sub-IFD 34665 (ExifIFD) present"]
    assert images.inspect(b"II*\0\xff\xff\xff\xff")["findings"] == ["not a valid TIFF"] and images.strip(b"II*\0\xff\xff\xff\xff")[1] == ["not a valid TIFF"]


def test_damage_and_foreign_bytes():
    cut = png((b"caBX", b"x"), (b"tEXt", b"a\0b"))[:70]
    got = images.inspect(cut)
    assert got["has_c2pa"] and got["findings"][-1].startswith("truncated chunk")
    assert "kept" in images.strip(cut)[1][-1]
    for data in (b"", b"\xff\xd8", b"\xff\xd8\xff", b"RIFF\0\0\0\0WEBP", b"text", images.PNG_START, b"GIF89a", b"BM", b"ID3", b"ID3\3\0\0\0\0\0\x7f", b"II*\0", b"\0\0\0\x0cftyp", b"\0\0\0\0ftypavif"):
        assert not images.inspect(data)["has_ai"] and images.strip(data)[0] == data
    for fmt in specimens.MEDIA:
        for mark in range(3):
            whole = media(fmt, mark)
            for k in range(len(whole)):
                images.inspect(whole[:k])
                images.strip(whole[:k])


def test_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(media("png", 2))), (2, None)], "k int, content binary").select("k", images.report("content").alias("r"), images.cleaned("content").alias("s")).orderBy("k").collect()
    assert rows[0]["r"]["has_c2pa"] and rows[0]["s"]["actions"] == ["drop chunk caBX"] and rows[1]["r"] is None and rows[1]["s"] is None


@pytest.mark.parametrize("head, kind", [(b"a\0\0", b"zTXt"), (b"a\0\1\0\0\0", b"iTXt")])
def test_text_beyond_the_cap_is_reported(head, kind):
    full = b" " * images.MAX_TEXT_BYTES
    got = images.inspect(png((kind, head + zlib.compress(full + b"Midjourney"))))
    assert got["findings"] == [f"PNG {kind.decode()}: not fully inspected (decompressed text exceeds cap)"] and not got["has_ai"]
    assert images.inspect(png((kind, head + zlib.compress(full))))["findings"] == []
    assert chunk(b"IEND", b"") in images.strip(png((kind, head + zlib.compress(full + b" "))))[0]
