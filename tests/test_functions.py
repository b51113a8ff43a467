import math
import random

from pyspark.sql import functions as F

from glyphsieve.functions import codepoints, compare, findings, stylometry, tokens
from glyphsieve.operators import detect, evaluation
from glyphsieve.sources import files
from glyphsieve.streaming import monitor


def one(spark, value, f):
    kind = "array<string>" if isinstance(value, list) else "string"
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_words_and_sentences(spark):
    assert one(spark, "It’s rock'n'roll-ing, a--b -x x- ½ ---", tokens.words) == ["it", "s", "rock'n'roll-ing", "a--b", "x", "x", "½"]
    assert one(spark, "One two. Three!\n```\ncode\n```\nFour", tokens.sentences) == ["One two.", "Three!", "Four"]
    assert one(spark, "", tokens.words) == []
    units = one(spark, "A. B\n\nC", tokens.units)
    assert "".join(u["unit"] + u["separator"] for u in units) == "A. B\n\nC"


def test_sentences_and_lines_lose_spaces_only(spark):
    assert one(spark, "0 a.  19.37.233.111\n  22 b2", tokens.sentences) == ["0 a.", "19.37.233.111", "22 b2"]
    assert [int(x) for x in one(spark, "00\n11\n 22 \n0x33", tokens.load_token_ids)] == [0, 11, 22, 0x33]


def test_token_ids(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big")
    assert [int(x) for x in one(spark, "ABC!", tokens.simple_token_ids)] == [want]
    assert [int(x) for x in one(spark, "[1, 18446744073709551615]", tokens.load_token_ids)] == [1, 2**64 - 1]
    assert one(spark, "-1", tokens.load_token_ids) is None


def test_cleaning_keeps_signs_that_bear_meaning():
    kept = ["👩‍👩‍👧", "❤️", "می‌خواهم", "\U0001f3f4\U000e0067\U000e0062\U000e007f"]
    for text in kept:
        assert codepoints.clean(text)[0] == text, text
    assert codepoints.clean("a​b c­")[0] == "ab c"
    assert codepoints.clean("a‮b‬")[0] == "ab" and codepoints.clean("a‪b‬")[0] == "a‪b‬"
    assert codepoints.inspect("a‎") and codepoints.clean("a‎")[0] == "a‎"


def test_cleaning_twice_changes_nothing_more():
    rng = random.Random(5)
    signs = "ab я中👩❤​‌‍️‮‬­ "
    for _ in range(300):
        done = codepoints.clean("".join(rng.choice(signs) for _ in range(12)))[0]
        assert codepoints.clean(done)[0] == done


def test_native_and_full_cleaning_agree_among_latin_letters(spark):
    text = "a​b c­d⁠e"
    assert one(spark, text, codepoints.native_clean) == codepoints.clean(text)[0]


def test_anchors_are_in_every_match():
    import re

    for label, _, pattern in stylometry.PHRASES:
        assert stylometry.anchors(pattern.removeprefix("(?i)").replace(r"\p{L}\p{N}_", r"\w")) != [""], label
    assert stylometry.anchors(r"\bnestled\b") == ["nestled"] and re.search("a", "a")


def test_stylometry_of_short_and_empty_texts(spark):
    rows = stylometry.with_stylometry(spark.createDataFrame([(1, None), (2, ""), (3, "few words"), (4, "As an AI, I delve into it. " * 20)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["score"] is None for r in rows] == [True, True, True, False] and rows[3]["tier"] == "high"


def test_mattr(spark):
    words = [str(k % 60) for k in range(200)]
    want = sum(len(set(words[k : k + 50])) / 50 for k in range(151)) / 151
    assert math.isclose(one(spark, words, stylometry.mattr), want)


def test_confidence(spark):
    for text, level in {"layer-a: x2 (space)": "informational", "JPEG APP11 segment": "confirmed", "info: cms generator: x": "informational", "meta: x": "probable", "byte-scan ai:": "likely_false_positive", "x": "informational"}.items():
        assert one(spark, text, findings.confidence) == level


def test_humanize(spark):
    assert one(spark, "“In order to” win — we Utilize it, 2019–2020", compare.humanize) == '"To" win, we Use it, 2019–2020'


def test_gumbel_tail_and_detection():
    assert math.isclose(detect.gamma_tail(1, 2.0), math.exp(-2)) and detect.gamma_tail(0, 1) == 1.0
    rng, key, ids = random.Random(1), b"k", [1, 2, 3]
    for _ in range(150):  # of eight tokens the one with the highest number is taken
        options = [rng.getrandbits(63) for _ in range(8)]
        ids.append(max(options, key=lambda x: detect.statistic([*ids[-3:], x], key)["statistic"]))
    assert detect.statistic(ids, key)["is_watermarked"] and not detect.statistic(ids, b"other")["is_watermarked"]


def test_frontier_and_auroc(spark):
    c = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.5, 0.5), ("c", 0.4, 0.6), ("d", None, 0.0), ("e", 1.0, 0.0)], "name string, up double, down double").repartition(4)
    assert sorted(r["name"] for r in evaluation.pareto_frontier(c, "name", ["up"], ["down"]).collect()) == ["a", "e"]
    rows = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, True), ("g", 1.0, False), ("g", 0.0, False), ("h", 1.0, True)], "g string, s double, p boolean")
    assert {r["g"]: r["auroc"] for r in evaluation.auroc(rows, "g", "s", "p").collect()} == {"g": 0.875, "h": None}


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in/node_modules").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("a​b")
    (tmp_path / "in/b.bin").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "in/node_modules/c.txt").write_text("no")
    read, skipped = files.walk(spark, str(tmp_path / "in"), max_bytes=5)
    assert [r["path"].rsplit("/", 1)[1] for r in read.collect()] == ["a.txt"] and skipped.count() == 1
    monitor.run_once(monitor.landing(spark, str(tmp_path / "in/*.*")), str(tmp_path / "out"), str(tmp_path / "state"))
    items = spark.read.parquet(str(tmp_path / "out")).collect()
    found = {r["path"].rsplit("/", 1)[1]: r for r in items}
    assert sorted(found) == ["a.txt", "b.bin"] and found["a.txt"]["actionable"] and found["a.txt"]["suspicious_total"] == 1
    assert found["b.bin"]["kind"] == "unknown" and found["b.bin"]["findings"] == [] and not found["b.bin"]["actionable"]


def test_walk_goes_through_carriers_only():
    text = "plain é words " * 1000 + "a​b " + "c" * 1000 + "‪d‬"
    assert [(at, out, why) for at, _, out, why in codepoints.walk(text, strip_bidi=True)] == [(14001, "", "zwj_family"), (14003, " ", "space"), (15004, "", "bidi"), (15006, "", "bidi")]
    assert [why for *_, why in codepoints.walk(text)] == ["zwj_family", "space", None, None]
    assert codepoints.clean(text)[0] == text.replace("​", "").replace(" ", " ")


def test_inspect_judges_carriers_only(monkeypatch):
    seen, test = [], codepoints._KEPT_BIDI
    monkeypatch.setattr(codepoints, "_KEPT_BIDI", lambda cp: seen.append(cp) or test(cp))
    codepoints.inspect("plain é words " * 1000 + "a\u200bb\u202ec")
    assert set(seen) <= {0x200B, 0x202E} and len(seen) <= 2


def test_clean_judges_carriers_only(monkeypatch):
    seen, test = [], codepoints._KEPT_BIDI
    monkeypatch.setattr(codepoints, "_KEPT_BIDI", lambda cp: seen.append(cp) or test(cp))
    codepoints.clean("plain é words " * 1000 + "a\u200bb\u202ec")
    assert set(seen) <= {0x200B, 0x202E} and len(seen) <= 2


def test_token_counters_are_those_of_the_ids(spark):
    rng = random.Random(6)
    lists = [[rng.choice("abcde") for _ in range(rng.randrange(30))] for _ in range(80)] + [None, [], ["a"] * 3, ["a"] * 9]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, t array<string>").repartition(3)
    ids = rows.select("k", detect.counters(F.transform("t", tokens.token_id)).alias("c"), detect.token_counters(F.col("t")).alias("d"), detect.keyed("k")(F.transform("t", tokens.token_id)).alias("x"), detect.keyed_tokens("k")("t").alias("y"))
    got = ids.collect()
    assert len(got) == 84 and all(r.x == r.y and (r.c == r.d or lists[r.k] is None and r.d is None) for r in got)


def test_tokens_are_counted_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    seen, counted = [], detect._counted
    monkeypatch.setattr(detect, "TOKENS", 50)
    monkeypatch.setattr(detect, "_counted", lambda x, n: seen.append(len(x.flatten())) or counted(x, n))
    lists = [[str(k % 7)] * (k % 13) for k in range(100)]
    got = detect.token_counts(pa.array(lists, pa.list_(pa.string())), 4)
    assert max(seen) <= 62 and got.field("tokens_total").to_pylist() == [len(x) for x in lists]


def test_keyed_detection_hashes_a_token_once(monkeypatch):
    import pyarrow as pa

    hashed, sha = [], detect.hashlib.sha256
    monkeypatch.setattr(detect.hashlib, "sha256", lambda x: hashed.append(x) or sha(x))
    codes, ids = detect._ids(pa.array([["ab", "cd", "ab"], None, ["cd"]]))
    assert codes.tolist() == [0, 1, 0, 1] and len(ids) == 2 and sorted(hashed) == [b"ab", b"cd"]


def test_swaps_look_for_the_phrase_before_the_expression(spark):
    rows = spark.createDataFrame([("In order to Utilize it, IN ORDER TO utilized; reutilize",), ("plain",), (None,)], "x string").select(compare.swap_phrases(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == ["To Use it, TO used; reutilize", "plain", None]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 48 == plan.lower().count("contains(")


def test_keyed_statistic_is_by_hmac():
    import hmac

    rng = random.Random(7)
    ids = [rng.randrange(2**64) for _ in range(40)] * 2
    for key in (b"k", b"x" * 64, b"y" * 65, b"z" * 200):
        total, seen = 0.0, set()
        for k in range(3, len(ids)):
            span = b"".join(i.to_bytes(8, "big") for i in ids[k - 3 : k + 1])
            if span not in seen:
                seen.add(span)
                total -= math.log1p(-(int.from_bytes(hmac.digest(hmac.digest(key, span[:-8], "sha256"), span[-8:], "sha256")[:8], "big") + 0.5) / 2**64)
        got = detect.statistic(ids, key)
        assert (got["statistic"], got["counted"], got["skipped_repeated"]) == (total, len(seen), 77 - len(seen))
