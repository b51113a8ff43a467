import random

import pytest

from glyphsieve.operators import evaluation, scan, strategies
from glyphsieve.plans import specimens


def test_specifications():
    assert strategies.variants("paraphrase:3, chunk:1") == [("paraphrase", 3), ("chunk", 1)]
    assert strategies.strategy("humanize@0.9,chunk@0.6,humanize@0.4") == [("humanize", 0.9), ("chunk", 0.6), ("humanize", 0.4)]
    assert strategies.canonical(strategies.strategy("humanize@0.9,chunk@0.6,humanize@0.4")) == (("chunk", 0.6), ("humanize", 0.4))
    assert strategies.slug((("chunk", 0.6), ("humanize", 1.0))) == "chunk@0.6+humanize@1" and strategies.escalated([("chunk", 0.95)], 0.1) == [("chunk", 1.0)]
    assert strategies.weights("0.5/0.3/0.2,1/0/0") == [(0.5, 0.3, 0.2), (1.0, 0.0, 0.0)]
    for bad in ("", "chunk", "chunk@0", "chunk@2", "other@0.5", "humanize@0.5", "chunk@x"):
        with pytest.raises(ValueError):
            strategies.strategy(bad)
    for bad in ("a", "a:0", "a:b", "a:1:2"):
        with pytest.raises(ValueError):
            strategies.variants(bad)
    for bad in ("1/2", "0.5/0.5/0.5", "a/b/c"):
        with pytest.raises(ValueError):
            strategies.weights(bad)


def test_search_measures_each_strategy_once_and_finds_the_best_pair():
    asked = []

    def measure(wanted):
        asked.extend(wanted)
        gain = {"chunk": 0.3, "paraphrase": 0.4, "humanize": 0.0}
        return {s: {"robust_clear_rate": min(1.0, sum(gain[t] * x for t, x in s)), "sem_div": 0.1 * len(s), "human_like": 0.9 if s[-1][0] == "humanize" else 0.4} for s in wanted}

    known = strategies.search(measure, ["chunk", "paraphrase", "humanize"], [0.5, 1.0], [(0.5, 0.3, 0.2)], depth=3, beam=2, levels=1)
    assert len(asked) == len(set(asked)) == len(known) and all(s == strategies.canonical(s) for s in known)
    best = max(known, key=lambda s: strategies.score(known[s], (0.5, 0.3, 0.2)))
    assert best in {(("chunk", 1.0), ("paraphrase", 1.0), ("humanize", 0.5)), (("paraphrase", 1.0), ("chunk", 1.0), ("humanize", 0.5)), (("paraphrase", 1.0), ("humanize", 0.5)), (("paraphrase", 1.0), ("chunk", 1.0), ("humanize", 1.0)), (("chunk", 1.0), ("paraphrase", 1.0), ("humanize", 1.0))}
    frontier = list(known.items())
    assert strategies.recommended(frontier, (0.5, 0.3, 0.2), 0.6, lambda s: {"robust_clear_rate": 0.0})[-1][0] == "humanize"
    assert strategies.recommended(frontier, (0.5, 0.3, 0.2), 1.1, lambda s: {}) is None
    assert strategies.search(lambda s: {}, ["chunk"], [0.5], [(1, 0, 0)]) == {}


def test_scan_of_one_file():
    assert scan.scan("a.png", specimens.media("png", 1))["has_ai"] and scan.scan("a", specimens.zipped("epub", 2))["format"] == "epub"
    assert scan.scan("a.md", b"---\nai: yes\n---\n")["findings"] == ["frontmatter: ai=yes"] and scan.scan("x.png", b"text")["findings"] == ["format not recognized"]
    assert scan.scan("a.txt", b"a\0b")["error"] == "looks like nul bytes, not text" and scan.scan("a.bin", b"\x7fELF\0")["kind"] == "unknown"
    assert scan.scan("a", "a​b".encode())["suspicious_total"] == 1 and scan.scan("a.txt", b"a\xffb")["suspicious_total"] == 0


def test_batches_spans_and_functions(spark):
    import base64

    rows = [("a.png", base64.b64encode(specimens.media("png", 2)).decode()), ("b.txt", "%%%"), ("c.txt", None)]
    got = {r["name"]: r for r in scan.payloads(spark.createDataFrame(rows, "name string, data_base64 string")).collect()}
    assert got["a.png"]["has_c2pa"] and got["b.txt"]["error"].startswith("not base64") and got["c.txt"]["kind"] == "text"
    with pytest.raises(ValueError):
        scan.payloads(spark.createDataFrame(rows, "name string, data_base64 string"), limit=2)
    text = spark.createDataFrame([(1, "we delve into​ it"), (2, None), (3, "")], "k int, t string")
    spans = {r["k"]: r["s"] for r in text.select("k", scan.flagged_spans("t").alias("s")).collect()}
    assert [tuple(s) for s in spans[1]] == [(3, 13, "phrase", "delve into"), (13, 14, "zwj_family", "U+200B ZERO WIDTH SPACE (Cf)")] and spans[2] is None and spans[3] == []
    scan.register(spark)
    text.createOrReplaceTempView("t_texts")
    assert [tuple(r) for r in spark.sql("SELECT k, s.phrase FROM t_texts, LATERAL ai_phrase_spans(t) s").collect()] == [(1, "delve into")]
    spark.createDataFrame([(1, bytearray(specimens.zipped("docx", 0))), (2, bytearray(b"no"))], "k int, c binary").createOrReplaceTempView("t_zips")
    assert sorted(r["member"] for r in spark.sql("SELECT z.member FROM t_zips, LATERAL unzip_members(c) z").collect()) == ["[Content_Types].xml", "docProps/core.xml", "word/document.xml"]
    items, skipped = scan.items(spark.createDataFrame([("a.txt", bytearray(b"In conclusion, we delve into it. " * 20)), ("b.txt", bytearray(b"\0"))], "path string, content binary"), check_stylometry=True)
    assert items.first()["findings"][0].startswith("stylometry") and skipped.first()["path"] == "b.txt"
    assert scan.sarif([{"path": "a", "rule_id": "AI-WATERMARK-C2PA", "level": "error", "message": "m", "confidence": "confirmed"}])["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"] == {"uri": "a", "uriBaseId": "SRCROOT"}


def test_running_sums_medians_and_ranks_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), round(rng.random() ** 4 * 50, 2), rng.random() < 0.5) for _ in range(600)] + [("c", 1.0, True), ("c", 1.0, False), ("d", 3.0, True)]
    df = spark.createDataFrame(rows, "g string, v double, p boolean")
    want = {}
    for g in {r[0] for r in rows}:
        pos, neg = [v for x, v, p in rows if x == g and p], [v for x, v, p in rows if x == g and not p]
        want[g] = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert {r["g"]: r["auroc"] for r in evaluation.auroc(df, "g", "v", "p").collect()} == {g: pytest.approx(x) if x is not None else None for g, x in want.items()}
    middle = {g: sorted(v for x, v, _ in rows if x == g) for g in want}
    assert {r["g"]: r["m"] for r in evaluation.upper_median(df, "g", "v", "m").collect()} == {g: v[len(v) // 2] for g, v in middle.items()}
    names = sorted({f"doc{rng.randrange(10**k)}" for k in range(1, 5) for _ in range(60)} | {"", "d", "é", "doc"})
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    for k in (1, 2, 17, len(names)):
        assert evaluation.nth_smallest(frame, "name", k) == sorted(names, key=lambda s: s.encode())[k - 1]
    points = [(str(k), rng.randrange(12) / 4, rng.randrange(12) / 4) for k in range(300)]
    best = sorted(n for n, a, b in points if not any(x >= a and y <= b and (x > a or y < b) for _, x, y in points))
    assert sorted(r["name"] for r in evaluation.pareto_frontier(spark.createDataFrame(points, "name string, up double, down double").repartition(5), "name", ["up"], ["down"]).collect()) == best
