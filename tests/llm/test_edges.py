"""Sessions with several benchmarks, repeated ids, odd pages, and how archives are dealt to tasks."""

import gzip
import io
import random
import time

import pytest

from glyphsieve.llm import common, decontam, html_extract, html_samples, language_id, queries, warc
from tests.conftest import SF

CLASH = "page_id long, url string, html string, text string, n_chars int"


@pytest.mark.parametrize(("held", "at_once"), [(8, 64 << 20), (1, 300)])
def test_ten_benchmarks_in_one_session(spark, monkeypatch, held, at_once):
    monkeypatch.setattr(decontam, "HELD", held)
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["a", "b", "cé", "d9"]) for _ in range(n))
    items = [(k, words(rng.randrange(2, 14)) + f" own{k // 3}") for k in range(30)]
    docs = [(k, words(30) + " " + t + " " + words(5)) for k, t in items] + [(99, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for k in range(10):
        some = items[3 * k : 3 * k + 3]
        got = decontam.scan(frame, spark.createDataFrame(some, "item_id long, text string"), block_bytes=40, at_once=at_once).select("doc_id", "__gs_scan.n_words", "__gs_scan.n_hit", "__gs_scan.items").collect()
        want = decontam.brute_force(docs, some)
        assert sorted((r[0], r[1], r[2], len(r[3])) for r in got) == [w[:4] for w in want]
        out = decontam.report(frame, spark.createDataFrame(some, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, out.collect())) == want


def test_wu_manber_with_colliding_blocks():
    rng = random.Random(2)
    for _ in range(40):
        patterns = [bytes(rng.choices(b"ab ", k=rng.randrange(3, 12))) for _ in range(rng.randrange(1, 9))]
        text = bytes(rng.choices(b"ab ", k=200))
        found = decontam.WuManber(patterns)
        found.mask, found.shift = 0, bytearray([0])  # every block in one place
        for table in (decontam.WuManber(patterns), found):
            assert sorted(table.find(text)) == sorted((k, p) for p in set(patterns) for k in range(len(text)) if text.startswith(p, k))


def test_no_language_is_lost_where_ids_repeat(spark):
    rows = [(6, f"the quick text number {k} in english words", "en") for k in range(2000)] + [(6, "the same text again and again", "it")] * 300 + [(k, f"le texte {k} est en français avec des mots", "fr") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, langs = language_id.fit(docs.selectExpr("doc_id AS id", "text", "lang"), docs_per_lang=16, steps=1)
    assert langs == ["en", "fr", "it"]


def test_language_id_of_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "das ist ein Text", "de", 1, 0.5), (1, "das ist ein Text", "de", 2, 0.5), (2, None, None, 3, 0.5)], "doc_id long, text string, lang string, lang_pred int, score double")
    got = language_id.report(docs).collect()
    assert len(got) == 3 and got[0]["lang_pred"] == got[1]["lang_pred"]
    assert language_id.keep_identified(docs).columns == docs.columns


def test_html_extraction_through_spark(spark):
    page = "<body><nav><a href=x>Home</a></nav><article><p>A paragraph of text that says something, and more of it.</p></article></body>"
    df = spark.createDataFrame([(1, "u", page, "old", 5), (1, "u", page, "old", 5), (2, None, None, "x", 0), (3, "v", "", "x", 0), (None, "v", "<p>", None, None)], CLASH)
    want = "A paragraph of text that says something, and more of it."
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.report(df).collect()), key=repr) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (None, "", 0)], key=repr)
    assert html_extract.extract(df).columns == [*df.columns, "__gs_text"] and html_extract.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["<a " * 300_000, "<b>" * 150_000 + "</i>" * 150_000, "<b><ul>" + "<i>" * 120_000 + "</b>" * 120_000, "<div class='ad'>" * 60_000 + "x", "<b>" * 100_000 + "<p>x" * 100_000, "<a x='" * 150_000, '<a href="' * 100_000, "<!--" * 200_000, "<" * 1_000_000, "</" * 300_000, "<script>" * 100_000, "<p>" + "<li>" * 100_000, "<x>a</y>" * 100_000])
def test_long_odd_pages_take_linear_time(odd):
    began = time.process_time()
    html_extract.main_text(odd)
    assert time.process_time() - began < 20  # a second or so alone; hours if it were quadratic


def test_nothing_but_the_named_kinds_is_dropped():
    text = "The value <math><mi>x</mi></math> is the one that <svg><text>a drawing</text></svg> shows, and &am<b></b>p; stays."
    page = f"<article><p>{text}</p><p>A second one that is here so that there is text <object>or its stand-in</object> around.</p></article>"
    assert html_extract.main_text(page) == "The value x is the one that a drawing shows, and &amp; stays." + "\nA second one that is here so that there is text or its stand-in around."
    assert html_extract.main_text('<main><div class="header"><h1>A title of some words</h1></div><p>The text of the page, which goes on for a while.</p></main>').startswith("A title of some words\n")


def test_html_extraction_on_made_pages():
    hit = extra = missed = 0
    for page, text in html_samples.pages(200, seed=99):
        got, want = set(html_extract.main_text(page).split("\n")), set(text)
        hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
    assert hit / (hit + extra) >= 0.95 and hit / (hit + missed) >= 0.95


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    pages = spark.createDataFrame([(k, f"http://h/{k}", "".join(rng.choices("abcdefgh<>", k=2000))) for k in range(400)] + [(7, "again", "same"), (7, "again", "same"), (8, None, "same")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path, range_bytes=16 << 10)
    tasks = read.selectExpr("spark_partition_id() AS t", "record_id").collect()
    assert len(tasks) == 403 and len({r["t"] for r in tasks}) > 10
    assert sum(r["record_type"] == "response" for r in read.where("payload_bytes = 4").collect()) == 2


def test_heads_are_checked_whole():
    good = b"WARC/1.0\r\nWARC-Type: response\r\nX-Folded: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = [good.replace(b"WARC/1.0", b"WARC/2.0"), good.replace(b"WARC-Type: ", b"WARC Type: "), good.replace(b"Content-Length: 3", b"Content-Length: x"), good.replace(b"Content-Length: 3", b"Content-Length: 99"), good[:20], b"WARC/1.0\r\n" + b"A: b\r\n" * 20_000]
    blob = b"".join(gzip.compress(x) for x in (bad[0], good, *bad[1:], good))
    found = list(warc.members_in(io.BytesIO(blob), 0, len(blob)))
    assert [(f["x-folded"], body) for _, f, body in found] == [("a b", b"abc")] * 2


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Sc:
                        @staticmethod
                        def getCheckpointDir():
                            return type("None_", (), {"isDefined": staticmethod(lambda: False)})

                    return Sc

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_scratch_tables_go(spark):
    import os

    with common.scratch(spark):
        held = common.written(spark.range(3), "scratch")
        path = held.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert held.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_queries_on_a_scale_after_another(spark):
    """A benchmark of another folder in the same session."""
    first = queries.op9_decontamination(spark, SF).agg({"n_hit": "sum"}).first()[0]
    queries.op9_decontamination(spark, "/root/testdata/sf0.01").agg({"n_hit": "sum"}).first()
    assert queries.op9_decontamination(spark, SF).agg({"n_hit": "sum"}).first()[0] == first


def test_merge_index_in_batches(spark):
    import hashlib

    from pyspark.sql import functions as F

    from glyphsieve.llm.exact_dedup import Index

    index = Index(spark, 400, "smallest", memtable_rows=8, fanout=3)
    rows = spark.range(600).select(F.unhex(F.sha2((F.col("id") % 150).cast("string").cast("binary"), 256)).alias("digest"), "id")
    for k in range(5):
        index.flush(rows.where(f"id % 5 = {k}"), 120)
    assert [len(level) for level in index.levels] == [2, 1]
    want = sorted((hashlib.sha256(str(d).encode()).digest(), d, 4) for d in range(150))
    assert sorted((bytes(r["digest"]), r["survivor"], r["n"]) for r in index.entries().collect()) == want
    plan = index._merged(0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert [r["survivor"] for r in index.lookup([want[3][0]]).collect()] == [want[3][1]]
    index.close()


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, None, "w"), (2, "", "en", "a", 0, "w"), (3, "some words here", "en", "a", 15, "w"), (3, "some words here", "en", "a", 15, "w"), (None, "autres mots", "fr", None, 11, "w"), (4, "é " * 40_000, "fr", "b", 80_000, "w"), (5, "123 !", "en", "b", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = {"language_id": 4, "line_dedup": 7, "decontamination": 7}
    for name, n in kept.items():
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == n, name
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    assert len(mixed) == 7 and all(r["taken"] <= 2 * r["size"] for r in mixed) and stages["mixing"](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_of_odd_labels(spark):
    from glyphsieve.llm import quality

    docs = spark.createDataFrame([(k, ("good words in a row. " if k % 2 else "$$ 12 !! ") * 5, 0.1) for k in range(80)] + [(90, None, 0.1), (91, "", 0.1), (None, "words", 0.1), (1, "good words again", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(80)] + [(k, k % 2, 1) for k in range(80)] + [(3, None, None), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.report(docs, labels).collect()
    assert len(got) == 84 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    good, bad = ([r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 2 == k] for k in (1, 0))
    assert sum(good) / len(good) > sum(bad) / len(bad)
