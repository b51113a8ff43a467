"""Queries that SQL can't express against slow versions of themselves, on the small tables."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np

from glyphsieve.llm import html_extract, language_id, mixing, quality, queries
from tests.conftest import SF


def test_mixing_word_by_word(spark):
    rng = random.Random(12)
    rows = [(k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 7, 60, 400]))), [None, "a", "b"][k % 3]) for k in range(120)] + [(5, "x y", "a"), (5, "x y", "a")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=32, docs_per_bucket=8, slots_per_shard=4)
    owner = {}
    for d in mix.documents.collect():
        for w in range(d["offset"], d["offset"] + d["size"]):
            assert (d["s"], w) not in owner  # no two documents hold one place
            owner[d["s"], w] = (d["id"], d["size"], d["offset"], d["s"])
    slots = mix.slots.collect()
    assert len({r["shard"] for r in slots}) > 1
    taken = Counter(owner[r["s"], r["block"] * 32 + k] for r in slots for k in range(r["words"]))
    want = Counter((i, size, n) for (i, size, _, _), n in taken.items())
    got = Counter((r["id"], r["size"], r["taken"]) for r in mix.taken().collect() if r["taken"])
    assert got == want
    for x in mix.sources:
        assert sum(n for (*_, s), n in taken.items() if s == x["s"]) == x["words"]


def test_quality_rule_by_rule(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    base, rules = quality.learn(docs, labels.where(quality._fold(5) != 0))
    made = {r["doc_id"]: list(r["__gs_f"]) for r in quality.with_features(docs.select("doc_id", "text")).select("doc_id", "__gs_f").collect()}
    for r in queries.op10_quality(spark, SF).collect():
        x = np.array([made[r["doc_id"]]], float)
        total = base + sum(w for w, rule in rules if quality.holds(rule, x)[0])
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_language_position_by_position(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = language_id._bucket("doc_id", 4)
    model, langs = language_id.fit(docs.where(fold != 2).selectExpr("doc_id AS id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op7_language_id(spark, SF).collect()}
    for r in docs.orderBy("n_chars").limit(60).collect():
        raw = (r["text"] or "").encode()
        total = np.zeros(len(langs))
        for at in range(0, len(raw), language_id.CHUNK):
            x = np.frombuffer(raw[at : at + language_id.CHUNK], np.uint8)[:, None]
            total += language_id.probabilities(model, x, None)[0][:, 0].sum(axis=0)
        if language_id.has_letter(raw):
            assert got[r["doc_id"]][0] == langs[int(total.argmax())] and abs(got[r["doc_id"]][1] - total.max() / len(raw)) < 1e-3
        else:
            assert got[r["doc_id"]] == ("und", 0.0)


def test_main_text_is_the_cheapest_labelling(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got, tried = {r["page_id"]: r["text"] for r in queries.op6_html_extraction(spark, SF).collect()}, 0
    for page, html in pages.items():
        blocks = html_extract.blocks_of(html or "")
        if not 0 < len(blocks) <= 12:
            continue
        tried += 1
        odds = np.clip(html_extract.features(blocks) @ html_extract.weights(), -html_extract.MOST, html_extract.MOST)
        edges = html_extract.edges_of(blocks)
        cost = {on: sum(-o * x for o, x in zip(odds, on, strict=True)) + sum(w for (i, j), w in edges.items() if on[i] != on[j]) for on in product((0, 1), repeat=len(blocks))}
        least = min(cost.values())
        assert got[page] in {"\n".join(b.text for b, x in zip(blocks, on, strict=True) if x) for on, c in cost.items() if c < least + 1e-9}
    assert tried > 5
