"""The operators of the training-data pipeline against SQL, brute force, round trips and held-out accuracy; and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from glyphsieve.llm import decontam, exact_dedup, html_extract, language_id, line_dedup, mixing, near_copies, quality, queries, simhash, suffix_dedup, warc
from tests.conftest import SF, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "This line is long enough to count as one of the common lines."
ODD = [(1, None), (2, ""), (3, "\n"), (4, "é" * 50_000), (5, LONG), (6, LONG), (7, LONG.upper() + "  \n" + LONG), (8, LONG), (9, LONG), (9, LONG), (None, LONG), (10, "x")]


def table(spark, rows):
    """With other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "w", 0) for r in rows], "doc_id long, text string, id string, k1 int")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert same(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("sizes", [{}, {"keys_per_shard": 1, "probes_per_slice": 1}])
def test_line_dedup(spark, sizes):
    out = line_dedup.dedup_lines(table(spark, ODD), **sizes)
    got = [(r["doc_id"], r["__gs_n_lines"], r["__gs_n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(line_dedup.brute_force(ODD), key=repr)
    assert line_dedup.dedup_lines(table(spark, []), **sizes).count() == 0


def test_perfect_hash_with_equal_keys():
    keys = np.array([5, 5, 7, 9, 5], np.uint64)
    mph, slots = line_dedup.PerfectHash.build(keys)
    assert sorted(slots) == [0, 1, 2, 3, 4]
    again = line_dedup.PerfectHash.load(*mph.dump())
    assert (again.find(np.array([7, 9], np.uint64)) == slots[2:4]).all()


def test_warc_round_trip_in_small_ranges(spark):
    rng = random.Random(1)
    pages = [(k, f"http://h/{k} é", "".join(rng.choice("ab\x1f\x8b\x08é") for _ in range(rng.randrange(3000)))) for k in range(60)]
    pages += [(100, None, None), (101, "u", ""), (102, "u", pages[0][2]), (103, "u", "x" * (1 << 20))]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    first: dict[str, int] = {}
    for k, _, html in sorted(pages):
        first.setdefault(html or "", k)
    want = sorted((k, len((h or "").encode()), warc.digest((h or "").encode()), "response" if first[h or ""] == k else "revisit", None if first[h or ""] == k else first[h or ""]) for k, _, h in pages)
    for size in (701, 1 << 22):
        assert sorted(map(tuple, warc.round_trip(df, range_bytes=size).collect())) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(400))), None, [None, "a", "b", "c"][rng.randrange(4)], 0) for k in range(300)] + [(None, None, None, "a", 0), (5000, "x " * 30_000, None, "a", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for block in (16, 2048):
        mix = mixing.Mix(df, block_words=block, docs_per_bucket=8, slots_per_shard=64)
        got = mix.taken().collect()
        assert len(got) == len(rows)
        for x in mix.sources:
            assert sum(r["taken"] for r in got if r["target"] == x["target"] and r["source_size"] == x["source_size"]) == x["words"]
        assert all(r["taken"] <= 2 * r["size"] for r in got)
        assert rows_of(mixing.Mix(df, block_words=block, docs_per_bucket=8, slots_per_shard=64).taken()) == sorted(map(tuple, got), key=repr)
        assert mix.spans().agg({"n": "sum"}).first()[0] == sum(r["taken"] for r in got)
    assert mixing.report(df.limit(0)).count() == 0


def test_targets_stop_at_two_epochs():
    assert mixing.targets([10, 100, 100]) == [20.0, pytest.approx(295 / 3), pytest.approx(590 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0.0, pytest.approx(7.5)]


def test_permutation():
    for n in (1, 2, 3, 100, 1000):
        f = mixing.Feistel(n, (1, 2))
        assert sorted(f.forward(np.arange(n))) == list(range(n)) and (f.backward(f.forward(np.arange(n))) == np.arange(n)).all()


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    rows = [*ODD, *((k, str(k % 90)) for k in range(1000, 1400))]
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert rows_of(exact_dedup.exact_groups(table(spark, rows), digest_bytes=digest_bytes)) == want
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [65_536, 3])
def test_suffix_dedup(spark, limit):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij ") for _ in range(900))
    rows = [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 450), (None, base), (104, base), (104, base), (105, base[:199]), (106, base[:200])]
    for i in range(40):
        t = list(base[rng.randrange(300) : rng.randrange(500, 900)])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xyzé")
        rows.append((i, "".join(t) + "".join(rng.choice("abc") for _ in range(rng.randrange(50)))))
    out = suffix_dedup.remove_repeats(table(spark, rows), group_limit=limit)
    got = out.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long)", "sha2(kept, 256)")
    assert rows_of(got) == sorted(suffix_dedup.brute_force(rows), key=repr)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_suffix_dedup_of_a_text_longer_than_a_piece(spark):
    rng = random.Random(4)
    raw = rng.randbytes(suffix_dedup.AT_ONCE + 5000).hex()[: suffix_dedup.AT_ONCE + 5000]
    rows = [(1, raw), (2, raw[suffix_dedup.AT_ONCE - 300 : suffix_dedup.AT_ONCE + 300])]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 600, 2: 600}


def test_html_extraction():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div>
      <article><h1>The  title</h1><p>A first paragraph &amp; some words, long enough to be text.<br>Next.<p>Another one, unclosed, that is text as well.</article>
      <aside>Related things to read, all of them.</aside><section class="comments"><p>A reader says something long about this.</p></section><form><p>Name</p></form><footer>(c) me</footer><script>x("</p>")</script></body></html>"""
    assert html_extract.main_text(page) == "The title\nA first paragraph & some words, long enough to be text. Next.\nAnother one, unclosed, that is text as well."
    for odd in ("", "<", "<<<>>", "<p", "<script>", "&#xffffffff;", "<div>" * 3000, "plain text without any tag, which is a sentence.", "</p></div>"):
        html_extract.main_text(odd)
    assert not any(x in html_extract.main_text(page) for x in ("Home", "cookies", "Related", "reader", "Name", "(c)"))


@pytest.mark.parametrize("wrapper", ["<div class='has-sidebar'><article>{}</article>", "<article class='post comments-open'>{}</article>", "<div id=sidebar-left><main>{}</main></div>", "<div class='widget'>{}</div>"])
def test_html_extraction_inside_a_wrapper_named_like_chrome(wrapper):
    text = "A first paragraph and some words, long enough to be text of the page. " * 3
    page = f"<body><nav>Home</nav>{wrapper.format(f'<p>{text}</p><div class=ad><p>Buy this now, it is cheap.</p></div><div class=comments><p>A reader says something long about this.</p></div>')}<div class=sidebar><p>Other things to read here.</p></div>"
    assert html_extract.main_text(page) == text.strip()


def test_minimum_cut_against_all_labellings():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda on: sum(-o * x for o, x in zip(odds, on, strict=True)) + sum(w for (i, j), w in edges.items() if on[i] != on[j])  # noqa: B023, E731
        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert abs(cost([int(x) for x in html_extract.min_cut(odds, edges)]) - best) < 1e-9


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language_id.init(3, 4).items()}
    x, y = rng.integers(0, 256, (7, 5)), np.array([0, 1, 2, 0, 1])
    mask = language_id._mask(np.array([7, 3, 1, 7, 5]), 7).astype(np.float64)
    _, g = language_id.gradients(p, x, mask, y)
    for name in ("V", "b", "Uf", "Ub", "cf", "cb"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-4
        up = language_id.gradients(q, x, mask, y)[0]
        q[name][at] -= 2e-4
        assert (up - language_id.gradients(q, x, mask, y)[0]) / 2e-4 == pytest.approx(g[name][at], abs=2e-3)


def test_language_id_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held if docs[r["doc_id"]]["lang"]]) >= 0.9
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", None), (None, "the word", "en"), (4, "é", "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.report(odd).collect()}[2] == "und"
    assert language_id.report(odd.limit(0)).count() == 0


def test_keep_identified_drops_only_texts_without_a_letter(spark, monkeypatch):
    """With six languages and a network that knows nothing each score is a sixth."""
    langs = ["de", "en", "es", "fr", "it", "pt"]
    flat = {k: v * 0 for k, v in language_id.init(len(langs)).items()}
    monkeypatch.setattr(language_id, "fit", lambda *_: (flat, langs))
    docs = spark.createDataFrame([(1, "some words"), (2, "123 !"), (3, None), (4, "é"), (5, "")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and rows_of(kept) == [(1, "some words", "en"), (4, "é", "en")]


def test_simhash(spark):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (None, "one two three four"), (6, "one two three four")]
    for k in range(40):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)]
        rows += [(10 + 3 * k, " ".join(w)), (11 + 3 * k, " ".join([*w[:-1], "new"])), (12 + 3 * k, " ".join(w))]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    boss = list(range(len(rows)))
    for _ in rows:
        boss = [min(boss[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    want = sorted(((i, f"{f:016x}", min(x[0] for x, b in zip(rows, boss, strict=True) if b == boss[k] and x[0] is not None)) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True))), key=repr)
    for bucket, blocks in ((4096, None), (2, 5)):
        assert rows_of(simhash.near_groups(table(spark, rows), bucket=bucket, blocks=blocks)) == want
    kept = simhash.keep_firsts(table(spark, [*rows, (10, rows[7][1])])).collect()
    assert len(kept) == len({w[2] for w in want})
    assert simhash.near_groups(table(spark, [])).count() == 0


def near_brute_force(rows):
    """The ids that stay: links between all pairs of Jaccard similarity 0.8 or more over five-word shingles as tuples."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    boss = list(range(len(rows)))

    def top(k):
        while boss[k] != k:
            k = boss[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                boss[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted(least.values())


@pytest.mark.parametrize("small", [64, 2])
def test_near_copies_of_five_words_against_brute_force(spark, small):
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x " * 50), (7, "x " * 60)]
    for k in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 5, 9, 40, 200]))] + (common.split() if k % 3 == 0 else [])
        for _ in range(6):
            t = list(w)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                t[rng.randrange(len(t))] = "new"
            rows.append((100 + len(rows), " ".join(t[rng.randrange(3) :])))
    want = near_brute_force(rows)
    assert len(want) < len(simhash.keep_firsts(table(spark, rows)).collect())
    kept = near_copies.keep_firsts(table(spark, rows), small=small)
    assert kept.columns == ["doc_id", "text", "id", "k1"] and sorted(r["doc_id"] for r in kept.collect()) == want
    assert near_copies.keep_firsts(table(spark, [])).count() == 0


def test_sets_alike_are_alike_in_a_part():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 250, 256, 257, 300, 320, 1024, 1100, 1280, 5000, 17_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        for kept, new in ((len(a), len(a) // 4), (-(-4 * len(a) // 5), 0), (len(a) - len(a) // 9, len(a) // 9)):
            b = np.unique(np.concatenate([rng.permutation(a)[:kept], rng.integers(0, 1 << 64, new, np.uint64, endpoint=False)]))
            assert near_copies.alike(a, b)
            cuts = [{(k, int(p[0]) >> (64 - 2 * k)): p for k, p in near_copies.parts(s)} for s in (a, b)]
            assert any(near_copies.alike(cuts[0][key], cuts[1][key]) for key in cuts[0].keys() & cuts[1].keys())


@pytest.mark.parametrize("small", [64, 2])
def test_long_texts_that_share_a_passage_are_not_compared(spark, monkeypatch, small):
    """Sets of 1,500 shingles, 116 of them also in the next text: parts rule out all pairs but those of near copies."""
    rng = random.Random(11)
    passages = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(61)]
    rows = [(k, " ".join(passages[k] + [f"w{rng.randrange(10**6)}" for _ in range(1260)] + passages[k + 1])) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(" w1", " new w1", 3)) for k in range(10)]
    asked, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda pairs, *more: asked.append(pairs.count()) or links(pairs, *more))
    kept = near_copies.keep_firsts(table(spark, rows), small=small)
    assert sorted(r["doc_id"] for r in kept.collect()) == near_brute_force(rows) == list(range(60))
    assert sum(asked) <= 20


def test_simhash_finds_near_copies_before_the_join(spark, monkeypatch):
    """Fingerprints equal to those by single bits; sets of close ones are compared first, each connected to all that are close."""
    rng = random.Random(12)
    s = np.unique(np.array([rng.randrange(1 << 64) for _ in range(301)], np.uint64))
    assert near_copies.fingerprint(s) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s))
    sims = [rng.getrandbits(63) for _ in range(20)]
    sims += [x ^ (1 << rng.randrange(60)) ^ (1 << 61) for x in sims[:8]] + sims[5:12]
    pairs = near_copies._close(spark.createDataFrame(list(enumerate(sims)), "fp long, sim long")).collect()
    boss = list(range(len(sims)))
    brute = list(boss)
    for found, joined in (([(r["u"], r["v"]) for r in pairs], boss), ([(i, j) for i in range(len(sims)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= 3], brute)):
        for i, j in found:
            assert i > j
            joined[:] = [joined[j] if x == joined[i] else x for x in joined]
    same_sets = lambda b: {frozenset(k for k, x in enumerate(b) if x == y) for y in b}
    assert same_sets(boss) == same_sets(brute) and len(pairs) < len(sims)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    asked, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda *x: asked.append(links(*x)) or asked[-1])
    assert near_copies.keep_firsts(table(spark, [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, "x")])).count() == 2
    assert [f.count() for f in asked][:2] == [1, 0]


def test_near_copies_free_what_they_shuffle(spark, monkeypatch):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, inside, links = spark.conf.get(key), [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda *x: inside.append(spark.conf.get(key)) or links(*x))
    near_copies.keep_firsts(table(spark, [(1, "a b"), (2, "a b"), (3, "c")]))
    assert set(inside) == {"true"} and spark.conf.get(key) == before


def test_pipeline_stage_takes_what_three_bits_leave(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == near_brute_force(rows)


def test_decontamination(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["a", "b", "Cé", "d9"]) for _ in range(n))
    items = [(k, words(rng.randrange(0, 25))) for k in range(30)] + [(None, "x y"), (40, None), (41, "a" * 3)]
    docs = [(k, words(60) + " — " + (items[k % 30][1] or "").replace(" ", ", ")) for k in range(60)] + [(100, None), (101, ""), (None, "x... Y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (64, 1 << 19):
        got = decontam.scan(table(spark, docs), bench, block_bytes=size).select("doc_id", "__gs_scan.*").collect()
        want = {(i, t): (n, h) for (i, t), (_, n, h, *_) in zip(docs, decontam.brute_force(docs, [(i if i is not None else "", t) for i, t in items]), strict=True)}
        assert sorted((r["n_words"], r["n_hit"]) for r in got) == sorted(want.values())
    assert decontam.report(table(spark, docs).limit(0), bench).count() == 0 and not decontam.report(table(spark, docs), bench.limit(0)).where("contaminated").count()


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["quality"] is not None}
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, "/root/testdata/sf0.01").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) >= 0.9
    odd = table(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.report(odd, none).collect()} == {0.5} and quality.report(odd.limit(0), none).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Ids and texts that each stage keeps of what the one before kept, from a small table of planted cases."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = words(12)
    spark.createDataFrame([(1, passage), (2, words(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [words(40) + "\n" + (LONG if k % 4 == 0 else words(9)) for k in range(30)] + [None, "", "123 !", "é", "short"]
    texts += [texts[3], texts[5] + " more", words(20) + " " + passage + " " + words(20), words(20) + " " + " ".join(passage.split()[:9]) + " end", passage]
    docs = spark.createDataFrame([(k, t, ["en", "de"][k % 2], "web", len(t or "")) for k, t in enumerate(texts)], DOCS)
    items = [tuple(r) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]

    def lines(rows):
        digests = {i: d for i, _, _, d in line_dedup.brute_force(rows)}
        holders = [i for i, t in rows if LONG in t.split("\n")]
        out = [(i, "\n".join(x for x in t.split("\n") if x != LONG or i == max(holders))) for i, t in rows]
        assert all(hashlib.sha256(t.encode()).hexdigest() == digests[i] for i, t in out)
        return out

    def near(rows):
        ids = set(near_brute_force(rows))
        return [r for r in rows if r[0] in ids]

    want = list(enumerate(texts))
    stages = [lambda rows: [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))], lines, near, lambda rows: [r for r, x in zip(rows, decontam.brute_force(rows, items), strict=True) if not x[5]]]
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:-1], stages, strict=True):
        before, want = want, brute(want)
        assert want != before
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / stage.__name__)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == want
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "mixing"]
    assert 100 < len(out) < 200 and len({r["doc_id"] for r in out}) == len(out) and all(r["taken"] <= 2 * r["size"] for r in out)
