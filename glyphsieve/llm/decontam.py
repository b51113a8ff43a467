r"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are normalised to words between single spaces, as UTF-8 bytes. A pattern is a window of benchmark words with a
space at both ends, so a pattern occurs in a text exactly where the words do. Patterns of equal word count share a
table: for the first ``m`` bytes of all patterns (``m`` is the shortest's length) a shift table holds, per block of
bytes, how far the block lies from the end; unknown blocks skip ``m - block + 1`` bytes. Where the shift is zero, the
bucket of that suffix block names the patterns to compare.

The benchmark is the stated query set. It is read in blocks of at most ``BLOCK_BYTES`` of text, each broadcast by
itself, and every document is searched with every block. A worker keeps the tables of ``HELD`` blocks, some 30 MB each;
where a benchmark has more, it searches ``AT_ONCE`` bytes of documents at a time, so that tables are built once for
as much text as takes longer to search than they take to build. Broadcasts lie on the disks of driver and executors;
a worker loads each, so it holds the benchmark's texts, but not their tables, whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, a-z and every byte over 0x7F.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 512 << 10
SUFFIX = 8
#: Blocks whose tables a worker keeps.
HELD = 8
#: Bytes of documents that are searched with one block after the other where there are more.
AT_ONCE = 64 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows(items: list[tuple[str, bytes]], n: int) -> dict[bytes, list[str]]:
    """Each window as a pattern, with the items that hold it."""
    found: dict[bytes, list[str]] = defaultdict(list)
    for item, raw in items:
        words = words_of(raw)
        for k in range(max(1, len(words) - n + 1) if words else 0):
            found[b" " + b" ".join(words[k : k + n]) + b" "].append(item)
    return found


class WuManber:
    """Finds all occurrences of patterns, overlaps included. The shift table is indexed by a block's hash, so it takes
    a byte or four per block; blocks that share a place share the smaller shift, which costs steps but no occurrence."""

    def __init__(self, patterns: list[bytes]):
        distinct = set(patterns)
        self.m = m = min(map(len, distinct))
        self.block = b = min(SUFFIX, m)
        self.far = far = min(m - b + 1, 255)
        self.mask = mask = (1 << min(24, max(12, (2 * len(distinct) * far).bit_length()))) - 1
        self.shift = shift = bytearray([far]) * (mask + 1)
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in distinct:
            for left in range(min(far, m - b + 1)):
                at = hash(p[m - left - b : m - left]) & mask
                if left < shift[at]:
                    shift[at] = left
            self.buckets[p[m - b : m]].append(p)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        found, at, n = [], self.m, len(text)
        shift, mask, b, m, bucket = self.shift, self.mask, self.block, self.m, self.buckets.get
        while at <= n:
            part = text[at - b : at]
            step = shift[hash(part) & mask]
            if step:
                at += step
                continue
            for p in bucket(part, ()):
                if text.startswith(p, at - m):
                    found.append((at - m, p))
            at += 1
        return found


class Search:
    """One block of the benchmark, ready to search."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items = windows(items, n)
        by_size: dict[int, list[bytes]] = defaultdict(list)
        for p in self.items:
            by_size[p.count(b" ")].append(p)
        self.tables = [WuManber(x) for x in by_size.values()]

    def run(self, text: bytes) -> list[tuple[int, int, bytes]]:
        """``(first word, number of words, pattern)`` of each occurrence."""
        out = []
        for table in self.tables:
            word, seen = 0, 0
            for at, p in table.find(text):
                word += text.count(b" ", seen, at)
                seen = at
                out.append((word, p.count(b" ") - 1, p))
        return out


#: By the block's name, which no other block of any benchmark has.
_READY: OrderedDict[tuple[str, int], Search] = OrderedDict()


def _search(name: str, block, n: int) -> Search:
    if (name, n) not in _READY:
        while len(_READY) >= HELD:
            _READY.popitem(last=False)
        _READY[name, n] = Search(block.value, n)
    return _READY[name, n]


def query_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[tuple]:
    """The benchmark as ``(name, broadcast)`` of bounded size. Rows arrive one partition at a time."""
    sc, blocks, rows, size = benchmark.sparkSession.sparkContext, [], [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        raw = text.encode()
        if rows and size + len(raw) > block_bytes:
            blocks.append((uuid.uuid4().hex, sc.broadcast(rows)))
            rows, size = [], 0
        rows.append((item or "", raw))
        size += len(raw)
    return [*blocks, (uuid.uuid4().hex, sc.broadcast(rows))] if rows else blocks


def _found(folded: list[tuple[int, bytes]], blocks: list[tuple], n: int) -> list[dict]:
    """What ``scan`` says of each ``(number of words, words between single spaces)``."""
    hits: list[list] = [[] for _ in folded]
    names: list[set] = [set() for _ in folded]
    for name, block in blocks:
        search = _search(name, block, n)
        for k, (size, text) in enumerate(folded):
            if size:
                for first, count, pattern in search.run(text):
                    hits[k].append((first, first + count))
                    names[k].update(search.items[pattern])
    out = []
    for (size, _), spans, ids in zip(folded, hits, names, strict=True):
        runs: list[list[int]] = []
        for start, end in sorted(spans):
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        out.append({"n_words": size, "n_hit": sum(e - s for s, e in runs), "items": sorted(ids), "spans": [{"start": s, "end": e} for s, e in runs]})
    return out


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """Marks the words of each document that lie in an occurrence of a benchmark window.

    A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. Returns the
    rows of ``docs`` with all their columns and ``__gs_scan``: ``n_words``, ``n_hit``, ``items`` (the ids of items with
    occurring windows, as sorted strings, each once; a null id is the empty string) and ``spans`` (the hit runs of
    words, ``[start, end)``). Null or empty texts and benchmark texts have no words. Items that share an id are one item. Any table may be
    empty; without items nothing is hit.
    """
    blocks = query_blocks(benchmark, item_col, item_text_col, block_bytes)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf("struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>")
    def mark(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        folded: list[tuple[int, bytes]] = []
        sizes: list[int] = []
        held = 0

        def settle():
            out, at = _found(folded, blocks, n), 0
            for size in sizes:
                yield pa.array(out[at : at + size], kind)
                at += size
            folded.clear()
            sizes.clear()

        for texts in columns:
            for raw in texts.cast(pa.binary()).to_pylist():
                words = words_of(raw or b"")
                folded.append((len(words), b" " + b" ".join(words) + b" "))
                held += len(folded[-1][1])
            sizes.append(len(texts))
            if len(blocks) <= HELD or held >= at_once:
                yield from settle()
                held = 0
        yield from settle()

    return docs.withColumn(f"{OWN}scan", mark(F.col(text_col)))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The result that the query returns."""
    s = F.col(f"{OWN}scan")
    return scan(docs.select("doc_id", "text"), benchmark, n=n).select("doc_id", s["n_words"].alias("n_words"), s["n_hit"].alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(s["items"], ","), 256).alias("items_sha256"), (s["n_hit"] > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The same by comparing every window at every word, for tests."""
    split = lambda t: words_of((t or "").encode())
    wins = [(str(i), w[k : k + n]) for i, t in items for w in [split(t)] for k in range(max(1, len(w) - n + 1) if w else 0)]
    out = []
    for i, text in docs:
        words, hit, ids = split(text), set(), set()
        for item, win in wins:
            for k in range(len(words) - len(win) + 1):
                if words[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(item)
        out.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
