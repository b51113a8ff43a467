"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into chunks of ``CHUNK`` bytes. One recurrent layer reads a chunk forwards, one backwards; at every
position both states give probabilities over the languages. A document's probabilities are the mean over all positions
of all its chunks. Training is backpropagation through time with the document's language as the label of every
position, on the driver, over chunks of a bounded sample: at most ``docs_per_lang`` documents of
each language, picked by a hash of id and text, and ``chunks_per_doc`` chunks from anywhere in each. The network is a few kilobytes and is broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN

CHUNK = 64
HIDDEN = 8
LANES = 2048
DOCS_PER_LANG = 384
CHUNKS_PER_DOC = 12
STEPS = 160
BATCH = 256
RATE = 0.02
BYTES_AT_ONCE = 4 << 20
_LETTER = re.compile(rb"[A-Za-z]")


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in place: ``x / (1 + |x|)``, a third of the hyperbolic tangent's price. Its slope is ``(1 - |y|)**2``."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """From 0 to 1, in place; its slope is ``2 * min(y, 1 - y)**2``."""
    _squash(x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"V": rng.normal(0, 0.3, (2 * hidden, classes)), "b": np.zeros(classes)}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"U{d}": rng.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)), f"c{d}": np.zeros(3 * hidden)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_layer(p: dict, d: str, x: np.ndarray, mask: np.ndarray | None, tape: list | None = None) -> np.ndarray:
    """States ``(T, N, H)`` for bytes ``(T, N)``; direction ``b`` goes from the last row up. ``tape`` gets what backpropagation needs."""
    W, U, hidden = p[f"W{d}"] + p[f"c{d}"], p[f"U{d}"], p[f"U{d}"].shape[0]
    h, out = np.zeros((x.shape[1], hidden), np.float32), np.empty((*x.shape, hidden), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        a, g = W[x[t]], h @ U
        zr = _gate(a[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r, q = zr[:, :hidden], zr[:, hidden:], g[:, 2 * hidden :]
        n = r * q
        n += a[:, 2 * hidden :]
        _squash(n)
        if tape is not None:
            tape.append((t, h, z, r, q, n))
        h = h - n
        h *= z
        h += n
        if mask is not None:
            h *= mask[t][:, None]
        out[t] = h
    return out


def probabilities(p: dict, x: np.ndarray, mask: np.ndarray | None, tapes: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
    """``(T, N, classes)`` probabilities, and the states of both directions."""
    states = np.concatenate([run_layer(p, d, x, mask, tape) for d, tape in zip("fb", tapes, strict=True)], axis=2)
    s = states @ p["V"]
    s += p["b"]
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    return s, states


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over the positions of ``mask``, and its gradients by backpropagation through time."""
    tapes: tuple[list, list] = ([], [])
    prob, states = probabilities(p, x, mask, tapes)
    weight = mask / max(1.0, float(mask.sum()))
    loss = float(-(np.log(prob[:, np.arange(len(y)), y] + 1e-12) * weight).sum())
    ds = prob
    ds[:, np.arange(len(y)), y] -= 1
    ds *= weight[:, :, None]
    hidden = states.shape[2] // 2
    g = {"V": states.reshape(-1, 2 * hidden).T @ ds.reshape(-1, ds.shape[2]), "b": ds.sum(axis=(0, 1))}
    both = ds @ p["V"].T
    for d, tape, outer in (("f", tapes[0], both[:, :, :hidden]), ("b", tapes[1], both[:, :, hidden:])):
        U = p[f"U{d}"]
        dU, inputs = np.zeros_like(U), np.empty((*x.shape, 3 * hidden), np.float32)
        dh = np.zeros((x.shape[1], hidden), np.float32)
        for t, h, z, r, q, n in reversed(tape):
            dh = (dh + outer[t]) * mask[t][:, None]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dz = dh * (h - n) * 2 * np.minimum(z, 1 - z) ** 2
            dr = dn * q * 2 * np.minimum(r, 1 - r) ** 2
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            inputs[t] = np.concatenate([dz, dr, dn], axis=1)
            dU += h.T @ dg
            dh = dh * z + dg @ U.T
        dW = np.zeros_like(p[f"W{d}"])
        np.add.at(dW, x.ravel(), inputs.reshape(-1, 3 * hidden))
        g |= {f"U{d}": dU, f"W{d}": dW, f"c{d}": inputs.sum(axis=(0, 1))}
    return loss, g


def chunks(texts: list[bytes], size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes ``(n, size)`` with zeros behind the ends, the length of each chunk, and the text it is from."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    flat, lengths, at = np.zeros(int(counts.sum()) * size, np.uint8), np.full(int(counts.sum()), size, np.int64), 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        if n:
            flat[at * size : at * size + len(t)] = np.frombuffer(t, np.uint8)
            at += n
            lengths[at - 1] = len(t) - (n - 1) * size
    return flat.reshape(-1, size), lengths, np.repeat(np.arange(len(texts)), counts)


def _mask(lengths: np.ndarray, size: int) -> np.ndarray:
    return (np.arange(size)[:, None] < lengths[None, :]).astype(np.float32)


def train(texts: list[bytes], labels: list[int], classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on random batches of chunks, each language as often."""
    x, lengths, _ = chunks(texts)
    y = np.array(labels, np.int64)
    p, rng = init(classes, seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    of = [np.flatnonzero(y == c) for c in range(classes)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-BATCH // classes)) for rows in of if len(rows)])
        loss, g = gradients(p, np.ascontiguousarray(x[pick].T), _mask(lengths[pick], CHUNK), y[pick])
        norm = sum(float((a * a).sum()) for a in g.values()) ** 0.5
        rate = RATE * min(1.0, 2 * (steps - step + 1) / steps)
        for k, a in g.items():
            a = a * min(1.0, 1.0 / (norm + 1e-12))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _states(p: dict, d: str, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """What ``run_layer`` gives, as ``(T, H, N)`` and without a tape: features first, in place, for speed."""
    hidden = p[f"U{d}"].shape[0]
    W, U = np.ascontiguousarray((p[f"W{d}"] + p[f"c{d}"]).T), np.ascontiguousarray(p[f"U{d}"].T)
    n = x.shape[1]
    h, out = np.zeros((hidden, n), np.float32), np.empty((len(x), hidden, n), np.float32)
    a, g, size = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32), np.empty((2 * hidden, n), np.float32)
    gates, z, r, new = a[: 2 * hidden], a[:hidden], a[hidden : 2 * hidden], a[2 * hidden :]
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        np.take(W, x[t], axis=1, out=a, mode="clip")
        np.matmul(U, h, out=g)
        gates += g[: 2 * hidden]
        np.abs(gates, out=size)
        size += 1
        gates /= size
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        g[2 * hidden :] *= r
        new += g[2 * hidden :]
        np.abs(new, out=size[:hidden])
        size[:hidden] += 1
        new /= size[:hidden]
        h -= new
        h *= z
        h += new
        if mask is not None:
            h *= mask[t]
        out[t] = h
    return out


def pooled(p: dict, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """``(N, classes)``: the probabilities of each chunk summed over its positions."""
    hidden = p["Uf"].shape[0]
    forth, back = _states(p, "f", x, mask), _states(p, "b", x, mask)
    Vf, Vb, b = p["V"][:hidden].T.copy(), p["V"][hidden:].T.copy(), p["b"][:, None]
    total = np.zeros((len(p["b"]), x.shape[1]), np.float32)
    for t in range(len(x)):
        s = Vf @ forth[t]
        s += Vb @ back[t]
        s += b
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        if mask is not None:
            s *= mask[t]
        total += s
    return total.T


def predict(p: dict, texts: list[bytes]) -> np.ndarray:
    """``(texts, classes)``: mean probabilities over all positions; zeros for empty texts."""
    sums, size = np.zeros((len(texts), len(p["b"]))), np.zeros(len(texts))
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= BYTES_AT_ONCE):
            n += len(texts[to])
            to += 1
        x, lengths, owner = chunks(texts[at:to])
        for k in range(0, len(x), LANES):
            part, length = np.ascontiguousarray(x[k : k + LANES].T), lengths[k : k + LANES]
            mask = _mask(length, CHUNK) if (length < CHUNK).any() else None
            np.add.at(sums, at + owner[k : k + LANES], pooled(p, part, mask))
        size[at:to] = [len(t) for t in texts[at:to]]
        at = to
    return sums / np.maximum(size, 1)[:, None]


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "replace")))


def _bucket(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chunks_per_doc: int = CHUNKS_PER_DOC, steps: int = STEPS) -> tuple[dict, list[str]]:
    """The network and its languages from ``(id, text, lang)``; rows without a text or a language don't count."""

    @F.arrow_udf("array<binary>")
    def some(texts: pa.Array) -> pa.Array:
        out = []
        for raw in texts.cast(pa.binary()).to_pylist():
            n = -(-len(raw) // CHUNK)
            pick = np.random.default_rng(n).permutation(n)[:chunks_per_doc] if n <= 1 << 20 else np.random.default_rng(n).integers(0, n, chunks_per_doc)
            out.append([raw[int(k) * CHUNK : (int(k) + 1) * CHUNK] for k in sorted(pick)])
        return pa.array(out, pa.list_(pa.binary()))

    # A language's documents are dealt to slots by a hash of id and text, and the least of each slot is kept: one of any number of
    # copies, none of a language's rows lost while a slot is free, and no more than the slots whatever the input's size.
    slots = 4 * docs_per_lang
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("h", F.xxhash64(F.col("id").cast("string"), "text")).withColumn("slot", F.pmod("h", F.lit(slots)))
    least = usable.groupBy("lang", "slot").agg(F.min("h").alias("h"))
    one = Window.partitionBy("lang", "slot").orderBy("h", "id", "text")
    chosen = usable.join(F.broadcast(least), ["lang", "slot", "h"]).withColumn("k", F.row_number().over(one)).where("k = 1")
    sample = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("slot"))).where(F.col("k") <= docs_per_lang)
    rows = sorted((r["lang"], r["k"], r["parts"]) for r in sample.select("lang", "k", some("text").alias("parts")).collect())
    langs = sorted({r[0] for r in rows})
    parts = [(bytes(x), langs.index(lang)) for lang, _, xs in rows for x in xs]
    return (train([x for x, _ in parts], [y for _, y in parts], len(langs), steps) if langs else {}), langs


def identify(docs: DataFrame, model: dict, langs: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``__gs_lang``: ``lang_pred`` and its pooled probability ``score``. A text that is null, or without any
    letter, is ``und`` with score 0; so is every text if there was nothing to learn from."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def label(texts: pa.Array) -> pa.Array:
        raws = [raw or b"" for raw in texts.cast(pa.binary()).to_pylist()]
        sure = [bool(langs) and has_letter(raw) for raw in raws]
        prob = predict(known.value, [raw if ok else b"" for raw, ok in zip(raws, sure, strict=True)]) if langs else np.zeros((len(raws), 1))
        best = prob.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array([langs[k] if ok else "und" for k, ok in zip(best.tolist(), sure, strict=True)], pa.string()), pa.array([float(min(1.0, q[k])) if ok else 0.0 for q, k, ok in zip(prob, best.tolist(), sure, strict=True)], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(f"{OWN}lang", label(F.col(text_col)))


def report(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The result that the query returns: ``doc_id, held_out, lang_pred, score``.

    Learns from documents outside the held-out fold. Only the text is an input of a prediction. A null id is in no
    fold (``held_out`` false) and isn't learned from. Repeated rows and ties get equal predictions; an empty table none.
    """
    rows = docs.select("doc_id", "text", "lang")
    fold = _bucket("doc_id", folds)
    model, langs = fit(rows.where(fold != held).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = F.col(f"{OWN}lang")
    return identify(rows.select("doc_id", "text"), model, langs).select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), out["lang_pred"].alias("lang_pred"), out["score"].alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that get a language, with all their columns: a text that is null or without any letter goes, every
    other stays in whichever language is likeliest, however unsure; if there was nothing to learn from, all go."""
    model, langs = fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    out = F.col(f"{OWN}lang")
    return identify(docs, model, langs, text_col).where(out["lang_pred"] != "und").drop(f"{OWN}lang")
