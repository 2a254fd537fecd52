"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions and gives every byte position a distribution over the
languages; a document's distribution is the mean over its letter positions. Every byte of every text is read: a text
is cut into windows side by side, states start afresh in each. Training is plain numpy: backpropagation through time
on a bounded sample, at most SAMPLE_DOCS documents and SAMPLE_BYTES bytes of each language (those with the smallest
hashes of their ids), of which every step draws some windows, at any place of the texts. Texts are learned from whole;
of those longer than a LONG-th of SAMPLE_BYTES that much is taken, in STRETCHES spread evenly from begin to end, so no
text shuts out others and no language is lost for the length of its texts. Texts are scored where they are read;
nothing is shuffled.

Defined results: `und` with score 0 for null texts, texts without a letter, and when there was nothing to learn
from. Documents without language or id are scored but not learned from; of rows that repeat an id, one for each
language. Very long texts are scored whole, window by window. Of equally likely languages the first by name is taken.
Repeated rows are scored alike. Columns that clash with result columns are replaced, others stay, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairloom.llm.common import blocks, flat_bytes, fold, unused, without
from fairloom.operators.storage import cut

HIDDEN, WINDOW, BATCH = 8, 128, 2048
SAMPLE_DOCS, SAMPLE_BYTES, TRAIN_WINDOW = 400, 2_000_000, 48
LONG, STRETCHES = 8, 16
STEPS, TRAIN_BATCH, RATE, SEED = 260, 192, 0.03, 7
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _cell(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of a gated recurrent unit for a batch in columns. x: what the byte adds to the gates; u: (3H, H)."""
    k = len(h)
    s = u @ h
    gates = x[: 2 * k] + s[: 2 * k]
    gates *= 0.2
    gates += 0.5
    np.clip(gates, 0, 1, out=gates)
    new = np.tanh(x[2 * k :] + gates[k:] * s[2 * k :])
    return new + gates[:k] * (h - new), gates, new, s


@dataclass
class Network:
    languages: list[str]
    embed: list[np.ndarray]  # for each direction (3H, 256): what a byte adds to update gate, reset gate and new state
    recur: list[np.ndarray]  # (3H, H)
    out: np.ndarray  # (languages, 2H)
    bias: np.ndarray  # (languages, 1)

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(languages, positions, windows): the distribution at every byte of windows (positions, windows)."""
        width, n = windows.shape
        k = HIDDEN
        logits = np.empty((len(self.languages), width, n), np.float32)
        for way, (embed, recur) in enumerate(zip(self.embed, self.recur, strict=True)):
            h = np.zeros((k, n), np.float32)
            head = self.out[:, way * k : (way + 1) * k]
            for t in range(width) if way == 0 else range(width - 1, -1, -1):
                h = _cell(embed.take(windows[t], axis=1), recur, h)[0]
                if way == 0:
                    logits[:, t] = head @ h + self.bias
                else:
                    logits[:, t] += head @ h
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def documents(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): the mean distribution over each text's letters; 0 if it has none."""
        raw, at = flat_bytes(texts)
        raw = _FOLD[raw]
        lengths = np.diff(at)
        n_windows = -(-lengths // WINDOW)
        of = np.repeat(np.arange(len(texts)), n_windows)
        begin = at[:-1][of] + WINDOW * (np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows))
        size = np.minimum(WINDOW, at[1:][of] - begin)
        raw = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
        total = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts))
        for a in range(0, len(of), BATCH):
            part = slice(a, a + BATCH)
            place = np.arange(WINDOW)[:, None]
            inside = place < size[part]
            windows = np.where(inside, raw[begin[part] + place], 0)
            counted = (_LETTER[windows] & inside).astype(np.float32)
            pooled = np.einsum("ltn,tn->nl", self.positions(windows), counted)
            for i in range(len(self.languages)):
                total[:, i] += np.bincount(of[part], pooled[:, i], minlength=len(texts))
            letters += np.bincount(of[part], counted.sum(axis=0), minlength=len(texts))
        return total / np.maximum(letters, 1)[:, None]


def drawn(texts: list[np.ndarray], picked: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A window of TRAIN_WINDOW bytes at any place of each text picked; short texts are filled with zeros."""
    out = np.zeros((len(picked), TRAIN_WINDOW), np.uint8)
    for row, i in enumerate(picked.tolist()):
        at = int(rng.integers(0, max(1, len(texts[i]) - TRAIN_WINDOW + 1)))
        part = texts[i][at : at + TRAIN_WINDOW]
        out[row, : len(part)] = part
    return out


def fit(texts: list[np.ndarray], labels: np.ndarray, languages: list[str]) -> Network:
    """texts of folded bytes, each with the number of its language; every byte of the windows drawn is a target."""
    rng = np.random.default_rng(SEED)
    k, n_lang = HIDDEN, len(languages)
    params = {}
    for way in (0, 1):
        params[f"e{way}"] = rng.normal(0, 0.3, (3 * k, 256)).astype(np.float32)
        params[f"u{way}"] = rng.normal(0, 0.3, (3 * k, k)).astype(np.float32)
    params["v"] = rng.normal(0, 0.3, (n_lang, 2 * k)).astype(np.float32)
    params["c"] = np.zeros((n_lang, 1), np.float32)
    m = {p: np.zeros_like(x) for p, x in params.items()}
    s = {p: np.zeros_like(x) for p, x in params.items()}
    width = TRAIN_WINDOW
    rows_of = [np.flatnonzero(labels == i) for i in range(n_lang)]
    for step in range(1, STEPS + 1):
        picked = np.concatenate([rng.choice(r, max(1, TRAIN_BATCH // n_lang)) for r in rows_of])
        x, y = drawn(texts, picked, rng).T, labels[picked]
        n = len(picked)
        grad = {p: np.zeros_like(v) for p, v in params.items()}
        states, kept = np.zeros((2, width, k, n), np.float32), [[None] * width, [None] * width]
        for way in (0, 1):
            h = np.zeros((k, n), np.float32)
            for t in range(width) if way == 0 else range(width - 1, -1, -1):
                before = h
                h, gates, new, pre = _cell(params[f"e{way}"].take(x[t], axis=1), params[f"u{way}"], h)
                states[way, t] = h
                kept[way][t] = (before, gates, new, pre)
        both = np.concatenate([states[0], states[1]], axis=1)  # (width, 2H, n)
        logits = params["v"] @ both + params["c"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(n)] -= 1
        p *= (x != 0)[:, None, :] / max(1, int((x != 0).sum()))
        grad["v"] = np.einsum("tln,tkn->lk", p, both)
        grad["c"] = p.sum(axis=(0, 2))[:, None]
        back = np.einsum("lk,tln->tkn", params["v"], p)
        for way in (0, 1):
            u, by_byte = params[f"u{way}"], grad[f"e{way}"]
            dh = np.zeros((k, n), np.float32)
            for t in range(width - 1, -1, -1) if way == 0 else range(width):
                before, gates, new, pre = kept[way][t]
                z, r = gates[:k], gates[k:]
                dh = dh + back[t, way * k : (way + 1) * k]
                open_ = ((gates > 0) & (gates < 1)) * np.float32(0.2)
                dnew = dh * (1 - z) * (1 - new * new)
                dgates = np.concatenate([dh * (before - new), dnew * pre[2 * k :]]) * open_
                dx = np.concatenate([dgates, dnew])
                dpre = np.concatenate([dgates, dnew * r])
                grad[f"u{way}"] += dpre @ before.T
                np.add.at(by_byte.T, x[t], dx.T)
                dh = dh * z + u.T @ dpre
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * g
            s[name] = 0.99 * s[name] + 0.01 * g * g
            params[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(languages, [params["e0"], params["e1"]], [params["u0"], params["u1"]], params["v"], params["c"])


def spread(text: str, size: str, most: int) -> Column:
    """A text of at most `most` bytes as it is; of a longer one STRETCHES of its characters, evenly spread, with letters
    in as many bytes each as on average."""
    points = F.char_length(text)
    each = F.floor(points.cast("double") * (most // STRETCHES) / F.col(size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(F.col(text), F.floor((points - each).cast("double") * i / (STRETCHES - 1)).cast("int") + 1, each))
    return F.when(F.col(size) > most, F.array_join(parts, " ")).otherwise(F.col(text))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from documents outside the held-out fold; None if none has a language."""
    order = F.xxhash64(key)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (fold(key) != 0))
    usable = usable.select(F.col(text).alias("text"), F.col(lang).alias("lang"), order.alias("o"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))
    best = usable.select("lang", "o", "h", "n").withColumn("nth", nth).where(F.col("nth") <= SAMPLE_DOCS)  # cut short before the shuffle
    best = cut(best.groupBy("lang", "o").agg(F.min(F.struct("h", "n")).alias("x")).select("lang", "o", "x.h", F.least("x.n", F.lit(SAMPLE_BYTES // LONG)).alias("n")))
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("o"))
    best = best.withColumn("sum", so_far).where(F.col("sum") <= SAMPLE_BYTES).select("lang", "o", "h")
    rows = usable.join(F.broadcast(best), ["lang", "o", "h"])  # SAMPLE_DOCS short rows a language
    rows = rows.groupBy("lang", "o").agg(F.first(spread("text", "n", SAMPLE_BYTES // LONG)).alias("text"))  # equal texts once
    got = rows.toArrow().sort_by([("lang", "ascending"), ("o", "ascending")])
    if not got.num_rows:
        return None
    known = sorted(set(got["lang"].to_pylist()))
    texts = [_FOLD[np.frombuffer(x.encode(), np.uint8)] for x in got["text"].to_pylist()]
    labels = np.array([known.index(x) for x in got["lang"].to_pylist()])
    return fit(texts, labels, known)


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    base = without(docs, "lang_pred", "score")
    if network is None:
        return base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    names = pa.array(network.languages)

    @F.arrow_udf("struct<best:string,p:double>")
    def read(texts: pa.Array) -> pa.Array:
        parts = [network.documents(texts.slice(a, b - a)) for a, b in blocks(texts, 2_000_000)]
        p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))], ["best", "p"])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = unused("read_", *base.columns)
    return base.withColumn(found, read(F.col(text))).select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.when(has_letter, F.col(f"{found}.best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(has_letter, F.col(f"{found}.p")).otherwise(0.0).alias("score"),
    )


def language_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    network = train(docs, key)
    held_out = F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out")
    return identify(docs.select(key, "text"), network).select(key, held_out, "lang_pred", "score")
