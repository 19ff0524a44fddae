"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams (lower case; all but letters is a blank); a
linear layer gives a score per language and one for "no known language". All are trained together in numpy by
stochastic gradient descent on a bounded sample of labelled documents (``train_docs``, spread evenly over the languages,
whole texts of up to ``train_bytes``). Examples of no known language are made from the sample: texts whose letters are
exchanged by a random permutation, or put into another script. Grams that training never saw count as much for "no
known language" as those that only such examples have, so an unknown language is rejected, even by a model of one.

Rejection is calibrated on texts that training didn't see: on a tenth of the sample, and foreign texts made of it, a
temperature is fitted; on another tenth the least threshold is taken at which at most ``max_error`` of the accepted,
foreign texts included, are wrong. Texts under the threshold are rejected, and so are texts without letters.

Defined cases: null and empty texts and texts without letters have language ``und``, probability 0, and are rejected;
so have texts that look most like no known language, with the probability of the best language. Rows with a null or
blank language are no training rows, nor are texts of over ``train_bytes``, which are judged whole like others. Where
no row is labelled everything is ``und``. Languages that tie: the first by name. Repeated rows are judged alike; doc_id
may have any type; empty tables give empty results; extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkit as tk
from . import units as U

GRAMS, BITS, DIM = (2, 3, 4), 16, 16
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, RATE, MAX_ERROR, FLOOR = 4000, 32_000, 4, 0.5, 0.005, 0.5
SCRIPTS = (0x0430, 0x03B1, 0x0561, 0x05D0, 0x0628, 0x0915, 0x0E01, 0x10D0, 0x1200, 0x3042, 0x4E00, 0xAC00)
FIELDS = [("language", T.StringType()), ("probability", T.DoubleType())]

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """``table``: a score per bucket and language (the embedding times the linear layer), the last one of no known
    language; one zero row at the end."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def buckets(col: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Per gram size, the bucket at each byte (2**BITS where a gram would be blank or leave its text); text offsets."""
    raw, off = tk.string_buffers(tk.lowered(col))
    letter = _LETTER[raw]
    data = np.where(letter, raw, 32).astype(np.uint64) + np.uint64(1)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(raw))
    out = []
    for n in GRAMS:
        ids = np.full(len(raw), 1 << BITS, np.int64)
        m = len(raw) - n + 1
        if m > 0:
            acc = np.full(m, n, np.uint64)
            some = np.zeros(m, bool)
            for j in range(n):
                acc = acc * tk._P + data[j : j + m]
                some |= letter[j : j + m]
            acc *= np.uint64(0xBF58476D1CE4E5B9)
            ok = some & (left[:m] >= n)
            ids[:m][ok] = (acc[ok] >> np.uint64(64 - BITS)).astype(np.int64)
        out.append(ids)
    return out, off


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def foreign(text: str, rng: np.random.Generator) -> str:
    """The text in no known language: its letters exchanged, or in another script."""
    letters = sorted({ch for ch in text.lower() if ch.isalpha()})
    if rng.random() < 0.6:
        new = [letters[i] for i in rng.permutation(len(letters))] if rng.random() < 0.5 else [chr(97 + i) for i in rng.integers(0, 26, len(letters))]
    else:
        base = int(rng.choice(SCRIPTS))
        new = [chr(base + int(i)) for i in rng.integers(0, 24, len(letters))]
    return text.lower().translate(dict(zip(map(ord, letters), new)))


def train(texts: list[str], labels: list[str], seed: int = 7, max_error: float = MAX_ERROR) -> Model:
    """A model fitted to whole texts; a tenth each is for the temperature and for the threshold, the rest for training."""
    languages = sorted(set(labels))
    c = len(languages) + 1
    if c == 1:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    part = np.zeros(len(texts), np.int64)  # 0 for training, 1 and 2 for calibration
    part[order[: len(texts) // 10]], part[order[len(texts) // 10 : len(texts) // 5]] = 1, 2
    made = rng.permutation(len(texts))[: -(-len(texts) // 2)]
    part = np.concatenate([part, part[made]])
    y = np.array([languages.index(x) for x in labels] + [c - 1] * len(made))
    texts = [*texts, *(foreign(texts[i], rng) for i in made)]
    rows = []
    for lo in range(0, len(texts), 256):
        ids, off = buckets(pa.array(texts[lo : lo + 256], pa.string()))
        for a, b in zip(off[:-1], off[1:]):
            u, k = np.unique(np.concatenate([x[a:b] for x in ids]), return_counts=True)
            rows.append((u[u < 1 << BITS], k[u < 1 << BITS].astype(np.float32)))
    used = np.flatnonzero(part == 0)
    embed = rng.normal(0, 0.1, ((1 << BITS), DIM)).astype(np.float32)
    linear, bias = rng.normal(0, 0.1, (DIM, c)).astype(np.float32), np.zeros(c, np.float32)
    total = EPOCHS * max(1, len(used))
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            u, k = rows[i]
            step += 1
            if not len(u):
                continue
            rate = RATE * (1 - step / (total + 1))
            share = k / k.sum()
            hidden = share @ embed[u]
            error = _softmax(hidden @ linear + bias)
            error[y[i]] -= 1
            back = linear @ error
            linear -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # each bucket moves as if its text held nothing else, held back by its share
            embed[u] -= (20 * rate * share)[:, None] * back
    seen = np.zeros((2, 1 << BITS), bool)
    for i in used:
        seen[int(y[i] == c - 1), rows[i][0]] = True
    table = (embed @ linear).astype(np.float32)
    # a gram that training never saw speaks like those that only texts in no known language have
    strange = seen[1] & ~seen[0]
    table[~seen.any(axis=0)] = table[strange].mean(axis=0) if strange.any() else 0
    table = np.vstack([table, np.zeros((1, c), np.float32)]).astype(np.float32)

    def scores(which: np.ndarray) -> np.ndarray:
        return np.array([(rows[i][1] / max(rows[i][1].sum(), 1)) @ table[rows[i][0]] + bias for i in which if len(rows[i][0])]).reshape(-1, c)

    def truth(which: np.ndarray) -> np.ndarray:
        return np.array([y[i] for i in which if len(rows[i][0])], np.int64)

    first, second = (np.flatnonzero(part == k) if (part == k).any() else used for k in (1, 2))
    x, t_ = scores(first), truth(first)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 80):
        loss = -np.log(np.maximum(_softmax(x / t)[np.arange(len(t_)), t_], 1e-12)).mean() if len(t_) else np.inf
        if loss < best:
            best, temperature = loss, float(t)
    prob, t_ = _softmax(scores(second) / temperature), truth(second)
    told = prob.argmax(axis=1) < c - 1
    top, right = prob[told].max(axis=1), prob[told].argmax(axis=1) == t_[told]
    by = np.argsort(-top)
    wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
    fine = np.flatnonzero(wrong <= max_error)
    if not len(by):
        threshold = FLOOR
    elif not len(fine):
        threshold = 1.0
    else:  # what is wrong lies below; where all is right, nothing does
        threshold = max(FLOOR, float(top[by][fine[-1]])) if fine[-1] < len(by) - 1 else FLOOR
    return Model(languages, table, bias, temperature, threshold)


def predict(model: Model, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Language (``und`` where there are no letters or no known language is likelier), calibrated probability of the best
    language, and whether the text is accepted."""
    ids, off = buckets(col)
    rows, c = len(off) - 1, len(model.languages)
    full = np.flatnonzero(np.diff(off))
    if not c or not len(full):
        return pa.array(["und"] * rows, pa.string()), np.zeros(rows), np.zeros(rows, bool)
    score, count = np.zeros((rows, c + 1)), np.zeros(rows)
    for x in ids:
        score[full] += np.add.reduceat(model.table[x], off[full], axis=0)
        count[full] += np.add.reduceat(x < 1 << BITS, off[full])
    prob = _softmax((score / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best = np.where(count > 0, prob.argmax(axis=1), c)
    likely = np.where(count > 0, prob[:, :c].max(axis=1), 0.0)
    return pa.array(np.array([*model.languages, "und"], dtype=object)[best], pa.string()), likely, (best < c) & (likely >= model.threshold)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", train_docs: int = TRAIN_DOCS, seed: int = 7, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on about ``train_docs`` labelled documents of up to ``train_bytes`` at most, as many of each language, chosen
    by a hash; the driver sees no more than their product, 128 MB."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("txt"), F.col(f"`{language}`").cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit(seed)), F.lit(1 << 30)).alias("h")).where("trim(lang) != '' and txt is not null").where(F.octet_length("txt") <= train_bytes)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return train([], [])
    each = train_docs / len(sizes)
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, each / n) * (1 << 30))))))
    got = rows.where(F.col("h") < share[F.col("lang")]).select("h", "txt", "lang").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["txt"], r["lang"]))
    return train([r["txt"] for r in got], [r["lang"] for r in got], seed)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, probability, accepted) of all documents."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        lang, prob, accepted = predict(model, U.text_column(part, text))
        return {"language": lang, "probability": pa.array(prob), "accepted": pa.array(accepted)}

    return common.append(docs, text, make, [*FIELDS, ("accepted", T.BooleanType())], [doc_id])


def accept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` whose language the model, trained on them, doesn't reject."""
    model = fit(docs, doc_id, text, language, train_docs)
    ok = common.fresh(docs, "accepted")

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {ok: pa.array(predict(model, U.text_column(part, text))[2])}

    return common.append(docs, text, make, [(ok, T.BooleanType())]).where(F.col(ok)).drop(ok)
