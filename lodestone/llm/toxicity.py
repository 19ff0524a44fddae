"""Toxicity by weak supervision: a generative label model over lexicon and pattern voters, then a linear classifier.

Voters. Each fires or abstains. Public lexicon voters, one for each kind of insult in English and one for each of
four other groups of languages, fire when a word of the text begins with one of their stems. Mined lexicon voters do
the same with stems mined from labelled rows: word prefixes of 4 to 8 letters that follow far more different words in
toxic documents than in others, which is the only way to learn the insults of a language that no public list has. The
labelled sample is dealt in FOLDS parts, and each mined lexicon leaves another part out. It fires on a sure stem, which
other documents hardly ever have, or when its stems, unsure ones included, begin enough of the words. Pattern voters look at no word list of insults: runs of exclamation marks, shouting, words masked by symbols, letters or words
said over and over, and forms of address in every other sentence.

Label model. The number of documents with each combination of votes is counted over all documents (at most 2**VOTERS
rows). Expectation-maximisation fits the class prior and, for each class, how often each voter fires: its accuracy.
Voters that still depend on each other given the class are linked in a forest (maximum spanning tree of the
conditional mutual information), and the model is fitted again with each voter depending on its parent as well: its
correlations. No label enters the fit but through the mined stems.

Classifier. A logistic regression over how densely words and word prefixes occur in a text is trained by stochastic
gradient descent with an L1 penalty on the posteriors of a bounded sample of documents, drawn by the posterior: at most
about ``train_toxic`` with one of at least one half, and ``train_clean`` others. It judges every document.

Bounds: the sample of labelled rows (``seed_rows``) and that of the classifier, both of texts of up to ``train_bytes``;
longer texts vote and are judged whole like others.

Defined cases: null and empty texts are not toxic. Labels with nulls, or for ids that no document has, are ignored; of
labels that repeat an id one counts; without labels the public lists stand alone. A probability of exactly one half is
toxic. Repeated rows are judged alike; doc_id may have any type. Empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkit as tk
from . import units as U

#: Stems of insults that are on many public lists of abusive words, by kind.
PUBLIC = {
    "intellect": "idiot moron imbecile stupid cretin dimwit halfwit retard dumbass nitwit simpleton brainless braindead",
    "worth": "worthless pathetic loser scum trash garbage lowlife vermin parasite useless subhuman nobody deadbeat",
    "disgust": "disgusting repulsive filthy vile repugnant sickening loathsome revolting scumbag slimy stinking",
    "ridicule": "clown buffoon jackass laughingstock crybaby weakling coward creep freak weirdo",
    "vulgar": "fuck motherfuck shit bullshit bitch bastard asshole cunt slut whore dickhead prick twat wanker douche",
    "germanic": "trottel dummkopf schwachkopf arschloch abschaum wertlos widerlich erbärmlich blödmann vollidiot scheiß hurensohn missgeburt klootzak sukkel",
    "romance": "imbécile crétin connard connasse salope ordure débile abruti merde putain enculé idiota estúpid imbécil gilipollas pendejo mierda cabrón payaso escoria asqueros inútil stronzo coglione",
    "slavic": "идиот дурак дура тупой тупиц придур мразь ублюд ничтожеств сволоч дебил мерзав мерзк урод кретин",
}
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi ton ta tes vous votre tú eres usted ustedes ты тебя тебе твой вы вас ваш".split()
FOLDS, PATTERNS = 3, 6
LEXICONS = len(PUBLIC) + FOLDS
VOTERS = LEXICONS + PATTERNS
#: Words added to a text's own before densities are taken, so that one word of a short text is no flood.
SMOOTH, DENSE, ADDRESS = 50, 0.01, 0.03
SEED_ROWS, TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 6_000, 4_000, 5_000, 32_000
PREFIXES = (4, 5, 6, 8)
LIFT, LEAST, SURE = 10.0, 0.003, 0.97


@dataclass
class LabelModel:
    """Class prior, and tables (parent value, own value is 1) of each voter by class; ``parent`` is -1 at roots."""

    prior: float
    parent: list[int]
    fires: np.ndarray  # (class, voter, parent value)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each combination of votes, given as bit masks."""
        bits = (votes[:, None] >> np.arange(len(self.parent))) & 1
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            given = bits[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            for c in (0, 1):
                f = self.fires[c, j, given]
                log[:, c] += np.where(bits[:, j] == 1, np.log(f), np.log1p(-f))
        log -= log.max(axis=1, keepdims=True)
        e = np.exp(log)
        return e[:, 1] / e.sum(axis=1)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, voters: int = VOTERS, lexicons: int = LEXICONS, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over vote combinations; first with independent voters, then along the forest."""
    bits = (votes[:, None] >> np.arange(voters)) & 1
    parent = [-1] * voters
    guess = np.where(bits[:, :lexicons].any(axis=1), 0.9, 0.02)

    def maximise(q: np.ndarray) -> LabelModel:
        fires = np.zeros((2, voters, 2))
        for c, weight in enumerate((counts * (1 - q), counts * q)):
            for j, p in enumerate(parent):
                given = bits[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
                for v in (0, 1):
                    w = weight * (given == v)
                    fires[c, j, v] = (w @ bits[:, j] + 0.1) / (w.sum() + 0.2 + 1)
        return LabelModel(float(np.clip((counts @ q) / max(counts.sum(), 1), 1e-4, 0.5)), list(parent), np.clip(fires, 1e-6, 1 - 1e-6))

    for _ in range(2):
        for _ in range(rounds):
            model = maximise(guess)
            new = model.posterior(votes)
            moved = float(np.abs(new - guess) @ counts) / max(counts.sum(), 1)
            guess = new
            if moved < 1e-7:
                break
        gain = np.zeros((voters, voters))
        for weight in (counts * (1 - guess), counts * guess):
            total = max(weight.sum(), 1e-9)
            for a in range(voters):
                for b in range(a):
                    for x in (0, 1):
                        for y in (0, 1):
                            both = weight @ ((bits[:, a] == x) & (bits[:, b] == y)) / total
                            alone = (weight @ (bits[:, a] == x) / total) * (weight @ (bits[:, b] == y) / total)
                            if both > 0 and alone > 0:
                                gain[a, b] += both * np.log(both / alone) * total / max(counts.sum(), 1)
        gain += gain.T
        parent = [-1] * voters
        left = set(range(voters))
        while left:
            tied = [(gain[a, b], a, b) for a in left for b in range(voters) if b not in left]
            best = max(tied, default=(0.0, min(left), -1))
            left.discard(best[1])
            parent[best[1]] = best[2] if best[0] > 1e-4 else -1
    return maximise(guess)


def mine(docs: DataFrame, labels: DataFrame, seed_rows: int = SEED_ROWS, seed: int = 3, train_bytes: int = TRAIN_BYTES) -> list[list[str]]:
    """The stems of the lexicon voters, then the unsure ones of the mined ones. ``docs``: id and txt, ``labels``: id and toxic (0/1)."""
    known = labels.where("id is not null and toxic is not null").dropDuplicates(["id"])
    share = min(1.0, 0.9 * seed_rows / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(seed_rows)
    got = docs.where(F.octet_length("txt") <= train_bytes).join(F.broadcast(some), "id").select("txt", "toxic", F.xxhash64("id").alias("h")).orderBy("h", "txt").toArrow()  # some: bounded by seed_rows
    toxic, col = got.column("toxic").to_numpy().astype(bool), pa.array(got.column("txt").to_pylist(), pa.string())
    fold = np.arange(len(toxic)) % FOLDS
    mined: list[list[str]] = []
    weak: list[list[str]] = []
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        part = toxic[rest]
        sure, unsure = _stems(col.take(pa.array(rest)), part) if 0 < part.sum() < len(part) else ([], [])
        mined.append(sure)
        weak.append(unsure)
    return [*(v.split() for v in PUBLIC.values()), *mined, *weak]


def _stems(col: pa.Array, toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Prefixes of words that toxic texts have LIFT times as often, sure ones and others, most frequent first.

    What counts is the number of different words before them, as copies of a text say each word after the same one.
    """
    stems: list[str] = []
    kept: set[str] = set()
    weight: dict[str, int] = {}
    sure: dict[str, bool] = {}
    size = (max(int((~toxic).sum()), 1), max(int(toxic.sum()), 1))
    parts = list(_slices(col))
    for n in PREFIXES:
        hashes, pairs, flags = [], [], []
        for lo, part in parts:
            w, long, h, _, _ = _prefixes(part, n)
            before = np.concatenate([[0], w.hash[:-1]]).astype(np.uint64)
            before[w.first[:-1][np.diff(w.first) > 0]] = 0
            bad = toxic[lo + w.row[long]]
            pair, one = np.unique(tk.mix64(h ^ tk.mix64(before[long])) ^ bad.astype(np.uint64), return_index=True)
            hashes.append(h[one])
            pairs.append(pair)
            flags.append(bad[one])
        h, bad = np.concatenate(hashes), np.concatenate(flags)
        _, one = np.unique(np.concatenate(pairs), return_index=True)
        keys, code = np.unique(h[one], return_inverse=True)
        yes, no = np.bincount(code, bad[one], len(keys)), np.bincount(code, ~bad[one], len(keys))
        ok = np.flatnonzero((yes >= max(8.0, LEAST * size[1])) & (yes / size[1] >= LIFT * (no + 0.5) / size[0]))
        names: dict[int, str] = {}
        for _, part in parts if len(ok) else []:
            w, _, h, a, e = _prefixes(part, n)
            for i in np.unique(h, return_index=True)[1]:
                k = int(np.searchsorted(keys[ok], h[i]))
                if k < len(ok) and keys[ok[k]] == h[i] and int(ok[k]) not in names:
                    names[int(ok[k])] = w.raw[a[i] : e[i]].tobytes().decode("utf-8", "replace")
        for k, s in names.items():
            if not any(s[:m] in kept for m in range(1, len(s))):
                kept.add(s)
                weight[s] = int(yes[k])
                sure[s] = bool(yes[k] >= SURE * (yes[k] + no[k]))
    stems = sorted(kept, key=lambda s: (-weight[s], s))
    return [s for s in stems if sure[s]], [s for s in stems if not sure[s]]


def _slices(col: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of about 2 MB of a string column, with the index of their first row."""
    lo = 0
    for part in tk.byte_slices(pa.RecordBatch.from_arrays([col], names=["t"]), "t"):
        yield lo, part.column(0)
        lo += part.num_rows


def _prefixes(col: pa.Array, n: int) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, which of them have n letters, and hash, start and end of those prefixes."""
    w = tk.words_of(col)
    lead = (w.raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    at_char = np.concatenate([np.flatnonzero(lead), [len(w.raw)]])
    long = np.flatnonzero(chars[w.end] - chars[w.start] >= n)
    a = w.start[long]
    e = at_char[chars[a] + n]
    return w, long, tk.span_hash(w.raw, a, e), a, e


def _stem_table(groups: list[list[str]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length in bytes: sorted hashes of stems and the bits of their voters."""
    bits: dict[bytes, int] = {}
    for k, stems in enumerate(groups):
        for s in stems:
            bits[s.encode()] = bits.get(s.encode(), 0) | 1 << k
    by: dict[int, list[bytes]] = {}
    for s in bits:
        by.setdefault(len(s), []).append(s)
    table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n, stems in by.items():
        raw = np.frombuffer(b"".join(stems), np.uint8)
        at = np.arange(len(stems)) * n
        h = tk.span_hash(raw, at, at + n)
        order = np.argsort(h)
        table[n] = (h[order], np.array([bits[stems[i]] for i in order], np.int64))
    return table


def _hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return np.sort(tk.span_hash(raw, np.concatenate([[0], end[:-1]]), end))


_you = _hashes(YOU)


def votes_of(col: pa.Array, table: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bit mask of the voters that fire, per text."""
    w = tk.words_of(col)
    n_rows = len(w.first) - 1
    out = np.zeros(n_rows, np.int64)
    p, inv = tk._power(len(w.raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((w.raw.astype(np.uint64) + np.uint64(1)) * p[: len(w.raw)], dtype=np.uint64)])
    dense = np.zeros((FOLDS, n_rows), np.int64)
    for n, (known, bit) in table.items():
        long = np.flatnonzero(w.end - w.start >= n)
        a = w.start[long]
        h = tk.mix64((sums[a + n] - sums[a]) * inv[a])
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = np.flatnonzero(known[at] == h)
        row, fired = w.row[long[hit]], bit[at[hit]]
        np.bitwise_or.at(out, row, fired & ((1 << LEXICONS) - 1))
        for k in range(FOLDS):
            both = 1 << (len(PUBLIC) + k) | 1 << (LEXICONS + k)
            dense[k] += np.bincount(row[(fired & both) != 0], minlength=n_rows)
    for k in range(FOLDS):
        out |= (dense[k] >= DENSE * (w.counts + SMOOTH)).astype(np.int64) << (len(PUBLIC) + k)
    raw, off = tk.string_buffers(col)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    letter = upper | lower
    bang = np.zeros(len(raw), bool)
    bang[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
    symbol = (raw == 42) | (raw == 64) | (raw == 35) | (raw == 36) | (raw == 37)  # * @ # $ %
    masked, stretched = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw) >= 4:
        masked[3:] = letter[:-3] & symbol[1:-2] & symbol[2:-1] & letter[3:]
        stretched[3:] = letter[3:] & (raw[3:] == raw[2:-1]) & (raw[3:] == raw[1:-2]) & (raw[3:] == raw[:-3])
        for mark in (masked, stretched):  # not across texts
            inner = off[1:-1]
            for k in range(3):
                mark[np.minimum(inner + k, len(raw) - 1)] = False
    again = np.zeros(len(w.hash), bool)
    if len(again) >= 4:
        again[3:] = (w.hash[3:] == w.hash[2:-1]) & (w.hash[3:] == w.hash[1:-2]) & (w.hash[3:] == w.hash[:-3]) & (w.row[3:] == w.row[:-3])
    at = np.minimum(np.searchsorted(_you, w.hash), len(_you) - 1)
    address = np.bincount(w.row[_you[at] == w.hash], minlength=n_rows)
    patterns = (tk.segment_sum(bang, off) > 0, tk.segment_sum(upper, off) > tk.segment_sum(lower, off), tk.segment_sum(masked, off) > 0, tk.segment_sum(stretched, off) > 0, tk.segment_sum(again, w.first) > 0, address >= ADDRESS * (w.counts + SMOOTH))
    for k, fires in enumerate(patterns):
        out |= fires.astype(np.int64) << (LEXICONS + k)
    return out


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of their prefixes, the text of each, and per text what a word counts."""
    w = tk.words_of(col)
    p, inv = tk._power(len(w.raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((w.raw.astype(np.uint64) + np.uint64(1)) * p[: len(w.raw)], dtype=np.uint64)])
    hashes, rows = [w.hash], [w.row]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        a = w.start[long]
        hashes.append(tk.mix64((sums[a + n] - sums[a]) * inv[a] + np.uint64(n)))
        rows.append(w.row[long])
    return np.concatenate(hashes), np.concatenate(rows), 4.0 * SMOOTH / (w.counts + SMOOTH)


@dataclass
class Classifier:
    """Weights of the features that have any, by sorted hash."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, col: pa.Array) -> np.ndarray:
        h, row, scale = features(col)
        score = np.full(len(col), self.bias)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            score += np.bincount(row[hit], self.weights[at[hit]], len(col)) * scale
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def train_classifier(texts: list[str], target: np.ndarray, epochs: int = 8, rate: float = 1.0, l1: float = 1e-4, seed: int = 5) -> Classifier:
    """Logistic regression on posteriors by AdaGrad with lazily applied L1; features in fewer than 3 toxic texts are left out."""
    rng = np.random.default_rng(seed)
    none = Classifier(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    toxic = target >= 0.5
    if not len(target) or not toxic.any():
        return none

    def rows(which: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lo, part in _slices(pa.array([texts[i] for i in which], pa.string())):
            h, row, scale = features(part)
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(len(part) + 1))
            for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                u, k = np.unique(h[order[a:b]], return_counts=True)
                yield int(which[lo + i]), u, k * scale[i]

    keys, times = np.unique(np.concatenate([u for _, u, _ in rows(np.flatnonzero(toxic))]), return_counts=True)
    keys, times = keys[times >= 3], times[times >= 3]
    if not len(keys):
        return none
    other = np.zeros(len(keys))
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    for i, u, x in rows(np.arange(len(texts))):
        at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
        ok = keys[at] == u
        kept[i] = at[ok].astype(np.int32), x[ok].astype(np.float32)
        if not toxic[i]:
            other[at[ok]] += 1
    # what clean texts say as often tells nothing
    tells = times / toxic.sum() >= 2 * (other + 0.5) / max((~toxic).sum(), 1)
    place = np.cumsum(tells) - 1
    kept = [(place[u[tells[u]]], x[tells[u]]) for u, x in kept]
    keys = keys[tells]
    weight, square, seen = np.zeros(len(keys)), np.full(len(keys), 1e-2), np.zeros(len(keys), np.int64)
    bias = -4.0
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            u, x = kept[i]
            step += 1
            shrink = l1 * (step - seen[u]) * rate / np.sqrt(square[u])
            weight[u] = np.sign(weight[u]) * np.maximum(np.abs(weight[u]) - shrink, 0)
            seen[u] = step
            error = 1 / (1 + np.exp(-np.clip(bias + weight[u] @ x, -40, 40))) - target[i]
            g = error * x
            square[u] += g * g
            weight[u] -= rate * g / np.sqrt(square[u])
    weight = np.sign(weight) * np.maximum(np.abs(weight) - l1 * (step - seen) * rate / np.sqrt(square), 0)
    some = np.abs(weight) > 1e-3
    return Classifier(keys[some], weight[some], bias)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", seed_rows: int = SEED_ROWS, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN, train_bytes: int = TRAIN_BYTES, seed: int = 3) -> DataFrame:
    """(doc_id, votes, posterior, probability, flagged) of all documents; flagged: probability of at least one half."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("txt"))
    lab = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    table = _stem_table(mine(rows, lab, seed_rows, seed, train_bytes))
    # 16 bytes a document: what the model counts, and what the sample is drawn by
    key = F.xxhash64("id", "txt", F.lit(seed + 1))
    ballots = common.cut(common.append(rows.withColumn("h", key), "txt", lambda part: {"votes": pa.array(votes_of(U.text_column(part, "txt"), table))}, [("votes", T.LongType())], ["h"]))
    seen = ballots.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toArrow()
    kinds, counts = seen.column("votes").to_numpy(), seen.column("n").to_numpy().astype(float)
    model = fit_label_model(kinds, counts) if len(kinds) else LabelModel(0.01, [-1] * VOTERS, np.full((2, VOTERS, 2), 0.5))
    guess = model.posterior(kinds)
    bad = [int(v) for v in kinds[guess >= 0.5]]
    share = lambda most, n: int(min(1.0, most / max(n, 1)) * (1 << 30))
    is_bad = F.col("votes").isin(bad) if bad else F.lit(False)
    drawn = ballots.where(F.pmod("h", F.lit(1 << 30)) < F.when(is_bad, share(train_toxic, counts[guess >= 0.5].sum())).otherwise(share(train_clean, counts[guess < 0.5].sum())))
    picked = drawn.select("h").distinct().limit(2 * (train_toxic + train_clean))  # about half of that are drawn
    sample = rows.where(F.octet_length("txt") <= train_bytes).withColumn("h", key).join(F.broadcast(picked), "h").select("h", "txt").dropDuplicates(["h"]).toArrow()
    texts = [t for _, t in sorted(zip(sample.column("h").to_pylist(), sample.column("txt").to_pylist()))]
    target = np.concatenate([np.zeros(0), *(model.posterior(votes_of(part, table)) for _, part in _slices(pa.array(texts, pa.string())))])
    judge = train_classifier(texts, target)

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        col = U.text_column(part, "txt")
        votes = votes_of(col, table)
        return {"votes": pa.array(votes), "posterior": pa.array(model.posterior(votes)), "probability": pa.array(judge.probability(col))}

    fields = [("votes", T.LongType()), ("posterior", T.DoubleType()), ("probability", T.DoubleType())]
    out = common.append(rows, "txt", make, fields, ["id"])
    return out.select(F.col("id").alias(doc_id), "votes", "posterior", "probability", (F.col("probability") >= 0.5).alias("flagged"))
