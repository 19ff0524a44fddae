"""N-gram Jaccard join by Bayesian candidate pruning.

Texts are sets of hashed word n-grams (64 bits; a text of 1 to n-1 words is one shorter n-gram). Candidates are texts
that agree in a band of MinHash values. For a candidate pair the values are compared a few at a time; as soon as the
posterior probability that the Jaccard similarity reaches the threshold, given the matches so far and a uniform prior,
is below ``tolerance``, the pair is dropped. The rest are verified exactly on the n-gram sets.

Plan. Equal texts are one vertex, named by 128 bits of their hash, so that thousands of copies cost one comparison.
Bands that only one text has go. In each of the other bands the pruning is done on the low bytes of the MinHash values
(which can only match more often) and reduced to a spanning forest, so that texts which merely fall into one band are
not tied together and no band emits its pairs; bands of over ``block`` texts are split in blocks, and each pair of
blocks is a task. Each text is then sent once to its component of that forest, where the pairs that share a band are
pruned on the whole values and verified; components of over ``block`` texts are split likewise. A task returns for each
of its texts the number of its links and one link of a spanning forest, never the pairs (but for ``pairs``).

Defined cases: null texts have no row; texts without a word are alone in their class. Rows with a null doc_id are no
result of ``classes`` and ``pairs`` but count as copies in ``keep_one``. Repeated rows (same id and text) are one. Rows
that share an id but not a text are compared like others. A similarity equal to the threshold is a link. Very long texts
are taken whole, a set of all their n-grams. doc_id may have any orderable type. Empty tables give empty results; extra
columns are ignored (``classes``, ``pairs``) or kept (``keep_one``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph
from . import textkit as tk
from . import units as U

NGRAM, THRESHOLD, TOLERANCE = 3, 0.5, 0.01
BANDS, ROWS = 30, 3
STEP, BLOCK = 9, 2000
HAS_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"

_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def ngram_sets(col: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, text by text, repeats included, and per text the index of its first (rows + 1)."""
    w = tk.words_of(col)
    h, at = tk.shingle_hash(w, n)
    row = w.row[at]
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            more = counts[short] > j
            acc[more] = tk.mix64(acc[more] * tk._P + w.hash[w.first[short[more]] + j] + np.uint64(1))
        place = np.searchsorted(row, short)
        h, row = np.insert(h, place, acc), np.insert(row, place, short)
    return h, np.searchsorted(row, np.arange(len(counts) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, (texts, BANDS * ROWS) of uint32; texts without n-grams have 2**32 - 1 throughout."""
    full = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, len(_MUL)), 0xFFFFFFFF, np.uint32)
    if len(full):
        at = first[full]
        for k in range(len(_MUL)):
            out[full, k] = np.minimum.reduceat((((h ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) of int64, different from band to band."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for j in range(ROWS):
        acc = tk.mix64(acc * tk._P + s[:, :, j])
    return acc.view(np.int64)


def least_matches(threshold: float, tolerance: float, total: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m matches has P(J >= threshold) < tolerance."""
    out = []
    for n in range(step, total + 1, step):
        m = 0
        # posterior Beta(m + 1, n - m + 1): P(J >= t) = P(Bin(n + 1, t) <= m)
        tail = comb(n + 1, 0) * (1 - threshold) ** (n + 1)
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def similar(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that share a band, survive pruning and reach the threshold: i, j, Jaccard."""
    keys = band_keys(sig)
    table = least_matches(threshold, tolerance)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    words, code = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    seen = np.zeros(len(words), bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, i in enumerate(left):
        js = right[n + 1 :] if same else right
        js = js[(keys[js] == keys[i]).any(axis=1)]
        at = 0
        match = np.zeros(len(js), np.int64)
        for upto, least in table:
            if not len(js):
                break
            match = match + (sig[js, at:upto] == sig[i, at:upto]).sum(axis=1)
            ok = match >= least
            js, match, at = js[ok], match[ok], upto
        js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i])]
        if not len(js):
            continue
        mine = code[first[i] : first[i + 1]]
        seen[mine] = True
        inter = tk.segment_sum(seen[U.ragged(code, first[js], size[js])], np.concatenate([[0], np.cumsum(size[js])])).astype(np.int64)
        seen[mine] = False
        union = size[js] + size[i] - inter
        ok = inter >= threshold * union
        out.append((np.full(int(ok.sum()), i), js[ok], inter[ok] / union[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Places in ``a`` and ``b`` of the pairs of rows of ``sig`` that pruning leaves."""
    alive, match, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for upto, least in table:
        match = match + (sig[a[alive], at:upto] == sig[b[alive], at:upto]).sum(axis=1)
        ok = match >= least
        alive, match, at = alive[ok], match[ok], upto
    return alive


def forest(sig: np.ndarray, edge: np.ndarray, table: list[tuple[int, int]], pairs: int = 200_000) -> np.ndarray:
    """Per row the least row that it is tied to; rows edge[g]:edge[g + 1] of ``sig`` are compared with each other.

    All rows are compared with the first of their group; where that leaves several classes, all pairs that aren't in one
    class already are compared, about ``pairs`` at a time.
    """
    m, size = edge[-1], np.diff(edge)
    label, head = np.arange(m), np.repeat(edge[:-1], size)
    rest = np.flatnonzero(head != np.arange(m))
    ok = survivors(sig, rest, head[rest], table)
    label[rest[ok]] = head[rest[ok]]
    bad = np.unique(head[label != head])
    if not len(bad):
        return label
    member = np.flatnonzero(np.isin(head, bad))
    after = (head + np.repeat(size, size) - 1 - np.arange(m))[member]  # rows of the group that follow
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(member):
        to = max(at + 1, int(np.searchsorted(total, total[at] + pairs, side="right")) - 1)
        i = np.repeat(member[at:to], after[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[at:to] - total[at], after[at:to])
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        ok = survivors(sig, i, j, table)
        graph.union(label, i[ok], j[ok])
        at = to
    return label


def _worded(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), t.alias("txt")).where(F.col("txt").rlike(HAS_WORD)).withColumn("cid", identity(F.col("txt")))


def identity(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text))


def _rows_of_bytes(values: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    width = values.shape[1] * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(values))])


def _in_blocks(rows: DataFrame, group: str, n: Column, block: int, own: bool) -> DataFrame:
    """``rows`` with ``i``, ``j`` and ``mine``: a row for each pair of blocks that its own block ``mine`` is in.

    Groups of up to ``block`` rows are one block. With ``own`` each block is a pair with itself, too; without, a pair of
    blocks stands for all pairs of its rows.
    """
    size = max(1, block if own else block // 2)
    rows = rows.withColumn("nb", F.when(n <= block, 1).otherwise(F.ceil(n / size)).cast("int")).withColumn("mine", F.pmod(F.hash("cid"), F.col("nb")))
    each = F.sequence(F.lit(0), F.col("nb") - 1)
    others = each if own else F.filter(each, lambda k: (F.col("nb") == 1) | (k != F.col("mine")))
    spread = rows.withColumn("t", F.explode(F.transform(others, lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))))
    return spread.select("*", "t.i", "t.j").drop("t", "nb").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def candidates(rows: DataFrame, n: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Edges (u, v) of forests that span all texts of a band that pruning leaves together."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        sig = signatures(*ngram_sets(U.text_column(part, "txt"), n))
        keys = band_keys(sig)
        return {"bands": pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel())), "sig": _rows_of_bytes(sig.astype(np.uint8))}

    every = common.append(rows, "txt", make, [("bands", T.ArrayType(T.LongType())), ("sig", T.BinaryType())], ["cid"])
    owner = uuid.uuid4().hex
    signed = common.written(every.groupBy("cid").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")), owner)
    flat = signed.select("cid", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = flat.join(shared, "band").groupBy("cid").agg(F.collect_list(F.struct("band", "n")).alias("shared"))
    told = signed.select("cid", "sig").join(mine, "cid").select("cid", "sig", F.explode("shared").alias("b")).select("cid", "sig", "b.band", "b.n")
    table = least_matches(threshold, tolerance)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, ["band", "i", "j"]):
            if not len(t):
                continue
            keys = [t.column(k).to_numpy() for k in ("band", "i", "j")]
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(t)]])
            raw, _ = tk.string_buffers(t.column("sig").chunk(0))
            label = forest(raw.reshape(len(t), -1), edge, table)
            tied = np.flatnonzero(label != np.arange(len(t)))
            cid = t.column("cid").chunk(0)
            yield pa.RecordBatch.from_arrays([cid.take(pa.array(tied)), cid.take(pa.array(label[tied]))], names=["u", "v"])
        common.tidy()

    edges = common.cut(_in_blocks(told, "band", F.col("n"), block, False).select("cid", "sig", "band", "i", "j").mapInArrow(tie, "u binary, v binary").distinct())
    common.drop_written(owner)
    return edges


def _verified(rows: DataFrame, n: int, threshold: float, tolerance: float, block: int, pairs: bool) -> DataFrame:
    """Per task (u, v, jaccard) of all pairs that reach the threshold, or (u, v, links): a text, the least that it is tied to, and the number of its links."""
    comp = graph.components(candidates(rows, n, threshold, tolerance, block))
    size = comp.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    comp = comp.join(size, "root").select(F.col("node").alias("cid"), "root", "size")
    texts = rows.join(comp, "cid").select("cid", F.xxhash64("root").alias("root"), "size", "txt")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the join leaves equal texts side by side: one of them is enough
            cid = batch.column(0)
            new = np.ones(len(cid), bool)
            new[1:] = pc.not_equal(cid.slice(1), cid.slice(0, len(cid) - 1)).to_numpy(zero_copy_only=False)
            new[0] = cid[0].as_py() != last
            last = cid[-1].as_py()
            for part in tk.byte_slices(batch.filter(pa.array(new)), "txt"):
                h, first = ngram_sets(U.text_column(part, "txt"), n)
                grams = pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], grams, _rows_of_bytes(signatures(h, first))], names=["cid", "root", "size", "grams", "sig"])
        common.tidy()

    made = texts.mapInArrow(sets, "cid binary, root bigint, size bigint, grams binary, sig binary")
    spread = _in_blocks(made, "root", F.col("size"), block, True).select("cid", "root", "grams", "sig", "mine", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, ["root", "i", "j"]):
            if not len(whole):
                continue
            keys = [whole.column(k).to_numpy() for k in ("root", "i", "j")]
            edge = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(whole)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                t = whole.slice(lo, hi - lo)
                code = t.column("cid").chunk(0).dictionary_encode().indices.to_numpy()
                _, at = np.unique(code, return_index=True)  # equal texts: one
                t = t.take(pa.array(at)).combine_chunks()
                cid, mine = t.column("cid").chunk(0), t.column("mine").to_numpy()
                i, j = int(keys[1][lo]), int(keys[2][lo])
                grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(t), -1)
                a, b, s = similar(grams, sig, np.flatnonzero(mine == i), np.flatnonzero(mine == j), i == j, threshold, tolerance)
                if pairs:
                    yield pa.RecordBatch.from_arrays([cid.take(pa.array(a)), cid.take(pa.array(b)), pa.array(s)], names=["u", "v", "jaccard"])
                    continue
                links = np.bincount(a, minlength=len(t)) + np.bincount(b, minlength=len(t))
                label = np.arange(len(t))
                graph.union(label, a, b)
                tied = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([cid.take(pa.array(tied)), cid.take(pa.array(label[tied])), pa.array(links[tied])], names=["u", "v", "links"])
        common.tidy()

    return spread.mapInArrow(compare, "u binary, v binary, jaccard double" if pairs else "u binary, v binary, links bigint")


def pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs of different texts that reach the threshold, each named by its least id.

    Its rows grow with the square of a group of near copies; ``classes`` says the same in a row per document.
    """
    rows = _worded(docs, doc_id, text).where("id is not null")
    low = rows.groupBy("cid").agg(F.min("id").alias("id"))
    found = _verified(rows, n, threshold, tolerance, block, True)
    both = found.join(low.select(F.col("cid").alias("u"), F.col("id").alias("x")), "u").join(low.select(F.col("cid").alias("v"), F.col("id").alias("y")), "v")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copies, links): a row per document.

    ``class_id`` is the least id of the component of the join that the document is in, its own if it is alone.
    ``copies`` counts the documents with its text, itself included, ``links`` the different texts that reach the
    threshold with it.
    """
    every = docs.where(F.col(f"`{doc_id}`").isNotNull())
    rows = _worded(every, doc_id, text)
    found = common.cut(_verified(rows, n, threshold, tolerance, block, False))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    comp = graph.components(found)
    ids = rows.select("cid", "id").distinct()
    texts = ids.groupBy("cid").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    linked = links.join(comp, F.col("u") == F.col("node")).select(F.col("u").alias("cid"), "root", "links").join(texts, "cid")
    least = linked.groupBy("root").agg(F.min("low").alias("class_id"))
    linked = linked.join(least, "root").select("cid", "class_id", "links")
    told = texts.join(linked, "cid", "left").select("cid", F.coalesce("class_id", "low").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    t = F.col(f"`{text}`").cast("string")
    wordless = every.where(t.isNotNull() & ~t.rlike(HAS_WORD)).select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("txt")).distinct()
    alone = wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("links"))
    return ids.join(told, "cid").select(F.col("id").alias("doc_id"), "class_id", "copies", "links").union(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``docs`` without all but one document of each class.

    The document with the least id of the class stays (nulls last); of repeated rows the least by its other columns.
    Texts without a word, null ones included, all stay. Copies are aggregated before the shuffle.
    """
    worded = _worded(docs, doc_id, text)
    found = common.cut(_verified(worded, n, threshold, tolerance, block, False))
    comp = graph.components(found)
    order = lambda i, *more: F.struct(i.isNull().alias("none"), i.alias("id"), *more)
    least = worded.groupBy("cid").agg(F.min(order(F.col("id"))).alias("k"))
    placed = comp.join(least, F.col("node") == F.col("cid")).select("node", "root", F.struct("k", "node").alias("k"))
    first = placed.groupBy("root").agg(F.min("k").alias("first"))
    gone = placed.join(first, "root").where(F.col("k.node") != F.col("first.node")).select("node")
    t, i = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    with_word = F.coalesce(t.rlike(HAS_WORD), F.lit(False))
    names = [F.col(f"`{c}`") for c in docs.columns]
    # one row of each text: an aggregate combines copies before they are sent anywhere
    one = docs.where(with_word).groupBy(identity(t).alias("cid")).agg(F.min_by(F.struct(*names), order(i, F.xxhash64(*names).alias("h"))).alias("row"))
    return docs.where(~with_word).union(one.join(gone, F.col("cid") == F.col("node"), "left_anti").select("row.*"))
