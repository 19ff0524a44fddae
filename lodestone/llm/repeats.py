"""Suffix-array dedup: all maximal repeats of at least ``min_words`` words, each with all its occurrences.

A repeat is a run of words (lower-cased, white space and punctuation aside) that occurs at least twice, of which
neither all left nor all right neighbours agree; the end of a text agrees with nothing. Repeats inside one text count.

How it stays small: every window of ``min_words`` words has an anchor, the word 12-gram in it with the least hash, so
occurrences of a repeat share the anchor of their first window. Anchors of all windows of all texts are counted.
Where all occurrences of an anchor follow the same 39 words, no repeat can begin at windows of that anchor. For the
other anchors that occur more than once, suffixes are made, up to the end of the run of windows whose anchors repeat,
beyond which no common prefix reaches. Equal suffixes are one class, aggregated before the shuffle: its words, the
number of its places, and the least and greatest of the words before them, which say whether their left neighbours
differ. So a passage that a third of all documents have is a few rows in the partition of its anchor. There the classes
that begin with the same window are sorted (an enhanced suffix array with common-prefix lengths and left neighbours; a
class of several places stands twice, once with either neighbour); one scan with a stack gives the intervals of the
common-prefix tree, and those whose left neighbours differ are the repeats. A join gives each class its places back.
Nothing is sampled: the result is that of one suffix array over all texts.

The result. Copies of g texts have about g nested repeats of g places each, so a row per repeat and occurrence would
grow with the square of a group. Repeats are told by intervals instead: each place at which repeats begin is one row,
with the longest of them, its own ``place`` in the order of the suffixes of its ``group_id`` (those that begin with the
same window), and that repeat's ``first_place`` and ``last_place``. The occurrences of a repeat are all rows of its group
whose place is in the interval; ``expand`` lists them. A repeat that is nowhere the longest has a row of its own, at its
first occurrence, without a place.

Periodic runs: words that go on with a period of at most 25 words (half of ``min_words`` if that is less) for
``min_words`` and a period more. A word said a thousand times would be a thousand nested repeats of a thousand places
each, so what lies wholly inside runs is told compactly: a repeat with a ``period`` has the first places only, and
``run`` says for how many words the period goes on from each; it stands for all its shifts by the period and all
its shorter forms in these runs. Each run is in such a repeat: with the runs that have as many of its words in common,
or by itself, as the run without its last period, at its first two places. Repeats that begin inside a run and go on
after its end have all their places: where the runs are longer, only tails that are as long as a whole run can begin
one, as others have the same word before them everywhere. Repeats that begin inside runs have a row per occurrence and
no ``first_place``.

Between tasks the words of a class are told in two bytes each: their places in a code book of frequent words, which the
first texts of every task say how often. Words that aren't in it are told by their whole hashes, so the book makes rows
smaller and changes no result.

Words are compared by 32-bit hashes inside a bucket of equal 64-bit anchor hashes: 50 unlike words agree with a
probability of 2**-1600, a single word at an end of a repeat with 2**-32. Equal suffixes are told by 128 bits.

Defined cases: null and empty texts and texts under ``min_words`` words have no repeats. Rows with equal id and text
are one document. doc_id may have any orderable type; a null one stays null, and comes last in the order. Very long
texts are taken whole; one text is one row of a Python worker. Ties: of equally early occurrences (null ids) that of the
least row hash is the first. Empty tables give empty results. Extra columns are ignored by ``repeats`` and kept by
``cut_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from . import textkit as tk
from . import units as U

MIN_WORDS, ANCHOR, PERIOD = 50, 12, 25
LISTED, KNOWN, BUCKETS = 100_000, 20_000, 1 << 20
#: Words of a code book at most, and the code of the others; how often a task must have seen a word to propose it.
BOOK, OFTEN = (1 << 16) - 1, 4


class Windows:
    """Windows of ``size`` words of several texts: validity, liveness and anchors. Indices count all words in order.

    ``live`` windows equal none at most a period before them, ``second`` ones equal live ones, ``run`` ones are in a run.
    """

    def __init__(self, words: tk.Words, size: int):
        k = min(ANCHOR, size)
        self.words, self.size, self.reach = words, size, size - k + 1
        n = len(words.hash)
        p, inv = tk._power(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * p[:n], dtype=np.uint64)])
        self.inv = inv
        m = n - size + 1
        if m <= 0:
            self.valid = self.live = self.second = self.run = np.zeros(0, bool)
            self.anchor = np.zeros(0, np.int64)
            return
        i = np.arange(m)
        self.valid = words.row[:m] == words.row[size - 1 :]
        whole = self.span(i, i + size)
        back = np.zeros(m, np.int64)
        for d in range(min(PERIOD, size // 2, m - 1), 0, -1):
            back[d:][(whole[d:] == whole[:-d]) & self.valid[d:] & (words.row[d:m] == words.row[: m - d])] = d
        dead = np.flatnonzero(back)
        self.live = self.valid & (back == 0)
        self.second = np.zeros(m, bool)
        self.second[dead] = back[dead - back[dead]] == 0
        cover = np.bincount(dead - back[dead], minlength=m + 1) - np.bincount(dead + 1, minlength=m + 1)
        self.run = np.cumsum(cover)[:m] > 0
        j = np.arange(n - k + 1)
        key = (self.span(j, j + k) & np.uint64(0xFFFFFFFF00000000)) | j.astype(np.uint64)
        step = 1
        while step * 2 <= self.reach:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        rest = self.reach - step
        key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        self.anchor = (key[:m] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tk.mix64((self.sums[b] - self.sums[a]) * self.inv[a])


def _anchors(col: pa.Array, rid: np.ndarray, size: int):
    """(row, position in the text, anchor hash, hash of what precedes it) of the anchors of all live and second windows."""
    w = Windows(tk.words_of(col), size)
    k = min(ANCHOR, size)
    q = w.anchor[w.live | w.second]
    q = q[np.concatenate([[True], q[1:] != q[:-1]])] if len(q) else q
    row = w.words.row[q]
    begin = w.words.first[row]
    left = np.maximum(q - w.reach, begin)
    before = w.span(left, q) ^ tk.mix64((q - left).astype(np.uint64))
    # the window at the start of a text has no left neighbour: nothing else precedes like that
    opens = w.anchor[np.minimum(begin, len(w.anchor) - 1)] == q if len(q) else np.zeros(0, bool)
    before = np.where(opens, tk.mix64(rid[row].astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), before)
    return row, (q - begin).astype(np.int32), w.span(q, q + k).view(np.int64), before.view(np.int64)


def _frequent(col: pa.Array) -> pa.RecordBatch:
    """Rows like those of the anchors, without a ``rid``: in ``a`` words that are said OFTEN, in ``q`` how often."""
    word, n = np.unique(tk.words_of(col).hash.astype(np.uint32), return_counts=True)
    word, n = word[n >= OFTEN], n[n >= OFTEN]
    none = pa.nulls(len(word), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int32)), pa.array(word.astype(np.int64)), none], names=["rid", "q", "a", "before"])


def _coded(low: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted ``book``, or BOOK."""
    at = np.searchsorted(book, low)
    known = np.append(book, 0)[at] == low
    return np.where(known & (at < len(book)), at, BOOK).astype("<u2")


def _decoded(codes: np.ndarray, rare: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The words of codes; ``rare`` are those that have no code, in order."""
    out = np.zeros(BOOK + 1, np.uint32)
    out[: len(book)] = book
    out = out[codes]
    out[codes == BOOK] = rare
    return out


def _suffixes(part: pa.RecordBatch, size: int, classes: dict[bytes, list], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per anchor at which a repeat may begin, with the class of the words from its first window to the end of the
    run; the classes are counted in ``classes``, with ``mask``, the windows of the anchor."""
    w = Windows(tk.words_of(U.text_column(part, "txt")), size)
    first, lists = w.words.first, part.column(part.schema.get_field_index("marks"))
    flat, off = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    at = flat.field(0).to_numpy() + np.repeat(first[:-1], np.diff(off))
    diverse = flat.field(1).to_numpy(zero_copy_only=False)
    m, n = len(w.valid), len(w.words.hash)
    repeated = np.zeros(n + 1, bool)
    repeated[at] = True
    ok = w.valid & (repeated[w.anchor] | ~w.live | w.run)
    bad = np.where(ok, m, np.arange(m))
    stop = np.minimum.accumulate(bad[::-1])[::-1] + size - 1  # end of the words that the run of windows covers
    begins = np.zeros(n + 1, bool)
    begins[at[diverse]] = True
    mine = np.flatnonzero(w.live & begins[w.anchor]) if m else np.zeros(0, np.int64)
    anchor = w.anchor[mine]
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(mine) else np.zeros(0, np.int64)
    base, a = mine[head], anchor[head]
    group = np.cumsum(np.bincount(head, minlength=len(mine))) - 1 if len(mine) else np.zeros(0, np.int64)
    mask = np.zeros(len(head), np.int64)
    np.bitwise_or.at(mask, group, np.left_shift(np.int64(1), mine - base[group]))
    row = w.words.row[base]
    low = (w.words.hash & np.uint64(0xFFFFFFFF)).astype(">u4")
    length = stop[base] - base
    data = U.ragged(low, base, length).tobytes()
    off = np.concatenate([[0], np.cumsum(length * 4)]).tolist()
    code = _coded(low.astype(np.uint32), book)
    other = np.concatenate([[0], np.cumsum(code == BOOK)])
    codes, rare = U.ragged(code, base, length).tobytes(), low[code == BOOK].astype("<u4").tobytes()
    ids = part.column(part.schema.get_field_index("id")).take(pa.array(row))
    rid = part.column(part.schema.get_field_index("rid")).to_numpy()[row]
    # the start of a text has a left neighbour like no other
    none = (1 << 32) + (tk.mix64(rid.view(np.uint64)) >> np.uint64(2)).astype(np.int64)
    left = np.where(base > first[row], low[np.maximum(base - 1, 0)].astype(np.int64), none) if len(base) else none
    k = min(ANCHOR, size)
    a = w.span(a, a + k).view(np.int64)
    first_at = (base - first[row]).astype(np.int32)
    key = []
    for h, m, x, y, n, i, r, at_, u, v in zip(a.tolist(), mask.tolist(), off[:-1], off[1:], left.tolist(), ids.to_pylist(), rid.tolist(), first_at.tolist(), other[base].tolist(), other[base + length].tolist()):
        name = hashlib.blake2b(data[x:y], digest_size=16, key=h.to_bytes(8, "big", signed=True) + m.to_bytes(8, "big")).digest()
        key.append(name)
        order = (i is None, i, r, at_)
        have = classes.get(name)
        if have is None:
            classes[name] = [h, m, 1, n, n, order, codes[x // 2 : y // 2], rare[4 * u : 4 * v]]
        else:
            have[2] += 1
            have[3], have[4] = min(have[3], n), max(have[4], n)
            have[5] = min(have[5], order)
    none_ = pa.nulls(len(key))
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(none_.cast(t) for t in (pa.int64(),) * 5), ids, pa.array(rid), pa.array(first_at), none_.cast(pa.binary()), none_.cast(pa.binary())], names=NAMES)


NAMES = ["c", "a", "mask", "n", "low", "high", "id", "rid", "base", "words", "rare"]


def _told(classes: dict[bytes, list], kind: pa.DataType) -> pa.RecordBatch:
    """The rows of ``classes``, which is emptied; its id, rid and base are those of the first place."""
    a, mask, n, low, high, order, words, rare = zip(*classes.values())
    out = pa.RecordBatch.from_arrays([pa.array(list(classes), pa.binary()), *(pa.array(x, pa.int64()) for x in (a, mask, n, low, high)), pa.array([o[1] for o in order], kind), pa.array([o[2] for o in order], pa.int64()), pa.array([o[3] for o in order], pa.int32()), pa.array(words, pa.binary()), pa.array(rare, pa.binary())], names=NAMES)
    classes.clear()
    return out


def intervals(suffix: list[bytes], left: list[int], size: int) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """Suffixes of 4-byte words in order, the common-prefix length of each with the next, and the maximal repeats of at
    least ``size`` words as (length, first, last) in that order, longer ones before those that hold them."""
    order = sorted(range(len(suffix)), key=suffix.__getitem__)
    lcp = []
    for x, y in zip(order[:-1], order[1:]):
        s, t = suffix[x], suffix[y]
        m = min(len(s), len(t))
        if s[:m] == t[:m]:
            lcp.append(m // 4)
        else:
            differ = np.frombuffer(s, np.uint32, m // 4) != np.frombuffer(t, np.uint32, m // 4)
            lcp.append(int(differ.argmax()))
    run = [0] * len(order)  # where the run of equal left neighbours that ends here begins
    for i in range(1, len(order)):
        run[i] = run[i - 1] if left[order[i]] == left[order[i - 1]] else i
    found = []
    stack: list[tuple[int, int]] = []
    for i, h in enumerate([*lcp, 0]):
        at = i
        while stack and stack[-1][0] > h:
            length, at = stack.pop()
            if length >= size and run[i] > at:
                found.append((length, at, i))
        if h and (not stack or stack[-1][0] < h):
            stack.append((h, at))
    return order, lcp, found


def tree(suffix: list[bytes], left: list[int], size: int) -> Iterator[tuple[int, list[int]]]:
    """(length in words, suffixes) of the maximal repeats of at least ``size`` words."""
    order, _, found = intervals(suffix, left, size)
    for length, at, end in found:
        yield length, order[at : end + 1]


def nested(found: list[tuple[int, int, int]], places: int) -> tuple[list[int], list[int]]:
    """The innermost interval of each place (-1 if it has none), and the one around each interval (-1)."""
    owner, around = [-1] * places, [-1] * len(found)
    open_: list[int] = []
    at = 0
    pending: list[int] = []
    for k, (_, first, last) in enumerate(found):
        while at <= last:
            pending.append(at)
            at += 1
        while pending and pending[-1] >= first:
            owner[pending.pop()] = k
        while open_ and found[open_[-1]][1] >= first:
            around[open_.pop()] = k
        open_.append(k)
    return owner, around


def periodic(suffix: list[bytes], left: list[int], period: int, size: int) -> Iterator[tuple[int, int, list[tuple[int, int]], list[int]]]:
    """(length, period or 0, (suffix, words to skip) of the places, runs) of the repeats of suffixes that begin alike with a period.

    There is one suffix for each run, its first with these words.
    """
    runs = []
    for s in suffix:
        x = np.frombuffer(s, np.uint32)
        differ = x[period:] != x[:-period]
        runs.append(int(differ.argmax()) + period if differ.any() else len(x))
    before = int(np.frombuffer(suffix[0], ">u4", 1, 4 * (period - 1))[0])  # what precedes these words inside a run
    told = set()
    if len(suffix) > 1:
        for length, members in tree(suffix, left, size):
            if length <= runs[members[0]]:
                yield length, period, [(k, 0) for k in members], [runs[k] for k in members]
                told.update(members)
    for run in {runs[k] for k in range(len(suffix)) if k not in told and left[k] != before and runs[k] >= size + period}:
        places = [(k, skip) for k in range(len(suffix)) for skip in (0, period) if runs[k] - skip >= run - period]
        yield run - period, period, places, [runs[k] - skip for k, skip in places]
    # past the end of a run: those whose runs end at the same place of the period and go on with the same word
    by: dict[tuple[int, bytes], list[int]] = {}
    for k, s in enumerate(suffix):
        if len(s) > 4 * runs[k]:
            by.setdefault((runs[k] % period, s[4 * runs[k] : 4 * runs[k] + 4]), []).append(k)
    for mine in by.values():
        for tail in {runs[k] for k in mine if left[k] != before}:
            here = [k for k in mine if runs[k] >= tail]
            if len(here) > 1:
                lefts = [left[k] if runs[k] == tail else before for k in here]
                for length, members in tree([suffix[k][4 * (runs[k] - tail) :] for k in here], lefts, size):
                    if length > tail:
                        yield length, 0, [(here[j], runs[here[j]] - tail) for j in members], [0] * len(members)


def _periods(sums: np.ndarray, inv: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The least period, of at most PERIOD and half the window, of each window; 0 where there is none."""
    span = lambda a, b: (sums[b] - sums[a]) * inv[a]
    out = np.zeros(len(at), np.int64)
    for d in range(min(PERIOD, size // 2), 0, -1):
        out[span(at, at + size - d) == span(at + d, at + size)] = d
    return out


def _merged(t: pa.Table) -> pa.Table:
    """One row per class of the rows that several tasks have for it."""
    t = t.combine_chunks()
    code = t.column("c").chunk(0).dictionary_encode().indices.to_numpy()
    ids = t.column("id").chunk(0)
    kinds = pc.unique(ids.drop_null())
    rank = pc.fill_null(pc.index_in(ids, kinds.take(pc.array_sort_indices(kinds)), skip_nulls=True), len(kinds)).to_numpy()
    order = np.lexsort((t.column("base").to_numpy(), t.column("rid").to_numpy(), rank, code))
    head = order[np.concatenate([[True], code[order][1:] != code[order][:-1]])]
    n, low, high = (t.column(c).to_numpy() for c in ("n", "low", "high"))
    total, least, most = np.zeros(len(head), np.int64), low[head].copy(), high[head].copy()
    np.add.at(total, code, n)
    np.minimum.at(least, code, low)
    np.maximum.at(most, code, high)
    out = t.take(pa.array(head))
    for c, v in (("n", total), ("low", least), ("high", most)):
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(v))
    return out.append_column("rank", pa.array(rank[head])).combine_chunks()


def _repeats(table: pa.Table, size: int, book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The repeats of whole buckets of classes: a row for each class and place in it, in batches of about LISTED rows."""
    table = _merged(table)
    a, mask, count, rank, rids, base = (table.column(c).to_numpy() for c in ("a", "mask", "n", "rank", "rid", "base"))
    (codes, off), (rare, _) = (tk.string_buffers(table.column(c).chunk(0)) for c in ("words", "rare"))
    data, off = _decoded(np.frombuffer(codes.tobytes(), "<u2"), np.frombuffer(rare.tobytes(), "<u4"), book), off // 2
    raw, data = data.astype(">u4").tobytes(), data.astype(np.uint64)
    bits = (mask[:, None] >> np.arange(size)) & 1
    row, shift = np.nonzero(bits)
    # a class of several places stands twice, with the least and the greatest of what is before them
    twice = np.repeat(np.arange(len(row)), np.minimum(count[row], 2))
    second = np.concatenate([[False], twice[1:] == twice[:-1]]) if len(twice) else np.zeros(0, bool)
    row, shift = row[twice], shift[twice]
    at = off[:-1][row] + shift
    p, inv = tk._power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * p[: len(data)], dtype=np.uint64)])
    key = tk.mix64(tk.mix64((sums[at + size] - sums[at]) * inv[at]) ^ tk.mix64(a[row].view(np.uint64)))
    before = np.where(second, table.column("high").to_numpy()[row], table.column("low").to_numpy()[row])
    left = np.where(shift == 0, before, data[np.maximum(at - 1, 0)].astype(np.int64))
    order = np.lexsort((left, key))
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    lo, hi = edge[:-1], edge[1:]
    period = _periods(sums, inv, at[order[lo]], size) if len(lo) else np.zeros(0, np.int64)
    keep = ((hi - lo > 1) & (left[order[lo]] != left[order[hi - 1]])) | (period > 0) if len(lo) else np.zeros(0, bool)
    # how the first occurrences of all entries are ordered: null, id, rid, start
    begin = base[row] + shift
    by = np.lexsort((begin, rids[row], rank[row]))
    early = np.empty(len(by), np.int64)
    early[by] = np.arange(len(by))
    names, ids = table.column("c").chunk(0), table.column("id").chunk(0)
    short = np.frombuffer(b"".join(names.to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
    weight = np.where(second, 0, count[row])
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        entry, ahead, run, words, cyclic, total, name, group, place, first, last, lead, other, own = (np.concatenate(col) for col in zip(*out))
        f = row[lead]
        whole = lambda x: pa.array(x.astype(np.int32), mask=x < 0)
        # a repeat by itself has no class: its row is its first occurrence
        c = pc.if_else(pa.array(own > 0), names.take(pa.array(row[entry])), pa.scalar(None, pa.binary()))
        start = begin[lead] + np.maximum(own - 1, 0)
        return pa.RecordBatch.from_arrays([*map(pa.array, (name, words.astype(np.int32), cyclic.astype(np.int32), total, other, ahead.astype(np.int32), run.astype(np.int32), group)), whole(place), whole(first), whole(last), c, ids.take(pa.array(f)), pa.array(rids[f]), pa.array(start.astype(np.int32))], names=list(FOUND))

    held = 0
    for x, y, p in zip(lo[keep].tolist(), hi[keep].tolist(), period[keep].tolist()):
        mine = order[x:y]
        suffix = [raw[4 * s : 4 * e] for s, e in zip(at[mine].tolist(), off[row[mine] + 1].tolist())]
        group = int(key[mine[0]].view(np.int64))
        if p:
            for length, cyclic, places, run in periodic(suffix, left[mine].tolist(), p, size):
                members, skip = np.array(places).T
                e, run = mine[members], np.array(run)
                one = np.unique(np.stack([row[e], shift[e] + skip]), axis=1, return_index=True)[1]
                e, skip, run = e[one], skip[one], run[one]
                total = int(count[row[e]].sum())
                if total < 2:
                    continue
                with np.errstate(over="ignore"):
                    name = tk.mix64(np.array([tk.mix64(short[row[e]] ^ tk.mix64((shift[e] + skip).astype(np.uint64))).sum() * tk._P + np.uint64(length * (size + 1) + cyclic)], np.uint64)).view(np.int64)[0]
                start = begin[e] + skip
                lead = np.lexsort((start, rids[row[e]], rank[row[e]]))[0]
                k = np.ones(len(e), np.int64)
                out.append((e, shift[e] + skip, run, k * length, k * cyclic, k * total, k * name, k * group, -k, -k, -k, k * e[lead], k * 0, k * (1 + skip[lead])))
                held += len(e)
        else:
            ordered, lcp, found = intervals(suffix, left[mine].tolist(), size)
            entries = mine[ordered]
            owner, around = nested(found, len(entries))
            place = np.concatenate([[0], np.cumsum([suffix[i] != suffix[j] for i, j in zip(ordered[:-1], ordered[1:])])]).astype(np.int64)
            sums_ = np.concatenate([[0], np.cumsum(weight[entries])])
            firsts, least = [len(row)] * len(found), early[entries].tolist()
            inside: list[list[int]] = [[] for _ in found]
            for i, k in enumerate(owner):
                if k >= 0:
                    inside[k].append(i)
            for k, up in enumerate(around):  # inner ones come first
                firsts[k] = min([firsts[k], *(least[i] for i in inside[k])])
                if up >= 0:
                    firsts[up] = min(firsts[up], firsts[k])
            rest = [0] * len(found)
            for k in range(len(found) - 1, -1, -1):
                up = around[k]
                if up >= 0:
                    rest[k] = found[up][0] if firsts[up] != firsts[k] else rest[up]
            for k, (length, first, last) in enumerate(found):
                total = int(sums_[last + 1] - sums_[first])
                name = int(tk.mix64(np.array([group & (1 << 64) - 1], np.uint64) ^ tk.mix64(np.array([length << 32 | int(place[first])], np.uint64))).view(np.int64)[0])
                i = np.array([j for j in inside[k] if weight[entries[j]]], np.int64)
                own = len(i) > 0
                e = entries[i] if own else by[[firsts[k]]]
                n = np.ones(len(e), np.int64)
                out.append((e, shift[e], n * 0, n * length, n * 0, n * total, n * name, n * group, place[i] if own else -n, n * place[first], n * place[last], n * by[firsts[k]], n * rest[k], n * own))
                held += len(e)
        if held > LISTED:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


FOUND = {"repeat_id": "bigint", "n_words": "int", "period": "int", "n_occurrences": "bigint", "other": "bigint", "ahead": "int", "run": "int", "group_id": "bigint", "place": "int", "first_place": "int", "last_place": "int", "c": "binary", "lead_id": "", "lead_rid": "bigint", "lead_start": "int"}


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, owner: str = "") -> DataFrame:
    """The rows of ``repeats`` with ``rid`` and ``cut``, the words that all but the first occurrences of repeats cover here.

    The first occurrence of a repeat is that with the least id (nulls last), row hash and start.
    """
    size, kind = min_words, docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("txt"), common.row_id(doc_id, text).alias("rid"))
    rows = rows.where(F.octet_length("txt") >= 2 * size - 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            for part in tk.byte_slices(batch, "txt"):
                if not begun:
                    yield _frequent(U.text_column(part, "txt"))
                    begun = True
                rid = part.column(0).to_numpy()
                row, q, a, before = _anchors(U.text_column(part, "txt"), rid, size)
                yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(q), pa.array(a), pa.array(before)], names=["rid", "q", "a", "before"])
        common.tidy()

    mine, spark = uuid.uuid4().hex, docs.sparkSession
    both = common.written(rows.select("rid", "txt").mapInArrow(anchors, "rid bigint, q int, a bigint, before bigint"), mine)
    said = both.where("rid is null").groupBy("a").agg(F.sum("q").alias("n")).orderBy(F.desc("n"), "a").limit(BOOK).toArrow()  # BOOK rows at most
    book = spark.sparkContext.broadcast(np.sort(said.column("a").to_numpy().astype(np.uint32)))
    every = both.where("rid is not null")
    counted = every.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("x"), F.max("before").alias("y")).where("n > 1").select("a", (F.col("x") != F.col("y")).alias("diverse"))
    marks = common.written(every.select("rid", "q", "a").join(counted, "a").groupBy("rid").agg(F.collect_list(F.struct("q", "diverse")).alias("marks"), F.max("diverse").alias("any")).where("any").select("rid", "marks"), f"{mine}-marks")
    common.drop_written(mine)
    common.release(spark)
    # texts of which no row has a mark needn't be sent to the join: a table of at most BUCKETS rows tells most of them
    bucket = F.pmod(F.col("rid"), F.lit(BUCKETS))
    some = common.cut(marks.select(bucket.alias("bucket")).distinct())
    here = rows if some.count() > BUCKETS // 2 else rows.join(F.broadcast(some), bucket == F.col("bucket"), "left_semi")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[bytes, list] = {}
        for batch in batches:
            for part in tk.byte_slices(batch, "txt"):
                yield from _suffixes(part, size, classes, book.value)
                if len(classes) > KNOWN:
                    yield _told(classes, ids)
        if classes:
            yield _told(classes, ids)
        common.tidy()

    ids = to_arrow_type(kind)
    fields = [T.StructField(n, t) for n, t in zip(NAMES, (T.BinaryType(), *[T.LongType()] * 5, kind, T.LongType(), T.IntegerType(), *[T.BinaryType()] * 2))]
    single = here.dropDuplicates(["rid"]).join(marks, "rid").select("id", "rid", "txt", "marks")
    told = common.written(single.mapInArrow(suffixes, T.StructType(fields)), owner, compression="zstd")
    common.drop_written(f"{mine}-marks")
    common.release(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, ["a"], 2_000_000):
            if len(t):
                yield from _repeats(t, size, book.value)
        common.tidy()

    found = told.where("n is not null").repartition("a").sortWithinPartitions("a").mapInArrow(scan, ", ".join(f"{n} {t or kind.simpleString()}" for n, t in FOUND.items()))
    member = told.where("n is null").select("c", "id", "rid", "base")
    placed = found.join(member, "c", "left").withColumn("start", F.coalesce(F.col("base") + F.col("ahead"), F.col("lead_start")))
    lone = F.col("c").isNull()
    first = (F.col("rid") == F.col("lead_rid")) & (F.col("start") == F.col("lead_start"))
    cut = F.when(lone, 0).when(first, F.col("other")).otherwise(F.col("n_words")).cast("int")
    return placed.select("repeat_id", "n_words", "n_occurrences", "period", F.when(lone, F.col("lead_id")).otherwise(F.col("id")).alias("id"), F.coalesce("rid", "lead_rid").alias("rid"), "start", "run", "group_id", "place", "first_place", "last_place", first.alias("first"), cut.alias("cut"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, repeat_id, n_words, n_occurrences, period, run, group_id, place, first_place, last_place): the places
    at which repeats begin, each with the longest of them. ``start`` counts words; see above, and ``expand``."""
    return occurrences(docs, doc_id, text, min_words).select(F.col("id").alias("doc_id"), "start", "repeat_id", "n_words", "n_occurrences", "period", "run", "group_id", "place", "first_place", "last_place")


def expand(found: DataFrame) -> DataFrame:
    """(repeat_id, n_words, n_occurrences, period, run, doc_id, start): every occurrence of every repeat of ``repeats``.

    Its rows grow with the square of a group of near copies.
    """
    told = ("repeat_id", "n_words", "n_occurrences", "period", "run")
    whole = found.where("first_place is null").select(*told, "doc_id", "start")
    each = found.where("first_place is not null").select("group_id", *told, "first_place", "last_place").distinct()
    at = found.where("place is not null").select("group_id", "place", "doc_id", "start")
    return each.join(at, "group_id").where("place between first_place and last_place").select(*told, "doc_id", "start").union(whole)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", min_words: int = MIN_WORDS, owner: str = "") -> DataFrame:
    """``docs`` with all occurrences of each repeat but the first (by id, then start) cut from the texts; of a periodic
    run one period stays at most.

    A cut goes from the first word of a repeat to the word after it. ``n_chars``, if there, is counted again where a
    text was cut. Rows stay, even with nothing left in them.
    """
    start, inside = F.col("start"), (F.col("period") > 0) & (F.col("run") >= min_words + F.col("period"))
    # of a run only the first period can be the first occurrence
    gone = occurrences(docs, doc_id, text, min_words, owner).where((F.col("cut") > 0) | inside)
    s, e = F.when(inside & F.col("first"), start + F.col("period")).otherwise(start), F.when(inside, start + F.col("run")).otherwise(start + F.col("cut"))
    spans = gone.groupBy("rid").agg(F.collect_list(F.struct(s.alias("s"), e.alias("e"))).alias("spans"))
    rid, cuts = common.fresh(docs, "rid"), common.fresh(docs, "spans")
    rows = docs.withColumn(rid, common.row_id(doc_id, text)).join(spans.select(F.col("rid").alias(rid), F.col("spans").alias(cuts)), rid, "left")
    names = docs.columns
    rows = rows.select(*(F.col(f"`{c}`") for c in [*names, cuts]))
    at, count = names.index(text), names.index(n_chars) if n_chars in names else -1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.byte_slices(batch, text):
                columns = list(part.columns[:-1])
                spans = part.column(part.num_columns - 1)
                touched = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
                if len(touched):
                    texts = columns[at].to_pylist()
                    w = tk.words_of(columns[at].take(pa.array(touched)), lower=False)
                    sizes = columns[count].to_pylist() if count >= 0 else None
                    ends = np.cumsum([len(texts[i].encode()) for i in touched])
                    for j, i in enumerate(touched.tolist()):
                        begin, f, k = int(ends[j]) - len(texts[i].encode()), w.first[j], int(w.counts[j])
                        keep = np.ones(k, bool)
                        for s in spans[i].as_py():
                            keep[s["s"] : s["e"]] = False
                        edges = np.concatenate([w.start[f : f + k] - begin, [int(ends[j]) - begin]])
                        data = texts[i].encode()
                        change = np.flatnonzero(np.diff(np.concatenate([[False], ~keep, [False]]).astype(np.int8)))
                        left, pos = [], 0
                        for a, b in zip(change[::2], change[1::2]):
                            left.append(data[pos : edges[a]])
                            pos = int(edges[b])
                        texts[i] = b"".join([*left, data[pos:]]).decode("utf-8", "replace")
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                    columns[at] = pa.array(texts, columns[at].type)
                    if sizes is not None:
                        columns[count] = pa.array(sizes, columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(apply, docs.schema)
