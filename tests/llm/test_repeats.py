"""Maximal repeats against an exhaustive search."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import repeats


def brute(texts, size):
    words = [re.findall(r"[0-9a-z]+", t.lower()) for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append((d, i))
    out, todo = set(), [(size, tuple(v)) for v in seen.values() if len(v) > 1]
    while todo:
        n, at = todo.pop()
        while True:
            right = [words[d][i + n] if i + n < len(words[d]) else None for d, i in at]
            if None in right or len(set(right)) > 1:
                break
            n += 1
        if len({words[d][i - 1] if i else (d, i) for d, i in at}) > 1:
            out.add((n, tuple(sorted(at))))
        by = {}
        for place, r in zip(at, right):
            if r is not None:
                by.setdefault(r, []).append(place)
        todo += [(n + 1, tuple(v)) for v in by.values() if len(v) > 1]
    return out


def told(df, **more):
    """(n_words, ((id, start), ...)) -> (period, runs), from the rows of occurrences."""
    by = {}
    for r in repeats.expand(repeats.repeats(df, **more)).collect():
        by.setdefault((r.repeat_id, r.n_words, r.period, r.n_occurrences), []).append((r.doc_id, r.start, r.run))
    assert all(len(rows) == k[3] for k, rows in by.items())
    out = {}
    for (_, n, period, _), rows in by.items():
        rows.sort()
        assert (n, tuple((d, s) for d, s, _ in rows)) not in out
        out[n, tuple((d, s) for d, s, _ in rows)] = period, [g for *_, g in rows]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_all_maximal_repeats(spark, seed):
    rng = random.Random(seed)
    kinds = [f"w{i}" for i in range(300)]
    base = [[rng.choice(kinds) for _ in range(rng.randint(5, 200))] for _ in range(12)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b) - 1)
            w += b[i : rng.randint(i, len(b))] + [rng.choice(kinds) for _ in range(rng.choice((0, 0, 3)))]
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = "X"
        texts.append(" ".join(w))
    texts += [" ".join(base[0])] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert set(told(df, min_words=20)) == brute(texts, 20)
    left = repeats.cut_repeats(df, min_words=20)
    whole = {(w, d) for d, t in enumerate(texts) for w in t.lower().split()}
    kept = {(w, r.doc_id) for r in left.collect() for w in r.text.lower().split()}
    assert kept <= whole and {w for w, _ in whole} == {w for w, _ in kept}


def test_runs_of_one_word(spark):
    rows = [(1, "la " * 400), (2, "la " * 400), (3, "x " + "la " * 300)]
    assert set(told(spark.createDataFrame(rows, "doc_id int, text string"))) == {(400, ((1, 0), (2, 0))), (300, ((1, 0), (2, 0), (3, 1)))}


def windows_cut(texts, size):
    """What stays when every window that isn't the first of its kind is cut."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            u = tuple(w[i : i + size])
            if u in seen:
                keep[i : i + size] = [False] * size
            seen.add(u)
        out.append([x for x, k in zip(w, keep) if k])
    return out


def runs_of(texts, size, most):
    """(document, start, length, period) of all maximal periodic runs."""
    out = set()
    for d, t in enumerate(texts):
        w = t.split()
        for p in range(1, most + 1):
            i = 0
            while i < len(w) - p:
                j = i
                while j + p < len(w) and w[j] == w[j + p]:
                    j += 1
                if j - i >= size and not any(x[0] == d and x[1] <= i and x[1] + x[2] >= j + p and p % x[3] == 0 for x in out):
                    out.add((d, i, j + p - i, p))
                i = max(j, i + 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_periodic_runs_against_the_unrestricted_search(spark, seed):
    rng = random.Random(100 + seed)
    size = (20, 50)[seed % 2]
    word = lambda: f"w{rng.randrange(400)}"
    some = lambda n: [word() for _ in range(n)]
    lines = [some(n) for n in (1, 2, 3, 7, 10)] + [some(size // 2), some(size // 2 + 1)]
    passages, heads = [some(n) for n in (5, 30, 80)], [some(n) for n in (1, 60)]
    texts = []
    for _ in range(14):
        line = rng.choice(lines)
        turn = rng.randrange(len(line)) * rng.randrange(2)
        run = (line * (2 + 4 * size // len(line)))[turn : turn + rng.randint(size // 2, 3 * size)]
        texts.append(" ".join(rng.choice([[], some(3), *heads]) + run + rng.choice([[], some(2), *passages, *passages]) + rng.choice([[], [], run])))
    texts += [texts[0], texts[1] + " end"]
    want, runs, most = brute(texts, size), runs_of(texts, size, size // 2), size // 2
    rows = told(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), min_words=size)
    split = [t.split() for t in texts]
    cyclic = lambda n, at: any(split[at[0][0]][at[0][1] + p : at[0][1] + n] == split[at[0][0]][at[0][1] : at[0][1] + n - p] for p in range(1, most + 1))
    plain = {k for k in want if not cyclic(*k)}
    assert plain == {k for k, (p, _) in rows.items() if p == 0} and plain
    inside = {(n, d, s, g, p) for (n, at), (p, gs) in rows.items() if p for (d, s), g in zip(at, gs)}
    assert {(d, s, g, p) for _, d, s, g, p in inside if g >= size + p and not any(d == x and y <= s and s + g == y + m and p == q for x, y, m, q in runs)} == set()
    assert runs <= {(d, s, g, p) for _, d, s, g, p in inside}
    for (n, at), (p, gs) in rows.items():
        if p:  # with the shifts that it stands for it's a repeat of the unrestricted search
            shifts = {(d, s + k) for (d, s), g in zip(at, gs) for k in range(0, g - n + 1, p)}
            assert (n, tuple(sorted(shifts))) in want
    left = repeats.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), min_words=size)
    assert [r.text.split() for r in left.orderBy("doc_id").collect()] == windows_cut(texts, size)


def test_passage_after_runs_of_different_lengths(spark):
    line, passage = [f"l{i}" for i in range(10)], [f"p{i}" for i in range(70)]
    rows = [(1, line * 6 + passage), (2, line * 10 + passage), (3, [f"q{i}" for i in range(20)] * 5)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id int, text string")
    got = told(df)
    assert (130, ((1, 0), (2, 40))) in got and (80, ((3, 0), (3, 20))) in got
    kept = {r.doc_id: r.text.split() for r in repeats.cut_repeats(df).collect()}
    assert kept[2] == [] and kept[1] == line * 6 + passage or kept[1] == line + passage
    assert len(kept[3]) == 20


def test_passage_of_very_many_documents(spark):
    """A hot passage, after and before words of its own in each document: few classes, all places."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"a{k} b{k} {passage} c{k}") for k in range(3000)] + [(5000 + k, passage) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = told(df)
    assert set(got) == {(60, (*((k, 2) for k in range(3000)), *((5000 + k, 0) for k in range(500))))}
    left = {r.doc_id: r.text.split() for r in repeats.cut_repeats(df).collect()}
    assert len(left[0]) == 63 and all(len(left[k]) == 3 for k in range(1, 3000)) and left[5000] == []


def test_repeated_rows_and_ids_of_any_type(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [("b", f"x {passage}"), ("b", f"x {passage}"), (None, passage), ("a", f"{passage} y"), (None, None), ("c", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = repeats.expand(repeats.repeats(df)).collect()
    assert sorted((r.doc_id or "", r.start, r.n_words, r.n_occurrences) for r in got) == [("", 0, 55, 3), ("a", 0, 55, 3), ("b", 1, 55, 3)]
    left = sorted((r.doc_id or "", r.text or "") for r in repeats.cut_repeats(df).collect())
    assert left == [("", ""), ("", ""), ("a", f"{passage} y"), ("b", "x "), ("b", "x "), ("c", "")]


@pytest.mark.parametrize("book", (repeats.BOOK, 7, 0))
def test_words_of_classes_are_coded(spark, monkeypatch, book):
    rng = random.Random(11)
    kinds = [f"w{i}" for i in range(60)]
    base = [rng.choice(kinds) for _ in range(400)]
    texts = [" ".join([*base[i : i + 200], f"rare{i}", *base[250:350]]) for i in range(0, 200, 10)]
    kept, written = [], repeats.common.written

    def keep(df, owner="", compression="snappy"):
        out = written(df, owner, compression)
        if "words" in out.columns:
            kept.append(out.where("n is not null").selectExpr("sum(octet_length(words)) as coded", "sum(octet_length(rare)) as rare").first())
        return out

    monkeypatch.setattr(repeats.common, "written", keep)
    monkeypatch.setattr(repeats, "BOOK", book)  # on the driver: the book is smaller
    got = told(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2))
    assert set(got) == brute(texts, 50)
    # a word has two bytes, and four more if it isn't in the book
    (coded, rare), = kept
    assert rare == 2 * coded if book == 0 else rare < 0.2 * coded if book > 7 else 0 < rare < 2 * coded


def test_code_book():
    words = np.array([5, 0, 2**32 - 1, 7, 5], np.uint32)
    for book in ([], [0], [5, 7], [0, 5, 2**32 - 1]):
        book = np.array(book, np.uint32)
        code = repeats._coded(words, book)
        assert ((code == repeats.BOOK) == ~np.isin(words, book)).all()
        assert (repeats._decoded(code, words[code == repeats.BOOK], book) == words).all()
