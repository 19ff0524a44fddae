"""Searches of many queries: one pass over the texts, whatever the queries are; no text, word or pair is shuffled."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.plans import queries


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_websearch_match_shuffles_nothing(spark, tmp_path):
    d = documents(spark, tmp_path, [(0, "longest after second c", "en", "s"), (50, "longest after second c", "en", "s"), (1, "longest x after, second", "en", "s"), (2, "second c", "en", "s"), (3, "LONGEST after c", "en", "s"), (4, None, "en", "s"), (5, "after longest", "en", "s")])
    got = queries.QUERIES["websearch_match"](spark, d)
    # longest words: "longest", "second", "after"
    assert sorted(map(tuple, got.collect())) == sorted((q, c) for q in (0, 50) for c in (0, 2, 3, 50))
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strings", (100_000, 1))
def test_scan_like_brute_force(spark, monkeypatch, strings):
    import random

    monkeypatch.setattr(search, "STRINGS", strings)
    monkeypatch.setattr(search, "ROWS", 3)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dd"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None]
    asked = ['"bb" "a"', '"ccc a" or dd', "bb -a", "-a", 'a or -bb "dd dd"', '"bb" "a"', "", None]
    chunks = spark.createDataFrame([*enumerate(texts), (None, "a bb")], "chunk_id int, text string").repartition(3)
    table = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(asked)], "query_id string, s string")
    want = {}
    for i, s in enumerate(asked):
        for k, text in enumerate(texts):
            at = {}
            for p, w in enumerate((text or "").split(), 1):
                at.setdefault(w, []).append(p)
            operands = search.parse(s, False)
            x = search.cover(operands, at)
            assert search.matches(operands, at) == (x is not None)
            if x is not None:
                want[f"q{i}", k] = x
    got = {(r.query_id, r.chunk_id): r.text_score for r in search.text_search(chunks, table, stemmed=False, by="query_id").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
    said = search.text_search(chunks, table, stemmed=False, by="query_id", scored=False).where(F.col("chunk_id").isNotNull())
    assert {(r.query_id, r.chunk_id) for r in said.collect()} == set(want)
    few = search.text_topk(search.text_search(chunks, table, stemmed=False, by="query_id", k=2), 2, by="query_id")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, search.text_topk(search.text_search(chunks, table, stemmed=False, by="query_id"), 2, by="query_id").collect()))


def parts(spark, tmp_path, n):
    names = ("red bolt", "Red Bolt ", "new anvil", "hot ring", "red ring", "zz", None)
    spark.createDataFrame([(k, names[k % len(names)]) for k in range(n)], "p_partkey bigint, p_name string").repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def slow_find(spark, d):
    """(query_id, doc_id, exact, score, place) by comparing every name with every other one."""
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/part.parquet").where("p_name is not null").collect()]
    grams = lambda s: {f"  {w} "[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}
    for q, s in rows:
        if q % 50 == 0:
            found = []
            for k, name in rows:
                a, b = grams(s), grams(name)
                exact, score = s.strip().lower() == name.strip().lower(), round(len(a & b) / len(a | b), 9)
                if exact or score > 0:
                    found.append((not exact, -score, name.strip().lower(), k))
            for place, (other, score, _, k) in enumerate(sorted(found)[:5], 1):
                yield q, k, not other, round(-score, 6), place


@pytest.fixture
def counted(spark, monkeypatch):
    """How many rows the blocks that are compared have."""
    kind, told = type(spark.range(1)), []
    count = kind.count
    monkeypatch.setattr(kind, "count", lambda self: told.append(count(self)) or told[-1])
    return told


def test_fuzzy_find_compares_different_names_only(spark, tmp_path, counted):
    """Names that many parts have are compared once: the blocks hold five names, not a thousand parts."""
    d = parts(spark, tmp_path, 1000)
    got = queries.QUERIES["fuzzy_find"](spark, d)
    assert counted and max(counted) <= 5
    assert sorted(tuple(r[c] for c in ("query_id", "doc_id", "exact", "score", "place")) for r in got.collect()) == sorted(slow_find(spark, d))


def test_select_document_of_a_name_that_one_part_has(spark, tmp_path, counted):
    names = [(k, "red bolt") for k in range(1, 400) if k % 50] + [(50, "hot ring"), (100, "Hot Plate "), (150, "red bolt"), (200, None)]
    spark.createDataFrame(names, "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.QUERIES["select_document"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(50, 50, "hot ring"), (100, 100, "Hot Plate ")]
    assert counted and max(counted) <= 3


@pytest.mark.parametrize("vectors", (20_000, 9))
def test_vector_topk_hands_rows_not_blocks_to_python(spark, monkeypatch, vectors):
    """No row holds a block of vectors, so a worker's memory is that of an Arrow batch; ties at the k-th go by key."""
    import numpy as np

    monkeypatch.setattr(search, "VECTORS", vectors)
    v = np.random.default_rng(3).integers(-1, 2, size=(90, 3)).astype("float32")
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(90, None), (91, [])], "chunk_id bigint, embedding array<float>").repartition(3)
    asked = rows.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    some = [k for k in range(90) if v[k].any()]
    unit = {k: v[k].astype(float) / np.linalg.norm(v[k].astype(float)) for k in some}
    want = {q: sorted((-np.round(unit[q] @ unit[c], 9), c) for c in some)[:5] for q in some if q % 4 == 0}
    for block in (4096, 7):
        near = search.vector_topk(rows, asked, 5, by="query_id", block=block)
        got = {}
        for r in near.collect():
            got.setdefault(r.query_id, []).append((r.vector_rank, r.chunk_id))
        assert {q: [c for _, c in sorted(x)] for q, x in got.items()} == {q: [c for _, c in x] for q, x in want.items()}
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert search.vector_topk(rows, asked.limit(0), 5, by="query_id").count() == 0


def test_text_topk_shuffles_only_the_best(spark, tmp_path):
    """The words and their places stay where the texts are read: the best rows of each search string are all that moves."""
    d = documents(spark, tmp_path, [(0, "anvil bolt", "en", "s"), (50, "bolt anvil", "en", "s"), *((k, "anvil " * (k % 7) + "x bolt", "en", "s") for k in range(1, 50))])
    got = queries.QUERIES["text_rank_cover_density"](spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan
    assert all(x in ("class_", "query_id") for x in __import__("re").findall(r"Exchange hashpartitioning\((\w+)#", plan))
    rows = got.collect()
    assert {r.query_id for r in rows} == {0, 50} and len(rows) == 80
    first = [(r.chunk_id, r.text_rank, r.text_score) for r in sorted(rows, key=lambda r: (r.query_id, r.text_rank))]
    # equal strings have equal results; ties go by key
    assert first[:40] == first[40:] and [x[0] for x in first[:3]] == [0, 50, 1] and first[0][2] == 0.1


@pytest.mark.parametrize("needles", (100_000, 1))
def test_occurrences_shuffle_nothing(spark, monkeypatch, needles):
    import random

    from lodestone.operators import audit

    monkeypatch.setattr(audit, "NEEDLES", needles)
    monkeypatch.setattr(audit, "ROWS", 2)
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("aab") for _ in range(n))
    hay = [*enumerate(text(rng.randrange(30)) for _ in range(30)), (30, None), (30, "A, b. a")]
    asked = [("x", "a b"), ("y", "A-B"), ("x", "a"), ("z", ""), ("n", None), *((f"l{n}", text(n)) for n in range(2, 9)), ("c", "c")]
    got = audit.occurrences(spark.createDataFrame(hay, "id int, text string").repartition(3), spark.createDataFrame(asked, "id string, text string"), "id", "id")
    want = []
    for name, needle in asked:
        w = (needle or "").lower().replace("-", " ").split()
        for k, said in hay:
            h = (said or "").lower().replace(",", "").replace(".", "").split()
            n = sum(h[i : i + len(w)] == w for i in range(len(h))) if w else 0
            if n:
                want.append((name, k, n))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_hybrid_rrf_moves_ranked_rows_only(spark, tmp_path):
    d = documents(spark, tmp_path, [(k, f"anvil bolt {'x ' * (k % 5)}", "en", f"s{k % 3}") for k in range(101)])
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(101)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["hybrid_rrf"](spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan
    rows = got.collect()
    assert {r.query_id for r in rows} == {0, 50, 100} and len(rows) == 24
    assert all(r.source == f"s{r.chunk_id % 3}" for r in rows)
