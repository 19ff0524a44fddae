"""Exact and fuzzy lookup: items, sections and appendices, documents by name, catalog, full texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def is_item(number: str, descendants: bool = False) -> Column:
    """Whether ``item_number`` is the number or, if asked, one below it."""
    c = F.col("item_number")
    return (c == number) | c.startswith(number + ".") if descendants else c == number


def is_section(number: str) -> Column:
    return (F.col("heading_number") == number) | F.array_contains("section_path", number)


def structural(chunks: DataFrame, kind: str, number: str, appendix: str | None = None, doc_id: str | None = None, descendants: bool = False) -> DataFrame:
    """Chunks of an item, section, appendix or bare number, with ``structural_match``, in document order.

    An item that no chunk has is looked for as a section, and so is a bare number. Metadata chunks never match.
    """
    rows = chunks.where(F.coalesce(F.col("chunk_type") != "metadata", F.lit(True)))
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    if kind == "appendix":
        found = rows.where(F.col("appendix_number") == number).withColumn("structural_match", F.lit("appendix"))
    elif kind == "section":
        found = rows.where(is_section(number)).withColumn("structural_match", F.lit("section"))
    elif kind in ("item", "bare"):
        item = is_item(number, descendants) & ((F.col("appendix_number") == appendix) if appendix else F.lit(True))
        match = F.when(item, "item").when(is_section(number), "section")
        both = rows.withColumn("structural_match", match).where("structural_match is not null")
        # only matching rows reach the window: items beat sections
        first = F.min("structural_match").over(Window.partitionBy())
        found = both.withColumn("first_", first).where("structural_match = first_").drop("first_")
    else:
        raise ValueError(f"unknown kind of reference: {kind}")
    return found.orderBy("doc_id", "chunk_id")


def anchors(found: DataFrame, descendants: bool = False, number: str | None = None) -> DataFrame:
    """Distinct places that a structural lookup hit; more than one means that the reference is ambiguous.

    An item is known by document, appendix, section path, number and blocks, so the parts of one split item are one
    place, and by its root number instead of number and blocks if ``descendants`` were asked for; a section by document,
    appendix and reference; an appendix by document and number.
    """
    path = F.concat_ws("/", F.coalesce("section_path", F.array().cast("array<string>")))
    blocks = F.array_join("block_ids", ",") if "block_ids" in found.columns else F.lit("")
    item = F.concat_ws("|", path, F.lit(number)) if descendants and number else F.concat_ws("|", path, F.coalesce("item_number", F.lit("")), F.coalesce(blocks, F.lit("")))
    what = F.when(F.col("structural_match") == "item", item).when(F.col("structural_match") == "section", F.lit((number or "").casefold())).otherwise("")
    keyed = found.select("structural_match", "doc_id", F.coalesce("appendix_number", F.lit("")).alias("appendix"), what.alias("anchor"))
    return keyed.groupBy("structural_match", "doc_id", "appendix", "anchor").agg(F.count(F.lit(1)).alias("chunks"))


def find(documents: DataFrame, query: str, limit: int = 5, names: tuple[str, ...] = ("document_title", "source_name", "index_code")) -> DataFrame:
    """Documents by name: exact hits first, then by the best trigram similarity, then by title."""
    q = F.lit(query)
    scores = [F.coalesce(tx.similarity(F.col(n), q), F.lit(0.0)) for n in names]
    exact = F.lit(False)
    for n in names:
        exact |= F.coalesce(F.lower(F.trim(n)) == query.strip().lower(), F.lit(False))
    out = documents.withColumn("score", F.round(F.greatest(*scores) if len(scores) > 1 else scores[0], 9)).withColumn("exact", exact)
    return out.where("exact or score > 0").orderBy(F.desc("exact"), F.desc("score"), *names[:1], "doc_id").limit(limit)


def find_each(documents: DataFrame, queries: DataFrame, by: str = "query_id", limit: int = 5, name: str = "document_title", block: int = 2048) -> DataFrame:
    """(by, doc_id, exact, score, place): ``find`` by one name for every phrase ``s`` of a table of queries.

    Phrases and names that are the same but for case and blanks around them are one, with the ``limit`` least keys of the
    documents that have the name: the work follows the different ones. These are compared in pairs of blocks of about
    ``block``, as matrices of the trigrams in them; the best ``limit`` of each phrase go on.
    """
    side = lambda df, key, text: df.select(F.col(key).alias("key"), F.trim(F.lower(F.col(text))).alias("low")).where("low is not null")
    asked, named = side(queries, by, "s"), side(documents, "doc_id", name)

    def blocks(df: DataFrame, out: str) -> DataFrame:
        df = df.select("low").distinct()
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64("low"), F.lit(n)).alias("b_")).agg(F.collect_list(F.struct("low", tx.trigrams(F.col("low")).alias("grams"))).alias(out)).drop("b_")

    def matrix(s: pa.Array, known: dict[str, int]) -> np.ndarray:
        lists = s.field("grams")
        m = np.zeros((len(s), len(known)), np.float32)
        row = np.repeat(np.arange(len(s)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        m[row, [known[g] for g in lists.flatten().to_pylist()]] = 1
        return m

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qs, ds = (batch.column(j).slice(i, 1).flatten() for j in (0, 1))
                known = {g: k for k, g in enumerate(dict.fromkeys([*qs.field("grams").flatten().to_pylist(), *ds.field("grams").flatten().to_pylist()]))}
                a, b = matrix(qs, known), matrix(ds, known)
                low = qs.field("low").to_pylist()
                lows = ds.field("low").take(pc.array_sort_indices(ds.field("low")))
                at_low = {x: k for k, x in enumerate(lows.to_pylist())}
                b = b[pc.array_sort_indices(ds.field("low")).to_numpy()]
                size = b.sum(axis=1)[None, :]
                for lo in range(0, len(low), 256):
                    m = a[lo : lo + 256]
                    both = m @ b.T
                    score = np.round(both / np.maximum(m.sum(axis=1)[:, None].astype(float) + size - both, 1), 9)
                    exact = np.zeros(score.shape, bool)
                    for k, x in enumerate(low[lo : lo + 256]):
                        if x in at_low:
                            exact[k, at_low[x]] = True
                    top = np.argsort(-(score + 2 * exact), axis=1, kind="stable")[:, :limit]
                    at = np.repeat(np.arange(lo, lo + len(m)), top.shape[1])
                    s, e = np.take_along_axis(score, top, axis=1).ravel(), np.take_along_axis(exact, top, axis=1).ravel()
                    some = np.flatnonzero((s > 0) | e)
                    yield pa.RecordBatch.from_arrays([qs.field("low").take(pa.array(at[some])), lows.take(pa.array(top.ravel()[some])), pa.array(e[some]), pa.array(s[some])], names=["s", "low", "exact", "score"])

    pairs = blocks(asked, "qs").crossJoin(blocks(named, "ds"))
    found = pairs.mapInArrow(near, "s string, low string, exact boolean, score double")
    order = (F.desc("exact"), F.desc("score"), "low")
    found = found.withColumn("n_", F.row_number().over(Window.partitionBy("s").orderBy(*order))).where(F.col("n_") <= limit).drop("n_")
    least = named.withColumn("n_", F.row_number().over(Window.partitionBy("low").orderBy("key"))).where(F.col("n_") <= limit).select("low", F.col("key").alias("d"))
    # at most limit * limit rows of a phrase, limit when they are handed to the queries that ask it
    found = found.join(least, "low").withColumn("n_", F.row_number().over(Window.partitionBy("s").orderBy(*order, "d"))).where(F.col("n_") <= limit).drop("n_")
    found = found.groupBy("s").agg(F.collect_list(F.struct("d", "low", "exact", "score")).alias("hits_"))
    found = asked.select(F.col("key").alias("q"), F.col("low").alias("s")).join(found, "s").select("q", F.inline("hits_"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order, "d"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select(F.col("q").alias(by), F.col("d").alias("doc_id"), "exact", "score", "place")


def select(candidates: DataFrame, query: str | Column, names: tuple[str, ...] = ("source_name", "index_code", "document_title"), least: float = 0.2, lead: float = 0.035, by: str | None = None) -> DataFrame:
    """At most one of the scored candidates (of each query ``by``): one equal name, else one contained name, else a clear
    leader. Several equal names give none."""
    q = F.trim(F.lower(F.lit(query) if isinstance(query, str) else query))
    low = lambda n: F.trim(F.lower(F.coalesce(F.col(n), F.lit(""))))
    w = Window.partitionBy(*([by] if by else [F.lit(0)]))
    rows = candidates.withColumn("q_", q)
    for k, n in enumerate(names):
        rows = rows.withColumn(f"same{k}_", (low(n) == F.col("q_")) & (F.col("q_") != "")).withColumn(f"in{k}_", (low(n) != "") & F.contains(F.col("q_"), low(n)))
    # candidates are few for each query: what ``find`` was asked for
    rows = rows.withColumns({f"n_{c}": F.count_if(c).over(w) for k in range(len(names)) for c in (f"same{k}_", f"in{k}_")})
    rows = rows.withColumn("place_", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).withColumn("next_", F.lead("score").over(w.orderBy(F.desc("score"), "doc_id")))
    chosen = F.lit(None).cast("boolean")
    for k in range(len(names)):
        chosen = F.coalesce(chosen, F.when(F.col(f"n_same{k}_") == 1, F.col(f"same{k}_")).when(F.col(f"n_same{k}_") > 1, F.lit(False)))
    for k in range(len(names)):
        chosen = F.coalesce(chosen, F.when(F.col(f"n_in{k}_") == 1, F.col(f"in{k}_")))
    clear = (F.col("place_") == 1) & (F.col("score") >= least) & (F.col("next_").isNull() | (F.round(F.col("score") - F.col("next_"), 9) >= lead))
    return rows.where(F.coalesce(chosen, clear)).select(*candidates.columns)


def catalog(documents: DataFrame, limit: int = 0) -> DataFrame:
    """Documents by title or else file name; all of them unless ``limit`` is positive."""
    out = documents.select("doc_id", "source_name", "index_code", "document_title").orderBy(F.coalesce("document_title", "source_name"), "source_name", "doc_id")
    return out.limit(limit) if limit > 0 else out


def full_text(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """(key, full_text, chunks): the texts of each document in order, with an empty line between."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n\n").alias("full_text"), F.count(F.lit(1)).alias("chunks"))
