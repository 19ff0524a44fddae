"""What a document shows against what its blocks hold: segments that must be there, and blocks for those that are not.

All of it is plans over the rows of ``docx.read_segments`` and ``extract.typed_blocks``, one group per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

PAGE = r"(?iu)^(?:(?:стр(?:аница)?\.?|page)\s*(?:№\s*)?\d+(?:\s*(?:из|of|/)\s*\d+)?|\d+\s*/\s*\d+)$"
TOC_ENTRY = r"(?iu)(?:(?:\.{2,}|\s{2,}|\t)\s*\d{1,4}$)|^(?:\d+(?:\.\d+)*|(?:приложение|appendix)\s*№?\s*\d+).+\s+\d{1,4}$"
TOC_STYLE = r"(?iu)^(?:toc|contents|оглавлен|содержан)"
TOC_TITLES = ("содержание", "оглавление", "contents", "table of contents")


def is_page_counter(text: Column, dynamic: Column) -> Column:
    """Whether a header or footer only counts pages: numbers, "page N of M", or page words and numerals around a field."""
    w = tx.words(text)
    some = F.size(w) > 0
    counts = F.forall(w, lambda t: t.rlike(r"^(?:\d+|стр|страница|page|из|of|[ivxlcdm]+)$"))
    return F.coalesce((some & F.forall(w, lambda t: t.rlike(r"^\d+$"))) | text.rlike(PAGE) | (dynamic & some & counts), F.lit(False))


def partition(segments: DataFrame) -> DataFrame:
    """``segments`` with ``ignored``: contents pages of the body, and page counters of headers and footers.

    A contents page goes from a title or an entry style to the first segment that is neither nor looks like an entry.
    """
    rows = segments.where("text is not null")
    text, style = tx.normalize_space(F.col("text")), F.regexp_replace(F.lower(F.coalesce("style", F.lit(""))), " ", "")
    body = F.col("story") == "body"
    start = body & (F.lower(text).isin(*TOC_TITLES) | style.rlike(TOC_STYLE))
    entry = F.col("text").rlike(TOC_ENTRY)
    rows = rows.withColumns({"start_": start, "entry_": start | (body & entry)})
    w = Window.partitionBy("path", "part").orderBy("pos")
    # islands of entries, which a row that is none ends
    rows = rows.withColumn("island_", F.sum(F.when(F.col("entry_"), 0).otherwise(1)).over(w))
    began = F.max(F.col("start_").cast("int")).over(Window.partitionBy("path", "part", "island_").orderBy("pos"))
    counter = F.col("story").isin("header", "footer") & is_page_counter(text, F.coalesce("dynamic_page", F.lit(False)))
    return rows.withColumn("ignored", (F.col("entry_") & (began == 1)) | counter).drop("start_", "entry_", "island_")


def counts(segments: DataFrame) -> DataFrame:
    """(path, story, location, required, ignored) of partitioned segments."""
    return segments.groupBy("path", "story", "location").agg(F.count_if(~F.col("ignored")).alias("required"), F.count_if("ignored").alias("ignored"))


def _tokens(c: Column) -> Column:
    return F.array_join(tx.words(c), " ")


def rendered(blocks: DataFrame) -> DataFrame:
    """(path, source_kind, tokens, n) of primary blocks as the source has them: with their marker unless it is automatic."""
    has = lambda c: F.col(c) if c in blocks.columns else F.lit(None).cast("string")
    marker = F.when(has("display_prefix").isNotNull(), F.lit(None)).when(F.col("kind") == "heading", has("heading_number")).when(F.col("kind").isin("numbered_paragraph", "appendix_numbered_item"), has("item_number")).when(F.col("kind").isin("letter_bullet", "appendix_bullet", "list_item"), has("item_marker"))
    typed = F.when(F.startswith(F.ltrim("text"), F.coalesce(marker, F.lit(""))), F.col("text")).otherwise(F.concat_ws(" ", marker, "text"))
    n = F.greatest(F.lit(1), F.coalesce(F.col("source_occurrences"), F.lit(1))) if "source_occurrences" in blocks.columns else F.lit(1)
    return blocks.where((F.col("kind") != "supplemental") & (tx.normalize_space(F.col("text")) != "")).select("path", "source_kind", _tokens(typed).alias("tokens"), n.alias("n"))


def supplemental(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks for required segments that the primary ones lack: all stories but the body, text boxes, and of the body's texts
    those that it says more often than the blocks do, table rows counted by runs of words.

    (path, pos, block_id, kind, text, source_kind, source_story, source_parts, source_locations, source_occurrences)
    """
    seg = segments.where(~F.col("ignored")).select("path", "part", "story", "location", tx.normalize_block(F.col("text")).alias("text"))
    box = F.col("location") == "textbox"
    sets = lambda c, when=None: F.sort_array(F.collect_set(F.when(when, F.col(c)) if when is not None else F.col(c)))
    grouped = seg.groupBy("path", "story", "text").agg(F.count(F.lit(1)).alias("n"), F.count_if(box).alias("boxes"), sets("part").alias("parts"), sets("location").alias("places"), sets("part", box).alias("box_parts"))
    other = F.col("story") != "body"
    whole = grouped.where(other | (F.col("boxes") > 0)).select("path", "story", "text", F.when(other, F.col("parts")).otherwise(F.col("box_parts")).alias("parts"), F.when(other, F.col("places")).otherwise(F.array(F.lit("textbox"))).alias("places"), F.when(other, F.col("n")).otherwise(F.col("boxes")).alias("times"))
    rest = grouped.where(~other & (F.col("boxes") == 0)).withColumn("tokens", _tokens(F.col("text"))).where("tokens != ''")
    told = rendered(blocks)
    exact = told.where("source_kind != 'table_row'").groupBy("path", "tokens").agg(F.sum("n").alias("exact"))
    rows = told.where("source_kind = 'table_row'").select("path", F.split("tokens", " ").alias("row"), F.col("n").alias("times_"))
    # a document's table rows meet its own open segments only
    lacking = rest.join(exact, ["path", "tokens"], "left").withColumn("exact", F.coalesce("exact", F.lit(0))).where("n > exact")
    runs = lacking.select("path", "tokens", "story", "text", F.split("tokens", " ").alias("needle")).join(rows, "path")
    within = runs.groupBy("path", "tokens", "text").agg(F.sum(tx.ngram_count(F.col("row"), F.col("needle")) * F.col("times_")).alias("within"))
    short = lacking.join(within, ["path", "tokens", "text"], "left").withColumn("times", F.col("n") - F.col("exact") - F.coalesce("within", F.lit(0))).where("times > 0")
    out = whole.union(short.select("path", "story", "text", "parts", "places", "times"))
    digest = tx.sha1_prefix(F.concat("story", F.lit("\0"), "text"), 16)
    last = blocks.groupBy("path").agg(F.max("pos").alias("last_"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("story", "text"))
    out = out.join(last, "path", "left").withColumn("pos", (F.coalesce("last_", F.lit(-1)) + place).cast("int"))
    return out.select("path", "pos", F.concat(F.lit("supplemental-"), "story", F.lit("-"), digest).alias("block_id"), F.lit("supplemental").alias("kind"), "text", F.concat(F.lit("supplemental_"), "story").alias("source_kind"), F.col("story").alias("source_story"), F.col("parts").alias("source_parts"), F.col("places").alias("source_locations"), F.col("times").cast("int").alias("source_occurrences"))


def metrics(segments: DataFrame, blocks: DataFrame, most: int = 50, samples: int = 30) -> DataFrame:
    """(path, expected_tokens, covered_tokens, coverage, missing_tokens, missing_segments, critical, samples): how much of
    the required segments the blocks hold, by multisets of words, and which segments are missing.

    ``critical`` counts missing segments of notes and text boxes; ``missing_tokens`` are the ``most`` frequent ones.
    """
    need = segments.where(~F.col("ignored"))
    bag = lambda df, c, n: df.select("path", F.explode(c).alias("token"), n.alias("n_")).groupBy("path", "token").agg(F.sum("n_").alias("n"))
    want = bag(need, tx.words(F.col("text")), F.lit(1))
    extra = blocks.where("kind = 'supplemental'").select("path", F.explode(tx.words(F.col("text"))).alias("token"), (F.col("source_occurrences") if "source_occurrences" in blocks.columns else F.lit(1)).alias("n_")).groupBy("path", "token").agg(F.sum("n_").alias("n"))
    have = rendered(blocks).where("tokens != ''").select("path", F.explode(F.split("tokens", " ")).alias("token"), F.col("n").alias("n_")).groupBy("path", "token").agg(F.sum("n_").alias("n")).union(extra).groupBy("path", "token").agg(F.sum("n").alias("m"))
    both = want.join(have, ["path", "token"], "left").withColumn("lack", F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0))))
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("lack") > 0, F.struct((-F.col("lack")).alias("k"), "token")))), 1, most)
    tokens = both.groupBy("path").agg(F.sum("n").alias("expected_tokens"), F.sum(F.col("n") - F.col("lack")).alias("covered_tokens"), F.transform(top, lambda x: x["token"]).alias("missing_tokens"))
    said = need.groupBy("path", "story", "location", _tokens(F.col("text")).alias("tokens")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text")).where("tokens != ''")
    told = rendered(blocks).select("path", F.concat(F.lit(" "), "tokens", F.lit(" ")).alias("t")).union(blocks.where("kind = 'supplemental'").select("path", F.concat(F.lit(" "), _tokens(F.col("text")), F.lit(" "))))
    found = said.join(told, "path").where(F.contains("t", F.concat(F.lit(" "), "tokens", F.lit(" ")))).select("path", "story", "location", "tokens").distinct()
    gone = said.join(found, ["path", "story", "location", "tokens"], "left_anti")
    critical = F.col("story").isin("footnote", "endnote") | (F.col("location") == "textbox")
    missing = gone.groupBy("path").agg(F.count(F.lit(1)).alias("missing_segments"), F.count_if(critical).alias("critical"), F.slice(F.sort_array(F.collect_set("text")), 1, samples).alias("samples"))
    out = segments.select("path").distinct().join(tokens, "path", "left").join(missing, "path", "left").na.fill(0, ["expected_tokens", "covered_tokens", "missing_segments", "critical"])
    return out.withColumn("coverage", F.when(F.col("expected_tokens") == 0, 1.0).otherwise(F.col("covered_tokens") / F.col("expected_tokens")))
