"""Dialogs: history windows, budgets, references to earlier answers, attached sources, routes."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

ROUTES = ("rag", "identity", "capabilities", "documents", "document_section", "full_document", "general")
ASK = {"document_section": "Which item or section do you mean?", "full_document": "Of which document do you want the whole text?"}
LEANS = r"(?iu)\b(?:it|its|this|that|these|they|them|there|then|he|she|first|second|third|previous|это|этот|эта|эти|там|тогда|он|она|они|его|её|их|такое|данн\w+|перв\w+|втор\w+|трет\w+|предыдущ\w+|подробнее|продолжи|уточни|поясни)\b|^\s*(?:and|а|и)\s+(?:who|what|how|where|when|why|кто|что|как|где|когда|почему)\b"
DESCENDANTS = r"(?iu)(?:^|\s)(?:(?:вместе\s+)?с|включая|и|плюс)\s+(?:его\s+|е[её]\s+|всеми\s+|все\s+)?подпункт|\b(?:with|including|and|plus)\s+(?:all\s+|its\s+)*sub-?items"


def last_turns(turns: DataFrame, most: int, exclude_last_user: bool = True) -> DataFrame:
    """The last ``most`` user and assistant turns with content of each conversation, without its last user turn."""
    rows = turns.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    w = Window.partitionBy("conv_id")
    if exclude_last_user:
        rows = rows.withColumn("last_", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w)).where("last_ is null or turn != last_").drop("last_")
    return rows.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("back") <= most)


def history_budget(turns: DataFrame, budget: int, each: int = 5000, most: int | None = None, keep_end: int | None = None, marker: str = " [...] ") -> DataFrame:
    """The newest turns (``most`` at most) whose texts, white space collapsed and cut in the middle, fit in ``budget``
    characters. With ``keep_end`` the first one that doesn't fit stays with a marker and its end, if at least so many
    characters are left; older ones go."""
    rows = turns.where(F.col("role").isin("user", "assistant")).withColumn("text", tx.middle_truncate(tx.normalize_space(F.col("text")), each, marker)).where("text != ''")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    if most is not None:
        rows = rows.withColumn("back_", F.row_number().over(w)).where(F.col("back_") <= most).drop("back_")
    rows = rows.withColumn("used", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if keep_end is None:
        return rows.where(F.col("used") <= budget)
    left = F.lit(budget) - (F.col("used") - F.length("text"))
    cut = F.when(F.col("used") > budget, F.concat(F.lit(marker), F.ltrim(F.right("text", (left - len(marker)).cast("int"))))).otherwise(F.col("text"))
    kept = rows.where((F.col("used") <= budget) | (left >= keep_end)).withColumn("text", cut)
    return kept.withColumn("used", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def latest_assistant(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) of the last assistant turn of each conversation."""
    return turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def numbered_lines(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, label, line) of lines such as ``1. text``, ``2) text`` and ``[3] text``; kind is list or citation."""
    lines = rows.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "l"))
    item = r"^\s*(\d{1,3})[.)]\s+(.+?)\s*$"
    cite = r"^\s*\[(\d{1,3})\]\s+(.+?)\s*$"
    out = lines.withColumn("kind", F.when(F.col("l").rlike(item), "list").when(F.col("l").rlike(cite), "citation")).where("kind is not null")
    pattern = lambda g: F.when(F.col("kind") == "list", F.regexp_extract("l", item, g)).otherwise(F.regexp_extract("l", cite, g))
    return out.select(*key, "kind", "at", pattern(1).cast("int").alias("label"), pattern(2).alias("line"))


def resolve_reference(turns: DataFrame, label: int, kind: str = "list") -> DataFrame:
    """(conv_id, turn, line) that a label means: list lines of the last answer, or citations of the last that has any."""
    told = latest_assistant(turns) if kind == "list" else turns.where("role = 'assistant'")
    lines = numbered_lines(told, ["conv_id", "turn"]).where(F.col("kind") == kind)
    last = lines.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return lines.where(F.col("label") == label).join(last, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min_by("line", "at").alias("line"))


def retrieval_query(turns: DataFrame, question: str | None = None, most: int = 2, each: int = 1800) -> DataFrame:
    """(conv_id, query): the question, after the last ``most`` turns before it where it leans on them (a pronoun, an ordinal).

    Without a ``question`` that of a conversation is its last user turn. Turns are collapsed and cut in the middle.
    """
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q_"))
    asked = turns.select("conv_id").distinct().join(asked, "conv_id", "left").select("conv_id", F.trim(F.lit(question) if question is not None else F.col("q_")).alias("q_")).where("q_ is not null")
    kept = last_turns(turns, most).select("conv_id", "turn", tx.middle_truncate(tx.normalize_space(F.col("text")), each, " ... ").alias("t_"))
    before = kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t_"))), lambda x: x["t_"]), "\n").alias("before_"))
    return asked.join(before, "conv_id", "left").select("conv_id", F.when(F.col("q_").rlike(LEANS), F.concat_ws("\n", "before_", "q_")).otherwise(F.col("q_")).alias("query"))


def asks_descendants(question: Column) -> Column:
    """Whether a question asks for an item with all that is below it."""
    return F.coalesce(question.rlike(DESCENDANTS), F.lit(False))


def content_text(content: Column) -> Column:
    """The text of a message's content: plain, or the texts of a JSON list of parts, a line each; null is empty."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        def one(x: str | None) -> str:
            if x is None:
                return ""
            try:
                parts = json.loads(x) if x.lstrip().startswith("[") else None
            except ValueError:
                parts = None
            if not isinstance(parts, list):
                return x.strip()
            told = [p.get("text") if p.get("type") == "text" and p.get("text") else p.get("content") if isinstance(p, dict) else p for p in parts if p] if all(isinstance(p, dict) for p in parts if p) else [p if isinstance(p, str) else (p.get("text") or p.get("content")) if isinstance(p, dict) else str(p) for p in parts if p]
            return "\n".join(str(t) for t in told if t).strip()

        return c.map(one)

    return run(content)


def frames(answers: DataFrame, key: str, text: str = "text", size: int = 2000) -> DataFrame:
    """(key, frame, line): each text as event-stream frames of ``size`` characters as chat chunks; the first has the role,
    then a stop frame and ``[DONE]`` follow. An empty or null text has no content frame."""
    n = F.ceil(F.coalesce(F.length(text), F.lit(0)) / size).cast("int")
    rows = answers.select(key, F.col(text).alias("t_"), n.alias("n_"))
    each = rows.where("n_ > 0").select(key, "t_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("i_"))
    piece = F.substring("t_", F.col("i_") * size + 1, F.lit(size))
    choice = lambda delta, reason: F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), reason.alias("finish_reason"))).alias("choices")))
    delta = F.struct(F.when(F.col("i_") == 0, F.lit("assistant")).alias("role"), piece.alias("content"))
    body = each.select(key, F.col("i_").cast("bigint").alias("frame"), F.concat(F.lit("data: "), choice(delta, F.lit(None).cast("string"))).alias("line"))
    end = lambda k, line: rows.select(key, (F.col("n_") + k).cast("bigint").alias("frame"), line.alias("line"))
    empty = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"))
    return body.union(end(0, F.concat(F.lit("data: "), choice(empty, F.lit("stop"))))).union(end(1, F.lit("data: [DONE]")))


def sources(messages: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """(key, at, id, name, body) of ``<source id= name=>`` blocks, entities decoded, once each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = re.compile(r"<source\b([^>]*)>(.*?)</source>", re.I | re.S)
        attr = re.compile(r"""(\w+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
        for part in parts:
            out = []
            for k, t in zip(part[key], part[text]):
                seen = set()
                for at, (attrs, body) in enumerate(block.findall(t or "")):
                    a = {n.lower(): html.unescape(x or y) for n, x, y in attr.findall(attrs)}
                    entry = (a.get("id"), a.get("name"), html.unescape(body).strip())
                    if entry not in seen:
                        seen.add(entry)
                        out.append((k, at, *entry))
            yield pd.DataFrame(out, columns=[key, "at", "id", "name", "body"])

    kind = messages.schema[key].dataType.simpleString()
    return messages.select(key, text).mapInPandas(run, f"{key} {kind}, at int, id string, name string, body string")


def first_object(text: str | None) -> str | None:
    """The first JSON object that begins anywhere in a text, as JSON."""
    reader = json.JSONDecoder()
    for m in re.finditer(r"\{", text or ""):
        try:
            found, _ = reader.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False)
    return None


def decisions(replies: DataFrame, text: str = "text", ask: dict[str, str] | None = None) -> DataFrame:
    """``replies`` with route, answer, document_query, section_query, retrieval_query, include_descendants.

    Anything that is no decision, unknown routes, and a general one without an answer give the route ``rag``; fields that
    a route has no use for are null, and where it lacks what it needs ``answer`` asks for it.
    """

    @F.pandas_udf("string")
    def found(c: pd.Series) -> pd.Series:
        return c.map(first_object)

    ask = ASK | (ask or {})
    d = F.from_json(found(F.col(text)), "route string, answer string, document_query string, section_query string, retrieval_query string, include_descendants string")
    out = replies.withColumn("d_", d)
    field = lambda n: F.nullif(F.trim(F.col(f"d_.{n}")), F.lit(""))
    route = F.lower(F.trim(F.col("d_.route")))
    known = route.isin(*ROUTES) & ~((route == "general") & field("answer").isNull())
    out = out.withColumn("route", F.when(known, route).otherwise("rag"))
    use = {"answer": ("general", "full_document", "document_section"), "document_query": ("full_document", "document_section"), "section_query": ("document_section",), "retrieval_query": ("rag", "documents")}
    for name, routes in use.items():
        out = out.withColumn(name, F.when(F.col("route").isin(*routes), field(name)))
    needs = {"document_section": "section_query", "full_document": "document_query"}
    for kind, need in needs.items():
        out = out.withColumn("answer", F.when((F.col("route") == kind) & F.col(need).isNull(), F.coalesce("answer", F.lit(ask[kind]))).otherwise(F.col("answer")))
    return out.withColumn("include_descendants", (F.col("route") == "document_section") & tx.loose_bool(F.col("d_.include_descendants"))).drop("d_")


def attachments(turns: DataFrame, question_mark: str = "### User Query:", budget: int = 60_000) -> DataFrame:
    """(conv_id, query, sources, prompt): what is attached to the question of each conversation.

    Source blocks of the last user turn count, or else those of the last system turn that has any; blocks of earlier user
    turns are history. Of the question the part after the last mark counts. A source is kept once by id (its first 1 to 4
    digits, or its place) and text, and sources are rendered until ``budget`` characters are used, the last one cut.
    Conversations without a source or a question are left out.
    """
    has = F.col("text").rlike(r"(?i)<source\b")
    last = turns.groupBy("conv_id").agg(
        F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("asked"),
        F.max_by(F.when((F.col("role") == "system") & has, F.col("text")), F.when((F.col("role") == "system") & has, F.col("turn"))).alias("given"),
    )

    @F.pandas_udf("query string, sources array<struct<id: string, name: string, text: string>>, prompt string")
    def run(asked: pd.Series, given: pd.Series) -> pd.DataFrame:
        out = []
        for a, g in zip(asked, given):
            a, g = ("" if x is None else x for x in (a, g))
            own = source_blocks(a)
            query = clean_query(a, question_mark)
            out.append((query, *render(query, own or source_blocks(g), budget)))
        return pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=object) for k, n in enumerate(("query", "sources", "prompt"))})

    got = last.select("conv_id", run("asked", "given").alias("r"))
    return got.select("conv_id", "r.query", "r.sources", "r.prompt").where("query != '' and size(sources) > 0")


_SOURCE = re.compile(r"<source\b([^>]*)>(.*?)</source\s*>", re.I | re.S)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def source_blocks(text: str) -> list[tuple[str, str | None, str]]:
    """(id, name, text) of the source blocks of a text, each once, entities decoded; empty ones are left out."""
    out: dict[tuple[str, str], tuple[str, str | None, str]] = {}
    for place, (attributes, body) in enumerate(_SOURCE.findall(text), 1):
        a = {n.lower(): html.unescape(x or y) for n, x, y in _ATTRIBUTE.findall(attributes)}
        digits = re.match(r"\s*(\d{1,4})", a.get("id") or "")
        key, told = digits[1] if digits else str(place), html.unescape(body).strip()
        if told:
            out.setdefault((key, told), (key, a.get("name") or a.get("title"), told))
    return list(out.values())


def clean_query(text: str, mark: str = "### User Query:") -> str:
    """The question behind the last mark, or what is left without context and source blocks."""
    if mark in text:
        text = text.rsplit(mark, 1)[1]
    text = re.sub(r"(?is)<context\b.*?</context\s*>", " ", text)
    return re.sub(r"(?i)</?(?:context|user_query|query)\b[^>]*>", " ", _SOURCE.sub(" ", text)).strip()


def render(query: str, found: list[tuple[str, str | None, str]], budget: int = 60_000) -> tuple[list[dict], str]:
    """Source records, and a prompt of the question and as many of them as fit in ``budget`` characters."""
    left, told = budget, []
    for key, name, text in found:
        head = f"SOURCE [{key}]" + (f" {name}" if name else "")
        room = left - len(head) - 24
        if room <= 0:
            break
        body = text if len(text) <= room else text[:room].rstrip() + "…"
        told.append(f"{head}\n{body}\nEND [{key}]")
        left -= len(head) + len(body) + 24
    return [{"id": k, "name": n, "text": t} for k, n, t in found], "\n\n".join([query, *told])


def clean_history(turns: DataFrame, most: int = 12, each: int = 4000) -> DataFrame:
    """The last ``most`` turns before the question, attached sources taken out of them, each cut to ``each`` characters."""
    no_source = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?is)<context\b.*?</context\s*>", " "), r"(?is)<source\b[^>]*>.*?</source\s*>", " ")
    after_mark = F.element_at(F.split("text", "### User Query:"), -1)
    text = tx.normalize_space(F.when(F.col("text").rlike(r"(?i)<source\b"), no_source(after_mark)).otherwise(F.col("text")))
    rows = turns.withColumn("text", text)
    cut = F.when(F.length("text") > each, F.concat(F.rtrim(F.left("text", F.lit(each - 1))), F.lit("…"))).otherwise(F.col("text"))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked_"))
    rows = rows.join(asked, "conv_id", "left").where("asked_ is null or turn != asked_").drop("asked_")
    return last_turns(rows, most, exclude_last_user=False).withColumn("text", cut)


def extractive(rows: DataFrame, most: int = 5, text: str = "raw_text", label: str = "citation_label", rank: str = "rank") -> DataFrame:
    """(answer): the first texts, each cut to 519 characters and dots, with numbered sources below."""
    body = F.when(F.length(text) > 520, F.concat(F.substring(text, 1, 519), F.lit("..."))).otherwise(F.col(text))
    best = rows.orderBy(rank).limit(most).select(F.row_number().over(Window.orderBy(rank)).alias("n"), body.alias("body"), label)
    list_ = F.array_sort(F.collect_list(F.struct("n", "body", F.col(label).alias("label"))))
    told = F.array_join(F.transform(list_, lambda x: F.concat(x["body"], F.lit(" ["), x["n"].cast("string"), F.lit("]"))), "\n\n")
    named = F.array_join(F.transform(list_, lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["label"])), "\n")
    return best.agg(F.concat(told, F.lit("\n\nSources:\n"), named).alias("answer"))
