"""Typed, hierarchical blocks from raw ones, and document metadata.

Blocks of a document are a sequence with state (contents page, headings above, appendix), so they are folded in order,
one group per document; metadata are first matches and stay in column expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SCHEMA = "path string, pos int, block_id string, kind string, text string, source_kind string, section_path array<string>, section_labels array<string>, heading_number string, item_number string, item_marker string, appendix_number string, appendix_title string, heading_level int"
NUMBER = re.compile(r"^(\d+(?:\.\d+)*)[.)]?\s+(.*\S)", re.S)
LETTER = re.compile(r"^([a-zа-я])\)\s+(.*\S)", re.I | re.S)
APPENDIX = re.compile(r"^(?:приложение|appendix)\s*(?:№|no\.?)?\s*(\d+|[A-ZА-Я])\b[.:\s]*(.*)$", re.I | re.S)
TOC_TITLE = re.compile(r"^(?:содержание|оглавление|contents|table of contents)$", re.I)
TOC_ENTRY = re.compile(r"(?:\.{3,}|\t|\s{2,}|\s)\s*\d+$")
BULLETS = "•▪➢-–—·"


def number_of(text: str) -> tuple[str, str, int] | None:
    """Dotted number, the rest, and the level (dots + 1); rests that are digits only don't count."""
    m = NUMBER.match(text)
    return (m[1], m[2].strip(), m[1].count(".") + 1) if m and not m[2].strip().isdigit() else None


def is_heading(block: dict, title: str, level: int) -> bool:
    """Whether a numbered paragraph is a heading rather than an item."""
    style = (block.get("style") or "").lower()
    if style.startswith(("heading", "заголовок")):
        return True
    bold = (block.get("bold_ratio") or 0) >= 0.55
    if block["source_kind"] == "table_row" or (block.get("label") and not bold):
        return False
    if level <= 2:
        return True
    if title.endswith((".", ";", ":")) or len(title) > 90:
        return False
    letters = [c for c in title if c.isalpha()]
    return bold or (bool(letters) and sum(c.isupper() for c in letters) >= 0.8 * len(letters))


def fold(blocks: list[dict]) -> list[dict]:
    """Typed blocks of one document from its raw ones in order."""
    out: list[dict] = []
    path: list[tuple[int, str, str]] = []
    appendix: tuple[str, str | None] | None = None
    toc = waits = False
    seen: dict[str, int] = {}
    body = False

    def put(raw: dict, kind: str, text: str, base: str, **more: object) -> None:
        seen[base] = seen.get(base, 0) + 1
        name = base if seen[base] == 1 else f"{base}--{seen[base]}"
        while seen[base] > 1 and name in seen:
            seen[base] += 1
            name = f"{base}--{seen[base]}"
        seen.setdefault(name, 1)
        out.append({"pos": raw["pos"], "block_id": name, "kind": kind, "text": text, "source_kind": raw["source_kind"], "section_path": [p[1] for p in path], "section_labels": [p[2] for p in path], "heading_number": None, "item_number": None, "item_marker": None, "appendix_number": appendix[0] if appendix else None, "appendix_title": appendix[1] if appendix else None, "heading_level": None, **more})

    for raw in blocks:
        text = (raw.get("text") or "").strip()
        style = (raw.get("style") or "").lower()
        if not text:
            continue
        if TOC_TITLE.match(text) or style.startswith("toc"):
            toc = True
            continue
        if toc:
            if TOC_ENTRY.search(text):
                continue
            toc = False
        hit = APPENDIX.match(text)
        if hit and raw["source_kind"] == "paragraph":
            path, body = [], True
            appendix = (hit[1], hit[2].strip() or None)
            waits = appendix[1] is None
            put(raw, "appendix_heading", text, f"appendix-{hit[1].lower()}", heading_number=hit[1])
            continue
        if appendix and waits:
            waits = False
            if not number_of(text) and len(text) <= 200:
                appendix = (appendix[0], text)
                put(raw, "appendix_title", text, f"appendix-{appendix[0].lower()}-title")
                continue
        numbered, letter = number_of(text), LETTER.match(text)
        bullet = text[0] in BULLETS
        inside = f"a{appendix[0].lower()}-" if appendix else ""
        if appendix:
            if bullet or letter:
                put(raw, "appendix_bullet", text, f"{inside}bullet", item_marker=text[0] if bullet else letter[1])
            elif numbered:
                put(raw, "appendix_numbered_item", text, f"{inside}item-{numbered[0]}", item_number=numbered[0])
            else:
                put(raw, "appendix_paragraph", text, f"{inside}paragraph")
        elif bullet:
            put(raw, "list_item", text, "list-item", item_marker=text[0])
        elif letter:
            put(raw, "letter_bullet", text, f"letter-{letter[1].lower()}", item_marker=letter[1])
        elif numbered and is_heading(raw, numbered[1], numbered[2]):
            body = True
            path = [p for p in path if p[0] < numbered[2]] + [(numbered[2], numbered[0], f"{numbered[0]} {numbered[1]}")]
            put(raw, "heading", text, f"section-{numbered[0]}", heading_number=numbered[0], heading_level=numbered[2])
        elif numbered:
            put(raw, "numbered_paragraph", text, f"item-{numbered[0]}", item_number=numbered[0])
        elif style.startswith(("heading", "заголовок")):
            level = int(re.sub(r"\D", "", style) or 1)
            body = True
            path = [p for p in path if p[0] < level] + [(level, tx_slug(text), text)]
            put(raw, "heading", text, f"section-{tx_slug(text)}", heading_level=level)
        else:
            put(raw, "paragraph" if body else "front_matter", text, "paragraph" if body else "front")
    return out


def tx_slug(text: str) -> str:
    return re.sub("[^a-zа-яё0-9]+", "-", text.lower()).strip("-") or "document"


def typed_blocks(raw: DataFrame) -> DataFrame:
    """Typed blocks of all documents, from the rows of ``docx.read_blocks``; rows with errors are left out."""
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        made = pd.DataFrame([{"path": rows[0]["path"], **b} for b in fold(rows)], columns=names).astype(object)
        return made.where(made.notna(), None)

    return raw.where("error is null").groupBy("path").applyInPandas(run, SCHEMA)


def _first(pattern: str, group: int = 1) -> Column:
    got = F.nullif(F.trim(F.regexp_extract("text", pattern, group)), F.lit(""))
    return F.min_by(F.when(got.isNotNull(), got), F.when(got.isNotNull(), F.col("pos")))


KINDS = ("политика", "положение", "регламент", "инструкция", "порядок", "правила", "стандарт", "методика", "policy", "regulation", "procedure", "instruction", "standard", "rules", "guideline")
FIELD_LINE = r"(?iu)^(?:индекс|index|версия|version|дата введения|effective|приказ|order|утвержд|approved|всего страниц|листов|pages)\b"


def titles(raw: DataFrame) -> DataFrame:
    """(path, title_lines): the lines in capitals, or in a title style, before the first number, heading or contents page."""
    letters = F.regexp_replace("text", r"(?U)[^\p{L}]", "")
    capitals = F.length(F.regexp_replace(letters, r"(?U)[^\p{Lu}]", ""))
    style = F.lower(F.coalesce("style", F.lit("")))
    ends = F.col("text").rlike(r"(?iu)^\s*(?:\d+(?:\.\d+)*[.)]?\s+\S|(?:содержание|оглавление|contents|table of contents)\s*$)") | style.rlike("^(?:heading|заголовок|toc)")
    end = raw.where(ends).groupBy("path").agg(F.min("pos").alias("end_"))
    title = ((F.length(letters) >= 3) & (capitals >= 0.8 * F.length(letters)) | style.rlike("^(?:title|название)")) & ~F.col("text").rlike(FIELD_LINE) & ~F.col("text").rlike(ORGANIZATION)
    lines = raw.join(end, "path", "left").where((F.col("end_").isNull() | (F.col("pos") < F.col("end_"))) & title)
    ordered = F.array_sort(F.collect_list(F.struct("pos", tx.normalize_space(F.col("text")).alias("t"))))
    return lines.groupBy("path").agg(F.transform(ordered, lambda x: x["t"]).alias("title_lines"))


ORGANIZATION = r"(?u)(?:^|[\s«\"(])(?:ООО|АО|ПАО|ЗАО|Inc\.?|Ltd\.?|LLC|GmbH)(?:$|[\s»\").,])"


def metadata(raw: DataFrame) -> DataFrame:
    """(path, source_name, doc_id, index_code, version, effective_date, approval_date, approval_order, declared_pages,
    organization, title_lines, display_title, document_kind) of all documents: the first match of each field in order."""
    rows = raw.where("error is null")
    got = rows.groupBy("path").agg(
        _first(r"(?iu)^(?:индекс(?:\s+нд)?|index(?:\s+code)?)\s*[:№]\s*(\S+)").alias("index_code"),
        _first(r"(?iu)(?:версия|version)\s*[:№]?\s*(\d+(?:\.\d+)*)").alias("version"),
        _first(r"(?iu)(?:дата введения|effective(?: date)?)\s*:?\s*(\d{2}\.\d{2}\.\d{4})").alias("effective_date"),
        _first(r"(?iu)(?:приказ\S*|order)\D{0,40}от\s*(\d{2}\.\d{2}\.\d{4})").alias("approval_date"),
        _first(r"(?iu)(?:приказ\S*|order)[^№]{0,60}№\s*(\S+)").alias("approval_order"),
        _first(r"(?iu)(?:всего страниц|листов|pages)\s*:?\s*(\d+)").cast("int").alias("declared_pages"),
        F.min_by(F.when(F.col("text").rlike(ORGANIZATION), tx.normalize_space(F.col("text"))), F.when(F.col("text").rlike(ORGANIZATION), F.col("pos"))).alias("organization"),
    ).join(titles(rows), "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?i)\.docx$", "")
    version = F.coalesce("version", F.nullif(F.regexp_extract("index_code", r"-(\d+\.\d+)$", 1), F.lit("")))
    title = F.nullif(F.array_join("title_lines", " "), F.lit(""))
    kind = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: w.isin(*KINDS))
    return got.withColumns({"source_name": name, "version": version, "display_title": title, "document_kind": F.get(kind, F.lit(0)), "doc_id": tx.slug(F.coalesce("index_code", title, stem))})
