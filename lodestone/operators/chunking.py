"""Chunks of documents: paragraphs packed up to a number of characters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1800
STAND_ALONE = {"front_matter", "heading", "appendix_heading", "appendix_title"}
OPENERS = {"numbered_paragraph": "numbered_item", "appendix_numbered_item": "appendix_item"}
LISTS = {"list_item": "list", "letter_bullet": "list", "appendix_bullet": "appendix_list"}
NAMES = {
    "en": {"document": "Document", "index": "Index", "kind": "Kind", "organization": "Organization", "version": "Version", "approved": "Approved", "order": "Order", "effective": "Effective", "pages": "Pages", "file": "File", "source": "Source", "appendix": "Appendix No.", "section": "Section", "item": "Item", "cite_version": "version", "cite_appendix": "appendix No.", "cite_section": "section", "cite_item": "item", "part": "part", "header": "header", "footer": "footer", "footnote": "footnote", "endnote": "endnote", "body": "text box", "other": "additional text"},
    "ru": {"document": "Документ", "index": "Индекс", "kind": "Тип", "organization": "Организация", "version": "Версия", "approved": "Дата утверждения", "order": "Номер приказа", "effective": "Дата ввода в действие", "pages": "Листов", "file": "Файл", "source": "Источник", "appendix": "Приложение №", "section": "Раздел", "item": "Пункт", "cite_version": "версия", "cite_appendix": "приложение №", "cite_section": "раздел", "cite_item": "пункт", "part": "часть", "header": "верхний колонтитул", "footer": "нижний колонтитул", "footnote": "сноска", "endnote": "концевая сноска", "body": "текстовый блок", "other": "дополнительный текст"},
}
METADATA = (("document", "display_title"), ("index", "index_code"), ("kind", "document_kind"), ("organization", "organization"), ("version", "version"), ("approved", "approval_date"), ("order", "approval_order"), ("effective", "effective_date"), ("pages", "declared_pages"), ("file", "source_name"))
SCHEMA = "doc_id string, ordinal int, chunk_id string, chunk_type string, source_name string, index_code string, document_title string, version string, citation_label string, raw_text string, searchable_text string, section_path array<string>, section_labels array<string>, section_title string, subsection_title string, item_number string, heading_number string, appendix_number string, appendix_title string, block_ids array<string>, part int, char_count int"


def split_text(text: str, most: int = MAX_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters: whole paragraphs, else sentences, else hard cuts."""
    if len(text) <= most:
        return [text]
    out: list[str] = []
    held = ""

    def put(piece: str) -> None:
        nonlocal held
        joined = f"{held}\n{piece}" if held else piece
        if len(joined) <= most:
            held = joined
            return
        if held:
            out.append(held)
        held = piece

    for paragraph in filter(None, (p.strip() for p in text.split("\n"))):
        if len(paragraph) <= most:
            put(paragraph)
            continue
        for sentence in filter(None, re.split(r"(?<=[.!?;:])\s+", paragraph)):
            if len(sentence) <= most:
                put(sentence)
                continue
            if held:
                out.append(held)
                held = ""
            out += [sentence[i : i + most] for i in range(0, len(sentence), most)]
    return [*out, held] if held else out


def chunk_id(doc: str, ordinal: int, block_ids: list[str], part: int, text: str) -> str:
    digest = hashlib.sha1("|".join([doc, ",".join(block_ids), str(part), text]).encode()).hexdigest()
    return f"{doc}::chunk-{ordinal:04d}-{digest[:12]}"


def line(text: object) -> str:
    return " ".join(str(text or "").split())


def block_text(block: dict) -> str:
    """The text of a block with its number or marker in front, unless it has it already."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub("[ \t]+", " ", (block.get("text") or "").replace("\xa0", " "))).strip()
    kind = block["kind"]
    if block.get("display_prefix") and kind in (*OPENERS, "heading", "list_item", "appendix_bullet"):
        return f"{block['display_prefix']}{text}".strip()
    mark = block.get("heading_number") if kind == "heading" else block.get("item_number") if kind in OPENERS else block.get("item_marker") if kind in LISTS else None
    mark = line(mark)
    if not mark or text.startswith(mark):
        return text
    return f"{mark}{')' if len(mark) == 1 and mark.isalpha() else ''} {text}"


def metadata_text(metadata: dict, language: str = "en") -> str:
    return "\n".join(f"{NAMES[language][n]}: {metadata[k]}" for n, k in METADATA if metadata.get(k) not in (None, "", []))


def place(metadata: dict, unit: dict, language: str = "en", part: int = 0) -> tuple[str, str]:
    """(citation label, context) of a unit: where in which document it is, in a phrase and in lines."""
    n, first = NAMES[language], unit["blocks"][0]
    item = next((b["item_number"] for b in unit["blocks"] if b.get("item_number")), None)
    title, version = line(metadata.get("display_title") or metadata.get("source_name") or metadata.get("doc_id")), line(metadata.get("version"))
    label = [f"{title} ({n['cite_version']} {version})" if version else title]
    context = [f"{n[k]}: {line(metadata.get(f))}" for k, f in (("document", "display_title"), ("index", "index_code"), ("version", "version")) if metadata.get(f)]
    sections = " / ".join(filter(None, map(line, first.get("section_labels") or [])))
    if unit["type"] == "supplemental":
        story = n.get(first.get("source_story") or "", n["other"])
        label.append(story)
        context.append(f"{n['source']}: {story}")
    elif first.get("appendix_number"):
        number, named = line(first["appendix_number"]), line(first.get("appendix_title"))
        label.append(f"{n['cite_appendix']} {number}" + (f" {named}" if named else ""))
        context.append(f"{n['appendix']} {number}" + (f": {named}" if named else ""))
    elif sections:
        label.append(f"{n['cite_section']} {sections}")
        context.append(f"{n['section']}: {sections}")
    if item and unit["type"] != "supplemental":
        label.append(f"{n['cite_item']} {line(item)}")
        if not first.get("appendix_number"):
            context.append(f"{n['item']}: {line(item)}")
    if part:
        label.append(f"{n['part']} {part}")
    return ", ".join(label), "\n".join(context)


def pack_blocks(doc: str, blocks: list[dict], most: int = MAX_CHARS, metadata: dict | None = None, language: str = "en") -> list[dict]:
    """Chunks of one document from its typed blocks, in order; one of its metadata comes first if it has any."""
    out: list[dict] = []
    unit: dict | None = None
    about = {"doc_id": doc} | (metadata or {})

    def text_of(blocks: list[dict]) -> str:
        return "\n".join(t for t in (b["text"].strip() if b["kind"] == "metadata" else block_text(b) for b in blocks) if t)

    def flush() -> None:
        nonlocal unit
        if unit is None:
            return
        text = text_of(unit["blocks"])
        pieces = split_text(text, most) if text else []
        ids = [b["block_id"] for b in unit["blocks"]]
        first = unit["blocks"][0]
        item = next((b["item_number"] for b in unit["blocks"] if b.get("item_number")), None)
        labels = [line(x) for x in first.get("section_labels") or []]
        for k, piece in enumerate(pieces, 1):
            part = k if len(pieces) > 1 else 0
            n = len(out) + 1
            label, context = place(about, unit, language, part)
            told = re.sub(r"\n{3,}", "\n\n", re.sub("[ \t]+", " ", "\n\n".join(filter(None, (context, piece))))).strip()
            out.append({"doc_id": doc, "ordinal": n, "chunk_id": chunk_id(doc, n, ids, part, piece), "chunk_type": unit["type"], "source_name": about.get("source_name") or "", "index_code": about.get("index_code"), "document_title": about.get("display_title"), "version": about.get("version"), "citation_label": label, "raw_text": piece, "searchable_text": told, "section_path": list(first.get("section_path") or []), "section_labels": labels, "section_title": labels[0] if labels else None, "subsection_title": labels[1] if len(labels) > 1 else None, "item_number": item, "heading_number": first.get("heading_number"), "appendix_number": first.get("appendix_number"), "appendix_title": line(first.get("appendix_title")) or None, "block_ids": ids, "part": part, "char_count": len(piece)})
        unit = None

    if metadata and (told := metadata_text(metadata, language)):
        unit = {"type": "metadata", "blocks": [{"block_id": "metadata", "kind": "metadata", "text": told}]}
        flush()

    def absorbs(block: dict) -> bool:
        if unit is None:
            return False
        first = unit["blocks"][0]
        size = len(text_of(unit["blocks"])) + 1 + len(block_text(block))
        return first.get("appendix_number") == block.get("appendix_number") and list(first.get("section_path") or []) == list(block.get("section_path") or []) and size <= most

    for block in blocks:
        kind = block["kind"]
        if kind in STAND_ALONE:
            flush()
            unit = {"type": kind, "blocks": [block]}
            flush()
        elif kind in OPENERS:
            flush()
            unit = {"type": OPENERS[kind], "blocks": [block]}
        elif kind in LISTS:
            if unit and unit["type"] in ("numbered_item", "appendix_item") and absorbs(block):
                unit["blocks"].append(block)
            else:
                flush()
                unit = {"type": LISTS[kind], "blocks": [block]}
        elif kind == "supplemental":
            if unit and unit["type"] == "supplemental" and unit["blocks"][0].get("source_story") == block.get("source_story") and absorbs(block):
                unit["blocks"].append(block)
            else:
                flush()
                unit = {"type": "supplemental", "blocks": [block]}
        elif absorbs(block) and unit["type"] != "supplemental":
            unit["blocks"].append(block)
        else:
            flush()
            unit = {"type": {"paragraph": "section_text", "appendix_paragraph": "appendix_text"}.get(kind, "other"), "blocks": [block]}
    flush()
    return out


def chunk_blocks(blocks: DataFrame, most: int = MAX_CHARS, metadata: DataFrame | None = None, key: str = "doc_id", language: str = "en") -> DataFrame:
    """Chunks of all documents, their blocks packed in order.

    blocks: ``key``, pos, block_id, kind, text, section_path, section_labels, heading_number, item_number, item_marker,
    appendix_number, appendix_title, source_story, display_prefix; all but the first five may be missing. ``metadata``: a
    row per ``key`` with doc_id and the fields of METADATA; documents without one are known by their key.
    """
    columns = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]

    def plain(x: object) -> object:
        if hasattr(x, "tolist"):
            x = x.tolist()
        return None if x is None or isinstance(x, float) and x != x else x

    def made(pdf: pd.DataFrame, about: dict | None) -> pd.DataFrame:
        rows = [{k: plain(v) for k, v in r.items()} for r in pdf.sort_values("pos").to_dict("records")]
        for r in rows:
            r["text"] = r["text"] or ""
        doc = str((about or {}).get("doc_id") or rows[0][key])
        got = pd.DataFrame(pack_blocks(doc, rows, most, about, language), columns=columns).astype(object)
        return got.where(got.notna(), None)

    if metadata is None:
        return blocks.groupBy(key).applyInPandas(lambda pdf: made(pdf, None), SCHEMA)

    def both(pdf: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        return made(pdf, {k: plain(v) for k, v in meta.iloc[0].to_dict().items()} if len(meta) else None)

    # new columns, as both may come from the same rows
    blocks, metadata = (df.select(*(F.col(f"`{c}`").alias(f"{c}") for c in df.columns)) for df in (blocks, metadata))
    return blocks.groupBy(key).cogroup(metadata.groupBy(key)).applyInPandas(both, SCHEMA)


def chunk_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_CHARS) -> DataFrame:
    """(doc_id, ordinal, raw_text, char_count): plain texts in pieces of at most ``most`` characters."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, p, len(p)) for i, t in zip(part[doc_id], part[text]) for n, p in enumerate(split_text(t or "", most), 1) if p]
            yield pd.DataFrame(rows, columns=[doc_id, "ordinal", "raw_text", "char_count"])

    return docs.select(doc_id, text).mapInPandas(run, f"`{doc_id}` {kind}, ordinal int, raw_text string, char_count int")
