"""Answer texts from a few collected rows, prompts, and cited sources. Templates are parameters by language."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

TEMPLATES = {
    "en": {
        "identity": "I answer questions about the documents of this collection.",
        "capabilities": "I find passages, show items, sections and appendices, list documents, and show whole documents.",
        "catalog": "Documents: {n}", "topic": "Documents about “{topic}”: {n}", "none": "Nothing was found.",
        "ambiguous": "The reference “{ref}” is ambiguous:", "missing": "“{ref}” was not found.", "near": "Did you mean:",
        "sources": "Sources:", "source": "Source [{n}]: {text}", "which_source": "There were several sources. Which one?",
        "which_item": "The list has {n} entries. Which ones?", "full": "Full text: {label}",
    },
    "ru": {
        "identity": "Я отвечаю на вопросы по документам этой коллекции.",
        "capabilities": "Я нахожу фрагменты, показываю пункты, разделы и приложения, перечисляю документы и вывожу их целиком.",
        "catalog": "Документов: {n}", "topic": "Документы по теме «{topic}»: {n}", "none": "Ничего не найдено.",
        "ambiguous": "Ссылка «{ref}» неоднозначна:", "missing": "«{ref}» не найдено.", "near": "Возможно, имелось в виду:",
        "sources": "Источники:", "source": "Источник [{n}]: {text}", "which_source": "Источников было несколько. Какой из них?",
        "which_item": "В списке вариантов: {n}. Какие из них?", "full": "Полный текст: {label}",
    },
}
ASK = {"ru": {"document_section": "Какой пункт или раздел нужен?", "full_document": "Какой документ показать целиком?"}}


def label(row: dict) -> str:
    """Title (or file name), index code and version of a document."""
    name = row.get("document_title") or row.get("source_name") or row.get("doc_id") or ""
    more = [x for x in (row.get("index_code"), row.get("version")) if x]
    return f"{name} ({', '.join(more)})" if more else name


def listing(rows: Sequence[dict], kind: str = "catalog", language: str = "en", most: int = 12, **values: str) -> str:
    """A numbered list of documents under a headline."""
    t = TEMPLATES[language]
    if not rows:
        return t["none"]
    lines = [f"{k}. {label(r)}" for k, r in enumerate(rows[:most], 1)]
    return "\n".join([t[kind].format(n=len(rows), **values), *lines])


def not_found(reference: str, candidates: Sequence[dict] = (), language: str = "en") -> str:
    """That a document was not found, and the nearest ones."""
    t = TEMPLATES[language]
    near = [f"- {label(r)}" for r in candidates]
    return "\n".join([t["missing"].format(ref=reference), *([t["near"], *near] if near else [])])


def section(reference: str, rows: Sequence[dict], places: int, language: str = "en") -> str:
    """The texts of a structural lookup, or why there are none: not found, or several places."""
    t = TEMPLATES[language]
    if not rows:
        return t["missing"].format(ref=reference)
    if places > 1:
        return "\n".join([t["ambiguous"].format(ref=reference), *dict.fromkeys(f"- {r['citation_label']}" for r in rows)])
    return "\n\n".join(r["raw_text"] for r in rows)


def full_text(document: dict, text: str, language: str = "en") -> str:
    return f"{TEMPLATES[language]['full'].format(label=label(document))}\n\n{text}"


def ambiguous(resolved: dict, language: str = "en") -> str:
    """Asks which source, or which entries of a list, is meant."""
    t, items = TEMPLATES[language], resolved["items"]
    if resolved["reference_type"] == "list_selection_ambiguity":
        return t["which_item"].format(n=len(items))
    return "\n".join([t["which_source"], *(f"{i['label']}. {t['source'].format(n=i['label'], text=i['text'])}" for i in items)])


def cited(text: str, most: int) -> list[int]:
    """Numbers in brackets between 1 and ``most``, once each, in order."""
    return list(dict.fromkeys(n for n in map(int, re.findall(r"\[(\d{1,3})\]", text)) if 1 <= n <= most))


def has_sources(text: str) -> bool:
    heads = "|".join(re.escape(t["sources"]) for t in TEMPLATES.values())
    return re.search(rf"(?im)^\s*(?:{heads})", text) is not None


def with_sources(text: str, labels: Sequence[str], language: str = "en") -> str:
    """The answer with the sources it cites below, or all if it cites none; unless it has such a block already."""
    if not labels or has_sources(text):
        return text
    use = cited(text, len(labels)) or range(1, len(labels) + 1)
    return "\n".join([text, "", TEMPLATES[language]["sources"], *(f"[{n}] {labels[n - 1]}" for n in use)])


def parse_sources(text: str | None) -> list[tuple[int, str]]:
    """(number, label) of the source block of an answer: below the last headline, up to the first other line after one."""
    heads = [t["sources"].rstrip(":").lower() for t in TEMPLATES.values()]
    lines = (text or "").splitlines()
    at = max((k for k, x in enumerate(lines) if x.strip().strip("*#: ").lower() in heads), default=None)
    out: list[tuple[int, str]] = []
    for line in [] if at is None else lines[at + 1 :]:
        m = re.match(r"\s*(?:[-*]\s*)?\[(\d{1,3})\]\s*(.*\S)", line)
        if m:
            out.append((int(m[1]), m[2].strip()))
        elif out and line.strip():
            break
    return out


def extractive(question: str, rows: Sequence[dict], most: int = 5, language: str = "en") -> str:
    """The first texts, each cut to 519 characters and dots, with their numbers."""
    if not rows:
        return TEMPLATES[language]["none"]
    cut = lambda s: s if len(s) <= 520 else s[:519] + "..."
    return "\n\n".join(f"{cut(' '.join((r.get('raw_text') or '').split()))} [{k}]" for k, r in enumerate(rows[:most], 1))


def sources_block(rows: Sequence[dict], each: int = 1400) -> str:
    """Numbered sources for a prompt, each cut to ``each`` characters."""
    cut = lambda s: s if len(s) <= each else s[: each - 1] + "…"
    return "\n\n".join(f"[{k}] {r['citation_label']}\n{cut(r['raw_text'])}" for k, r in enumerate(rows, 1))


def history_block(history: Sequence[dict], each: int = 4000, total: int = 24_000) -> list[dict]:
    """The newest messages, each cut in the middle, until the first that doesn't fit."""
    out: list[dict] = []
    for m in reversed(history):
        text = " ".join(m["text"].split())
        if len(text) > each:
            head = each // 3
            text = f"{text[:head].rstrip()} ... {text[-(each - head - 5) :].lstrip()}"
        if m["role"] not in ("user", "assistant") or not text:
            continue
        if total < len(text):
            break
        total -= len(text)
        out.append({"role": m["role"], "content": text})
    return out[::-1]


def messages(question: str, rows: Sequence[dict], history: Sequence[dict] = (), system: str = "Answer from the sources and cite them as [N].") -> list[dict]:
    """A prompt of system rule, earlier turns, and sources with the question."""
    return [{"role": "system", "content": system}, *history_block(history), {"role": "user", "content": f"{sources_block(rows)}\n\n{question}"}]


def router_messages(question: str, history: Sequence[dict] = (), resolved: dict | None = None, system: str = "Choose a route and answer in JSON.") -> list[dict]:
    """What a router sees: a rule, and the history, question and resolved reference as JSON."""
    body = {"history": [{"role": m["role"], "content": m["text"]} for m in history], "query": question}
    if resolved:
        body["resolved_reference"] = resolved
    return [{"role": "system", "content": system}, {"role": "user", "content": json.dumps(body, ensure_ascii=False)}]


def benchmark_p95(values: Sequence[float]) -> float:
    """The 95th percentile by rank ``int(0.95 n + 0.9999)``, as the latency benchmark takes it."""
    by = sorted(values)
    return by[min(max(int(len(by) * 0.95 + 0.9999) - 1, 0), len(by) - 1)]
