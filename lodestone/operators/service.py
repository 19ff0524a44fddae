"""The answer service: a question, a route, and the operators that answer it, over tables of documents and chunks.

``Corpus`` holds the tables and what is injected: an embedder, a model that completes messages, templates by language. All
reads are plans; the driver sees the few rows that an answer is written from.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as tx
from . import answers, dialog, lookup, ranking, references, search, store

Embed = Callable[[str], Sequence[float]]
Complete = Callable[[list[dict]], str]


@dataclass
class Answer:
    """``rows``: what the answer rests on; ``sources``: their labels, once each; ``timings``: milliseconds by step."""

    query: str
    answer: str
    route: str
    mode: str = "service"
    sources: list[str] = field(default_factory=list)
    rows: list[Row] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)

    def server_timing(self) -> str:
        """The steps as a Server-Timing header."""
        return ", ".join(f"{k};dur={v:.2f}" for k, v in self.timings.items())


@dataclass
class Corpus:
    documents: DataFrame
    chunks: DataFrame
    embed: Embed
    complete: Complete | None = None
    route: Callable[[str, list[dict]], dict] | None = None
    model: str | None = None
    language: str = "en"
    index: str | None = None

    # -- single questions to the tables

    def counts(self) -> tuple[int, int]:
        """Documents and chunks."""
        return self.documents.count(), self.chunks.count()

    def health(self) -> dict:
        """Counts and the embedding profile, or what is wrong with it."""
        documents, chunks = self.counts()
        out: dict = {"status": "ok", "documents": documents, "chunks": chunks}
        try:
            store.check_profile(self.chunks, self.model or "", len(self.embed("health")))
        except ValueError as e:
            out |= {"status": "error", "error": str(e)}
        return out

    def search(self, query: str, limit: int = 6, candidates: int = 40) -> list[Row]:
        vector = self.embed(query)
        if self.model is not None:
            store.check_profile(self.chunks, self.model, len(vector))
        return search.hybrid_search(self.chunks, vector, query, limit, candidates, candidates, text="searchable_text", index=self.index).collect()

    def topic(self, query: str, limit: int = 12, **cutoffs: float) -> list[Row]:
        """The documents about a topic: 180 candidates on each side, the best 100 chunks, ranked by document."""
        rows = self.search(query, 100, 180)
        if not rows:
            return []
        spark = self.chunks.sparkSession
        fields = ("doc_id", "source_name", "document_title", "index_code", "version", "vector_score", "text_score", "hybrid_score", "vector_rank", "text_rank")
        kinds = ", ".join(f"{c} {'double' if c.endswith('score') else 'int' if c.endswith('rank') else 'string'}" for c in fields)
        known = rows[0].asDict()
        scored = spark.createDataFrame([(*(r[c] if c in known else None for c in fields), k) for k, r in enumerate(rows)], f"{kinds}, position int")
        return ranking.rank_documents(scored, limit, **cutoffs).collect()

    def document(self, name: str) -> tuple[Row | None, list[Row]]:
        """The document that a name means, and the candidates."""
        found = lookup.find(self.documents, name)
        chosen = lookup.select(found, name).collect()
        return (chosen[0] if chosen else None), found.collect()

    def structural(self, reference: str, doc_id: str | None = None, descendants: bool = False) -> tuple[list[Row], list[Row]]:
        """The chunks that a structural reference hits, and the places that they are at."""
        spark = self.chunks.sparkSession
        ref = spark.createDataFrame([(reference,)], "r string").select(tx.reference(F.col("r")).alias("x")).first().x
        if ref is None or ref.kind is None:
            return [], []
        found = lookup.structural(self.chunks, ref.kind, ref.number, ref.appendix, doc_id, descendants)
        rows = found.collect()
        if not rows:
            return [], []
        return rows, lookup.anchors(found, descendants, ref.number).collect()

    # -- answers

    def sections(self, query: str, wanted: list[tuple[str, str]], descendants: bool = False) -> Answer:
        """The texts of several places, each in its document, or why there is none: one block each."""
        t, blocks, kept = self.language, [], []
        for place, name in wanted:
            document, candidates = self.document(name) if name else (None, [])
            if name and document is None:
                blocks.append(answers.not_found(name, [r.asDict() for r in candidates], t))
                continue
            rows, places = self.structural(place, document.doc_id if document else None, descendants)
            blocks.append(answers.section(place, [r.asDict() for r in rows], len(places), t))
            if len(places) == 1:
                kept += rows
        unique = list({r.chunk_id: r for r in reversed(kept)}.values())[::-1]
        return Answer(query, "\n\n---\n\n".join(blocks), "document_section", sources=list(dict.fromkeys(r.citation_label for r in unique)), rows=unique)

    def full_document(self, query: str, name: str) -> Answer:
        document, candidates = self.document(name)
        if document is None:
            return Answer(query, answers.not_found(name, [r.asDict() for r in candidates], self.language), "full_document")
        rows = self.chunks.where((F.col("doc_id") == document.doc_id) & (F.col("chunk_type") != "metadata"))
        text = lookup.full_text(rows).collect()
        return Answer(query, answers.full_text(document.asDict(), text[0].full_text if text else "", self.language), "full_document")

    def listing(self, query: str, topic: str | None = None) -> Answer:
        if topic:
            rows = self.topic(topic)
            return Answer(query, answers.listing([r.asDict() for r in rows], "topic", self.language, topic=topic), "documents")
        rows = lookup.catalog(self.documents).collect()
        return Answer(query, answers.listing([r.asDict() for r in rows], "catalog", self.language, most=len(rows)), "documents")

    def generated(self, query: str, history: list[dict], retrieval: str, limit: int, extractive: bool) -> Answer:
        began = time.perf_counter()
        rows = self.search(retrieval, limit)
        took = {"search": (time.perf_counter() - began) * 1000}
        labels = [r.citation_label for r in rows]
        if extractive or self.complete is None:
            return Answer(query, answers.extractive(query, [r.asDict() for r in rows], language=self.language), "rag", "extractive", labels, rows, took)
        began = time.perf_counter()
        told = self.complete(answers.messages(query, [r.asDict() for r in rows], history))
        return Answer(query, told, "rag", "generated", labels, rows, took | {"generation": (time.perf_counter() - began) * 1000})

    def answer(self, query: str, history: list[dict] | None = None, limit: int = 6, extractive: bool = False) -> Answer:
        """Routes a question and answers it; ``history``: earlier messages with role and text, oldest first.

        The route is asked of ``route`` (the question, and the messages that fit); without one, or if it gives no valid
        decision, the chunks are searched. References to earlier answers come first: an ambiguous one is asked back, and
        choices from a list are looked up as places.
        """
        began, history = time.perf_counter(), list(history or [])
        resolved = self.resolved(query, history)
        kind = (resolved or {}).get("reference_type")
        if kind in ("citation_ambiguity", "list_selection_ambiguity"):
            return self.timed(Answer(query, answers.ambiguous(resolved, self.language), "document_section"), began)
        decision = self.decided(query, history, resolved)
        descendants = decision["include_descendants"] or self.column(dialog.asks_descendants, query)
        wanted = references.requests(resolved, decision["route"], decision["section_query"] or "", decision["document_query"] or "")
        route = "document_section" if wanted and kind == "list_selection" else decision["route"]
        if route in ("identity", "capabilities"):
            out = Answer(query, answers.TEMPLATES[self.language][route], route)
        elif route == "documents":
            out = self.listing(query, decision["retrieval_query"])
        elif route == "document_section":
            out = self.sections(query, wanted, descendants) if wanted else Answer(query, decision["answer"] or "", route)
        elif route == "full_document":
            out = self.full_document(query, decision["document_query"]) if decision["document_query"] else Answer(query, decision["answer"] or "", route)
        elif route == "general":
            out = Answer(query, decision["answer"] or "", route, "generated")
        else:
            out = self.generated(query, history, decision["retrieval_query"] or self.retrieval(query, history), limit, extractive)
        return self.timed(out, began)

    # -- parts of an answer

    def resolved(self, query: str, history: list[dict]) -> dict | None:
        said = [m["text"] for m in history if m["role"] == "assistant"]
        cited = next((t for t in reversed(said) if any(map(references.SOURCE_LINE.match, t.splitlines()))), None)
        return references.resolution(query, said[-1] if said else None, cited)

    def decided(self, query: str, history: list[dict], resolved: dict | None) -> dict:
        spark = self.chunks.sparkSession
        reply = "{}"
        if self.route is not None:
            turns = spark.createDataFrame([(0, k, m["role"], m["text"]) for k, m in enumerate(history)], "conv_id int, turn int, role string, text string")
            fits = dialog.history_budget(turns, 30_000, 5000, 24, 160).orderBy("turn").collect()
            reply = self.route(query, answers.router_messages(query, [{"role": r.role, "text": r.text} for r in fits], resolved))
        return dialog.decisions(spark.createDataFrame([(reply,)], "text string"), ask=answers.ASK.get(self.language)).first().asDict()

    def retrieval(self, query: str, history: list[dict]) -> str:
        rows = [(0, k, m["role"], m["text"]) for k, m in enumerate(history)] + [(0, len(history), "user", query)]
        turns = self.chunks.sparkSession.createDataFrame(rows, "conv_id int, turn int, role string, text string")
        return dialog.retrieval_query(turns).first().query

    def column(self, f: Callable, text: str):
        return self.chunks.sparkSession.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    @staticmethod
    def timed(out: Answer, began: float) -> Answer:
        out.timings = {k: round(v, 2) for k, v in (out.timings | {"total": (time.perf_counter() - began) * 1000}).items()}
        return out
