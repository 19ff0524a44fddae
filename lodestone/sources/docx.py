"""Word documents as rows, by the standard library: visible segments, typed blocks, automatic numbering.

Everything is read in Arrow batches from ``binaryFile`` rows. A file that can't be read, for whatever reason, gives one row
with its error; ``guard`` tells packages that expand too far before they are opened.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, pos int, source_kind string, style string, text string, label string, level int, bold_ratio double, error string"
SEGMENTS = "path string, pos int, part string, story string, location string, style string, text string, dynamic_page boolean, error string"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MEMBERS, EXPANDED, RATIO, RATIO_FROM = 10_000, 256 << 20, 500, 1 << 20
STORIES = {"footnote": "footnotes.xml", "endnote": "endnotes.xml"}
_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
_LATIN, _RUSSIAN = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Word files below a folder, lock files left out, as (path, modificationTime, length, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.lower("path").endswith(".docx") & ~name.startswith("~$"))


def number(n: int, kind: str) -> str:
    """A counter in a numbering format; unknown formats count in decimals."""
    if kind in ("upperRoman", "lowerRoman") and 0 < n < 4000:
        out = ""
        for value, sign in _ROMAN:
            out += sign * (n // value)
            n %= value
        return out if kind == "upperRoman" else out.lower()
    if kind.endswith("Letter") or kind in ("russianLower", "russianUpper"):
        alphabet = _RUSSIAN if kind.startswith("russian") else _LATIN
        out = ""
        while n > 0:
            n, r = divmod(n - 1, len(alphabet))
            out = alphabet[r] + out
        return out.upper() if kind in ("upperLetter", "russianUpper") else out
    return f"{n:02d}" if kind == "decimalZero" else str(n)


class Numbering:
    """Automatic numbers of one document: definitions, overrides and running counters."""

    def __init__(self, numbering: ET.Element | None, styles: ET.Element | None):
        self.levels: dict[str, dict[int, dict]] = {}
        self.counters: dict[str, dict[int, int]] = {}
        self.styles: dict[str, tuple[str | None, int | None, str | None]] = {}
        val = lambda e, tag: None if e is None or (x := e.find(W + tag)) is None else x.get(W + "val")
        for s in [] if styles is None else styles.iter(W + "style"):
            pr = s.find(f"{W}pPr/{W}numPr")
            level = val(pr, "ilvl")
            self.styles[s.get(W + "styleId") or ""] = (val(pr, "numId"), None if level is None else int(level), val(s, "basedOn"))
        abstract: dict[str, dict[int, dict]] = {}

        def level_of(e: ET.Element) -> dict:
            restart = val(e, "lvlRestart")
            return {"start": int(val(e, "start") or 1), "format": val(e, "numFmt") or "decimal", "text": val(e, "lvlText") or "", "suffix": val(e, "suff") or "tab", "restart": None if restart is None else int(restart), "legal": e.find(W + "isLgl") is not None}

        for a in [] if numbering is None else numbering.findall(W + "abstractNum"):
            abstract[a.get(W + "abstractNumId") or ""] = {int(e.get(W + "ilvl") or 0): level_of(e) for e in a.findall(W + "lvl")}
        for n in [] if numbering is None else numbering.findall(W + "num"):
            levels = {k: dict(v) for k, v in abstract.get(val(n, "abstractNumId") or "", {}).items()}
            for o in n.findall(W + "lvlOverride"):
                k = int(o.get(W + "ilvl") or 0)
                own = o.find(W + "lvl")
                if own is not None:
                    levels[k] = level_of(own)
                start = val(o, "startOverride")
                if start is not None and k in levels:
                    levels[k]["start"] = int(start)
            self.levels[n.get(W + "numId") or ""] = levels

    def where(self, paragraph: ET.Element) -> tuple[str, int] | None:
        """numId and level of a paragraph: its own first, then along its styles; numId 0 means none."""
        pr = paragraph.find(W + "pPr")
        own = None if pr is None else pr.find(W + "numPr")
        val = lambda tag: None if own is None or (x := own.find(W + tag)) is None else x.get(W + "val")
        num, level = val("numId"), val("ilvl")
        level = None if level is None else int(level)
        style = style_of(paragraph)
        seen: set[str] = set()
        while style and style not in seen and (num is None or level is None):
            seen.add(style)
            n, lv, style = self.styles.get(style, (None, None, None))
            num, level = num if num is not None else n, level if level is not None else lv
        return None if num in (None, "0") or num not in self.levels else (num, level or 0)

    def label(self, paragraph: ET.Element) -> tuple[str, int] | None:
        """The label that the paragraph shows, and its level; moves the counters on."""
        at = self.where(paragraph)
        if at is None or at[1] not in self.levels[at[0]]:
            return None
        num, level = at
        levels, count = self.levels[num], self.counters.setdefault(num, {})
        for deeper in [k for k in count if k > level]:
            restart = levels.get(deeper, {}).get("restart")
            if restart != 0 and level <= (restart - 1 if restart is not None else deeper - 1):
                del count[deeper]
        for k in range(level):
            if k not in count and k in levels:
                count[k] = levels[k]["start"]
        count[level] = count.get(level, levels[level]["start"] - 1) + 1
        spec = levels[level]
        if spec["format"] == "none":
            return None

        def put(m: re.Match) -> str:
            k = int(m[1]) - 1
            if k not in levels:
                return ""
            return number(count.get(k, levels[k]["start"]), "decimal" if spec["legal"] else levels[k]["format"])

        text = spec["text"] if spec["format"] == "bullet" else re.sub(r"%(\d)", put, spec["text"])
        text = text.translate({0xF0B7: "•", 0xF0A7: "▪", 0xF0D8: "➢"})
        return (text + ("" if spec["suffix"] == "nothing" else " "), level) if text else None


def is_on(e: ET.Element | None) -> bool:
    """Whether a flag element is there and not switched off."""
    return e is not None and (e.get(W + "val") or "true").strip().lower() not in ("0", "false", "off", "no")


def hidden(run: ET.Element) -> bool:
    return any(is_on(run.find(f"{W}rPr/{W}{flag}")) for flag in ("vanish", "webHidden"))


def shown(e: ET.Element) -> list[ET.Element]:
    """The visible children: no deleted or moved text or hidden runs, and of alternatives the first choice, else the fallback."""
    out = []
    for c in e:
        if c.tag in (W + "del", W + "moveFrom") or c.tag == W + "r" and hidden(c):
            continue
        if c.tag == MC + "AlternateContent":
            choice = c.find(MC + "Choice")
            choice = choice if choice is not None else c.find(MC + "Fallback")
            out += [] if choice is None else shown(choice)
        else:
            out.append(c)
    return out


def paragraphs(root: ET.Element, location: str = "paragraph") -> Iterator[tuple[ET.Element, str]]:
    """Visible paragraphs in order with where they are; those of text boxes after the one that holds the box."""
    for c in shown(root):
        inside = "textbox" if c.tag == W + "txbxContent" else "table" if c.tag == W + "tbl" and location == "paragraph" else location
        if c.tag == W + "p":
            yield c, location
        yield from paragraphs(c, inside)


def guard(content: bytes, members: int = MEMBERS, expanded: int = EXPANDED, ratio: float = RATIO) -> str | None:
    """Why a package must not be opened, or None: too many members, too much text, a member that shrinks too well, or
    parts that are missing."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
    except zipfile.BadZipFile:
        return "not a package"
    if len(infos) > members:
        return "too many members"
    if sum(i.file_size for i in infos) > expanded:
        return "expands too far"
    if any(i.file_size >= RATIO_FROM and i.file_size > ratio * i.compress_size for i in infos):
        return "shrinks too well"
    names = {i.filename for i in infos}
    return None if {"word/document.xml", "[Content_Types].xml"} <= names else "parts are missing"


def target(part: str, rel: ET.Element) -> str | None:
    """The part that a relationship of ``part`` means; None for external ones and those that leave the package."""
    name = rel.get("Target") or ""
    if (rel.get("TargetMode") or "").lower() == "external" or not name:
        return None
    path = posixpath.normpath(name.lstrip("/") if name.startswith("/") else posixpath.join(posixpath.dirname(part), name))
    return None if path.startswith("../") or path in ("", ".", "..") else path


def style_of(p: ET.Element) -> str | None:
    s = p.find(f"{W}pPr/{W}pStyle")
    return None if s is None else s.get(W + "val")


def text_of(p: ET.Element) -> str:
    """Visible text of a paragraph: deleted and hidden runs left out, tabs and breaks as blanks and line feeds."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        tag = e.tag
        if tag in (W + "instrText", W + "txbxContent"):
            return
        if tag == W + "t":
            out.append(e.text or "")
        elif tag == W + "tab":
            out.append("\t")
        elif tag in (W + "br", W + "cr"):
            out.append("\n")
        elif tag == W + "noBreakHyphen":
            out.append("-")
        elif tag != W + "pPr" and tag != W + "rPr":
            for c in shown(e):
                walk(c)

    walk(p)
    t = re.sub("[ \t]+", " ", "".join(out).replace(" ", " ").replace("\r", "\n"))
    return re.sub("\n{2,}", "\n", t).strip()


def bold_ratio(p: ET.Element) -> float:
    """Share of the visible letters that are in bold runs."""
    total = bold = 0
    for r in p.iter(W + "r"):
        n = sum(len((t.text or "").strip()) for t in r.findall(W + "t"))
        total += n
        bold += n if is_on(r.find(f"{W}rPr/{W}b")) else 0
    return bold / total if total else 0.0


def raw_blocks(content: bytes) -> list[tuple]:
    """(pos, source_kind, style, text, label, level, bold_ratio) of paragraphs and table rows in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ET.fromstring(z.read(name)) if name in z.namelist() else None
        body = part("word/document.xml").find(W + "body")
        numbering = Numbering(part("word/numbering.xml"), part("word/styles.xml"))
    out: list[tuple] = []

    def visit(parent: ET.Element) -> None:
        for e in shown(parent):
            if e.tag == W + "p":
                text, label = text_of(e), numbering.label(e)
                if text:
                    auto = label[0] if label else None
                    if auto and text.startswith(auto.strip()):
                        auto = None  # typed by hand as well
                    out.append((len(out), "paragraph", style_of(e), (auto or "") + text, label[0].strip() if label else None, label[1] if label else None, bold_ratio(e)))
            elif e.tag == W + "tbl":
                for row in rows_of(e):
                    if row:
                        out.append((len(out), "table_row", None, row, None, None, 0.0))
            elif e.tag in (W + "sdt", W + "sdtContent", W + "ins"):
                visit(e)

    visit(body)
    return out


def rows_of(table: ET.Element) -> Iterator[str]:
    """The rows of a table, cells joined; a cell that spans rows is in each of them, a table in a cell is part of the cell."""
    above: dict[int, str] = {}
    for row in (r for c in shown(table) for r in ([c] if c.tag == W + "tr" else c.iter(W + "tr") if c.tag in (W + "sdt", W + "ins") else [])):
        at, cells = 0, []
        for c in (x for y in shown(row) for x in ([y] if y.tag == W + "tc" else y.iter(W + "tc") if y.tag == W + "sdt" else [])):
            span, merge = c.find(f"{W}tcPr/{W}gridSpan"), c.find(f"{W}tcPr/{W}vMerge")
            text = " ".join(filter(None, (text_of(p) for p, _ in paragraphs(c))))
            if merge is not None and merge.get(W + "val") != "restart":
                text = above.get(at, text)
            above[at] = text
            cells.append(text)
            width = span.get(W + "val") if span is not None else "1"
            at += int(width) if width and width.isdigit() else 1
        yield " | ".join(filter(None, cells))


def segments(content: bytes) -> list[tuple]:
    """(pos, part, story, location, style, text, dynamic_page, error) of all visible paragraphs of the body, of the headers and
    footers that it refers to, and of the notes that it refers to."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        main = "word/document.xml"
        body = ET.fromstring(z.read(main))
        seen = [x for c in shown(body) for x in _visible(c)]
        refs = {x.get(R + "id") for x in seen if x.tag in (W + "headerReference", W + "footerReference")}
        notes = {kind: {x.get(W + "id") for x in seen if x.tag == W + kind + "Reference"} for kind in STORIES}
        parts = [(main, "body", body)]
        rels = "word/_rels/document.xml.rels"
        used = set()
        for r in ET.fromstring(z.read(rels)) if rels in names else []:
            kind, name = (r.get("Type") or "").rsplit("/", 1)[-1], target(main, r)
            if kind in ("header", "footer") and r.get("Id") in refs and name in names and name not in used:
                used.add(name)
                parts.append((name, kind, ET.fromstring(z.read(name))))
        parts += [(f"word/{f}", s, ET.fromstring(z.read(f"word/{f}"))) for s, f in STORIES.items() if f"word/{f}" in names]
    for name, story, root in parts:
        roots = [n for n in root.findall(W + story) if n.get(W + "id") in notes[story]] if story in STORIES else [root]
        for one in roots:
            for p, location in paragraphs(one):
                text = text_of(p)
                if text:
                    field = " ".join(x.text or "" for x in p.iter(W + "instrText")) + " ".join(x.get(W + "instr") or "" for x in p.iter(W + "fldSimple"))
                    out.append((len(out), name, story, location, style_of(p), text, bool(re.search(r"\b(?:PAGE|NUMPAGES|SECTIONPAGES)\b", field.upper())), None))
    return out


def _visible(e: ET.Element) -> Iterator[ET.Element]:
    yield e
    for c in shown(e):
        yield from _visible(c)


def _rows(files: DataFrame, read, schema: str, empty: tuple) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows += [(path, *r) for r in read(bytes(content))]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one file, the others are read
                    rows.append((path, *empty, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=names).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)


def read_blocks(files: DataFrame) -> DataFrame:
    """Raw blocks of all files; a file that can't be read gives a row with ``error``."""
    return _rows(files, lambda c: [(*r, None) for r in raw_blocks(c)], BLOCKS, (None,) * 7)


def read_segments(files: DataFrame) -> DataFrame:
    """Visible segments of all files; a file that can't be read gives a row with ``error``."""
    return _rows(files, segments, SEGMENTS, (None,) * 7)


def upload(files: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """(path, file_name, text, parser, sha256, error): the text of uploaded files: Word documents, or UTF-8 texts by suffix.

    ``files``: path and content, and perhaps content_type. ``error`` is null, or ``empty``, ``too large``,
    ``unsupported``, or ``invalid`` with a reason; then there is no text.
    """
    kind = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))) if "content_type" in files.columns else F.lit("")
    rows = files.select("path", tx.safe_name(F.col("path")).alias("file_name"), "content", F.coalesce(kind, F.lit("")).alias("kind"))
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    word = (suffix == ".docx") | (F.col("kind") == DOCX_TYPE)
    plain = suffix.isin(*TEXT_SUFFIXES) | F.col("kind").startswith("text/")
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    parser = F.when(word, "docx").when(plain, "text")
    early = F.when(size == 0, "empty").when(size > max_bytes, "too large").when(parser.isNull(), "unsupported")
    rows = rows.withColumns({"parser": parser, "early": early})

    @F.pandas_udf("text string, error string")
    def read(content: pd.Series, parser: pd.Series, early: pd.Series) -> pd.DataFrame:
        out = []
        for c, how, wrong in zip(content, parser, early):
            text = None
            if wrong is None:
                try:
                    if how == "docx":
                        wrong = guard(bytes(c))
                        text = None if wrong else "\n".join(b[3] for b in raw_blocks(bytes(c)))
                    else:
                        text = bytes(c).decode("utf-8-sig")
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    wrong = f"{type(e).__name__}"
                wrong = f"invalid: {wrong}" if wrong else None if (text or "").strip() else "invalid: no text"
            out.append((None if wrong else text.strip(), wrong))
        return pd.DataFrame(out, columns=["text", "error"])

    got = rows.withColumn("r", read("content", "parser", "early"))
    return got.select("path", "file_name", "r.text", F.when(F.col("r.error").isNull(), F.col("parser")).alias("parser"), F.sha2("content", 256).alias("sha256"), "r.error")


DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".json", ".xml", ".yaml", ".yml")


def inputs(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Word files of globs and paths, each path once."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").load(patterns).dropDuplicates(["path"])
    return found.where(F.lower("path").endswith(".docx") & ~name.startswith("~$"))


def locate(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, path, content): the source file of each document: at its stored path, else by its name, whatever the case.

    Of several files of a name the first by path counts.
    """
    base = lambda c: F.lower(F.element_at(F.split(F.col(c), "/"), -1))
    want = documents.select("doc_id", "source_path", F.lower("source_name").alias("name"))
    have = files.select("path", "content", base("path").alias("name"))
    hits = want.join(have, "name").withColumn("other", F.when(F.col("path") == F.col("source_path"), 0).when(F.endswith("path", F.concat(F.lit("/"), "source_path")), 1).otherwise(2))
    return hits.groupBy("doc_id").agg(F.min_by(F.struct("path", "content"), F.struct("other", "path")).alias("x")).select("doc_id", "x.path", "x.content")


def source_text(located: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, text): the text of located files again; null where the file isn't the one that was read (its hash)."""
    hashed = located.join(documents.select("doc_id", "source_sha256"), "doc_id")
    same = hashed.where(F.sha2("content", 256) == F.col("source_sha256")).select("doc_id", F.col("path"), "content")
    text = upload(same.withColumn("content_type", F.lit(DOCX_TYPE))).select("path", "text")
    return documents.select("doc_id").join(same.join(text, "path").select("doc_id", "text"), "doc_id", "left")


def package(paragraphs: list[str], numbering: str = "", styles: str = "", extra: dict[str, str] | None = None) -> bytes:
    """A minimal package of paragraph XML, for tests and fixtures."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{''.join(paragraphs)}</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", f"<w:numbering {ns}>{numbering}</w:numbering>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
        for name, xml in (extra or {}).items():
            z.writestr(name, xml.replace("NS", ns))
    return out.getvalue()
