"""Text functions as Spark columns. All of them give null for null unless their docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "([0-9A-Za-zА-Яа-яЁё]+)"
LOWER_WORD = "([0-9a-zа-яё]+)"
NBSP = " "


def normalize_block(c: Column) -> Column:
    """No-break spaces become spaces, line ends LF; runs of blanks and of line feeds shrink to one; ends are cut."""
    c = F.regexp_replace(F.translate(c, NBSP + "\r", " \n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n{2,}", "\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def normalize_paragraphs(c: Column) -> Column:
    """Like ``normalize_block``, but an empty line between paragraphs stays."""
    c = F.regexp_replace(F.translate(c, NBSP + "\r", " \n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def normalize_space(c: Column) -> Column:
    """All runs of white space become one space; ends are cut."""
    return F.trim(F.regexp_replace(F.translate(c, NBSP, " "), r"[ \t\n\r\f\x0B]+", " "))


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens; ``document`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-zа-яё0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "document").otherwise(s)


def words(c: Column) -> Column:
    """Word tokens of the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit(LOWER_WORD), 1)


def middle_truncate(c: Column, most: int, marker: str = " [...] ") -> Column:
    """The head third, a marker and the tail of texts longer than ``most`` characters."""
    head = most // 3
    tail = most - head - len(marker)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(tail)))).otherwise(c)


def ngram_count(tokens: Column, needle: Column) -> Column:
    """How often the array ``needle`` occurs in ``tokens``, overlaps included; 0 for an empty needle.

    Pass a stored column of tokens: an expression would be computed again at each position.
    """
    n, w = F.size(tokens), F.size(needle)
    hits = F.filter(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.slice(tokens, i, F.greatest(w, F.lit(1))) == needle)
    return F.when((w == 0) | (n < w), 0).otherwise(F.size(hits))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the padded lower-case words."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words(c), grams)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigrams; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def loose_bool(c: Column) -> Column:
    """Whether the text says yes; null counts as no."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "да"), F.lit(False))


def citations(c: Column, most: Column | int = 99) -> Column:
    """Numbers in square brackets between 1 and ``most``, each once, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,3})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most)))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; else the decimal number."""
    out = F.lit("")
    rest = n
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        # each sign is repeated as often as its value fits in what the larger ones leave
        larger = [v for v in (1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1) if v > value]
        rest = n
        for v in larger:
            rest = F.pmod(rest, F.lit(v))
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
    return F.when((n >= 1) & (n <= 3999), out).otherwise(n.cast("string"))


def letters(n: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz", digits: int = 4) -> Column:
    """Bijective numeral in letters (1 is a, 27 aa) of at most ``digits`` letters; else the decimal number."""
    k = len(alphabet)
    out = F.lit("")
    rest = n.cast("bigint")
    for _ in range(digits):
        digit = F.pmod(rest - 1, F.lit(k))
        out = F.when(rest > 0, F.concat(F.substring(F.lit(alphabet), digit.cast("int") + 1, F.lit(1)), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / k)).otherwise(F.lit(0))
    return F.when((n >= 1) & (rest == 0), out).otherwise(n.cast("string"))


def plural(n: Column, one: str = "документ", few: str = "документа", many: str = "документов") -> Column:
    """The Russian form of a noun after a number."""
    a, b = F.abs(n) % 10, F.abs(n) % 100
    return F.when(b.between(11, 14), many).when(a == 1, one).when(a.between(2, 4), few).otherwise(many)


def ordinal(c: Column) -> Column:
    """1 to 10 of an ordinal word (Russian or English, by stem) or of one or two digits; 0 and others give null."""
    stems = ("перв|first", "втор|second", "трет|third", "четв|fourth", "пят|fifth", "шест|sixth", "седьм|seventh", "восьм|eighth", "девят|ninth", "десят|tenth")
    w = F.lower(F.trim(c))
    out = F.when(w.rlike(r"^0*[1-9]\d?$") & w.rlike(r"^\d{1,2}$"), w.try_cast("int"))
    for k, s in enumerate(stems, 1):
        out = out.when(w.rlike(f"^({s})"), k)
    return out


def reference(c: Column) -> Column:
    """struct(kind, number, appendix) of a structural reference such as ``item 2.3 of appendix 4`` or ``2.1``; else nulls.

    Items come before sections, those before appendices, and bare numbers last. A number in brackets alone is none.
    """
    t = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    number = r"\[?(\d+(?:\.\d+)*)\]?"
    item = F.nullif(F.regexp_extract(t, rf"(?:пункт\S*|п\.|item)\s*№?\s*{number}", 1), F.lit(""))
    section = F.nullif(F.regexp_extract(t, rf"(?:раздел\S*|section)\s*№?\s*{number}", 1), F.lit(""))
    appendix = F.nullif(F.regexp_extract(t, r"(?:приложени\S*|appendix)\s*№?\s*(\d+|[a-zа-я](?![a-zа-я]))", 1), F.lit(""))
    appendix = F.when(~appendix.isin("a", "i", "в", "и", "к", "о", "с"), appendix)
    bare = F.nullif(F.regexp_extract(t, r"^(\d+(?:\.\d+)*)$", 1), F.lit(""))
    kind = F.when(item.isNotNull(), "item").when(section.isNotNull(), "section").when(appendix.isNotNull(), "appendix").when(bare.isNotNull(), "bare")
    return F.struct(kind.alias("kind"), F.when(kind == "appendix", appendix).otherwise(F.coalesce(item, section, bare)).alias("number"), F.when(kind.isin("item", "section"), appendix).alias("appendix"))


def sha1_prefix(c: Column, length: int = 12) -> Column:
    return F.left(F.sha1(c), F.lit(length))


def one_line(c: Column) -> Column:
    """All runs of Unicode white space become one space; ends are cut."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def numbering_value(c: Column) -> Column:
    """A numbering label without opening brackets in front and points and closing brackets behind."""
    return F.regexp_replace(F.trim(c), r"^[(\[\s]+|[.)\]\s]+$", "")


def end_truncate(c: Column, most: int, marker: str = "…") -> Column:
    """The beginning of texts longer than ``most`` characters, with a marker, that long in all."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - len(marker)))), F.lit(marker))).otherwise(c)


def keep_end(c: Column, most: int, marker: str = "… ") -> Column:
    """The end of texts longer than ``most`` characters behind a marker, that long in all."""
    return F.when(F.length(c) > most, F.concat(F.lit(marker), F.ltrim(F.right(c, F.lit(most - len(marker)))))).otherwise(c)


def redact_url(c: Column) -> Column:
    """An address without its password."""
    return F.regexp_replace(c, r"(?<=://)([^/@:\s]*):[^/@\s]*@", "$1:***@")


def base_url(c: Column) -> Column:
    """An address without white space, query, fragment and slashes at its end."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", "")


def chat_endpoint(c: Column) -> Column:
    """Where a service at a base address completes chats."""
    b = base_url(c)
    return F.when(b.rlike("/chat/completions$"), b).when(b.rlike("/v\\d+$"), F.concat(b, F.lit("/chat/completions"))).otherwise(F.concat(b, F.lit("/v1/chat/completions")))


def safe_name(c: Column) -> Column:
    """The last part of a URL-encoded path without NUL; ``document.docx`` where nothing is left."""
    name = F.trim(F.element_at(F.split(F.translate(F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), "\x00", ""), r"[/\\]"), -1))
    return F.when(F.coalesce(name, F.lit("")) == "", "document.docx").otherwise(name)


def relative(c: Column) -> Column:
    """Whether a path is relative and stays below its root."""
    return F.coalesce((F.trim(c) != "") & ~c.rlike(r"^(?:/|\\|[A-Za-z]:)") & ~c.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)"), F.lit(False))
