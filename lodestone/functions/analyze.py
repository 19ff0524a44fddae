"""Lexemes of texts: tokens without stop words, stemmed, with their positions.

ASCII words go to Porter's English stemmer, others to the Russian Snowball one, both after the published algorithms.
Stop words take a position. Stemming is per distinct word in an Arrow batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = frozenset("a an and are as at be but by for from has have he her his i if in into is it its no not of on or she so such that the their then there these they this to was we were will with you и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от меня еще нет о из ему теперь когда даже ну ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между".split())
_TOKEN = re.compile("[0-9A-Za-zА-Яа-яЁё]+")
_VOWEL = "аеиоуыэюя"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and not (c == "y" and i > 0 and _cons(w, i - 1))


def _shape(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("c" if _cons(w, i) else "v" for i in range(len(w))))


def _m(w: str) -> int:
    return _shape(w).count("vc")


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 1) and not _cons(w, n - 2) and _cons(w, n - 3) and w[-1] not in "wxy"


_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def english(w: str) -> str:
    """Porter's stemmer."""
    if len(w) < 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, put in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + put
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            s = w[: -len(end)]
            if _m(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        s = w[:-1]
        if _m(s) > 1 or (_m(s) == 1 and not _cvc(s)):
            w = s
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


_GERUND = re.compile("(?:(?<=[ая])(?:в|вши|вшись)|ив|ивши|ившись|ыв|ывши|ывшись)$")
_REFLEX = re.compile("(?:ся|сь)$")
_ADJ = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
_ADJECTIVAL = re.compile(f"(?:(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)(?:{_ADJ})|(?:{_ADJ}))$")
_VERB = re.compile("(?:(?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю)$")
_NOUN = re.compile("(?:а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я)$")


def russian(w: str) -> str:
    """The Russian Snowball stemmer."""
    w = w.replace("ё", "е")
    at = next((i + 1 for i, c in enumerate(w) if c in _VOWEL), len(w))
    head, rv = w[:at], w[at:]
    r = re.search(f"[{_VOWEL}][^{_VOWEL}]", w)
    r1 = r.end() if r else len(w)
    r = re.search(f"[{_VOWEL}][^{_VOWEL}]", w[r1:])
    r2 = r1 + r.end() if r else len(w)
    got = _GERUND.sub("", rv, count=1)
    if got == rv:
        rv = _REFLEX.sub("", rv, count=1)
        for pattern in (_ADJECTIVAL, _VERB, _NOUN):
            got = pattern.sub("", rv, count=1)
            if got != rv:
                break
    rv = got
    if rv.endswith("и"):
        rv = rv[:-1]
    w = head + rv
    for end in ("ость", "ост"):
        if w.endswith(end) and len(w) - len(end) >= r2:
            w = w[: -len(end)]
            break
    if len(w) > at:
        if w.endswith(("ейше", "ейш")):
            w = re.sub("ейше?$", "", w)
            w = w[:-1] if w.endswith("нн") else w
        elif w.endswith("нн"):
            w = w[:-1]
        elif w.endswith("ь"):
            w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    return english(word) if word.isascii() else russian(word)


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """(lexeme, position from 1) of a text; stop words are out but counted."""
    words = _TOKEN.findall((text or "").lower())
    return [(stem(w), i) for i, w in enumerate(words, 1) if w not in STOP]


def analyze(c: Column) -> Column:
    """array<struct<lexeme, pos>> of a text column; empty for null."""

    @F.pandas_udf("array<struct<lexeme: string, pos: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"lexeme": s, "pos": i} for s, i in lexemes(t)])

    return run(c)
