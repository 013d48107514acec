"""Sentence boundaries in many languages, by cascading tables of break and no-break rules.

A rule is a pair of patterns, for what stands before and after a position, and says
whether to break there. Tables are tried in order, the rules of the labelled language
first, then those of the other languages of the same kind of script, then the common
ones; the first rule that matches decides. Positions after closing marks are put to one
cascade, blanks of Thai lines to another. Rules read the line with the inside of every
balanced quotation and bracket replaced by one sign, for which the first rule of each
cascade stands: nothing in there ends a sentence. A line break always ends one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pieces import in_batches

BREAK, JOIN = True, False

# Abbreviations by language. A reference or title always goes on; a closing
# abbreviation may end a sentence if a new one plainly begins.
_TITLES = {
    "en": "Mr Mrs Ms Dr Prof Rev Hon Gen Col Capt Lt Sgt St Messrs",
    "de": "Hr Hrn Fr Frl Dr Prof Dipl Ing Mag St",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Pr Me Mgr St Ste",
    "es": "Sr Sra Srta Sres Sras Dr Dra Dª D Lic Ing Ud Uds Vd Vds",
    "hi": "डॉ श्री श्रीमती प्रो",
    "ar": "د أ م ا",
}
_REFERENCES = {
    "en": "No Nos Vol p pp ch Sec Secs Fig Figs Eq Ref Art Arts App para approx ca cf vs viz e.g i.e est ed eds al incl excl max min tel ext dept attn acct",
    "de": "Nr Nrn Abs Art Ziff Bd S Kap Tel Gem Lt Vgl ca bzw inkl exkl zzgl abzgl max min evtl ggf gegr geb z u d o i.d.R z.B d.h u.a z.T o.g Mio Mrd Std Str",
    "fr": "art arts réf ref cf p pp ex env tél éd vol chap fig no nos n ann al ap av boul",
    "es": "pág págs núm núms art arts ref ej p pp cap vol fig tel aprox máx mín depto avda av n cf",
    "hi": "क्र रु सं पृ",
    "ar": "ص ج ت",
}
_CLOSING = {
    "en": "etc Inc Ltd Co Corp Bros LLC Jr a.m p.m U.S U.K U.N E.U Ph.D B.A M.A no",
    "de": "usw usf etc u.s.w u.s.f GmbH e.V Co Jan Feb Aug Sept Okt Nov Dez",
    "fr": "etc s.a s.a.r.l Cie",
    "es": "etc S.A S.L Cía EE.UU a.m p.m",
    "hi": "",
    "ar": "",
}
# Months that follow an ordinal in German.
_MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner|Feber"

#: What plainly begins a sentence: a capital or a letter without case, with an opener before it or none. After an
#: abbreviation in Latin letters only a capital or an opener does: "Ltd. 的" goes on.
_BEGINS = r"""["'“„«‹「『‘(（\[【¿¡]*[\p{Lu}\p{Lt}\p{Lo}]|["“„«‹「『(（\[【¿¡]"""
_BEGINS_CASED = r"""["'“„«‹「『‘(（\[【¿¡]*[\p{Lu}\p{Lt}]|["“„«‹「『(（\[【¿¡]"""
_BLANK = r"[\p{White_Space}\p{Cf}]"
#: A word may start right after a letter of a script that writes no blanks, as in "書類No.".
_WORD_START = r"(?<![\p{Latin}\p{Devanagari}\p{Arabic}\p{M}\p{N}.])"


# German abbreviations of two words.
_PAIRS_DE = "|".join(
    rf"{a}\.{_BLANK}?{b}|{a}"
    for a, b in (x.split() for x in ("z B", "d h", "u a", "z T", "o g", "i V", "i A", "s o", "s u", "m E", "u U", "z Zt"))
)


def _either(words: str) -> str:
    found = sorted({w for w in words.split()}, key=len, reverse=True)
    both = {unicodedata.normalize(form, x) for w in found for x in (w, w[0].upper() + w[1:]) for form in ("NFC", "NFD")}
    return "|".join(regex.escape(w) for w in sorted(both, key=lambda w: (-len(w), w)))


def _language_rules(language: str) -> list[tuple[bool, str, str]]:
    rules = []
    if language == "de":
        rules.append((JOIN, r"(?<!\d)\d{1,2}\.", rf"{_BLANK}*(?:{_MONTHS_DE})\b"))
        # Abbreviations of two words and their second halves.
        rules.append((JOIN, rf"{_WORD_START}(?:{_PAIRS_DE})\.", ""))
    if language == "en":
        # The answer "no." is no number: it refers to one only if one follows.
        rules.append((BREAK, rf"{_WORD_START}[Nn]o\.", rf"{_BLANK}+\p{{Lu}}\p{{Ll}}"))
    if _TITLES.get(language):
        rules.append((JOIN, rf"{_WORD_START}(?:{_either(_TITLES[language])})\.", ""))
    if _REFERENCES.get(language):
        rules.append((JOIN, rf"{_WORD_START}(?:{_either(_REFERENCES[language])})\.", ""))
    if _CLOSING.get(language):
        rules.append((BREAK, rf"{_WORD_START}(?:{_either(_CLOSING[language])})\.", rf"{_BLANK}+(?:{_BEGINS_CASED})"))
        rules.append((JOIN, rf"{_WORD_START}(?:{_either(_CLOSING[language])})\.", ""))
    return rules


#: Stands for every character inside a balanced quotation or bracket; no character of Unicode text.
_INSIDE = "\uffff"
#: First what is inside, then the marks nothing can undo, and dots of omission.
_FIRST = [
    (JOIN, _INSIDE, ""),
    (BREAK, r"[!?。！？．｡؟।॥‼⁇⁈⁉።։۔][.…!?。！？．｡؟।॥‼⁇⁈⁉።։۔\p{Cf}]*", ""),
    (JOIN, r"(?:\.\.|…)\.*…*", ""),
    # A list number or letter at the start of the line.
    (JOIN, rf"^{_BLANK}*[-–—•*·]?{_BLANK}*[(（]?(?:\p{{Nd}}{{1,4}}|\p{{L}}|[ivxIVX]{{1,5}})\.", ""),
]
#: Last what holds for a period after anything else.
_LAST = [
    # Inside numbers, versions, names and addresses.
    (JOIN, r"\.", r"[\p{Ll}\p{Nd}_@/\\-]"),
    # An initial, or the parts of A.B.
    (JOIN, rf"{_WORD_START}\p{{Lu}}\.", ""),
    (JOIN, r"\.\p{L}\.", rf"{_BLANK}*(?!{_BEGINS})"),
    # A number or ordinal.
    (BREAK, r"\p{Nd}\.", rf"{_BLANK}+(?:{_BEGINS})"),
    (JOIN, r"\p{Nd}\.", rf"(?!\p{{Lu}}\p{{Ll}})"),
    # A blank left out, as in "done.The".
    (BREAK, r"[\p{Ll}\p{Lo}\p{M}\p{Nd}%)\]”»]\.", r"[\p{Lu}\p{Lo}¿¡“«„「『(（【]"),
    (JOIN, r"\.", r"[^\p{White_Space}\p{Cf}]"),
    (BREAK, r"\.", rf"{_BLANK}+"),
]
#: Blanks of a Thai line: none inside, none that touches a digit, percent sign or Latin letter, none after the
#: colon of a speaker or an opener or after a list number; all others.
_TOUCHED = r"[\p{Nd}%٪％\p{Latin}]"
_THAI_RULES = [
    (JOIN, "", _INSIDE),
    (JOIN, r"[:：]", ""),
    (JOIN, _TOUCHED, ""),
    (JOIN, "", rf"{_BLANK}+{_TOUCHED}"),
    (JOIN, rf"^{_BLANK}*(?:[-–—•*·]|[(（]?(?:\p{{Nd}}{{1,4}}|\p{{Latin}})[.)）、．])", ""),
    (BREAK, r"[^\p{White_Space}\p{Cf}]", rf"{_BLANK}+[^\p{{White_Space}}\p{{Cf}}]"),
]
#: Labels of the languages with Latin script; the rest by their script.
_LATIN = ("en", "de", "fr", "es")
_SCRIPTS = (("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"))


Rules = list[tuple[bool, regex.Pattern]]


def _compiled(rules: list[tuple[bool, str, str]]) -> Rules:
    sides = ((outcome, f"(?<={before})" if before else "", f"(?={after})" if after else "") for outcome, before, after in rules)
    return [(outcome, regex.compile(before + after)) for outcome, before, after in sides]


@lru_cache(maxsize=64)
def _cascade(languages: tuple[str, ...]) -> Rules:
    return _compiled([*_FIRST, *(r for language in languages for r in _language_rules(language)), *_LAST])


@lru_cache(maxsize=1)
def _thai_cascade() -> Rules:
    return _compiled(_THAI_RULES)


def _decided(rules: Rules, line: str, at: int) -> bool:
    """What the first rule that matches at a position says; no rule, no break."""
    return next((outcome for outcome, rule in rules if rule.match(line, at)), JOIN)


_CANDIDATE = regex.compile(r"[.!?…。！？．｡؟।॥‼⁇⁈⁉።։۔]+[\])}）】」』”’»›]*")
# Quotation marks and brackets that open, and what closes each.
_CLOSERS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“”", "«": "»", "‹": "›", "{": "}", "〔": "〕"}
_PAIRED = regex.compile(r"""["()（）\[\]【】「」『』《》〈〉“”„«»‹›{}〔〕]""")
_THAI = regex.compile(r"\p{Thai}")
_THAI_BLANK = regex.compile(rf"(?<=[^\p{{White_Space}}\p{{Cf}}]){_BLANK}*\p{{White_Space}}")
_LETTER = regex.compile(r"\p{L}")


def _protected(line: str) -> list[tuple[int, int]]:
    """Spans of balanced quotations and brackets of a line, outermost only, in order."""
    spans: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    # How many of the open marks each character would close.
    waiting: dict[str, int] = {}

    def note(closers: str, change: int) -> None:
        for c in closers:
            waiting[c] = waiting.get(c, 0) + change

    for match in _PAIRED.finditer(line):
        char, at = match[0], match.start()
        if waiting.get(char):
            # What opened inside and did not close is no bracket.
            while True:
                closers, start = opened.pop()
                note(closers, -1)
                if char in closers:
                    break
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at))
        elif char == '"' or char in _CLOSERS:
            closers = _CLOSERS.get(char, '"')
            opened.append((closers, at))
            note(closers, 1)
    return spans


def _languages(label: str, line: str) -> tuple[str, ...]:
    for name, script in _SCRIPTS:
        if regex.search(script, line):
            return (name, *_LATIN)
    first = label.strip().lower()[:2]
    return (first, *(x for x in _LATIN if x != first)) if first in _LATIN else _LATIN


def _masked(line: str) -> str:
    """The line with the inside of its balanced quotations and brackets hidden, as long as before."""
    parts, at = [], 0
    for start, end in _protected(line):
        parts += [line[at : start + 1], _INSIDE * (end - start - 1)]
        at = end
    return "".join([*parts, line[at:]]) if parts else line


def line_ends(line: str, label: str) -> list[int]:
    """Positions in a line after which a sentence ends, without the end of the line."""
    found = []
    marked = _CANDIDATE.search(line)
    thai = _THAI.search(line) and 2 * len(_THAI.findall(line)) > len(_LETTER.findall(line))
    if not (marked or thai):
        return found
    masked = _masked(line)
    if marked:
        cascade = _cascade(_languages(label, line))
        for match in _CANDIDATE.finditer(line):
            # A mark closes the part of the run before the first closer that belongs to a pair.
            marks = end = match.end()
            while line[marks - 1] in "])}）】」』”’»›":
                marks -= 1
            if _decided(cascade, masked, marks):
                found.append(end)
    if thai:
        found += [m.start() for m in _THAI_BLANK.finditer(line) if _decided(_thai_cascade(), masked, m.start())]
        found = sorted(set(found))
    return found


def sentence_spans(text: str, label: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points, without outer whitespace."""
    spans = []
    start = 0
    for line in text.split("\n"):
        at = start
        for end in [*(start + e for e in line_ends(line, label or "")), start + len(line)]:
            piece = text[at:end]
            kept = piece.strip()
            if kept:
                lead = len(piece) - len(piece.lstrip())
                spans.append((at + lead, at + lead + len(kept)))
            at = end
        start += len(line) + 1
    return spans


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_batches(batches, 1000):
        numbers, starts, ends = [], [], []
        for row, (text, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for start, end in sentence_spans(text, label) if text else ():
                numbers.append(row)
                starts.append(start)
                ends.append(end)
        keys = batch.column(0).take(pa.array(numbers, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[batch.schema.names[0], "start_char", "end_char"]
        )


def sentences(documents: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, start_char, end_char) of every sentence of every document, in code points.

    Null, empty and blank texts have no sentences. A null, unknown or wrong language
    label only changes which abbreviations are tried first. Repeated rows each give
    their sentences; an empty table gives an empty result; texts are read whole, line by
    line. Columns not named here are not read.
    """
    three = documents.select(F.col(key), F.col(text).alias("__text"), F.col(language).alias("__language"))
    kind = three.schema[0].dataType.simpleString()
    return three.mapInArrow(_split, f"`{key}` {kind}, start_char int, end_char int")
