"""Problem 3: sentences by cascading segmentation rule tables.

A rule is (break?, pattern before, pattern after). For each position after a stop the tables of the text's language and
then the common table are gone through in order, and the first rule whose two patterns match decides. Line breaks always
end a sentence. Quotations that open and close in one line hide the stops inside them; the stop before a closing mark
stands after it.

The language comes from the letters of the text, as the language columns aren't reliable. Defined results: null, empty
and blank texts give no row; offsets are code points from 0, the end exclusive, outer blanks left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.blocks import mapped

STOPS = ".!?…।॥۔؟。！？．｡"
CLOSERS = "\"”’»›)\\]}“」』】）"
#: A stop with the closing marks and citation marks that belong to it.
CANDIDATE = re.compile(rf"[{STOPS}]+(?:[*_]{{1,3}})?[{CLOSERS.replace('“', '')}]*")
CITED = re.compile(r"(?:[ \t\xa0]*\[S\d+\])*")
LINES = re.compile("[^\r\n\x0b\x0c  ]+")
#: Opening mark -> closing marks.
QUOTES = {"“": "”", "”": "“”", '"': '"', "«": "»", "「": "」", "『": "』", "„": "“”"}
MARKS = re.compile("[" + "".join(QUOTES) + "»」』]")

#: Characters before a stop that a rule may see: no pattern needs more than twenty and the citation marks behind the stop.
BEFORE = 400
B, N = True, False
#: The letters before the stop are matched at their end, those after it at their start.
WORDEND = r"(?<![\w.])"
COMMON = [
    (N, r"^\s*[*_#>-]*\s*[(\[]?(?:\d{1,4}|[A-Za-z]|[ivxlcIVXLC]{1,6})[)\]]?\.", r"\s"),  # a number or label in front
    (N, r"[.!?۔।]", r"\d"),  # decimals, numbered references
    (N, r"\.", r"[a-z0-9_/]"),  # file names, addresses
    (N, r".", r"\s*[,;:،、，；：]"),  # the sentence goes on
    (N, r"\.", r"[ºª]"),
    (N, r"…", r"\s*[^\sA-ZÀ-Þ]|\S"),
    (N, r"\.\.+", r"\s*[a-z]"),
    (N, r"[!?]", r"[A-Za-z0-9]"),
    (B, r"[!?।॥۔؟。！？｡．]", r""),
]
TAIL = [
    (N, r"\.", r"[A-Z]\.|[A-Z](?![a-z])|[a-z]"),
    (B, r"(?:[a-zà-ÿ]{3}|\d|[ऀ-ൿ])\.", r"[A-ZÀ-Þऀ-ൿ“(\"]"),  # no blank after the stop
    (N, r"\.", r"\S"),
    (B, r"\.", r""),
]
LATIN = [
    (N, WORDEND + r"(?i:dr|mr|mrs|ms|smt|shri|sri|km|m/s|messrs|prof|hon|hon'ble|adv|v|vs|i\.e|e\.g|viz|cf|art|arts|ex|exh|s|ss|sec|secs|r|rr|cl|cls|para|paras|p|pp|rs|sch|vol|ch|fig|app|reg)\.", r"\s*\S"),
    (N, WORDEND + r"(?i:no|nos)\.", r"\s*[\d(]"),
    (N, r"(?i:cent)\.", r"\s+(?i:per\b|[a-z])"),
    (N, WORDEND + r"(?i:etc|ltd|inc|co|bros|sons|corp|pvt|govt|a\.m|p\.m|fr|st)\.", r"\s*(?:(?!e-[A-Z])[a-zß-ÿ&]|\([^\d(])"),
    (N, r"(?<![\w.])(?:[A-Z]\.\s?){2,}", r"\s*[a-z\d(&]"),
    (N, r"(?<![\w.])(?:Dr|DR|Smt|SMT|M/s|Mr|Mrs|Shri)\.(?:\s?[A-Z]\.)+", r"\s*\S"),
    (N, r"(?<![\w.])[A-Z]\.", r"\s*[\w]"),
    (N, WORDEND + r"[A-Za-z]{1,2}\.", r"\s*[a-z]"),
]
#: French and Portuguese share the abbreviations of law reports; each has its own forms of address.
COURTS = r"art|arts|al|n|no|p|ex|cf|etc|vol|av"
FRENCH = [(N, WORDEND + rf"(?i:m|mm|mme|mmes|mlle|me|mgr|p\. ex|{COURTS})\.", r"\s*\S")]
PORTUGUESE = [(N, WORDEND + rf"(?i:sr|sra|srs|dr|dra|exmo|exma|fl|fls|{COURTS})\.", r"\s*\S")]
#: Hindi and Marathi share titles and signs; Marathi has its own forms of address besides.
HINDI = [(N, r"(?<![\w.])(?:सं|रु|डॉ|श्री|क्र|पृ)\.", r"\s*\S")]
MARATHI = [(N, r"(?<![\w.])(?:सं|रु|डॉ|श्री|क्र|पृ|सौ|कु|प्रा|न्या|ता|जि)\.", r"\s*\S")]
#: Urdu numbers and years have their own signs; a stop in Latin form behind them is no end.
URDU = [(N, r"(?<![\w])(?:نمبر|ص|ج|م|ء|ھ)\.", r"\s*[\d۰-۹]")]
#: Chinese has no blanks: a stop in Latin form between ideographs and digits numbers an article.
CHINESE = [(N, r"[\d０-９]．", r"[\d０-９]"), (N, r"(?<![\w.])(?:第|号|页)\.", r"\s*\d")]
BENGALI = [(N, r"(?<![\w.])(?:টা|ডা|ড|নং|মো|পৃ)\.", r"\s*\S")]
TAMIL = [(N, r"(?<![\w.])(?:எண்|ரூ|திரு|திருமதி|டாக்டர்|பக்)\.", r"\s*\S")]
#: After a closing quotation mark: words by which the sentence goes on.
QUOTED = [
    (N, r"[“”\"»」]", r"\s*(?:[a-zß-ÿ]|کہہ کر|等|ऐसा कह|এই বলে|என்|என)"),
]
TABLES = {
    "hi": [*QUOTED, *HINDI], "mr": [*QUOTED, *MARATHI], "bn": [*QUOTED, *BENGALI], "ta": [*QUOTED, *TAMIL], "ur": [*QUOTED, *URDU], "zh": [*QUOTED, *CHINESE],
    "fr": [*QUOTED, *FRENCH], "pt": [*QUOTED, *PORTUGUESE], "en": QUOTED,
}


def _compiled(rules: list) -> list:
    return [(b, re.compile(f"(?:{before})[*_]*[{CLOSERS}]*(?:\\s*\\[S\\d+\\])*\\Z"), re.compile(after)) for b, before, after in rules]


#: Cascades: the language's own table, the common one, that of Latin letters, the last one.
CASCADES = {k: _compiled([*own, *COMMON, *LATIN, *TAIL]) for k, own in TABLES.items()}
SCRIPTS = [("hi", re.compile("[ऀ-ॣ०-ॿ]")), ("bn", re.compile("[ঀ-৿]")), ("ta", re.compile("[஀-௿]")), ("ur", re.compile("[؀-ۿ]")), ("zh", re.compile("[一-鿿]"))]
#: Small words that tell languages of one script apart.
FRENCH_WORDS = re.compile(r"\b(?:le|la|les|du|dans|selon|devant|avec|et|des|une|est|par)\b", re.I)
PORTUGUESE_WORDS = re.compile(r"\b(?:o|os|das|dos|da|do|perante|segundo|e|uma|foi|pelo|pela)\b", re.I)
MARATHI_WORDS = re.compile(r"(?<![ऀ-ॿ])(?:आहे|आणि|नाही|व|या|हे|होते|केले)(?![ऀ-ॿ])|च्या|ळ")
HINDI_WORDS = re.compile(r"(?<![ऀ-ॿ])(?:है|और|नहीं|का|की|के|को|में|से|था|पर)(?![ऀ-ॿ])")


def table_of(text: str) -> str:
    """The rule table for a text: the language of its commonest script, of several that have the commonest small words."""
    n, name = max((len(p.findall(text)), k) for k, p in SCRIPTS)
    if n > 0.3 * sum(c.isalpha() for c in text):
        return "mr" if name == "hi" and len(MARATHI_WORDS.findall(text)) > len(HINDI_WORDS.findall(text)) else name
    fr, pt = len(FRENCH_WORDS.findall(text)), len(PORTUGUESE_WORDS.findall(text))
    if max(fr, pt) <= 0.08 * (text.count(" ") + 1):
        return "en"
    return "fr" if fr >= pt else "pt"


def _hidden(line: str) -> list[tuple[int, int]]:
    """Insides of quotations that open and close in the line."""
    out, opened, closing = [], -1, ""
    for m in MARKS.finditer(line):
        i, c = m.start(), m[0]
        if opened >= 0:
            if c in closing:
                out.append((opened + 1, i))
                opened = -1
        elif c in QUOTES and (i == 0 or not line[i - 1].isalnum() and line[i - 1] not in STOPS + ",;" or "一" <= line[i - 1] <= "鿿" or c in "“「『"):
            if i + 1 < len(line) and (not line[i + 1].isspace() or c == "«"):
                opened, closing = i, QUOTES[c]
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence."""
    if not text or text.isspace():
        return []
    rules, out = CASCADES[table_of(text)], []
    for at in LINES.finditer(text):
        line, base, start = at[0], at.start(), 0
        hidden = _hidden(line)
        for m in CANDIDATE.finditer(line):
            end = m.end()
            if line[end : end + 1] == "“" and any(b == end for _, b in hidden):
                end += 1  # it closes here, as Urdu has it
            end = CITED.match(line, end).end()
            if any(a <= end < b or a <= m.start() and end == b for a, b in hidden):
                continue
            # a longer beginning is marked as cut, so that what stands for the sentence's start isn't found there
            before = line[start:end] if end - start <= BEFORE else "\0" + line[end - BEFORE : end]
            for does, p, q in rules:
                if p.search(before) and q.match(line, end):
                    break
            else:
                does = False
            if does and line[start:end].strip():
                out.append((base + start, base + end))
                start = end
        out.append((base + start, base + len(line)))
    trimmed = []
    for a, b in out:
        s = text[a:b]
        a, b = a + len(s) - len(s.lstrip()), b - len(s) + len(s.rstrip())
        if a < b:
            trimmed.append((a, b))
    return trimmed


def split(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, start_at, end_at), one row per sentence."""

    def run(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        rows, a, b = [], [], []
        for i, t in enumerate(texts):
            for x, y in sentences(t):
                rows.append(i)
                a.append(x)
                b.append(y)
        return np.array(rows, np.int64), [pa.array(a, pa.int64()), pa.array(b, pa.int64())]

    return mapped(df, keys, text, "start_at bigint, end_at bigint", run)
