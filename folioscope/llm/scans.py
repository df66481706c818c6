"""Problem 5: text of scanned pages as continuous paragraphs.

1. Lines of their own that repeat the work's title or a report series' name, and page numbers alone on a line, are taken
   out.
2. The rest is de-lined to a stream of tokens. Where it holds something that the corpus's words don't know, a shortest
   path is decoded over it: each token may stay, be read through confusions, be split in two, be merged with the next, or be
   joined to it over a line end with or without its hyphen. Costs are negative logs of word frequencies plus what each
   repair costs.
3. Paragraph boundaries between the lines are chosen by dynamic programming: a paragraph costs something, more if it
   doesn't end as a sentence, and lines inside it cost what speaks for a boundary before them.

Word frequencies are counted over all texts, but for the tokens that a line end cuts and the lines taken out. The WORDS_BOUND
commonest words are broadcast with their counts, of the others a filter of fixed size is; what the filter holds of a text's words,
joins and readings is asked by a join (`asked`), so the same counts decide whatever the bounds.

Defined results: null, empty and blank texts, and those of other text sources, give no row; a text without page numbers
(null page_start and page_end) has no unusable page; repeated pages count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import types_of
from folioscope.session import staged

#: Words that are broadcast with their counts, the commonest; and bits of the filter of the others (16 MB).
WORDS_BOUND, FILTER_BITS = 300_000, 1 << 27
#: Shapes that scanning takes for each other: seen -> meant.
CONFUSIONS = {
    "rn": ["m"], "ri": ["n"], "ii": ["u"], "cl": ["d"], "vv": ["w"], "nn": ["m"], "c": ["e"], "1": ["l", "i"], "0": ["o"], "9": ["g"], "!": ["i", "l"], "5": ["s"],
    "lt": ["tt"], "@": ["a"], "(": ["c"], "b": ["h"], "h": ["b"], "8": ["b"], "6": ["b"], "|": ["l", "i"], "$": ["s"], "3": ["e"], "4": ["a"], "7": ["t"], "2": ["z"], "q": ["g"], "li": ["h"], "tl": ["d"], "m": ["rn"], "£": ["e"], "e": ["c"], "€": ["e"],
}
#: Longer strings are addresses and codes and aren't read; no word of the 3,833 counted ones has over 60 letters. A word has at
#: most so many readings tried; the most that a counted word has is 177.
LONGEST, READINGS = 60, 4000
#: A reading must be so many times commoner than what is seen.
RATIO = 20
CUT = "-¬\xad‐‑=­⸗"
PUNCTUATION = ".,;:?!…“”\"'’‘()[]{}«»<>।॥۔؟。，；：？！（）—–*~^|¦_•·°"
TRIM = PUNCTUATION.replace("!", "").replace("(", "").replace("|", "")
WORDLIKE = re.compile(r"[^\W\d_]")
MIXED = re.compile(r"[A-Za-zÀ-ÿ][015983467@!$|][A-Za-zÀ-ÿ]|[A-Za-zÀ-ÿ]{2}[01@$][A-Za-zÀ-ÿ]?$")
PLAIN = re.compile(r"[^\W\d_]+(?:[’'\-–][^\W\d_]+)*\Z")
ADDRESS = re.compile(r"[/\\]|\w\.\w{2,}|@\w+\.|^\w{1,2}\.|\d[,.]\d|^[A-Z]{1,4}\d+$|^\W*\d")
#: Marks that dust leaves, alone or at a word.
DUST = "~^|¦"
SPECKS = re.compile(r"^[~^|¦]+|[~^|¦]+$")
LABEL = re.compile(r"\s*(?:\(?(?:\d{1,4}|[a-zA-Z]|[ivxlc]{1,6})[.)]|[-•*#]+|§)\s")
STOP = re.compile(r"[.!?।॥۔؟。！？:—][\"”’»)\]“]*\s*(?:\[S\d+\]\s*)*\Z")
PAGE = re.compile(
    r"[-–—~=\s\[(<|•]*(?:(?:page|pg|p|पृष्ठ|पृ|পৃষ্ঠা|பக்கம்|صفحہ|第)\.?\s*)?(?:\d{1,3}|(?=[ivxlc])(?:x{0,3}|x?l|l?x{0,3}|xc|c{1,3}x{0,3})(?:ix|iv|v?i{0,3}))(?:\s*(?:of|/|de|का)\s*\d{1,4})?\s*页?[-–—~=\s\])>|•]*\Z", re.I
)
DECORATED = re.compile(r"[-–—~=\s\[(<|•]*(?:page|pg|p)?\.?\s*\d{4}(?:\s*(?:of|/)\s*\d{1,4})?[-–—~=\s\])>|•]*\Z", re.I)
SERIES = re.compile(r"(?:\S+\s+){1,4}(?:(?:law|appeal|weekly|civil|criminal|revenue|company)\s+)?(?:reports?|reporter|cases|journal|gazette|digest|notes)\Z", re.I)
NUMBER_AT_ENDS = re.compile(r"^\W*(?:\d{1,4}|[ivxlc]+)\s{2,}|\s{2,}\W*(?:\d{1,4}|[ivxlc]+)\W*$|^\W*\d{1,4}\s+(?=\D)|(?<=\D)\s+\d{1,4}\W*$")
CITED = re.compile(r"^\s*[\[(]\d{4}[\])]\s*\d*\s*(?:[A-Z]\.?){2,}\s+")


def _letters(s: str) -> str:
    return re.sub(r"[\W_]+", "", s).lower()


def _same(short: str, full: str) -> bool:
    """Whether short is full or its beginning, but for a few misread letters."""
    if len(short) < 6 or len(short) > len(full) + 2:
        return False
    wrong = sum(a != b for a, b in zip(short, full, strict=False)) + max(0, len(short) - len(full))
    return wrong <= len(short) // 10


def is_header(line: str, title: str | None) -> bool:
    s = line.strip()
    if not 4 <= len(s) <= 120:
        return False
    forms = {s, NUMBER_AT_ENDS.sub("", s).strip(), CITED.sub("", s).strip(), NUMBER_AT_ENDS.sub("", NUMBER_AT_ENDS.sub("", s)).strip()}
    full = _letters(title or "")
    if full and any(_same(_letters(x), full) for x in forms):
        return len(_letters(s)) >= 8 or _letters(s) == full
    bare = NUMBER_AT_ENDS.sub("", s).strip()
    return bool(SERIES.match(bare)) and bare[:1].isupper() and (bare.isupper() or bare.istitle() or all(w[0].isupper() or len(w) < 4 for w in bare.split())) and not STOP.search(s)


def is_page(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > 24:
        return False
    if DECORATED.match(s):
        return not s.isdigit() and bool(re.match(r"[-–—~=\[(<|•]|page|pg|p\.", s, re.I)) and not re.fullmatch(r"\(\d{4}\)", s)
    if not PAGE.match(s):
        return False
    if re.fullmatch(r"\(\w{1,4}\)|[ivxlcIVXLC]{1,6}[.)]?|\d+[.)]", s):
        return s.islower() and re.fullmatch(r"[ivxlc]+", s) is not None and s not in ("c", "l")
    return True


class Reader:
    """Reads tokens by the corpus's word counts (lower-cased word -> count)."""

    def __init__(self, counts: dict[str, int] | Callable[[str], int]):
        self.count = (lambda w: counts.get(w, 0)) if isinstance(counts, dict) else counts
        self.readings: dict[str, str | None] = {}
        self.fine: dict[str, bool] = {}
        self.seen: dict[str, bool] = {}
        self.strange: dict[str, bool] = {}

    def read(self, word: str) -> str | None:
        """What a misread word stands for; None if it is fine or nothing known comes near it."""
        w = word.lower()
        if w in self.readings:
            return self.readings[w]
        if len(self.readings) > 200_000:
            self.readings.clear()
        own, best, most = self.count(w), None, 0
        for v, steps in variants(w):
            n = self.count(v)
            # every further confusion must be made up for
            if n >= RATIO * max(own, 1) / 4 ** (own == 0) and n / 8**steps > most:
                best, most = v, n / 8**steps
        self.readings[w] = best
        return best

    def ok(self, token: str) -> bool:
        """Whether a token as it stands needs no decoding."""
        known = self.fine.get(token)
        if known is None:
            if len(self.fine) > 400_000:
                self.fine.clear()
            known = self.fine[token] = self._ok(token)
        return known

    def doubtful(self, token: str) -> bool:
        """Whether a token must be decoded: it isn't fine, or may lack a blank or have one too many."""
        known = self.seen.get(token)
        if known is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            known = self.seen[token] = not self.ok(token) or self.unknown(token)
        return known

    def _ok(self, token: str) -> bool:
        w = token.strip(PUNCTUATION)
        if not w or not WORDLIKE.search(w):
            return True
        if any(PLAIN.match(p) and self.count(p.lower()) and self.read(p) is None for p in (w, w.removesuffix("’s").removesuffix("'s"))):
            # a last letter read as a mark leaves a form that may be counted itself
            whole = token.strip(TRIM)
            meant = self.read(whole) if whole != w else None
            return meant is None or self.count(meant) < RATIO * self.count(w.lower())
        return not self.misread(token)

    def misread(self, token: str) -> str | None:
        """The token as meant, if scanning changed it."""
        for cut in (PUNCTUATION, TRIM):
            w = token.strip(cut)
            if not w or not WORDLIKE.search(w) or not 3 <= len(w) <= LONGEST or ADDRESS.search(w):
                continue
            core, tail = (w[:-2], w[-2:]) if w.lower().endswith(("’s", "'s")) else (w, "")
            parts = re.split(r"([-–])", core)
            read = [p if i % 2 else (self.read(p) if len(p) > 1 else None) for i, p in enumerate(parts)]
            if any(r for i, r in enumerate(read) if not i % 2):
                meant = "".join(p if r is None else _cased(r, p) for p, r in zip(parts, read, strict=True)) + tail
                return token.replace(w, meant, 1)
        return None

    def odd(self, token: str) -> bool:
        """A digit or mark inside letters, in no known word: misread, whatever it stands for."""
        w = token.strip(TRIM)
        if not MIXED.search(w) or ADDRESS.search(w) or self.count(w.lower()) > 2:
            return False
        return not re.search(r"[!|][A-ZÀ-Þ]|\d{2}|[A-Z]\d", w) and len(WORDLIKE.findall(w)) >= 4

    def stranger(self, token: str) -> bool:
        """`odd`, kept by token."""
        if len(self.strange) > 400_000:
            self.strange.clear()
        out = self.strange[token] = not token.isalpha() and self.odd(token)
        return out

    def unknown(self, token: str) -> bool:
        """A plain word that the corpus doesn't have, maybe two that run together or a part of one."""
        w = token.strip(PUNCTUATION)
        return w.isalpha() and w.islower() and not self.count(w)

    def cost(self, word: str) -> float:
        """By the word's count; by its rarest part, if it is a compound that isn't counted itself."""
        w = word.strip(PUNCTUATION).lower().removesuffix("’s").removesuffix("'s")
        n = self.count(w) if w else 1000
        parts = re.split(r"[-–]", w)
        if not n and len(parts) > 1:
            return max(self.cost(p) for p in parts)
        return 18 - math.log(n) if n else 16.0 + 2.0 * len(w)

    def path(self, tokens: list[str], breaks: list[str]) -> list[tuple[str, str, int]]:
        """The cheapest reading of tokens as (kind, word, tokens used); breaks[i] is "" or the mark at a line end after token i."""
        n = len(tokens)
        best: list[tuple[float, int, tuple[str, str, int] | None]] = [(math.inf, -1, None)] * (n + 1)
        best[0] = (0.0, -1, None)

        def offer(i: int, j: int, cost: float, step: tuple[str, str, int]) -> None:
            if best[i][0] + cost < best[j][0]:
                best[j] = (best[i][0] + cost, i, step)

        for i, t in enumerate(tokens):
            offer(i, i + 1, self.cost(t), ("keep", t, 1))
            if not self.ok(t):
                if meant := self.misread(t):
                    offer(i, i + 1, self.cost(meant) + 3, ("chars", meant, 1))
            if self.unknown(t):
                w = t.strip(PUNCTUATION)
                for k in range(2, len(w) - 1 if len(w) <= 2 * LONGEST else 0):
                    if self.count(w[:k]) > 2 and self.count(w[k:]) > 2:
                        offer(i, i + 1, self.cost(w[:k]) + self.cost(w[k:]) + 6, ("split", t.replace(w, f"{w[:k]} {w[k:]}", 1), 1))
            if i + 1 < n:
                if breaks[i]:
                    for kind, cost, word in self.joins(t[:-1], breaks[i], tokens[i + 1]):
                        offer(i, i + 2, cost, (kind, word, 2))
                elif t.isalpha() and self.unknown(t) and self.unknown(u := tokens[i + 1].rstrip(PUNCTUATION)) and self.count(t + u) > 2:
                    offer(i, i + 2, self.cost(t + u) + 6, ("merge", t + tokens[i + 1], 2))
        out, j = [], n
        while j > 0:
            _, i, step = best[j]
            out.append(step)
            j = i
        return out[::-1]

    def joins(self, left: str, mark: str, right: str) -> list[tuple[str, float, str]]:
        """Ways of joining what a line end parts: one word, or a compound that keeps its hyphen."""
        head, tail = halves(left, right)
        whole, compound = (head + tail).lower(), f"{head}-{tail}".lower()
        last = whole.rsplit("-", 1)[-1].rsplit("–", 1)[-1]
        joined = self.count(whole) or (self.count(last) if last != whole else 0)
        kept = self.count(compound)
        if kept > joined:
            return [("compound", -5.0, f"{left}-{right}")]
        if read := self.misread(head + tail):
            return [("hyphen chars", -5.0, left.replace(head, "") + read + right[len(tail) :] if right.startswith(tail) else left + right)]
        if joined:
            return [("hyphen", -5.0, left + right)]
        if compound_read := self.misread(compound):
            return [("compound chars", -5.0, compound_read)]
        # neither is known: names of places and persons are cut like words, two capitals are a compound
        if tail[:1].isupper() and not head.isupper() or self.count(head.lower()) > 20 and self.count(tail.lower()) > 20 and mark == "-" and len(head) > 3 and len(tail) > 3:
            return [("compound", -5.0, f"{left}-{right}")]
        return [("hyphen", -5.0, left + right)]


def halves(left: str, right: str) -> tuple[str, str]:
    """The letters on both sides of a cut."""
    head, tail = left.lstrip(PUNCTUATION), right.strip(PUNCTUATION)
    m = re.match(r"[^\W\d_]+|\w+", tail)
    return head, m[0] if m else tail


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def variants(word: str, steps: int = 3, most: int = READINGS) -> Iterator[tuple[str, int]]:
    """Readings of a word through up to `steps` confusions (all of them while there are fewer than `most`)."""
    seen, layer = {word}, [word]
    for step in range(1, steps + 1):
        made = []
        for w in layer:
            for i in range(len(w)):
                for k in (1, 2):
                    for meant in CONFUSIONS.get(w[i : i + k], ()):
                        v = w[:i] + meant + w[i + k :]
                        if v not in seen:
                            seen.add(v)
                            made.append(v)
                            yield v, step
            if len(seen) > most:
                return
        layer = made


def paragraphs(lines: list[str]) -> list[tuple[int, int]]:
    """Line ranges of the paragraphs, by dynamic programming."""
    n = len(lines)
    if not n:
        return []
    sizes = sorted(map(len, lines))
    width = (sizes[n // 2] + sizes[(n - 1) // 2]) / 2
    inside, ends = [0.0], []
    for i, x in enumerate(lines):
        stop = bool(STOP.search(x))
        ends.append(0.0 if stop else 7.0)
        if i + 1 < n:
            nxt = lines[i + 1]
            # what speaks for a boundary after line i
            against = 5.0 * (stop and bool(LABEL.match(nxt))) + 2.5 * (stop and len(x) < 0.75 * width) + 6.0 * (x.rstrip().endswith(".—")) + 3.0 * (not x.strip() or not nxt.strip())
            inside.append(inside[-1] + against)
    best, back, low, at = [0.0] * (n + 1), [0] * (n + 1), math.inf, 0
    for j in range(1, n + 1):
        # a paragraph of lines i..j-1 costs 3, its end, and the boundaries left out inside it
        if best[j - 1] - inside[j - 1] < low:
            low, at = best[j - 1] - inside[j - 1], j - 1
        best[j], back[j] = low + inside[j - 1] + 3.0 + (ends[j - 1] if j < n else 0.0), at
    out, j = [], n
    while j:
        out.append((back[j], j))
        j = back[j]
    return out[::-1]


def delined(text: str, title: str | None) -> tuple[set[str], list[str]]:
    """(defects, lines): the lines without headers, page numbers and blank lines, and which of them there were."""
    found: set[str] = set()
    lines = text.split("\n")
    if len(lines) > 1:
        kept = []
        for x in lines:
            if not x.strip():
                continue
            if is_page(x):
                found.add("pageno")
            elif is_header(x, title):
                found.add("header")
            else:
                kept.append(x.rstrip("\r "))
        lines = kept
    return found, lines


def stream(lines: list[str]) -> tuple[list[str], list[str], list[int]]:
    """(tokens, breaks, starts): the words of the lines, the mark that cuts a word at its line's end or "", where lines start."""
    tokens, breaks, starts = [], [], []
    for k, x in enumerate(lines):
        starts.append(len(tokens))
        words = x.split()
        tokens += words
        breaks += [""] * len(words)
        if words and k + 1 < len(lines) and words[-1][-1] in CUT and len(words[-1]) > 1 and words[-1][-2].isalpha() and lines[k + 1].split() and lines[k + 1].lstrip("“\"(")[:1].isalpha():
            breaks[-1] = words[-1][-1]
    return tokens, breaks, starts


def decode(text: str, title: str | None, reader: Reader) -> tuple[set[str], list[str]]:
    """(defects, paragraphs)."""
    found, lines = delined(text, title)
    tokens, breaks, starts = stream(lines)
    # runs of words that must be decoded
    odd, seen = reader.doubtful, reader.seen
    doubtful = [i for i, t in enumerate(tokens) if breaks[i] or (seen[t] if t in seen else odd(t))]
    strange = reader.strange
    for i, t in enumerate(tokens):
        if (strange[t] if t in strange else reader.stranger(t)) and not breaks[i] and not (i and breaks[i - 1]):
            found.add("chars")
            break
    read: dict[int, tuple[str, int]] = {}
    done = -1
    for i in doubtful:
        if i < done:
            continue
        j = i + 1
        while j < len(tokens) and (breaks[j - 1] or odd(tokens[j])):
            j += 1
        at = i
        for kind, word, used in reader.path(tokens[i:j], breaks[i:j]):
            found |= {k for k in kind.split() if k in ("chars", "hyphen")}
            if kind != "keep":
                read[at] = (word, used)
            at += used
        done = j
    out, dusty = [], any(c in text for c in DUST)
    for a, b in paragraphs(lines):
        lo, hi = starts[a], starts[b] if b < len(lines) else len(tokens)
        words, i = [], lo
        if not read and not dusty:
            if lo < hi:
                out.append(" ".join(tokens[lo:hi]))
            continue
        while i < hi:
            word, used = read.get(i, (tokens[i], 1))
            words.append(word)
            i += used
        if words:
            out.append(" ".join(w for x in words if (w := SPECKS.sub("", x) if x[0] in DUST or x[-1] in DUST else x)))
    return found, out


def words(chunks: DataFrame, text: str = "text", least: int = 3, title: str = "title") -> DataFrame:
    """(word, n): lower-cased words of all texts, those seen at least `least` times.

    Texts of several lines are de-lined as `decode` does it: headers, page numbers and the tokens on both sides of a cut word
    don't count.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0)
            lined = pc.match_substring(t, "\n")
            plain = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(pc.utf8_lower(t.filter(pc.invert(lined))))))
            seen: Counter[str] = Counter()
            for x, name in zip(t.filter(lined).to_pylist(), b.column(1).filter(lined).to_pylist(), strict=True):
                tokens, breaks, _ = stream(delined(x, name)[1])
                seen.update(w for w, cut, before in zip(tokens, breaks, ["", *breaks], strict=False) if not cut and not before)
            names = pa.concat_arrays([plain.field(0).cast(pa.string()), pc.utf8_lower(pa.array(list(seen), pa.string()))])
            yield pa.RecordBatch.from_arrays([names, pa.concat_arrays([plain.field(1), pa.array(list(seen.values()), pa.int64())])], ["token", "n"])

    rows = chunks.where(F.col(text).isNotNull()).select(text, F.col(title).cast("string"))
    counted = rows.mapInArrow(tally, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    bare = F.regexp_replace("token", r"^[^\p{L}]+|[^\p{L}\p{M}]+$", "")
    bare = F.regexp_replace(bare, r"['’]s$", "")
    return counted.select(bare.alias("word"), "n").where("word rlike '^[\\\\p{L}\\\\p{M}’\\'–-]+$'").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def usable(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page_start, page_end) none of whose pages is unusable."""
    bad = pages.where("usable = false").select(F.col("doc_id").alias("_doc"), F.col("number").alias("_page")).distinct()
    lo, hi = F.least("page_start", "page_end"), F.greatest("page_start", "page_end")
    return rows.join(bad, (F.col("doc_id") == F.col("_doc")) & F.col("_page").between(lo, hi), "left_anti")


def _scanned(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("text_source").isin("layer", "ocr") & F.col("text").isNotNull()).select("rowid", "doc_id", "page_start", "page_end", F.struct("title", "text").alias("both"))


class Lexicon:
    """What the workers know of the corpus's words: the commonest with their counts, and which others may be counted at all.

    The others are in a filter of a fixed number of bits: what it doesn't hold isn't counted, what it holds is asked by a join,
    so that its size decides how much is asked and never what comes out.
    """

    def __init__(self, common: dict[str, int], bits: np.ndarray | None):
        self.common, self.bits = common, bits
        self.of_word: dict[str, tuple[str, ...]] = {}
        self.of_token: dict[str, tuple[str, ...]] = {}

    def open(self, w: str) -> bool:
        """Whether the count of w must be asked."""
        if w in self.common or self.bits is None:
            return False
        import xxhash

        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42)
        p, q = h & FILTER_BITS - 1, h >> 32 & FILTER_BITS - 1
        return bool(int(self.bits[p >> 6]) >> (p & 63) & int(self.bits[q >> 6]) >> (q & 63) & 1)

    def asks_of_word(self, w: str) -> tuple[str, ...]:
        """Counts that reading w needs: its own and those of its readings."""
        got = self.of_word.get(w)
        if got is None:
            if len(self.of_word) > 200_000:
                self.of_word.clear()
            got = self.of_word[w] = tuple(v for v in (w, *(x for x, _ in variants(w))) if self.open(v))
        return got

    def asks_of_token(self, token: str) -> tuple[str, ...]:
        """Counts that a token needs by itself: of its parts as they are read, and of its halves if it may be unknown."""
        got = self.of_token.get(token)
        if got is None:
            if len(self.of_token) > 400_000:
                self.of_token.clear()
            mine: dict[str, None] = {}
            for w in {token.lower(), token.strip(PUNCTUATION).lower(), token.strip(TRIM).lower()}:
                for whole in {w, w.removesuffix("’s").removesuffix("'s")}:
                    for p in {whole, *re.split(r"[-–]", whole)}:
                        if p:
                            mine |= dict.fromkeys(self.asks_of_word(p))
                if w.isalpha() and w not in self.common and len(w) <= 2 * LONGEST:
                    mine |= dict.fromkeys(x for k in range(2, len(w) - 1) for x in (w[:k], w[k:]) if self.open(x))
            got = self.of_token[token] = tuple(mine)
        return got

    def asks_of_text(self, text: str, title: str | None) -> set[str]:
        """Every word whose count a Reader may want for the text, from the stream of tokens that `decode` reads."""
        tokens, breaks, _ = stream(delined(text, title)[1])
        mine: set[str] = set()
        for t in set(tokens):
            mine.update(self.asks_of_token(t))
        for t, cut, u in zip(tokens, breaks, tokens[1:], strict=False):
            if cut:
                head, tail = halves(t[:-1], u)
                for x in (head + tail, f"{head}-{tail}", head, tail):
                    mine.update(self.asks_of_token(x))
            elif t.isalpha() and t not in self.common and (u := u.rstrip(PUNCTUATION)) not in self.common and self.open(t + u):
                mine.add(t + u)
        return mine


class Aware(Reader):
    """A Reader that also knows the counts that were asked for one text; what these don't touch is read by the shared one."""

    def __init__(self, shared: Reader, lexicon: Lexicon, found: dict[str, int]):
        super().__init__(lambda w: found.get(w) or shared.count(w))
        self.shared, self.lexicon, self.found = shared, lexicon, found

    def read(self, word: str) -> str | None:
        touched = any(w in self.found for w in self.lexicon.asks_of_word(word.lower()))
        return super().read(word) if touched else self.shared.read(word)

    def ok(self, token: str) -> bool:
        return super().ok(token) if self.touched(token) else self.shared.ok(token)

    def doubtful(self, token: str) -> bool:
        return super().doubtful(token) if self.touched(token) else self.shared.doubtful(token)

    def touched(self, token: str) -> bool:
        return any(w in self.found for w in self.lexicon.asks_of_token(token))


def lexicon_of(table: DataFrame, bound: int) -> tuple[Lexicon, DataFrame | None]:
    """(what is broadcast, the words beyond it) of a table (word, n): its `bound` commonest words, and a filter of the others."""
    first = table.orderBy(F.desc("n"), "word").limit(bound).toArrow().to_pydict() if bound else {"word": [], "n": []}
    common = dict(zip(first["word"], first["n"], strict=True))
    if bound and len(common) < bound:
        return Lexicon(common, None), None
    rest = table
    if common:
        least = min(common.values())
        last = max((w for w, n in common.items() if n == least), key=str.encode)  # as Spark orders strings
        rest = table.where((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > last))
    h = F.xxhash64("word")
    at = rest.select(F.explode(F.array(h.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(FILTER_BITS - 1)))).alias("p"))
    cells = at.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()  # at most FILTER_BITS / 64
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[cells.column("cell").to_numpy()] = cells.column("x").to_numpy()
    return Lexicon(common, bits.view(np.uint64)), rest


def _decoded(chunks: DataFrame, bound: int, added: str, fn: Callable[[list, Callable[[int], Reader]], object]) -> DataFrame:
    """Runs fn over scanned rows with a reader of the corpus's words."""
    lexicon, rest = lexicon_of(staged(words(chunks), "words"), bound)
    rows, keep = _scanned(chunks), ["rowid", "doc_id", "page_start", "page_end"]
    shared = chunks.sparkSession.sparkContext.broadcast(lexicon)  # at most `bound` words and FILTER_BITS bits
    own: list[Reader] = []

    def run(both: list) -> object:
        if not own:
            own.append(Reader(shared.value.common))
        both = [x or {"title": None, "text": ""} for x in both]

        def reader(i: int) -> Reader:
            found = {x["word"]: x["n"] for x in both[i].get("words") or []}
            return Aware(own[0], shared.value, found) if found else own[0]

        return fn(both, reader)

    return mapped_structs(rows if rest is None else asked(rows, rest, shared), keep, added, run)


def asked(rows: DataFrame, rest: DataFrame, lexicon) -> DataFrame:
    """rows whose struct also holds the counts of the words that the lexicon can't tell."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = [], []
            for rowid, both in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = lexicon.value.asks_of_text(both["text"] or "", both["title"])
                ids += [rowid] * len(mine)
                got += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.string())], ["rowid", "word"])

    asks = rows.select(F.col("rowid").cast("bigint"), "both").mapInArrow(ask, "rowid bigint, word string")
    got = asks.join(rest, "word").groupBy("rowid").agg(F.collect_set(F.struct("word", "n")).alias("words"))  # bounded by the text
    both = rows.join(got, "rowid", "left")
    return both.select("rowid", "doc_id", "page_start", "page_end", F.struct("both.title", "both.text", "words").alias("both"))


def mapped_structs(df: DataFrame, keep: list[str], added: str, fn: Callable[[list], object]) -> DataFrame:
    """`mapped` for a struct column with a text; blocks follow the rows of a batch."""
    names = [*keep, *[x.strip().split()[0] for x in added.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows, made = fn(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(rows)) for c in range(len(keep))], *made], names)

    return df.select(*keep, "both").mapInArrow(run, f"{types_of(df, keep)}, {added}")


def defects(chunks: DataFrame, pages: DataFrame, bound: int = WORDS_BOUND) -> DataFrame:
    """(rowid, defect) of the scanned chunks on usable pages."""

    def run(both: list, reader: Callable[[int], Reader]) -> tuple[np.ndarray, list[pa.Array]]:
        rows, out = [], []
        for i, x in enumerate(both):
            for d in sorted(decode(x["text"] or "", x["title"], reader(i))[0]):
                rows.append(i)
                out.append(d)
        return np.array(rows, np.int64), [pa.array(out, pa.string())]

    made = _decoded(chunks, bound, "defect string", run)
    return usable(made, pages).select("rowid", "defect").distinct()


def repaired(chunks: DataFrame, pages: DataFrame, bound: int = WORDS_BOUND) -> DataFrame:
    """(rowid, paragraph, text) of the scanned chunks on usable pages."""

    def run(both: list, reader: Callable[[int], Reader]) -> tuple[np.ndarray, list[pa.Array]]:
        rows, k, out = [], [], []
        for i, x in enumerate(both):
            for j, p in enumerate(decode(x["text"] or "", x["title"], reader(i))[1]):
                rows.append(i)
                k.append(j + 1)
                out.append(p)
        return np.array(rows, np.int64), [pa.array(k, pa.int32()), pa.array(out, pa.string())]

    made = _decoded(chunks, bound, "paragraph int, text string", run)
    return usable(made, pages).select("rowid", "paragraph", "text")
