"""Text functions as Column expressions, so that they stay in the JVM and in whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of keyword queries.
STOPWORDS = """a an the and or of to in on for by with from at as is are was were be been being it its this that these those
what which who whom whose when where why how do does did can could should would may might must shall will i me my we our you
your he she they them their his her not no any all there here into under about if then than so such also only other over
upon within without per between after before क्या है के की का में से को और या कि होता होती करना लिए कैसे एक""".split()
#: Words that stay small inside a title.
SMALL_WORDS = "of the and in to for by on or a an under with from as at".split()
#: What stands for a missing value.
PLACEHOLDERS = ["...", "…", "tbd", "n/a", "na", "example", "placeholder", "unknown party", "xxx", "-", "none", "null"]

TOKEN = r"[\p{L}\p{M}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def straight(c: Column | str) -> Column:
    """Straight quotation marks, single blanks, lower case: the form in which quotations are compared."""
    return F.lower(collapse(F.translate(col(c), "“”‘’", "\"\"''")))


def alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^0-9a-z]", "")


def slug(c: Column | str) -> Column:
    """Lower case with runs of other characters as hyphens; x if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "x").otherwise(s)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def query_terms(c: Column | str) -> Column:
    """Distinct terms in order, without stop words and single letters."""
    stop = F.array(*[F.lit(x) for x in STOPWORDS])
    return F.array_distinct(F.filter(tokens(c), lambda t: ~F.array_contains(stop, t) & ((F.length(t) >= 2) | t.rlike(r"^\p{Nd}+$"))))


def match_expression(text: Column | str, phrases: Column | None = None) -> Column:
    """The query as text: quoted terms joined by OR, then phrases, which keep their stop words; null if empty."""
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    parts = F.transform(query_terms(text), quote)
    if phrases is not None:
        words = F.filter(F.transform(phrases, lambda p: F.array_join(tokens(p), " ")), lambda p: p != "")
        parts = F.array_distinct(F.concat(parts, F.transform(words, quote)))
    return F.when(F.size(parts) > 0, F.array_join(parts, " OR "))


def join_lines(lines: Column) -> Column:
    """Lines joined by blanks; a hyphen between letters joins without one and stays."""

    def add(acc: Column, t: Column) -> Column:
        glued = acc.rlike(r"(?U)\p{L}-$") & t.rlike(r"^\p{L}")
        return F.when(t == "", acc).when(acc == "", t).when(glued, F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t))

    return F.regexp_replace(F.aggregate(F.transform(lines, lambda x: F.trim(x)), F.lit(""), add), "[ \t]+", " ")


def clause_sentences(c: Column | str) -> Column:
    """Sentences of legal prose: after . ; : ? ! and a closing quote, before a capital, digit, bracket or quote."""
    marked = F.regexp_replace(col(c), r"([.;:?!][”\"']?)\s+(?=[“\"(A-Z0-9\[])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def excerpt(c: Column | str, limit: int = 600) -> Column:
    """The beginning of a text up to `limit` characters, cut at the last . ; : in its second half, else at a blank."""
    flat = collapse(c)
    head = F.substring(flat, 1, limit)
    last = lambda mark: F.lit(limit) - F.instr(F.reverse(head), mark) + 1
    marks = [F.when(F.instr(F.reverse(head), m) > 0, last(m)).otherwise(0) for m in (".", ";", ":")]
    at = F.greatest(*marks)
    blank = F.when(F.instr(F.reverse(head), " ") > 0, last(" ") - 1).otherwise(limit)
    cut = F.when(at > limit // 2, head.substr(F.lit(1), at)).otherwise(head.substr(F.lit(1), blank))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit(" …")))


def nice_title(c: Column | str) -> Column:
    small = F.array(*[F.lit(x) for x in SMALL_WORDS])
    words = F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != "")
    shaped = F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))))
    return F.array_join(shaped, " ")


def versus(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?i)\s+(?:versus|vs\.?)\s+", " v. ")


#: Letters that stand for words in HTML text; others stay as they are.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_text(c: Column | str) -> Column:
    bare = F.regexp_replace(col(c), r"(?s)<[^>]*>", " ")
    return collapse(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), bare))


def estimated_tokens(c: Column | str) -> Column:
    """A count without a tokenizer: by words, or by narrow and wide characters, whichever is more."""
    c = col(c)
    wide = F.regexp_count(c, F.lit("[^\\x{0000}-\\x{02FF}]"))
    words = F.regexp_count(c, F.lit(r"(?U)\S+"))
    return F.greatest(words * 1.5, (F.length(c) - wide) / 3.2 + wide / 1.5).cast("int") + 1


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def furniture_key(c: Column | str) -> Column:
    return F.regexp_replace(collapse(c), r"\d+", "#")


def part_number(locator: Column | str, para_start: Column | str) -> Column:
    n = F.regexp_extract(col(locator), r"part (\d+) of", 1)
    return F.coalesce(F.when(n != "", n.cast("int")), col(para_start), F.lit(0))


def party_words(c: Column | str, stop: tuple[str, ...] = ("the", "state", "union", "and", "ors", "anr", "others", "another", "smt", "shri")) -> Column:
    drop = F.array(*[F.lit(x) for x in stop])
    return F.slice(F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~F.array_contains(drop, w)), 1, 2)


def section_numbers(c: Column | str) -> Column:
    """Section numbers of a reference: sub-sections in brackets don't count."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(col(c), r"\([^)]*\)", ""), F.lit(r"\d{1,3}[A-Z]{0,2}"), F.lit(0)), F.upper)


def markers(c: Column | str) -> Column:
    """Numbers of the [S#] marks in order."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[\s*[Ss]\s*(\d{1,3})\s*\]"), F.lit(1)), lambda n: n.cast("int"))


def trim_marker_runs(c: Column | str) -> Column:
    """Of a run of six marks or more the first three stay."""
    return F.regexp_replace(col(c), r"((?:\[S\d+\]){3})(?:\[S\d+\]){3,}", "$1")


def tidy_markers(c: Column | str) -> Column:
    """Without empty marks, blanks before punctuation and doubled blanks."""
    bare = F.regexp_replace(col(c), r"(?i)[ \t]*\[(?:\s*(?:none|n/?a|nil)\s*)?\](?!\()", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+([.,;:])", "$1"), "[ \t]{2,}", " "))


def safe_filename(c: Column | str) -> Column:
    return F.left(F.regexp_replace(col(c), r"[^\w.\- ]", "_"), F.lit(120))


def roman(n: Column | str) -> Column:
    """Roman numerals of 1 to 89."""
    n = col(n)
    tens = F.element_at(F.array(*[F.lit(x) for x in ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX")]), (n / 10).cast("int") + 1)
    ones = F.element_at(F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]), (n % 10).cast("int") + 1)
    return F.when((n > 0) & (n < 90), F.concat(tens, ones))


def iso_date(c: Column | str) -> Column:
    return F.when(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(c), "yyyy-MM-dd"))


def day_first_date(c: Column | str) -> Column:
    return F.when(F.trim(col(c)).rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(F.trim(col(c)), "d-M-yyyy"))


def blank(c: Column | str) -> Column:
    """Null or only white space."""
    return col(c).isNull() | (F.trim(col(c)) == "")


def placeholder(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin(PLACEHOLDERS), F.lit(False))


def tidy_label(c: Column | str) -> Column:
    """PART I — OF DEEDS as PART I — Of Deeds; null stays null."""
    head, title = F.split_part(col(c), F.lit(" — "), F.lit(1)), F.split_part(col(c), F.lit(" — "), F.lit(2))
    return F.when(title == "", head).otherwise(F.concat(head, F.lit(" — "), nice_title(title)))


def case_title(title: Column | str, respondent: Column | str) -> Column:
    """A title without its empty second party."""
    bare = F.trim(F.regexp_replace(col(title), r"(?i)\s+(?:versus|vs\.?|v\.)\s+[^A-Za-z]*$", ""))
    return F.when(F.coalesce(col(respondent), F.lit("")).rlike("[A-Za-z]"), col(title)).otherwise(bare)


def coram(html: Column | str) -> Column:
    """Judges and author of a listing card, as struct<judges, author>; the author is the name before its mark."""
    part = F.regexp_extract(col(html), r"(?is)Coram\s*:\s*(.*?)</strong>", 1)
    author = F.regexp_extract(part, r'([^,>]+?)\s*<sup[^>]*data-tooltip="Author"', 1)
    names = F.split(html_text(F.regexp_replace(part, r"(?s)<sup.*?</sup>", "")), ",")
    judges = F.filter(F.transform(names, lambda x: F.trim(x, F.lit(" *"))), lambda x: x != "")
    return F.struct(F.coalesce(judges, F.array().cast("array<string>")).alias("judges"), F.nullif(F.trim(html_text(author), F.lit(" ,")), F.lit("")).alias("author"))


def case_header(title: Column, court: Column, decided: Column, judges: Column, author: Column, cites: Column, disposal: Column, cnr: Column) -> Column:
    """The header of a judgment, line by line; what is missing has no line."""
    bench = F.when(F.size(judges) > 0, F.concat(F.lit("Bench: "), F.array_join(judges, ", "), F.coalesce(F.concat(F.lit(" (author: "), F.nullif(author, F.lit("")), F.lit(")")), F.lit(""))))
    said = lambda name, c: F.concat(F.lit(f"{name}: "), F.nullif(c, F.lit("")))
    return F.concat_ws("\n", title, F.concat(court, F.lit(" — decided "), decided), bench, said("Citation", cites), said("Disposal", disposal), said("CNR", cnr))


def free_of(warnings: Column | str, prefixes: list[str]) -> Column:
    """Whether no warning begins with one of the prefixes, so that an answer may be kept; null and empty lists have none."""
    starts = lambda w: reduce(lambda x, p: x | F.startswith(w, F.lit(p)), prefixes, F.lit(False))
    return ~F.coalesce(F.exists(col(warnings), lambda w: F.coalesce(starts(w), F.lit(False))), F.lit(False))


def in_band(top: Column, height: Column, above: float = 0.16, below: float = 0.14) -> Column:
    """Whether a line stands in the upper or lower band of its page, where running lines are."""
    return (top < height * above) | (top > height * (1 - below))


def without_section(c: Column | str, heading: str) -> Column:
    """The text without the section under a bold heading, up to the next bold heading or the end."""
    return F.regexp_replace(F.regexp_replace(col(c), rf"(?is)\n*[ \t]*\*\*{heading}:?\*\*:?.*?(?=\n\s*\*\*|\z)", ""), r"\s+$", "")


def year_list(said: str) -> list[int]:
    """2016-2025 or 2019,2021, or both together, as years in order, each once."""
    years: set[int] = set()
    for part in said.split(","):
        ends = [int(x) for x in part.strip().split("-")]
        years |= set(range(ends[0], ends[-1] + 1))
    return sorted(years)
