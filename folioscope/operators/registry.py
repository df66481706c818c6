"""Names of laws in text, and the references to their sections.

Names are held as a trie of lower-cased words. A text is cut into words once, and from each word the longest name is
followed; the leftmost match wins, then the longer name. Between the words of a name there may be any white space, and a
comma before its year may be left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+|[^\w\s]")
#: Names a registry may hold for it to be sent to the workers; a register of laws is a table of fixed size.
NAMES_BOUND = 200_000
MENTION = "array<struct<start:int,end:int,names:string,expands:array<string>>>"


@dataclass
class Names:
    """A trie of names; each leads to the ids it stands for, the first being what it literally names."""

    root: dict = field(default_factory=dict)
    titles: dict[str, str] = field(default_factory=dict)

    def titled(self) -> Names:
        """The same names, leading to the titles of what they stand for."""

        def walk(node: dict) -> dict:
            return {k: tuple(self.titles.get(i, i) for i in v) if k == "" else walk(v) for k, v in node.items()}

        return Names(walk(self.root), self.titles)

    def add(self, name: str, ids: tuple[str, ...]) -> None:
        words = [w.lower() for w in WORD.findall(name)]
        ways = [words]
        if len(words) > 2 and words[-2] == "," and re.fullmatch(r"\d{4}", words[-1]):
            ways.append(words[:-2] + words[-1:])
        elif len(words) > 1 and re.fullmatch(r"\d{4}", words[-1]):
            ways.append([*words[:-1], ",", words[-1]])
        for way in ways:
            at = self.root
            for w in way:
                at = at.setdefault(w, {})
            at.setdefault("", ids)

    def find(self, text: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, ids) of the names, not overlapping; none inside a word or right after a full stop."""
        words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        out, i = [], 0
        while i < len(words):
            start = words[i][1]
            end, ids, j, at = 0, None, i, self.root
            if start == 0 or text[start - 1] != ".":
                while j < len(words) and words[j][0] in at:
                    at = at[words[j][0]]
                    j += 1
                    if "" in at:
                        end, ids, last = words[j - 1][2], at[""], j
            if ids is None:
                i += 1
            else:
                out.append((start, end, ids))
                i = last
        return out


def names_of(statutes: DataFrame) -> Names:
    """The trie of a statutes table: title with and without its article, short title, aliases; successors are searched too."""
    rows = statutes.select("id", "title", "short_title", "aliases", "successor").limit(NAMES_BOUND + 1).collect()
    if len(rows) > NAMES_BOUND:
        raise ValueError("more laws than a register holds; join them by their words instead")
    before = {r["successor"]: r["id"] for r in rows if r["successor"]}
    made, shared = Names(titles={r["id"]: r["short_title"] for r in rows if r["short_title"]}), {}
    for r in sorted(rows, key=lambda r: r["id"]):
        ids = tuple(x for x in (r["id"], r["successor"], before.get(r["id"])) if x)
        for name in (r["title"], r["short_title"], (r["title"] or "").removeprefix("The ")):
            if name:
                made.add(name, ids)
        for a in r["aliases"] or []:
            shared.setdefault(a, []).extend(x for x in ids if x not in shared.get(a, []))
    for a, ids in shared.items():
        made.add(a, tuple(ids))
    return made


def with_mentions(df: DataFrame, text: str, names: Names, out: str = "mentions") -> DataFrame:
    """df with the mentions of its text in order; null text has none."""
    shared = df.sparkSession.sparkContext.broadcast(names)  # at most NAMES_BOUND names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("names", pa.string()), ("expands", pa.list_(pa.string()))]))
        for b in batches:
            found = [[{"start": s, "end": e, "names": ids[0], "expands": list(ids)} for s, e, ids in shared.value.find(t)] if t else [] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` {MENTION}")


#: How a section is referred to.
SECTION = r"(?i)(?:\b(?:section|sec\.?|s\.|u/s\.?|ss\.)\s*|धारा\s*)(\d{1,3}[A-Z]{0,2})((?:\s*\(\w{1,4}\))*)"
ORDER_RULE = r"(?i)\bOrder\s+([IVXLC]+|\d{1,2})\s*,?\s*(?:Rule|r\.)\s*(\d{1,3}[A-Z]?)"


def section_refs(df: DataFrame, key: str, text: str, mentions: str = "mentions") -> DataFrame:
    """(key, seq, act, section, sub): each section reference with the law nearest to it.

    A law after the reference counts its distance, one before it its distance and five; of ties the first. Without a law the
    reference has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(SECTION)
        for b in batches:
            rows = []
            for k, t, ms in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), b.column(mentions).to_pylist(), strict=True):
                for n, m in enumerate(pattern.finditer(t or "")):
                    near = min(ms or [], key=lambda x: x["start"] - m.start() if x["start"] >= m.start() else m.start() - x["end"] + 5, default=None)
                    rows.append((k, n, near and near["names"], m[1].upper(), re.sub(r"\s+", "", m[2]) or None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(key).type), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]], [key, "seq", "act", "section", "sub"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, mentions).mapInArrow(run, f"`{key}` {kind}, seq int, act string, section string, sub string")


#: Cues of a question's domain, in order of precedence among equals.
DOMAINS = {
    "property_land": r"propert|land\b|plot|flat|apartment|house|sale deed|registr|mortgage|lease|tenan|landlord|gift deed|immov|possession|title deed|mutation|stamp duty|acquisition|builder|allottee|real estate|संपत्ति|जमीन|ज़मीन|रजिस्ट्री|मकान|किराय",
    "contract_civil": r"contract|agreement|breach|damages|specific performance|injunction|civil suit|\bsuit\b|decree|plaint|summons|limitation|time.?barred|execution|appeal|guarantee|indemnity|agent|अनुबंध|मुकदमा",
    "consumer": r"consumer|defective|deficiency|refund|warranty|e-?commerce|district commission|ncdrc|state commission|product liability|unfair trade|seller|manufacturer|उपभोक्ता",
    "criminal_procedure": r"\bfir\b|police|arrest|\bbail\b|charge.?sheet|magistrate|cognizable|investigation|accused|offence|crime|custody|remand|summons to accused|\bipc\b|\bbns\b|crpc|bnss|evidence act|गिरफ्तार|जमानत|पुलिस|अपराध|एफआईआर",
    "constitutional": r"constitution|fundamental right|article \d+|\bwrit\b|habeas corpus|संविधान",
}
#: Cues of a question's intent, in order.
INTENTS = {
    "drafting": r"\bdraft|format|template|sample (?:notice|letter|agreement)|मसौदा",
    "case_law": r"\bcase\b|judgment|judgement|supreme court|high court|precedent|landmark|held that|ruled|निर्णय|फैसला",
    "procedure": r"^\s*how\b|how (?:do|can|to|should)|procedure|process|steps?\b|apply|file (?:a|an|my)|lodge|register (?:a|my)|कैसे|प्रक्रिया",
}


#: The domains of laws, and cues of matters where much is at stake.
ACT_DOMAINS = {
    "crpc-1973": "criminal_procedure", "bnss-2023": "criminal_procedure", "ipc-1860": "criminal_procedure", "bns-2023": "criminal_procedure", "iea-1872": "criminal_procedure", "bsa-2023": "criminal_procedure",
    "cpa-2019": "consumer", "cpa-1986": "consumer", "registration-1908": "property_land", "tpa-1882": "property_land", "rfctlarr-2013": "property_land", "laa-1894": "property_land", "rera-2016": "property_land",
    "limitation-1963": "contract_civil", "ica-1872": "contract_civil", "sra-1963": "contract_civil", "cpc-1908": "contract_civil",
}
HIGH_STAKES = r"\barrest|detain|detention|in custody|police (?:took|picked|came)|\bbail\b|threat|violence|beat(?:en|ing)|assault|abuse|harass|rape|suicide|kill|kidnap|missing|evict|dispossess|thrown out|demolish|deadline|last date|limitation (?:is )?(?:expir|end)|tomorrow|\bchild\b|minor\b|गिरफ्तार|जमानत|धमकी|हिंसा|मारपीट|बेदखल"
DATE = r"\b(\d{1,2})[./-](\d{1,2})[./-]((?:19|20)\d{2})\b"
#: The law that orders and rules belong to.
CIVIL_CODE = "cpc-1908"


def domain(text: Column, act_domain: Column | None = None) -> Column:
    """The domain of a named law, else that of most cues (of ties the first), else other."""
    low = F.lower(text)
    n = [F.regexp_count(low, F.lit(p)) for p in DOMAINS.values()]
    most = F.greatest(*n)
    pick = F.when(F.coalesce(most, F.lit(0)) == 0, "other")
    for name, k in zip(DOMAINS, n, strict=True):
        pick = pick.when(k == most, name)
    return pick if act_domain is None else F.coalesce(act_domain, pick)


def intent(text: Column) -> Column:
    """statute_lookup if a section or rule is named, else by the first cue, else explain."""
    low = F.lower(text)
    pick = F.when(text.rlike(SECTION) | text.rlike(ORDER_RULE), "statute_lookup")
    for name, p in INTENTS.items():
        pick = pick.when(low.rlike(p), name)
    return pick.otherwise("explain")


def order_rules(text: Column) -> Column:
    """References like O. XXXIX r. 1, digits as Roman numerals."""
    from folioscope.functions.text import roman

    orders, rules = (F.regexp_extract_all(text, F.lit(ORDER_RULE), F.lit(i)) for i in (1, 2))
    shaped = F.transform(orders, lambda o: F.when(o.rlike(r"^\d+$"), roman(F.try_to_number(o, F.lit("99")).cast("int"))).otherwise(F.upper(o)))
    return F.zip_with(shaped, rules, lambda o, r: F.concat(F.lit("O. "), o, F.lit(" r. "), F.upper(r)))


def event_years(text: Column, mentions: Column) -> Column:
    """Years 1950 to 2049 and dates (day first, as YYYY-MM-DD) outside the names of laws, sorted, each once."""
    bare = F.aggregate(mentions, text, lambda t, m: F.overlay(t, F.repeat(F.lit(" "), m["end"] - m["start"]), m["start"] + 1, m["end"] - m["start"]))
    years = F.regexp_extract_all(bare, F.lit(r"\b(19[5-9]\d|20[0-4]\d)\b"), F.lit(1))
    day, month, year = (F.regexp_extract_all(bare, F.lit(DATE), F.lit(i)) for i in (1, 2, 3))
    dates = F.transform(F.arrays_zip(year.alias("y"), month.alias("m"), day.alias("d")), lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0")))
    return F.array_sort(F.array_distinct(F.concat(years, dates)))


def high_stakes(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(HIGH_STAKES), F.lit(False))


def classified(questions: DataFrame, names: Names, key: str = "query_id", text: str = "question", act_domains: dict[str, str] | None = None, states: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """(key, question, mentions, domain, intent, acts, search_acts, rules, years, high_stakes, jurisdictions) of each question.

    The domain is that of the first named law that has one, else of most cues. states: (code, names); jurisdictions are the codes
    of those named, sorted. years also holds full dates.
    """
    d = with_mentions(questions.select(key, text), text, names)
    known = act_domains if act_domains is not None else ACT_DOMAINS
    of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    decided = F.get(F.array_compact(F.transform("mentions", lambda m: of[m["names"]])), F.lit(0)) if known else None
    acts = F.array_distinct(F.transform("mentions", lambda m: m["names"]))
    return d.select(
        key, text, "mentions", domain(F.col(text), decided).alias("domain"), intent(F.col(text)).alias("intent"), acts.alias("acts"),
        F.array_distinct(F.flatten(F.transform("mentions", lambda m: m["expands"]))).alias("search_acts"),
        order_rules(F.col(text)).alias("rules"), event_years(F.col(text), F.col("mentions")).alias("years"),
        high_stakes(F.col(text)).alias("high_stakes"), F.array_sort(matched(F.col(text), list(states))).alias("jurisdictions"),
    )


def pattern_of(term: str) -> str:
    """A term as a pattern: Latin words at word borders with blanks or hyphens between them, others as they are."""
    if re.search("[A-Za-z]", term):
        return r"(?i)\b" + r"[\s-]+".join(re.escape(w) for w in term.split()) + r"\b"
    return re.escape(term)


def matched(text: Column, entries: list[tuple[str, list[str]]]) -> Column:
    """Values of the entries (value, terms) one of whose terms the text holds, in the order of the entries, each once.

    For registers of fixed size: states and their codes, lay terms and their legal wording.
    """
    hits = [F.when(text.rlike("|".join(f"(?:{pattern_of(t)})" for t in terms)), F.lit(value)) for value, terms in entries if terms]
    return F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def rewritten(question: Column, phrases: Column) -> Column:
    """q (phrase; phrase), or q alone."""
    return F.when(F.size(phrases) > 0, F.concat(question, F.lit(" ("), F.array_join(phrases, "; "), F.lit(")"))).otherwise(question)
