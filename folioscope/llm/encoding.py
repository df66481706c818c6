"""Problem 7: text decoded with a wrong encoding.

Each record has a latent chain: none, one of the chains below (UTF-8 or Latin bytes read as another encoding, once or
twice), or a lossy one that left only substitutes. What a record shows for each chain is a log-likelihood ratio against
clean text; alone it may be weak (a single dash or accent). Expectation-maximisation per source and field finds how
common each chain is there, starting from the shares over all sources, so records of one source lend each other evidence.
Each record is then repaired by the chain of greatest posterior.

The evidence is per record and small, and EM only sees counts of (source, rounded evidence), so a source of any size is
a bounded group. Defined results: null, empty and clean texts are no cases and give no row; what substitutes replaced
stays as it is; a null source is a source of its own.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import mapped, types_of

#: Encodings as which UTF-8 was read, and as which one-byte Latin text was read.
UTF8_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "iso8859-2", "iso8859-15", "koi8-r")
LATIN_AS = ("cp437", "cp850", "mac_roman", "cp1251", "cp1250")
CHAINS = ("none", *[f"utf-8>{x}" for x in UTF8_AS], *[f"latin-1>{x}" for x in LATIN_AS], "lossy")
#: Characters that a repair may bring out: letters of the scripts in use and common marks.
PLAUSIBLE = re.compile("[\\x20-\\x7e\xa0-\xffŒœŠšŽžŸıİĞğŞş؀-ۿऀ-෿฀-๿、。〈-】，；：？！（）一-鿿぀-ヿ가-힣“”‘’„‚–—…•′″€™№‰‹›​-‏﻿₹αβγδ]+")
ACCENTS = "éèêëàâçôöîïùûüáãõíóúñÉÈÊÀÂÇÔÁÃÕÍÓÚºª°§£½»«"
#: Marks that clean text holds too.
MARKS = "“”‘’‚„–—…•™†‡°ºª§£½«»·©®¬¦\xad"
#: Natural logs: how much likelier a character of a readable sequence is under its chain than in clean text, one of an
#: unreadable sequence, and a substitute.
GAIN, MISS, LOST = 5.0, -7.0, 9.0


def _table(codec: str) -> list[str]:
    """The characters of bytes 128 to 255; an undefined byte stays a control character, as most readers keep it."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(None)
def _utf8(codec: str) -> tuple[re.Pattern, dict[int, str]]:
    t = _table(codec)
    of = lambda a, b: "[" + re.escape("".join(t[a - 0x80 : b - 0x80])) + "]"
    c = of(0x80, 0xC0)
    return re.compile(f"(?:{of(0xC2, 0xE0)}{c}|{of(0xE0, 0xF0)}{c}{c}|{of(0xF0, 0xF5)}{c}{c}{c})+"), {ord(x): chr(i + 0x80) for i, x in enumerate(t)}


@lru_cache(None)
def _latin(codec: str) -> dict[int, str]:
    """Characters that stand for accented Latin letters, without those usual in clean text."""
    t = _table(codec)
    back = {}
    for b in range(0xA0, 0x100):
        seen, meant = t[b - 0x80], bytes([b]).decode("cp1252")
        if seen != meant and meant in ACCENTS and seen not in MARKS:
            back[ord(seen)] = meant
    return back


@lru_cache(None)
def _odd(codec: str) -> re.Pattern:
    """What clean words don't hold: capitals after small letters, marks and other alphabets beside Latin letters."""
    seen = [chr(x) for x in _latin(codec)]
    upper = re.escape("".join(x for x in seen if x.isalpha() and x.isupper() and ord(x) < 0x250))
    other = re.escape("".join(x for x in seen if not x.isalpha() or ord(x) >= 0x250))
    parts = ([f"(?<=[a-z])[{upper}]"] if upper else []) + ([f"(?<=[A-Za-z])[{other}]|[{other}](?=[A-Za-z])"] if other else [])
    return re.compile("|".join(parts))


def _sequences(text: str, codec: str) -> tuple[str, int, int]:
    """(text with sequences read again as UTF-8, characters explained, sequences whose reading is implausible)."""
    pattern, back = _utf8(codec)
    good = bad = 0

    def again(m: re.Match) -> str:
        nonlocal good, bad
        try:
            s = m[0].translate(back).encode("latin-1").decode("utf-8")
        except UnicodeError:
            bad += 1
            return m[0]
        if not PLAUSIBLE.fullmatch(s):
            inner = _deeper(s)
            if inner is None:
                bad += 1
                return m[0]
        good += len(m[0])
        return s

    return pattern.sub(again, text), good, bad


def _deeper(s: str) -> str | None:
    """A second reading, when a first one still holds sequences of another layer."""
    for codec in ("cp1252", "latin-1"):
        pattern, back = _utf8(codec)
        if pattern.search(s):
            return codec
    return None


def _layered(text: str, codec: str) -> tuple[str, int, int]:
    """As often as there are layers, up to three; the first reading decides what is explained."""
    text, good, bad = _sequences(text, codec)
    for _ in range(2):
        if not good:
            break
        best = max((_sequences(text, c) for c in ("cp1252", "latin-1", codec)), key=lambda x: x[1] - 3 * x[2])
        if best[1] < 2 or best[2] * 3 > best[1]:
            break
        text = best[0]
    return text, good, bad


WORDY = re.compile(r"[^\W\d_]")
LOSSES = re.compile("\ufffd|(?<![^\\W\\d_])\\?{2,}|(?<=[^\\W\\d_])\\?{2,}(?=[^\\W\\d_]|\\s[a-zß-ÿ])|(?<=[^\\W\\d_])\\?(?=[a-zß-ÿ])|(?:(?<=\\s)|^)\\?(?=[a-zß-ÿ]{2})")
#: What can be part of a wrongly read text at all; rows without it are clean (checked in the JVM).
LEAD = "[Â-ô\u0080-\u009fĂ-ƒЀ-џҐґͰ-Ͽ∀-⋿─-▟†‡ˆ-˝‘-‡¬√]"
SUSPECT = f"�|[?][?]|[a-zß-ÿ][?][a-zß-ÿ]|[\\s][?][a-zß-ÿ]{{2}}|[\u0080-\u009f]|{LEAD}[^\\x00-\\x7fऀ-෿一-鿿؀-ۿ]|[Ͱ-ϿЀ-ӿ∀-⋿─-▟]|[a-z][À-ÝŠŒŽŸƒˆ-˝†-‰™]"


def evidence(text: str) -> tuple[np.ndarray, list[str | None]]:
    """Log-likelihood ratio of each chain against clean text, and the repaired text by chain."""
    llr, fixed = np.zeros(len(CHAINS)), [None] * len(CHAINS)
    for k, codec in enumerate(UTF8_AS, 1):
        out, good, bad = _layered(text, codec)
        if good:
            llr[k], fixed[k] = GAIN * good + MISS * bad, out
        else:
            llr[k] = -12
    for k, codec in enumerate(LATIN_AS, 1 + len(UTF8_AS)):
        back = _latin(codec)
        out = text.translate(back)
        odd = len(_odd(codec).findall(text)) if out != text else 0
        left = sum(1 for c in out if ord(c) > 0x36F and WORDY.match(c)) if odd else 0
        llr[k], fixed[k] = (3.5 * odd - 2.0 * left - 0.5, out) if odd else (-12.0, None)
    lost = sum(len(m[0]) for m in LOSSES.finditer(text))
    llr[-1] = LOST * min(lost, 4) if lost else -12
    if lost:
        fixed[-1] = text
        known = llr[1:-1].max()
        if known > 0:  # part of it can still be read again
            llr[1:-1] = np.where(llr[1:-1] == known, known + LOST, llr[1:-1])
    return np.maximum(llr - max(llr.max() - 30, 0), -12), fixed


def suspects(df: DataFrame, key: str, text: str, source: Column | str, field: Column | str) -> DataFrame:
    """(key, source, field, llr array<float>, fixed array<string>) of the records that aren't plainly clean."""
    made = df.select(F.col(key), F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("")).alias("source"), (F.col(field) if isinstance(field, str) else field).alias("field"), F.col(text).alias("_text"))
    made = made.where(F.col("_text").rlike(SUSPECT))

    def run(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        rows, llrs, best = [], [], []
        for i, t in enumerate(texts):
            llr, fixed = evidence(t or "")
            if llr[1:].max() > 0:
                rows.append(i)
                llrs.append(np.round(llr).tolist())
                best.append([x if y > 0 else None for x, y in zip(fixed, llr, strict=True)])
        return np.array(rows, np.int64), [pa.array(llrs, pa.list_(pa.float32())), pa.array(best, pa.list_(pa.string()))]

    return mapped(made, [key, "source", "field"], "_text", "llr array<float>, fixed array<string>", run)


def weights(found: DataFrame, totals: DataFrame, rounds: int = 20, pooled: float = 20.0) -> DataFrame:
    """(source, field, weight array<double>): shares of the chains by EM, drawn to the overall shares by `pooled` pseudo-records."""
    chains = len(CHAINS)
    # coarse evidence is enough for the shares, and keeps the kinds of records of a source few
    coarse = F.transform("llr", lambda x: (F.round(x / 3) * 3).cast("float"))
    counts = found.groupBy("source", "field", coarse.alias("llr")).agg(F.count("*").alias("n"))
    # each record's own best chain, over all sources, starts the shares
    top = F.expr("array_position(llr, array_max(llr)) - 1")
    overall = counts.groupBy(F.when(F.expr("array_max(slice(llr, 2, size(llr)))") > 2, top).otherwise(0).alias("chain")).agg(F.sum("n").alias("n"))
    start = overall.agg(F.map_from_entries(F.collect_list(F.struct("chain", "n"))).alias("m"))  # one entry per chain
    everything = totals.agg(F.sum("total").alias("everything"))
    joined = counts.join(totals, ["source", "field"]).crossJoin(start).crossJoin(everything)  # both are single rows

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        m, total, seen = dict(first["m"] or {}), float(first["total"]), float(pdf["n"].sum())
        prior = np.array([m.get(k, 0) + 0.5 for k in range(chains)], float)
        prior[0] += max(float(first["everything"]) - prior.sum(), 1)
        prior /= prior.sum()
        like = np.exp(np.stack(pdf["llr"].to_numpy()).astype(float))
        n, w = pdf["n"].to_numpy(float), prior.copy()
        for _ in range(rounds):
            post = like * w
            post *= (n / post.sum(axis=1))[:, None]
            w = post.sum(axis=0) + pooled * prior
            w[0] += max(total - seen, 0)
            w /= w.sum()
        return pd.DataFrame({"source": [first["source"]], "field": [first["field"]], "weight": [w.tolist()]})

    kinds = types_of(found, ["source", "field"])
    return joined.groupBy("source", "field").applyInPandas(em, f"{kinds}, weight array<double>")


def repaired(df: DataFrame, key: str, text: str, source: Column | str, field: Column | str = "field", staged=None) -> DataFrame:
    """(key, source, field, chain, posterior, text) of each record that is more likely damaged than not.

    `staged` writes the suspects once, as they are used three times.
    """
    found = suspects(df, key, text, source, field)
    found = staged(found) if staged else found
    src = F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("")).alias("source")
    fld = (F.col(field) if isinstance(field, str) else field).alias("field")
    totals = df.select(src, fld).groupBy("source", "field").agg(F.count("*").alias("total"))
    w = weights(found, totals)
    score = F.transform(F.arrays_zip("llr", "weight"), lambda x: F.exp(x["llr"].cast("double")) * x["weight"])
    both = found.join(w, ["source", "field"]).withColumn("score", score)
    damaged = both.withColumn("posterior", 1 - F.element_at("score", 1) / F.aggregate("score", F.lit(0.0), lambda a, x: a + x))
    best = F.expr("array_position(slice(score, 2, size(score)), array_max(slice(score, 2, size(score)))) + 1").cast("int")
    out = damaged.where("posterior > 0.5").withColumn("best", best)
    names = F.array(*[F.lit(x) for x in CHAINS])
    return out.select(key, "source", "field", F.element_at(names, F.col("best")).alias("chain"), "posterior", F.element_at("fixed", F.col("best")).alias("text"))
