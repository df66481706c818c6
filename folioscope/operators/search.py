"""Keyword and vector search for batches of questions.

Every input and output is a long table with a query id, so one question or ten thousand use the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.session import spread, staged

K1, B = 1.2, 0.75
#: Rows up to which the terms of a batch of questions are broadcast.
TERMS_BOUND = 500_000
#: Texts in a block of an index (at most 65,536), and terms of questions in one of theirs, about.
BLOCK, BLOCK_TERMS = 65_536, 20_000
#: Postings that are added while one text is looked up in a term's.
LOOKUP = 10
#: Phrases up to which each text is simply searched for all of them.
PHRASES = 200


def small(df: DataFrame, bound: int) -> DataFrame:
    """df with a broadcast hint if it has at most `bound` rows; else the optimizer joins by shuffle."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def terms_of(queries: DataFrame, query: str = "query_id", text: str = "question") -> DataFrame:
    """(query, term), the terms of a question as a set."""
    return queries.select(query, F.explode(tx.query_terms(text)).alias("term")).distinct()


def lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.size(tx.tokens(F.coalesce(F.col(text), F.lit("")))).alias("len"))


def postings(docs: DataFrame, key: str, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(key, len, term, tf); with `only` (term) just those terms, so that the index is cut before it is shuffled."""
    made = docs.select(key, tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    made = made.select(key, F.size("t").alias("len"), F.explode("t").alias("term"))
    if only is not None:
        made = made.join(small(only.select("term").distinct(), TERMS_BOUND), "term", "left_semi")
    return made.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def collection(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: number of texts and their mean length in tokens, before any filter."""
    return lengths(docs, key, text).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def bm25(
    queries: DataFrame, docs: DataFrame, key: str, text: str = "text", k: int | None = 10, where: Column | None = None, query: str = "query_id", question: str = "question", phrases: DataFrame | None = None,
    flags: dict[str, Column] | None = None, matched: bool = False, index: Index | None = None,
) -> DataFrame:
    """(query, key, score, rank): texts by BM25; a filter `where` over docs keeps the statistics of the whole collection.

    Ties by key. Texts without a term of the question don't come out; with k None all that have one do. The texts are indexed once
    in blocks; each block of questions meets all of them and passes on the k best of each question, so that neither the terms nor
    the questions reach the driver, however many there are. Only a batch with more than PHRASES different phrases is joined to the
    postings instead, as is one that wants all hits.

    phrases: (query, phrase), counted like terms where their tokens stand one after the other. flags: conditions on docs whose
    values come out with each hit. matched adds the number of the question's terms that the text holds. index: of the same docs, key
    and text, made before with these phrases; `where` and `flags` must then be among its flags, `where` by its name.
    """
    q = terms_of(queries, query, question)
    pairs, said = None, []
    if phrases is not None:
        pairs = phrases.select(query, F.array_join(tx.tokens("phrase"), " ").alias("phrase")).where("phrase != ''").distinct()
        said = index.wording if index else wording(phrases)
    one = q.groupBy("term").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*"), F.countDistinct(F.xxhash64("term"))).first()
    if k is None or len(said) > PHRASES or one[1] != one[2]:  # terms go to numpy as 64-bit hashes
        scored = _joined(q, docs, key, text, index.flags[where] if isinstance(where, str) else where, query, pairs)
        if matched:
            scored = scored.join(_held(q, docs, key, text, query), [query, key], "left").na.fill(0, ["matched"])
        if flags:
            scored = scored.join(docs.select(key, *[F.coalesce(c, F.lit(False)).alias(x) for x, c in flags.items()]), key).select(*scored.columns, *flags)
        return scored if k is None else top(scored, query, key, k)
    if index is None:
        named = {} if where is None else {"_where": where}
        index, where = indexed(docs, key, text, {**named, **(flags or {})}, said), None if where is None else "_where"
    return top(_scored(q, one[0] or 0, index, key, k, where, query, pairs, list(flags or ()), matched), query, key, k)


def bm25_of(queries: DataFrame, pairs: DataFrame, docs: DataFrame, key: str, text: str = "text", query: str = "query_id", question: str = "question") -> DataFrame:
    """(query, key, score): BM25 of the stated pairs (query, key, text), each once, with the statistics of all of docs.

    As `bm25` with k None, but only what a pair's text holds of its question's terms is multiplied out.
    """
    q = terms_of(queries, query, question)
    df = docs.select(F.explode(F.array_distinct(tx.tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = collection(docs, key, text)
    own = q.groupBy(query).agg(F.collect_list("term").alias("_q"))  # the terms of one question
    d = pairs.select(query, key, text).withColumn("_t", tx.tokens(F.coalesce(F.col(text), F.lit("")))).join(own, query)
    d = d.select(query, key, F.size("_t").alias("len"), F.explode(F.filter("_t", lambda t: F.array_contains("_q", t))).alias("term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return d.groupBy(query, key, "len", "term").agg(F.count("*").alias("tf")).join(df.crossJoin(F.broadcast(stats)), "term").groupBy(query, key).agg(F.round(F.sum(weight), 6).alias("score"))  # one row of statistics


def _held(q: DataFrame, docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(query, key, matched): how many terms of a question each text holds."""
    return q.join(postings(docs, key, text, q), "term").groupBy(query, key).agg(F.count("*").cast("int").alias("matched"))


def wording(phrases: DataFrame) -> list[str]:
    """The different phrases (phrase) as their tokens, in order, or PHRASES + 1 of them."""
    p = phrases.select(F.array_join(tx.tokens("phrase"), " ").alias("phrase")).where("phrase != ''").distinct()
    return sorted(r[0] for r in p.limit(PHRASES + 1).collect())


@dataclass
class Index:
    """Texts in blocks: a row each with the keys, lengths and flags of its texts and their postings by term. avg_len is of all texts."""

    blocks: DataFrame
    avg_len: float
    n: int
    flags: dict[str, Column]
    wording: list[str]


def indexed(docs: DataFrame, key: str, text: str = "text", flags: dict[str, Column] | None = None, wording: list[str] = ()) -> Index:
    """The texts are read and split once; the index lies in the shared folder. Stop words, which no question asks for, have no postings.

    wording: phrases, at most PHRASES; they are terms with a blank in front.
    """
    flags, wording = flags or {}, list(wording)
    spark = docs.sparkSession
    hashed = lambda xs: np.array([r[0] for r in spark.createDataFrame([(x,) for x in xs], "t string").select(F.xxhash64("t")).collect()], np.int64)
    stops, said = np.sort(hashed(tx.STOPWORDS)), hashed([f" {p}" for p in wording]) if wording else np.zeros(0, np.int64)
    words = tx.tokens(F.coalesce(F.col(text), F.lit("")))
    made = spread(docs.select(key, text, *[F.coalesce(c, F.lit(False)).alias(f"_flag{i}") for i, c in enumerate(flags.values())]))
    own = [f"_flag{i}" for i in range(len(flags))]
    ready = made.select(key, words.alias("_w"), *own)
    if wording:
        ready = ready.select(key, "_w", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_f"), *own)  # made once, not once a phrase
    count = lambda p: F.when(F.contains("_f", F.lit(f" {p} ")), F.regexp_count("_f", F.lit(f"(?<= ){re.escape(p)}(?= )"))).otherwise(0)
    held = F.array(*[count(p) for p in wording]) if wording else F.array().cast("array<int>")
    ready = ready.select(key, F.transform("_w", lambda t: F.xxhash64(t)).alias("t"), held.alias("p"), *own)
    most = BLOCK

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        tokens = [b.column(1) for b in parts]
        length = np.concatenate([np.diff(t.offsets.to_numpy()) for t in tokens])
        ids = np.concatenate([t.flatten().to_numpy(zero_copy_only=False) for t in tokens]).astype(np.int64, copy=False)
        n = len(length)
        doc = np.repeat(np.arange(n), length)
        keep = stops[np.minimum(np.searchsorted(stops, ids), len(stops) - 1)] != ids
        ids, doc = ids[keep], doc[keep]
        if len(said):
            c = np.concatenate([b.column(2).flatten().to_numpy() for b in parts]).reshape(n, -1)
            d, p = np.nonzero(c)
            ids, doc = np.concatenate((ids, np.repeat(said[p], c[d, p]))), np.concatenate((doc, np.repeat(d, c[d, p])))
        terms, at = np.unique(ids, return_inverse=True)
        cell, tf = np.unique(at * n + doc, return_counts=True)
        bits = np.zeros(n, np.uint8)
        for i in range(len(own)):
            bits |= np.concatenate([b.column(3 + i).to_numpy(zero_copy_only=False) for b in parts]).astype(np.uint8) << i
        keys = pa.concat_arrays([b.column(0) for b in parts])
        sent = (length.astype(np.int32), bits, terms, np.bincount(cell // n, minlength=len(terms)).astype(np.int32), (cell % n).astype(np.uint16), tf.astype(np.uint8 if tf.max(initial=0) < 256 else np.int32))
        cells = [pa.array([n], pa.int32()), pa.array([int(length.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys), *[pa.array([x.tobytes()], pa.binary()) for x in sent]]
        return pa.RecordBatch.from_arrays(cells, ["n", "total", "keys", "len", "bits", "terms", "df", "docs", "tf"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            while b.num_rows:
                head, b = b.slice(0, most - n), b.slice(most - n)
                parts.append(head)
                n += head.num_rows
                if n == most:
                    yield block(parts)
                    parts, n = [], 0
        if parts:
            yield block(parts)

    k_type = docs.schema[key].dataType.simpleString()
    blocks = staged(ready.mapInArrow(build, f"n int, total bigint, keys array<{k_type}>, len binary, bits binary, terms binary, df binary, docs binary, tf binary"), "index")
    n, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Index(blocks, float(total / n) if n and total else 1.0, n, flags, wording)


def _phrase_postings(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, len, phrase, tf) of the phrases in names (phrase, their tokens with blanks between)."""
    p = names.select("phrase").distinct()
    p = p.withColumn("term", F.element_at(F.sort_array(F.transform(F.split("phrase", " "), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"])
    d = docs.select(key, tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    d = d.select(key, F.size("_t").alias("len"), F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).alias("_f"), F.explode(F.array_distinct("_t")).alias("term"))
    held = d.join(small(p, TERMS_BOUND), "term").where(F.contains("_f", F.concat(F.lit(" "), "phrase", F.lit(" "))))
    return held.select(key, "len", "phrase", F.regexp_count("_f", F.concat(F.lit("(?<= )\\Q"), "phrase", F.lit("\\E(?= )"))).cast("bigint").alias("tf"))


def _joined(q: DataFrame, docs: DataFrame, key: str, text: str, where: Column | None, query: str, pairs: DataFrame | None = None) -> DataFrame:
    p = postings(docs, key, text, q)
    if pairs is not None:
        # phrases are terms with a blank in front
        p = p.unionByName(_phrase_postings(docs, key, text, pairs).withColumn("phrase", F.concat(F.lit(" "), "phrase")).withColumnRenamed("phrase", "term"))
        q = q.unionByName(pairs.select(query, F.concat(F.lit(" "), "phrase").alias("term")))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    stats = collection(docs, key, text)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weights = q.join(small(df.crossJoin(stats), TERMS_BOUND), "term")  # one row of statistics
    if where is not None:
        p = p.join(docs.where(where).select(key), key, "left_semi")
    return p.join(weights, "term").groupBy(query, key).agg(F.round(F.sum(weight), 6).alias("score"))


def _scored(q: DataFrame, rows: int, index: Index, key: str, k: int, where: str | None, query: str, pairs: DataFrame | None, flags: list[str], matched: bool) -> DataFrame:
    """(query, key, score, …): of all blocks of texts that a task reads the k best of each question, and those equal to the last.

    rows: terms of questions. A question's terms are taken from the rarest on. Once what the rest can add is less than the score of
    the k-th best so far, the rest is only looked up for texts that hold an earlier term.
    """
    spark, cores = q.sparkSession, q.sparkSession.sparkContext.defaultParallelism

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, c in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t.as_buffer(), np.int64)), pa.array(np.frombuffer(c.as_buffer(), np.int32).astype(np.int64))], ["h", "df"])

    asked = q.select(query, F.xxhash64("term").alias("h"), F.lit(False).alias("said"))
    if pairs is not None:
        asked = asked.unionByName(pairs.select(query, F.xxhash64(F.concat(F.lit(" "), "phrase")).alias("h"), F.lit(True).alias("said")))
    df = index.blocks.select("terms", "df").mapInArrow(counted, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df"))
    lists = asked.join(df, "h").groupBy(query).agg(F.array_sort(F.collect_list(F.struct("df", "h", "said"))).alias("terms"))  # the terms of one question
    n_blocks = max(1, -(-rows // BLOCK_TERMS))
    n_blocks = n_blocks if n_blocks == 1 else -(-n_blocks // cores) * cores
    blocks = lists.groupBy(F.pmod(F.xxhash64(query), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(F.col(query).alias("q"), "terms")).alias("qs"))  # about BLOCK_TERMS terms
    blocks = staged(blocks, "asked").repartitionByRange(n_blocks, "block")
    parts = 1 if n_blocks >= cores else -(-2 * cores // n_blocks)
    columns = ["keys", "len", "bits", "terms", "df", "docs", "tf"]
    both = index.blocks.select(*columns).coalesce(parts).crossJoin(blocks.hint("shuffle_replicate_nl"))  # each block of questions stays while the texts pass
    q_type, k_type = q.schema[query].dataType.simpleString(), index.blocks.schema["keys"].dataType.elementType.simpleString()
    n, avg, names = index.n, index.avg_len, list(index.flags)
    open_, bits = (None if where is None else 1 << names.index(where)), [1 << names.index(x) for x in flags]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Asked] = {}
        k_arrow = None
        for b in batches:
            for i in range(b.num_rows):
                at = b.column(7)[i].as_py()
                if at not in held:
                    held[at] = Asked(b.column(8)[i].values, n, k)
                keys = b.column(0)[i].values
                k_arrow = keys.type
                sent = [np.frombuffer(b.column(j)[i].as_buffer(), kind) for j, kind in enumerate((np.int32, np.uint8, np.int64, np.int32, np.uint16), 1)]
                tf = b.column(6)[i].as_buffer()
                held[at].meet(keys, *sent, np.frombuffer(tf, np.uint8 if len(tf) == len(sent[4]) else np.int32), avg, open_)
        for x in held.values():
            if (got := x.best()) is not None:
                who, kept, scores, held_terms, flagged = got
                out = [x.names.take(pa.array(who)), kept if isinstance(kept, pa.Array) else pa.array(kept.tolist(), k_arrow), pa.array(scores)]
                out += [pa.array(held_terms)] * matched + [pa.array((flagged & bit) > 0) for bit in bits]
                yield pa.RecordBatch.from_arrays(out, [query, key, "score", *["matched"] * matched, *flags])

    kinds = f"`{query}` {q_type}, `{key}` {k_type}, score double" + ", matched int" * matched + "".join(f", `{x}` boolean" for x in flags)
    return both.mapInArrow(score, kinds)


class Asked:
    """A block of questions, and the best texts of each so far."""

    def __init__(self, rows: pa.StructArray, n: int, k: int):
        self.names, lists = rows.field(0), rows.field(1)
        self.ends = lists.offsets.to_numpy().astype(np.int64)
        self.ends -= self.ends[0]
        flat = lists.flatten()
        df = flat.field(0).to_numpy().astype(float)
        self.hashes, self.said = flat.field(1).to_numpy(), flat.field(2).to_numpy(zero_copy_only=False).astype(bool)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.k, self.least = k, np.zeros(len(lists))
        self.kept: list[list[np.ndarray] | None] = [None] * len(lists)

    def meet(self, keys: pa.Array, length: np.ndarray, bits: np.ndarray, terms: np.ndarray, df: np.ndarray, docs: np.ndarray, tf: np.ndarray, avg: float, open_: int | None) -> None:
        if not len(terms):
            return
        m = len(length)
        place = np.minimum(np.searchsorted(terms, self.hashes), len(terms) - 1)
        there = terms[place] == self.hashes
        idf = np.zeros(len(terms))
        idf[place[there]] = self.idf[there]
        # postings of asked terms alone, and of texts that pass the filter
        by = np.repeat(np.arange(len(terms)), df)
        use = idf[by] > 0
        if open_ is not None:
            use &= ((bits & open_) > 0)[docs]
        by, docs, tf = by[use], docs[use].astype(np.intp), tf[use]
        if not len(docs):
            return
        first = np.searchsorted(by, np.arange(len(terms) + 1))
        weight = idf[by] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[docs] / avg))
        light = weight.astype(np.float32)
        most = np.zeros(len(terms))
        full = np.nonzero(np.diff(first))[0]
        most[full] = np.maximum.reduceat(weight, first[full])
        start, stop = first[place], np.where(there, first[place + 1], first[place])
        # what a question's terms from each on can add at most, and how far sums of single precision may be off
        most = np.where(there, most[place], 0.0)
        run = np.concatenate(([0.0], np.cumsum(most)))
        n_terms = np.diff(self.ends)
        of = np.repeat(np.arange(len(self.least)), n_terms)
        rest = run[self.ends[1:]][of] - run[:-1]
        near = 2e-6 + (run[self.ends[1:]] - run[self.ends[:-1]]) * (n_terms + 4) * 2e-7
        needed = np.concatenate(([0], np.cumsum(rest > (self.least - near)[of])))
        needed = (needed[self.ends[1:]] - needed[self.ends[:-1]]).tolist()
        ends, start, stop, rest, least, near = self.ends.tolist(), start.tolist(), stop.tolist(), np.concatenate((rest, [0.0])).tolist(), self.least.tolist(), near.tolist()
        total, add = np.zeros(m, np.float32), np.add.at
        whose, found = [], []
        for i, p in enumerate(needed):
            if not p:
                continue
            a, e, low, j = ends[i], ends[i + 1], least[i] - near[i], ends[i]
            d = None
            while j < e:
                if j >= a + p:  # the rest is looked up where that is less work than adding it
                    d = np.flatnonzero(total > max(low - rest[j], 0.0)) if d is None else d
                    if LOOKUP * len(d) * (e - j) < sum(stop[x] - start[x] for x in range(j, e)):
                        break
                add(total, docs[start[j] : stop[j]], light[start[j] : stop[j]])
                j += 1
            if d is None:
                d = np.flatnonzero(total > max(low, 0.0))
            s = total[d]
            if j == e:
                on = s > max(low, 0.0)
                d, s = d[on], s[on]
            total.fill(0.0)
            for x in range(j, e):
                if not len(d):
                    break
                if start[x] < stop[x]:
                    own = docs[start[x] : stop[x]]
                    at = np.minimum(np.searchsorted(own, d), len(own) - 1)
                    s = s + np.where(own[at] == d, light[start[x] : stop[x]][at], np.float32(0))
                    on = s > low - (rest[x + 1] if x + 1 < e else 0.0)
                    d, s = d[on], s[on]
            if len(s) > self.k:
                d = d[s >= np.partition(s, -self.k)[-self.k] - 2 * near[i]]
            if len(d):
                whose.append(i)
                found.append(d)
        if not whose:
            return
        # the scores of those in double precision, term by term, and how many terms they hold; the postings are in the order of the cells
        d, sizes = np.concatenate(found), np.array([len(x) for x in found])
        cells = by * m + docs
        who = np.repeat(whose, sizes)
        row = np.repeat(np.arange(len(d)), n_terms[who])
        term = np.arange(len(row)) - np.repeat(np.cumsum(n_terms[who]) - n_terms[who], n_terms[who]) + self.ends[:-1][who][row]
        asked = place[term] * m + d[row]
        order, at = np.argsort(asked), np.zeros(len(asked), np.intp)  # in order, as near places are looked up faster
        at[order] = np.minimum(np.searchsorted(cells, asked[order]), len(cells) - 1)
        hit = (cells[at] == asked) & there[term]
        s = np.round(np.bincount(row[hit], weight[at[hit]], len(d)), 6)
        on = s >= self.least[who]
        hit &= ~self.said[term]
        held = np.bincount(row[hit], minlength=len(d)).astype(np.int32)[on]
        d, s, who = d[on], s[on], who[on]
        if not len(d):
            return
        whose, at = np.unique(who, return_index=True)
        sizes, scores = np.diff([*at, len(d)]), np.split(s, at[1:])
        kept = keys.take(pa.array(d))
        kept = kept.to_numpy(zero_copy_only=False) if pa.types.is_integer(kept.type) and not kept.null_count else np.array([*kept.to_pylist(), None], object)[:-1]
        flagged, at = bits[d], 0
        for i, s, size in zip(whose.tolist(), scores, sizes.tolist(), strict=True):
            new = [s, kept[at : at + size], held[at : at + size], flagged[at : at + size]]
            at += size
            if self.kept[i] is not None:
                new = [np.concatenate(x) for x in zip(self.kept[i], new, strict=True)]
            if len(new[0]) >= self.k:
                self.least[i] = np.partition(new[0], -self.k)[-self.k]
                if len(new[0]) > self.k:
                    on = new[0] >= self.least[i]
                    new = [x[on] for x in new]
            self.kept[i] = new

    def best(self) -> tuple | None:
        own = [(i, x) for i, x in enumerate(self.kept) if x is not None]
        if not own:
            return None
        who = np.repeat([i for i, _ in own], [len(x[0]) for _, x in own])
        scores, kept, held, flagged = (np.concatenate([x[j] for _, x in own]) for j in range(4))
        return who, pa.array(kept) if kept.dtype != object else kept, scores, held, flagged


def top(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best by score, then key, with their rank; each partition keeps k per query before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrases(docs: DataFrame, names: DataFrame, key: str, name: str, text: str = "text") -> DataFrame:
    """(name, key): texts that hold the tokens of the phrase one after the other, stop words too."""
    flat = F.concat(F.lit(" "), F.array_join(tx.tokens(text), " "), F.lit(" "))
    p = names.select(name, F.concat(F.lit(" "), F.array_join(tx.tokens(name), " "), F.lit(" ")).alias("_p")).where("trim(_p) != ''").distinct()
    few = p.limit(PHRASES + 1).collect()
    if len(few) <= PHRASES:
        held = F.array(*[F.struct(F.lit(r[name]).alias("name"), F.lit(r["_p"]).alias("p")) for r in few]) if few else F.array().cast("array<struct<name:string,p:string>>")
        d = docs.where(F.col(text).isNotNull()).select(key, flat.alias("_t"))
        return d.select(F.explode(F.filter(held, lambda x: F.contains(F.col("_t"), x["p"]))).alias("_x"), key).select(F.col("_x.name").alias(name), key)
    # a phrase is looked for only in texts that hold its longest token
    p = p.withColumn("term", F.element_at(F.sort_array(F.transform(F.split(F.trim("_p"), " "), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"])
    d = docs.where(F.col(text).isNotNull()).select(key, flat.alias("_t"), F.explode(F.array_distinct(tx.tokens(text))).alias("term"))
    return d.join(small(p, TERMS_BOUND), "term").where(F.col("_t").contains(F.col("_p"))).select(name, key)


def _blocks(df: DataFrame, key: str, vector: str, size: int, names: tuple[str, str, str]) -> DataFrame:
    n = max(1, -(-df.count() // size))
    b = df.where(F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(names[0]))
    return b.agg(F.collect_list(key).alias(names[1]), F.collect_list(vector).alias(names[2]))  # about `size` rows each


def dense(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", query_block: int = 512, block: int = 4096) -> DataFrame:
    """(query, key, rank, score): exact inner products, block against block in numpy; each pair of blocks keeps its k best.

    Scores are rounded to six places before ties are broken by key.
    """
    q = _blocks(queries, query, vector, query_block, ("_qb", "_qi", "_qv"))
    d = _blocks(docs, key, vector, block, ("_db", "_di", "_dv"))
    pairs = d.crossJoin(q)  # blocks of the stated queries, not rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                qi, di = np.array(r["_qi"]), np.array(r["_di"])
                s = np.round(np.array(r["_qv"], np.float64) @ np.array(r["_dv"], np.float64).T, 6)
                order = np.lexsort((np.broadcast_to(di, s.shape), -s), axis=1)[:, :k]
                m = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, m)), pa.array(di[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], [query, key, "score"])

    kinds = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {docs.schema[key].dataType.simpleString()}, score double"
    return top(pairs.select("_qi", "_qv", "_di", "_dv").mapInArrow(best, kinds), query, key, k)


def filtered_after(hits: DataFrame, allowed: DataFrame, key: str, k: int, query: str = "query_id") -> DataFrame:
    """Over-fetched hits that are allowed, ranked again, the first k; what the over-fetch missed isn't made up for."""
    w = Window.partitionBy(query).orderBy("rank")
    kept = hits.join(allowed.select(key).distinct(), key, "left_semi").withColumn("new", F.row_number().over(w)).where(F.col("new") <= k)
    return kept.withColumn("rank", F.col("new")).drop("new")


def quota(hits: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first `limit` hits of each list, ranked from 1."""
    w = Window.partitionBy(query).orderBy("rank")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).withColumn("rank", F.col("_r")).drop("_r")
