"""Queries that run whole pipelines: classification, retrieval, answers, checks, packing, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import citations, exact, passages, registry
from folioscope.plans import answer as plan
from folioscope.plans.retrieve import retrieve
from folioscope.queries.search import _chunks, _questions
from folioscope.session import scratch, table
from folioscope.streaming import ledger as stream


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The questions of the stored results, which name laws and sections."""
    return table(spark, sf, "phase1_acceptance").where("question is not null").select(F.col("result_id").cast("string").alias("query_id"), "question")


def act_mentions(spark: SparkSession, sf: str) -> DataFrame:
    d = registry.with_mentions(_asked(spark, sf), "question", registry.names_of(table(spark, sf, "statutes")))
    return d.select("query_id", F.explode("mentions").alias("m")).select("query_id", "m.names", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"))


def classify_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf)
    return q.select("query_id", registry.domain(F.col("question")).alias("domain"), registry.intent(F.col("question")).alias("intent"))


def section_refs(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf).select("query_id", F.col("seq").cast("bigint").alias("seq"), "act", "section", "sub")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    d = registry.with_mentions(_asked(spark, sf), "question", registry.names_of(table(spark, sf, "statutes")))
    return registry.section_refs(d, "query_id", "question")


def section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    none = _asked(spark, sf).select("query_id", F.lit(None).cast("string").alias("only"))
    pins, _ = exact.section_lookup(_refs(spark, sf), none, table(spark, sf, "statutes"), _chunks(spark, sf), F.lit(True))
    return pins.select("query_id", "chunk", F.col("pin").cast("bigint").alias("pin"))


def _full(spark: SparkSession, sf: str):
    return retrieve(_asked(spark, sf), _chunks(spark, sf), table(spark, sf, "statutes"), "full")


def retrieve_full(spark: SparkSession, sf: str) -> DataFrame:
    return _full(spark, sf).candidates.select("query_id", "chunk", "fused", "rerank", "final", "score", F.col("pin").isNotNull().alias("pinned"))


def retrieve_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _full(spark, sf).gate


def lookup_notes(spark: SparkSession, sf: str) -> DataFrame:
    return _full(spark, sf).notes


def _blocks(spark: SparkSession, sf: str):
    r = _full(spark, sf)
    c = _chunks(spark, sf)
    slim = r.candidates.select("query_id", "chunk", "fused", "final", "doc_type", "token_count")
    return r, plan.context(slim, c.drop("doc_type", "token_count").join(c.select("chunk", "doc_type", "token_count"), "chunk"))


def answer_context(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf)[1].select("query_id", "sid", "chunk", "label", "header")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    r, blocks = _blocks(spark, sf)
    return plan.answered(r.gate, blocks, registry.names_of(table(spark, sf, "statutes")))


def citation_cards(spark: SparkSession, sf: str) -> DataFrame:
    return plan.cards(_blocks(spark, sf)[1]).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("verbatim").alias("n_verbatim"))


def checked_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Stored answers against all chunks of the sections they cite."""
    a = table(spark, sf, "phase1_acceptance").where("answer_markdown is not null")
    cited = a.select("result_id", F.explode_outer("cited").alias("c")).select("result_id", "c.act", "c.section")
    c = _chunks(spark, sf).where("doc_type = 'statute'").select(F.col("act_title").alias("act"), "section", "chunk", "doc_type", "status", "successor", *citations.FIELDS)
    src = cited.distinct().join(c, ["act", "section"]).withColumn("sid", F.row_number().over(Window.partitionBy("result_id").orderBy("chunk")))  # all chunks of the cited sections
    s = table(spark, sf, "statutes")
    done = citations.validate(a.select("result_id", "answer_markdown"), src, "result_id", "answer_markdown", registry.names_of(s))
    d = citations.warnings(done, citations.repealed(done, src, s, "result_id"))
    joined = [F.array_join(c, "|").alias(c) for c in ("used", "unknown", "quotes", "authorities")]
    return d.select("result_id", *joined, F.size("removed").cast("bigint").alias("n_removed"), F.col("unsupported").cast("bigint").alias("unsupported"), F.round("unsupported_share", 6).alias("unsupported_share"), F.size("warnings").cast("bigint").alias("n_warnings"), F.length("text").cast("bigint").alias("n_text"))


def unsupported_share(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the stored answers with five words or more, and those without a mark."""
    a = table(spark, sf, "phase1_acceptance").where("answer_markdown is not null").select("result_id", F.explode(F.split("answer_markdown", "\n+")).alias("line"))
    d = a.where(F.regexp_count("line", F.lit(r"\w+")) >= 5)
    return d.groupBy("result_id").agg(F.count("*").alias("n"), F.count_if(~F.col("line").rlike(r"\[S\d+\]")).alias("bare"))


def quote_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the quotations of chunks stand in another chunk of their document as well."""
    c = _chunks(spark, sf).where("text is not null").select("doc_id", "chunk", tx.straight("text").alias("t"))
    q = c.select("doc_id", "chunk", F.explode(F.regexp_extract_all("t", F.lit('"([^"]{15,})"'), F.lit(1))).alias("quote")).distinct()
    other = c.select("doc_id", F.col("chunk").alias("other"), F.col("t").alias("u"))
    d = q.join(other, "doc_id").where("chunk != other").where(F.contains("u", "quote"))
    return q.join(d.select("chunk", "quote").distinct().withColumn("hit", F.lit(1)), ["chunk", "quote"], "left").groupBy("chunk").agg(F.count("*").alias("quotes"), F.count("hit").alias("elsewhere"))


def pack_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each chunk packed under fifty words."""
    c = _chunks(spark, sf).where("text is not null").select("chunk", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) != ''")
    return passages.packed(c, "chunk", "line_no", "line", 50).select("chunk", F.col("piece").cast("bigint").alias("piece"), F.col("n").cast("bigint").alias("n"))


def upload_passages(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf).where("text is not null").select(F.col("chunk").cast("string").alias("doc_id"), F.coalesce("page_start", F.lit(1)).alias("page"), (F.col("text_source") == "ocr").alias("ocr"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return passages.upload_passages(c).select("doc_id", "n", "locator", "words")


def upload_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of the first document that each question's best chunk comes from, under a budget."""
    from folioscope.operators.search import bm25

    q = _questions(spark, sf)
    best = bm25(q, _chunks(spark, sf), "chunk", k=1).join(_chunks(spark, sf).select("chunk", "doc_id"), "chunk")
    task = best.join(q, "query_id").select("query_id", "question", F.col("doc_id").cast("string").alias("doc_id"))
    p = _chunks(spark, sf).where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk").alias("n"), "text", tx.word_count("text").alias("words"))
    return plan.selected_passages(p, task, 300, 0).select("query_id", "doc_id", "n")


def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger as a stream, upserted batch by batch: the last row of each url."""
    m = table(spark, sf, "manifest").select("url", "seq", "sha256", "bytes")
    where = scratch(spark, "stream")
    m.repartitionByRange(3, "seq").write.parquet(f"{where}/in")
    source = stream.read(spark, f"{where}/in", m.schema, files_per_batch=1)
    q = stream.follow(source, stream.upsert(f"{where}/out", "url", "seq"), f"{where}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("part")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of events in event time."""
    e = table(spark, sf, "events").select("ts", "event_type", "value", "event_id")
    where = scratch(spark, "windows")
    e.write.parquet(f"{where}/in")
    source = stream.read(spark, f"{where}/in", e.schema)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out")

    q = stream.windows(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (act_mentions, classify_questions, section_refs, section_lookup, retrieve_full, retrieve_gate, lookup_notes, answer_context, answers, citation_cards, checked_answers, unsupported_share, quote_verbatim, pack_passages, upload_passages, upload_selection, stream_ledger, stream_windows)
}


def _classify() -> str:
    q = lambda s: s.replace("'", "''")
    n = ", ".join(f"len(regexp_extract_all(lower(question), '{q(p)}'))" for p in registry.DOMAINS.values())
    names = ", ".join(f"'{x}'" for x in registry.DOMAINS)
    intents = " ".join(f"WHEN regexp_matches(lower(question), '{q(p)}') THEN '{k}'" for k, p in registry.INTENTS.items())
    return (
        f"WITH g AS (SELECT id AS query_id, min(question) AS question FROM gold GROUP BY 1), k AS (SELECT *, [{n}] AS k FROM g) "
        f"SELECT query_id, CASE WHEN list_max(k) = 0 THEN 'other' ELSE [{names}][list_position(k, list_max(k))] END AS domain, "
        f"CASE WHEN regexp_matches(question, '{q(registry.SECTION)}') OR regexp_matches(question, '{q(registry.ORDER_RULE)}') THEN 'statute_lookup' {intents} ELSE 'explain' END AS intent FROM k"
    )


_FLAT = "lower(trim(regexp_replace(translate(@, '“”‘’', '\"\"'''''), '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')))"


def _checked() -> str:
    """Sentences by splitting at every stop and joining again what an abbreviation parted; all checks by regular expression."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    short = "|".join(a.replace(".", "\\.") for a in citations.ABBREVIATIONS)
    said = " || ' ' || ".join(f"coalesce({f}, '')" for f in citations.FIELDS)
    numbers = "list_transform(flatten(list_transform(regexp_extract_all(@, " + q(citations.SECTIONS) + ", 1), lambda x: regexp_extract_all(regexp_replace(x, '\\([^)]*\\)', '', 'g'), '\\d{1,3}[A-Za-z]{0,2}'))), lambda x: upper(x))"
    common = "[" + ", ".join(q(w) for w in citations.COMMON_PARTIES) + "]"
    word = f"list_filter(regexp_extract_all(lower(@), '[a-z]{{3,}}'), lambda w: NOT list_contains({common}, w))[1]"
    reports = " + ".join(f"len(list_filter(regexp_extract_all(s, {q(p)}), lambda x: NOT contains(regexp_replace(said, '[^0-9a-z]', '', 'g'), regexp_replace(lower(x), '[^0-9a-z]', '', 'g'))))" for p in citations.REPORTS)
    claims = ", ".join(q(c) for c in citations.CLAIMS)
    return f"""WITH a AS (SELECT result_id, regexp_replace(regexp_replace(answer_markdown, '(?i)[ \t]*\\[(?:\\s*(?:none|n/?a|nil)\\s*)?\\]', '', 'g'), '\\[\\s*[Ss]\\s*0*(\\d{{1,3}})\\s*\\]', '[S\\1]', 'g') AS t FROM phase1_acceptance WHERE answer_markdown IS NOT NULL),
c AS (SELECT DISTINCT result_id, x.act, x.section FROM (SELECT result_id, unnest(cited) AS x FROM phase1_acceptance)),
src AS (SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY "rowid") AS sid, {_FLAT.replace('@', said)} AS said, {_FLAT.replace('@', "coalesce(text, '')")} AS body, list_distinct(list_concat(CASE WHEN k.section IS NULL THEN [] ELSE [upper(k.section)] END, {numbers.replace('@', "coalesce(text, '')")})) AS nums, status FROM c JOIN chunks k ON k.act_title = c.act AND k.section = c.section AND k.doc_type = 'statute'),
m AS (SELECT result_id, t, unnest(regexp_extract_all(t, '\\[S(\\d+)\\]', 1))::BIGINT AS sid, generate_subscripts(regexp_extract_all(t, '\\[S(\\d+)\\]', 1), 1) AS pos FROM a),
u AS (SELECT result_id, string_agg('S' || sid, '|' ORDER BY pos) AS unknown, list('[S' || sid || ']') AS gone FROM m ANTI JOIN src USING (result_id, sid) GROUP BY 1),
b AS (SELECT result_id, coalesce(unknown, '') AS unknown, list_reduce(list_prepend(t, coalesce(gone, [])), lambda x, y: replace(x, y, '')) AS t FROM a LEFT JOIN u USING (result_id)),
p AS (SELECT result_id, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM (SELECT result_id, string_split(regexp_replace(regexp_replace(t, '(\n+)', '\\1' || chr(1), 'g'), '([.!?])([ \t]+)([A-Z“"(\\[*-])', '\\1\\2' || chr(1) || '\\3', 'g'), chr(1)) AS w FROM b)),
g AS (SELECT *, sum(CASE WHEN regexp_matches(coalesce(before, ''), '(?:^|[^\\pL\\pN_])(?:{short}|[A-Z])\\.[ \t]+$') THEN 0 ELSE 1 END) OVER (PARTITION BY result_id ORDER BY i) AS n FROM (SELECT *, lag(p) OVER (PARTITION BY result_id ORDER BY i) AS before FROM p)),
s0 AS (SELECT result_id, n, string_agg(p, '' ORDER BY i) AS p FROM g GROUP BY 1, 2),
s AS (SELECT result_id, n, regexp_replace(p, '\\s+$', '') AS s, regexp_extract(p, '\\s*$') AS gap, list_transform(regexp_extract_all(p, '\\[S(\\d+)\\]', 1), lambda x: x::BIGINT) AS sids FROM s0),
pool AS (SELECT s.result_id, n, string_agg(said, ' ' ORDER BY coalesce(list_position(sids, sid), 0), sid) AS said, string_agg(body, ' ' ORDER BY coalesce(list_position(sids, sid), 0), sid) AS body, flatten(list(nums)) AS nums FROM s JOIN src ON src.result_id = s.result_id AND (len(sids) = 0 OR list_contains(sids, sid)) GROUP BY 1, 2),
j AS (SELECT s.*, coalesce(said, '') AS said, coalesce(body, '') AS body, coalesce(nums, []) AS nums, regexp_extract_all(s, {q(citations.QUOTED)}, 1) AS qs FROM s LEFT JOIN pool USING (result_id, n)),
k AS (SELECT *, list_filter(qs, lambda x: NOT regexp_matches(body, '(?s)' || list_aggregate(list_transform(list_filter(list_transform(regexp_split_to_array(x, '\\s*(?:\\.\\s?\\.\\s?\\.|…)\\s*'), lambda y: trim({_FLAT.replace('@', "y")}, ' .,;:')), lambda y: y <> ''), lambda y: regexp_escape(y)), 'string_agg', '.*'))) AS bad,
  list_concat(list_transform(list_filter({numbers.replace('@', "s")}, lambda x: NOT list_contains(nums, x)), lambda x: 'section ' || x),
    list_transform(list_filter(regexp_extract_all(s, {q(citations.ORDER)}, 1), lambda x: NOT contains(said, 'order ' || lower(x)) AND NOT contains(said, 'o. ' || lower(x))), lambda x: 'Order ' || x),
    list_transform(list_filter(list_zip(regexp_extract_all(s, {q(citations.CASE)}, 1), regexp_extract_all(s, {q(citations.CASE)}, 2)), lambda x: coalesce(NOT contains(said, {word.replace('@', "x[1]")}), false) OR coalesce(NOT contains(said, {word.replace('@', "x[2]")}), false)), lambda x: x[1] || ' v. ' || x[2])) AS bad_names, {reports} AS n_reports FROM j),
v AS (SELECT *, CASE WHEN len(bad) > 0 THEN [] ELSE bad_names END AS x, len(bad) > 0 OR len(bad_names) + n_reports > 0 AS out FROM k),
w AS (SELECT result_id, n, bad, x, out, CASE WHEN NOT out THEN s || gap WHEN regexp_matches(s, '^\\s*\\*\\*[^*\n]{{2,60}}\\*\\*:?') THEN regexp_extract(s, '^\\s*(\\*\\*[^*\n]{{2,60}}\\*\\*:?)', 1) || gap ELSE '' END AS kept FROM v),
h0 AS (SELECT *, coalesce(regexp_matches(last_value(nullif(kept, '') IGNORE NULLS) OVER (PARTITION BY result_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '\\n\\s*$'), true) AS fresh FROM w),
h AS (SELECT *, last_value(CASE WHEN fresh THEN lower(trim(nullif(regexp_extract(kept, {q(citations.HEADED)}, 1), ''))) END IGNORE NULLS) OVER (PARTITION BY result_id ORDER BY n) AS head, CASE WHEN fresh THEN regexp_replace(kept, {q(citations.HEADED)}, '') ELSE kept END AS own FROM h0),
z AS (SELECT result_id, count(*) FILTER (NOT regexp_matches(own, '\\[S\\d+\\]'))::BIGINT AS bare, count(*)::BIGINT AS total FROM h WHERE head IN ({claims}) AND len(regexp_extract_all(own, '[\\pL\\pM\\pN_]+')) >= 5 AND NOT regexp_matches(own, {q(citations.UNCOVERED)}) GROUP BY 1),
f AS (SELECT result_id, trim(regexp_replace(regexp_replace(string_agg(kept, '' ORDER BY n), '[ \t]+([.,;:])', '\\1', 'g'), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text, flatten(list(bad ORDER BY n)) AS quotes, flatten(list(x ORDER BY n)) AS names, count(*) FILTER (out) AS n_removed FROM w GROUP BY 1),
o AS (SELECT result_id, sid, min(pos) AS pos FROM (SELECT result_id, unnest(regexp_extract_all(text, '\\[S(\\d+)\\]', 1))::BIGINT AS sid, generate_subscripts(regexp_extract_all(text, '\\[S(\\d+)\\]', 1), 1) AS pos FROM f) GROUP BY 1, 2),
y AS (SELECT result_id, string_agg('S' || sid, '|' ORDER BY pos) AS used, count(*) FILTER (status = 'repealed') AS n_repealed FROM o JOIN src USING (result_id, sid) GROUP BY 1)
SELECT result_id, coalesce(used, '') AS used, unknown, array_to_string(quotes, '|') AS quotes, array_to_string(names, '|') AS authorities, n_removed, coalesce(bare, 0) AS unsupported, round(coalesce(bare / total, 0.0), 6) AS unsupported_share,
  coalesce(n_repealed, 0) + (unknown <> '')::BIGINT + (len(quotes) > 0)::BIGINT + (len(names) > 0)::BIGINT AS n_warnings, length(text) AS n_text
FROM f JOIN b USING (result_id) LEFT JOIN z USING (result_id) LEFT JOIN y USING (result_id)"""


_MENTIONS = """WITH q AS (SELECT result_id::VARCHAR AS query_id, question FROM phase1_acceptance WHERE question IS NOT NULL),
m AS (SELECT query_id, question, id AS names, strpos(lower(question), lower(title)) - 1 AS start, length(title) AS n FROM q JOIN statutes ON contains(lower(question), lower(title))) """
_REFS = _MENTIONS + """, r AS (SELECT query_id, unnest(regexp_extract_all(question, '(?i)(?:\\b(?:section|sec\\.?|s\\.|u/s\\.?|ss\\.)\\s*|धारा\\s*)(\\d{1,3}[A-Z]{0,2})', 1)) AS section FROM q), f AS (SELECT query_id, 0::BIGINT AS seq, names AS act, upper(section) AS section, NULL::VARCHAR AS sub FROM r LEFT JOIN m USING (query_id)) """
_WORDS_IN = "len(regexp_extract_all({}, '[^\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'))"
_SAYS = "list_filter(list_transform(string_split(regexp_replace(line, '([.;:?!][”\"'']?)\\s+([“\"(A-Z0-9\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_PACKED = f"""WITH RECURSIVE l AS (SELECT "rowid" AS chunk, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS o FROM chunks WHERE text IS NOT NULL),
k AS (SELECT *, {_WORDS_IN.format('line')} > 50 AS big FROM l WHERE trim(line) <> ''),
e AS (SELECT chunk, o, big, unnest(CASE WHEN big THEN {_SAYS} ELSE [line] END) AS t, unnest(range(CASE WHEN big THEN len({_SAYS}) ELSE 1 END)) AS j FROM k),
i AS (SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY o, j) AS i, CASE WHEN big THEN o::VARCHAR ELSE '-' END AS key, {_WORDS_IN.format('t')} AS n FROM e),
w AS (SELECT chunk, i, 0::BIGINT AS piece, n AS used, key, n FROM i WHERE i = 1
  UNION ALL SELECT i.chunk, i.i, CASE WHEN i.key <> w.key OR used + i.n > 50 THEN piece + 1 ELSE piece END, CASE WHEN i.key <> w.key OR used + i.n > 50 THEN i.n ELSE used + i.n END, i.key, i.n FROM w JOIN i ON i.chunk = w.chunk AND i.i = w.i + 1)
SELECT chunk, piece, sum(n)::BIGINT AS n FROM w GROUP BY 1, 2"""
SQL = {
    "pack_passages": _PACKED,
    "lookup_notes": _REFS
    + """SELECT query_id, 0::INTEGER AS seq, CASE WHEN EXISTS (SELECT 1 FROM chunks c WHERE c.doc_type = 'statute' AND c.act_title = s.short_title) THEN 'Section ' || section || ' of ' || short_title || ' was not found.' ELSE 'The text of ' || short_title || ' is not held.' END AS note
FROM f JOIN statutes s ON s.id = f.act WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_type = 'statute' AND c.act_title = s.short_title AND c.section = f.section)""",
    "checked_answers": _checked(),
    "act_mentions": _MENTIONS + "SELECT query_id, names, start, start + n AS \"end\" FROM m",
    "section_refs": _REFS + "SELECT * FROM f",
    "section_lookup": _REFS + "SELECT query_id, c.\"rowid\" AS chunk, row_number() OVER (PARTITION BY query_id ORDER BY c.\"rowid\") AS pin FROM f JOIN statutes s ON s.id = f.act JOIN chunks c ON c.act_title = s.short_title AND c.section = f.section AND c.doc_type = 'statute'",
    "classify_questions": _classify(),
    "unsupported_share": "SELECT result_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(line, '\\[S\\d+\\]')) AS bare FROM (SELECT result_id, unnest(regexp_split_to_array(answer_markdown, '\\n+')) AS line FROM phase1_acceptance WHERE answer_markdown IS NOT NULL) WHERE len(regexp_extract_all(line, '\\w+')) >= 5 GROUP BY 1",
    "quote_verbatim": """WITH c AS (SELECT doc_id, "rowid" AS chunk, lower(trim(regexp_replace(translate(text, '“”‘’', '""'''''), '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))) AS t FROM chunks WHERE text IS NOT NULL),
q AS (SELECT DISTINCT doc_id, chunk, unnest(regexp_extract_all(t, '"([^"]{15,})"', 1)) AS quote FROM c),
h AS (SELECT DISTINCT q.chunk, q.quote FROM q JOIN c ON c.doc_id = q.doc_id AND c.chunk <> q.chunk AND contains(c.t, q.quote))
SELECT q.chunk, count(*) AS quotes, count(h.quote) AS elsewhere FROM q LEFT JOIN h USING (chunk, quote) GROUP BY 1""",
    "stream_ledger": "SELECT url, max(seq) AS seq, arg_max_null(sha256, seq) AS sha256, arg_max_null(bytes, seq) AS bytes FROM manifest GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
