"""Queries of ledgers, change detection, stored tables and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import ids, vectors
from folioscope.functions import text as tx
from folioscope.operators import index, search, store
from folioscope.session import table


def ledger_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest").select("url", "seq", "sha256", "bytes")
    return store.last_wins(m, "url", "seq").select("url", "seq", "sha256", "bytes", "first_at")


def ledger_sources(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "manifest")
    kind = F.get_json_object("extra", "$.kind")
    return m.groupBy(F.lower(F.trim("source")).alias("src"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count("sha256").alias("n_fetched"), F.sum("bytes").alias("total"))


def unchanged_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows whose address, hash and version the store doesn't hold."""
    m = table(spark, sf, "manifest").where("sha256 is not null").select(F.col("url").alias("source_url"), F.col("sha256").alias("raw_sha256"), "seq")
    return store.unchanged(m, table(spark, sf, "documents"), ["source_url", "raw_sha256"]).select("source_url", "seq")


def vector_sync(spark: SparkSession, sf: str) -> DataFrame:
    """What an index of the first deliveries would need: by chunk id and hash of its text."""
    c = table(spark, sf, "chunks").where("text is not null and chunk_id is not null")
    want = c.groupBy("chunk_id").agg(F.max(F.sha1("text")).alias("h"))
    have = c.where("rowid % 3 != 0").groupBy("chunk_id").agg(F.min(F.sha1("text")).alias("h"))
    return store.three_way(want, have, "chunk_id", "h").groupBy("state").agg(F.count("*").alias("n"))


def stale_documents(spark: SparkSession, sf: str) -> DataFrame:
    d, m = table(spark, sf, "documents"), table(spark, sf, "manifest")
    return d.join(m.select(F.col("url").alias("source_url")), "source_url", "left_anti").select("doc_id")


def allowed_semi(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("doc_type = 'judgment'").select("doc_id")
    return table(spark, sf, "chunks").join(d, "doc_id", "left_semi").groupBy("language").agg(F.count("*").alias("n"))


def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("text is not null").select("rowid", "doc_id", "locator", F.sha1("text").alias("h"))
    _, dropped = store.keep_first(c, ["doc_id", "h"], "rowid", "locator")
    return dropped.select(F.col("rowid").alias("chunk"), "locator", "kept_locator")


def replace_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table after every fifth document is delivered again with repeated texts, as the SQL has it."""
    c = table(spark, sf, "chunks").select("rowid", "doc_id", "locator", "text", F.lit(False).alias("fresh"))
    new = c.where("doc_id % 5 = 0").withColumn("fresh", F.lit(True))
    return store.replaced(c, new, "doc_id", ["doc_id", "text"], "rowid").groupBy("fresh").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def chunk_identity(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("text is not null and locator is not null")
    doc = ids.document_id(F.coalesce("source_url", F.lit("")))
    return c.select(F.col("rowid").alias("chunk"), ids.chunk_id(doc, F.col("locator"), F.col("text")).alias("made"), (F.sha1("text") == F.col("text_sha1")).alias("sha_ok"))


def corpus_hash(spark: SparkSession, sf: str) -> DataFrame:
    return ids.corpus_hash(table(spark, sf, "chunks"))


def page_runs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "page_info").where("usable")
    return store.runs_label(store.islands(p, ["doc_id"], "number"), ["doc_id"])


def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the one before, and whether they failed."""
    r = table(spark, sf, "ingest_runs")
    w = Window.orderBy("started_at", "run_id")  # one row a run: a small audit table
    d = r.select("run_id", F.lag("run_id").over(w).alias("previous"), F.col("finished_at").isNull().alias("failed"), (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("seconds"))
    return d


def part_numbers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("doc_id is not null")
    by = Window.partitionBy("doc_id", F.coalesce("section", F.lit("")))
    n, k = F.count("*").over(by), F.row_number().over(by.orderBy("rowid"))
    label = F.when(n > 1, F.concat(F.lit(" (part "), k.cast("string"), F.lit(" of "), n.cast("string"), F.lit(")"))).otherwise("")
    return c.select(F.col("rowid").alias("chunk"), label.alias("label"), tx.part_number("locator", "para_start").cast("bigint").alias("stored"))


def paragraph_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Lines grouped into paragraphs: a new one starts after a closed clause where the line opens one."""
    c = table(spark, sf, "chunks").where("text is not null and text != ''").select(F.col("rowid").alias("chunk"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("chunk").orderBy("line_no")
    opens = F.col("line").rlike(r"^(\(\w{1,6}\)|\[\(\w{1,6}\)|Provided|Explanation|Illustrations?\b|“|\[“)")
    new = F.when(F.lag("line").over(w).rlike(r"[.:;—–\-\]]\s*$|[.:;]”\s*$") & opens, 1).otherwise(0)
    d = c.withColumn("new", new).withColumn("para", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("chunk", "para").agg(F.count("*").alias("lines"), F.min("line_no").cast("bigint").alias("first"))


def successor_join(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "statutes")
    return s.join(s.select(F.col("id").alias("successor"), F.col("short_title").alias("next_title")), "successor").select("id", "short_title", "next_title")


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    a, b = d.where("lang = 'en'").select("source"), d.where("lang = 'hi'").select("source")
    tag = lambda x, n: x.select(F.lit(n).alias("op"), "source")
    parts = [tag(a.unionByName(b).distinct(), "union"), tag(a.intersect(b), "intersect"), tag(a.subtract(b), "except")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold").select("id", "question").distinct()
    return g.select("id", ids.cache_key(F.col("question"), model=F.lit("m1"), index=F.lit("i1")).alias("key"))


def answer_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold").select("id", "question").distinct()
    return g.select("id", ids.question_key(F.col("question"), model=F.lit("m1"), index=F.lit("i1")).alias("key"))


def unchanged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a run may leave out: the store holds their address, hash and the current version of their parser."""
    v = table(spark, sf, "parser_versions").groupBy("doc_type").agg(F.max_by("parser_version", F.struct("released_at", "parser_version")).alias("parser_version"))
    d = table(spark, sf, "documents")
    now = d.select("doc_id", "source_url", "raw_sha256", "doc_type").join(v, "doc_type", "left")
    due = store.unchanged(now, d, ["source_url", "raw_sha256", "parser_version"])
    return now.join(due.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def postings_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Postings after the judgments were delivered again with a word more."""
    c = table(spark, sf, "chunks").select("rowid", "doc_id", "doc_type", "text")
    stored = search.postings(c, "rowid").join(c.select("rowid", "doc_id"), "rowid")
    fresh = c.where("doc_type = 'judgment'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" amended")))
    after = index.postings_after(stored, fresh, fresh, "rowid")
    return after.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tf").alias("total"), F.sum(F.when(F.col("term") == "amended", F.col("tf")).otherwise(0)).alias("amended"))


def vectors_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """An index of two thirds of the chunks, some from older texts, brought up to all of them."""
    want, stored = _indexed(spark, sf)
    v, states = index.vectors_after(stored, want, "chunk_id", "h", vectors.hash_embedder(8))
    n = v.join(want.select("chunk_id", "h"), ["chunk_id", "h"]).agg(F.count("*").alias("n")).select(F.lit("after").alias("state"), "n")
    return states.groupBy("state").agg(F.count("*").alias("n")).unionByName(n)


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "chunks").where("text is not null and chunk_id is not null")
    want = c.groupBy("chunk_id").agg(F.max_by(F.struct(F.sha1("text").alias("h"), "text"), F.struct(F.sha1("text"))).alias("x")).select("chunk_id", "x.*")
    k = F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(3))
    had = want.where(k > 0).select("chunk_id", F.when(k == 1, F.sha1("h")).otherwise(F.col("h")).alias("h"), vectors.hash_embedder(8)("text").alias("embedding"))
    gone = spark.createDataFrame([("gone", "x", [0.0] * 8)], "chunk_id string, h string, embedding array<float>")
    return want, had.unionByName(gone)


def index_description(spark: SparkSession, sf: str) -> DataFrame:
    want, stored = _indexed(spark, sf)
    return index.described(index.vectors_after(stored, want, "chunk_id", "h", vectors.hash_embedder(8))[0], want, "hash-8")


def index_health(spark: SparkSession, sf: str) -> DataFrame:
    """The index before it was brought up to the chunks, under a description of it afterwards."""
    want, stored = _indexed(spark, sf)
    return index.health(stored, want, index_description(spark, sf), "hash-8")


def ledger_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of the ledger that no document has: what a build has to refuse."""
    m = table(spark, sf, "manifest").where("url is not null").select("url", F.lower(F.trim("source")).alias("source")).distinct()
    d = table(spark, sf, "documents").where("source_url is not null").select(F.col("source_url").alias("url"), F.lit(True).alias("known")).distinct()
    return m.join(d, "url", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("refused"))


def cacheable_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "phase1_acceptance").select("result_id", tx.free_of("warnings", ["Removed", "No "]).alias("kept"))


def laws_of_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "statutes").where(F.col("act_year").isin(tx.year_list("1900-1939, 1944,1962"))).select("id", "act_year")


def shortened_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without the section that a model wrote under Details."""
    a = table(spark, sf, "phase1_acceptance").where("answer_markdown is not null")
    return a.select("result_id", F.length(tx.without_section("answer_markdown", "Details")).cast("bigint").alias("n"))


def case_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """What a judgment's file beside it says, as JSON."""
    c = table(spark, sf, "chunks").where("doc_type = 'judgment'")
    one = c.groupBy("doc_id").agg(*[F.coalesce(F.min(x), F.lit("")).alias(x) for x in ("case_title", "cnr", "court", "decision_date")])
    return one.select("doc_id", F.to_json(F.struct("case_title", "cnr", "court", "decision_date")).alias("sidecar"))


def repeal_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an answer cites a repealed law, and whether it shares a section with what it used."""
    r = table(spark, sf, "statutes").where("status = 'repealed'").agg(F.coalesce(F.collect_list("short_title"), F.array().cast("array<string>")).alias("gone"))  # a register
    a = table(spark, sf, "phase1_acceptance").select("result_id", F.transform("cited", lambda c: c["act"]).alias("acts"))
    return a.crossJoin(F.broadcast(r)).select("result_id", F.coalesce(~F.arrays_overlap(F.array_compact("acts"), "gone"), F.lit(True)).alias("apart"))  # one row


QUERIES = {
    f.__name__: f
    for f in (ledger_unknown, cacheable_answers, laws_of_years, shortened_answers, case_sidecars, repeal_cited, answer_cache_keys, unchanged_documents, postings_upkeep, vectors_upkeep, index_description, index_health, ledger_last_wins, ledger_sources, unchanged_anti, vector_sync, stale_documents, allowed_semi, keep_first, replace_documents, chunk_identity, corpus_hash, page_runs, run_audit, part_numbers, paragraph_islands, successor_join, set_operations, cache_keys)
}

_WANT = """WITH w AS (SELECT chunk_id, max(sha1(text)) AS h FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
k AS (SELECT *, ('0x' || left(h, 4))::INT % 3 AS k FROM w) """
SQL = {
    "ledger_unknown": "SELECT source, count(*) AS n, count(*) FILTER (url NOT IN (SELECT source_url FROM documents WHERE source_url IS NOT NULL)) AS refused FROM (SELECT DISTINCT url, lower(trim(source)) AS source FROM manifest WHERE url IS NOT NULL) GROUP BY 1",
    "cacheable_answers": "SELECT result_id, len(list_filter(coalesce(warnings, []), lambda w: starts_with(w, 'Removed') OR starts_with(w, 'No '))) = 0 AS kept FROM phase1_acceptance",
    "laws_of_years": "SELECT id, act_year FROM statutes WHERE act_year BETWEEN 1900 AND 1939 OR act_year IN (1944, 1962)",
    "shortened_answers": "SELECT result_id, length(regexp_replace(regexp_replace(answer_markdown, '(?is)\\n*[ \\t]*\\*\\*Details:?\\*\\*:?.*?(\\n\\s*\\*\\*|\\z)', '\\1', 'g'), '\\s+$', '')) AS n FROM phase1_acceptance WHERE answer_markdown IS NOT NULL",
    "case_sidecars": "SELECT doc_id, '{\"case_title\":' || to_json(coalesce(min(case_title), ''))::VARCHAR || ',\"cnr\":' || to_json(coalesce(min(cnr), ''))::VARCHAR || ',\"court\":' || to_json(coalesce(min(court), ''))::VARCHAR || ',\"decision_date\":' || to_json(coalesce(min(decision_date), ''))::VARCHAR || '}' AS sidecar FROM chunks WHERE doc_type = 'judgment' GROUP BY 1",
    "repeal_cited": "WITH c AS (SELECT result_id, unnest(cited) AS c FROM phase1_acceptance) SELECT result_id, result_id NOT IN (SELECT result_id FROM c WHERE c.act IN (SELECT short_title FROM statutes WHERE status = 'repealed')) AS apart FROM phase1_acceptance",
    "answer_cache_keys": "SELECT DISTINCT id, sha256('{\"q\":' || to_json(lower(trim(regexp_replace(nfc_normalize(question), '\\s+', ' ', 'g'))))::VARCHAR || ',\"index\":\"i1\",\"model\":\"m1\"}') AS key FROM gold",
    "unchanged_documents": "SELECT doc_id FROM documents d JOIN (SELECT doc_type, arg_max(parser_version, (released_at, parser_version)) AS v FROM parser_versions GROUP BY 1) USING (doc_type) WHERE source_url IS NOT NULL AND raw_sha256 IS NOT NULL AND d.parser_version = v",
    "postings_upkeep": "WITH c AS (SELECT \"rowid\" AS r, doc_id, regexp_extract_all(lower(coalesce(text, '') || CASE WHEN doc_type = 'judgment' THEN ' amended' ELSE '' END), '[\\p{L}\\p{M}\\p{N}]+') AS t FROM chunks), p AS (SELECT r, doc_id, unnest(t) AS term FROM c) SELECT doc_id, count(DISTINCT (r, term)) AS n, count(*) AS total, count(*) FILTER (term = 'amended') AS amended FROM p GROUP BY 1",
    "vectors_upkeep": _WANT + "SELECT CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'current' END AS state, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'orphan', 1 UNION ALL SELECT 'after', count(*) FROM w",
    "index_description": _WANT + "SELECT 'hash-8' AS model, 8 AS dimensions, count(*) AS n_vectors, count(*) AS n_chunks, sha256(string_agg(chunk_id, '' ORDER BY chunk_id)) AS corpus_hash FROM w",
    "index_health": _WANT + "SELECT unnest(['described', 'model', 'dimensions', 'count', 'none missing', 'none too many']) AS check, unnest([true, true, true, n + 1 = m, n = m, false]) AS ok FROM (SELECT count(*) FILTER (k > 0) AS n, count(*) AS m FROM k)",
    "ledger_last_wins": "SELECT url, max(seq) AS seq, arg_max_null(sha256, seq) AS sha256, arg_max_null(bytes, seq) AS bytes, min(seq) AS first_at FROM manifest GROUP BY 1",
    "ledger_sources": "SELECT lower(trim(source)) AS src, json_extract_string(extra, '$.kind') AS kind, count(*) AS n, count(sha256) AS n_fetched, sum(bytes)::BIGINT AS total FROM manifest GROUP BY 1, 2",
    "unchanged_anti": "SELECT url AS source_url, seq FROM manifest m WHERE sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source_url = m.url AND d.raw_sha256 = m.sha256)",
    "vector_sync": """WITH w AS (SELECT chunk_id, max(sha1(text)) AS h FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
v AS (SELECT chunk_id, min(sha1(text)) AS h FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL AND "rowid" % 3 <> 0 GROUP BY 1)
SELECT CASE WHEN w.chunk_id IS NULL THEN 'orphan' WHEN v.chunk_id IS NULL THEN 'missing' WHEN w.h = v.h THEN 'current' ELSE 'stale' END AS state, count(*) AS n FROM w FULL JOIN v ON w.chunk_id = v.chunk_id GROUP BY 1""",
    "stale_documents": "SELECT doc_id FROM documents WHERE source_url IS NULL OR source_url NOT IN (SELECT url FROM manifest WHERE url IS NOT NULL)",
    "allowed_semi": "SELECT language, count(*) AS n FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_type = 'judgment') GROUP BY 1",
    "keep_first": "SELECT chunk, locator, kept_locator FROM (SELECT \"rowid\" AS chunk, locator, first_value(locator) OVER w AS kept_locator, row_number() OVER w AS n FROM chunks WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id, sha1(text) ORDER BY \"rowid\")) WHERE n > 1",
    "replace_documents": "SELECT fresh, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT false AS fresh, doc_id FROM chunks WHERE doc_id % 5 <> 0 UNION ALL SELECT true, doc_id FROM (SELECT DISTINCT doc_id, text FROM chunks WHERE doc_id % 5 = 0)) GROUP BY 1",
    "chunk_identity": "SELECT \"rowid\" AS chunk, left(sha256(coalesce(source_url, '')), 12) || ':' || coalesce(nullif(regexp_replace(regexp_replace(lower(locator), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') || ':' || left(sha1(text), 8) AS made, sha1(text) = text_sha1 AS sha_ok FROM chunks WHERE text IS NOT NULL AND locator IS NOT NULL",
    "corpus_hash": "SELECT sum(n)::BIGINT AS n_chunks, sha256(string_agg(h, '' ORDER BY p)) AS corpus_hash FROM (SELECT ('0x' || left(sha1(chunk_id), 3))::INT AS p, sha256(string_agg(chunk_id, '' ORDER BY chunk_id)) AS h, count(*) AS n FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1)",
    "page_runs": "WITH p AS (SELECT DISTINCT doc_id, number FROM page_info WHERE usable), k AS (SELECT *, number - row_number() OVER (PARTITION BY doc_id ORDER BY number) AS k FROM p), r AS (SELECT doc_id, min(number) AS a, max(number) AS b FROM k GROUP BY doc_id, k) SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1",
    "run_audit": "SELECT run_id, lag(run_id) OVER (ORDER BY started_at, run_id) AS previous, finished_at IS NULL AS failed, floor(epoch(finished_at))::BIGINT - floor(epoch(started_at))::BIGINT AS seconds FROM ingest_runs",
    "part_numbers": "SELECT \"rowid\" AS chunk, CASE WHEN count(*) OVER w > 1 THEN ' (part ' || row_number() OVER (PARTITION BY doc_id, coalesce(section, '') ORDER BY \"rowid\") || ' of ' || count(*) OVER w || ')' ELSE '' END AS label, coalesce(try_cast(nullif(regexp_extract(locator, 'part (\\d+) of', 1), '') AS BIGINT), para_start, 0) AS stored FROM chunks WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id, coalesce(section, ''))",
    "paragraph_islands": """WITH c AS (SELECT "rowid" AS chunk, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM chunks WHERE text <> ''),
f AS (SELECT *, CASE WHEN regexp_matches(lag(line) OVER w, '[.:;—–\\-\\]]\\s*$|[.:;]”\\s*$') AND regexp_matches(line, '^(\\(\\w{1,6}\\)|\\[\\(\\w{1,6}\\)|Provided|Explanation|Illustrations?\\b|“|\\[“)') THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY chunk ORDER BY line_no)),
p AS (SELECT *, sum(new) OVER (PARTITION BY chunk ORDER BY line_no)::BIGINT AS para FROM f)
SELECT chunk, para, count(*) AS lines, min(line_no) AS first FROM p GROUP BY 1, 2""",
    "cache_keys": "SELECT DISTINCT id, sha256('{\"q\":' || to_json(lower(trim(question)))::VARCHAR || ',\"index\":\"i1\",\"model\":\"m1\"}') AS key FROM gold",
    "successor_join": "SELECT s.id, s.short_title, t.short_title AS next_title FROM statutes s JOIN statutes t ON s.successor = t.id",
    "set_operations": "SELECT 'union' AS op, source FROM (SELECT source FROM documents WHERE lang = 'en' UNION SELECT source FROM documents WHERE lang = 'hi') UNION ALL SELECT 'intersect', source FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'hi') UNION ALL SELECT 'except', source FROM (SELECT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE lang = 'hi')",
}
