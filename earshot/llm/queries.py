"""One registered query per operator, and its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import curve, decontaminate, divergence, frames, licenses, packing, quality, repeats, secrets, sharding, simhash, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_sharding")
def op1_sharding(spark, table):
    """All documents in 16 shards of nearly equal counts, in random order."""
    written = sharding.shuffle_into_shards(table("documents"), shards=16)
    return written.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '')"""


@query(
    "op2_warc",
    f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS response FROM d)
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
      CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to FROM f""",
)
def op2_warc(spark, table):
    """Pages written as monolithic WARC files, normalised, and read back by offset."""
    records = warc.archive_pages(table("pages"), least_bytes=0)
    return records.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


@query("op3_packing")
def op3_packing(spark, table):
    """Token pieces of all documents in sequences of 1024."""
    pieces, places = packing.pack(table("documents"), 1024)
    digests = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(places, ["row_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(
    "op4_urls",
    """WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
    s AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
    rules(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    m AS (SELECT s.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM s LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
)
def op4_urls(spark, table):
    """Every page's url judged by the rules of a digest index."""
    return urls.judge_urls(table("pages"), urls.build_index(urls.rules_table(spark, URL_RULES)))


@query("op5_repeats")
def op5_repeats(spark, table):
    """Passages that repeat an earlier one: the spans to remove and where the first occurrence is."""
    docs = table("documents").select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    spans = repeats.repeated_spans(docs)
    return spans.select(F.col("rank").alias("doc_id"), "start", "end", "words", F.col("kept_rank").alias("kept_doc_id"), "kept_start")


@query("op6_simhash")
def op6_simhash(spark, table):
    """Fingerprint and near-duplicate component of every document."""
    docs = table("documents").select(F.col("doc_id"), simhash.fingerprint_column(F.col("text")).alias("fp"))
    groups = simhash.near_groups(simhash.frozen(docs, "prints"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_secrets")
def op7_secrets(spark, table):
    """Secrets of every document: counts of the fixed patterns and all spans."""
    found = secrets.find_secrets(table("documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


@query("op8_quality")
def op8_quality(spark, table):
    """Counts of every document and the verdict by limits of its language and source."""
    rated = quality.rate_documents(table("documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_licenses")
def op9_licenses(spark, table):
    """Licenses found in documents, with coverage and place."""
    return licenses.scan_licenses(table("documents"))


@query("op10_decontamination")
def op10_decontamination(spark, table):
    """Benchmark items found in documents."""
    return decontaminate.find_leaks(table("documents"), table("benchmark"))


@query(
    "op11_divergence",
    r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
    w AS (SELECT lang, source, sum(c) AS n FROM n SEMI JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c,
        (1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 5)) // (coalesce(w.n, 0) + 5 * v.v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (k.total + 5)) // (v.all_n + 5 * v.v))::BIGINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN w USING (lang, source) LEFT JOIN n USING (lang, source, term)),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    o AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM s WHERE c > 0 AND p > q),
    u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM o))
    SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 50""",
)
def op11_divergence(spark, table):
    """Sources of a language compared by their words, and the words each uses more than its language."""
    return divergence.audit_sources(table("documents"))


@query(
    "op12_fill_in_middle",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
      ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM t),
    f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM f""",
)
def op12_fill_in_middle(spark, table):
    """Texts turned for filling in the middle, and restored from the outputs."""
    outputs = frames.fill_in_middle(frames.archive_texts(table("documents")))
    return outputs.withColumn("both", frames.digests(F.col("frames"), F.col("form"))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "both.*")


@query("op13_curve_packing")
def op13_curve_packing(spark, table):
    """Token pieces of all documents in sequences of 4096, neighbours along a Hilbert curve together."""
    pieces = curve.pack_along_curve(table("documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
