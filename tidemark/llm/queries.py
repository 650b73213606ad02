"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity, url_filter
from .common import held_out, table
from .decontam import contamination
from .divergence import audit
from .exact_dedup import exact_dedup
from .html_extract import extract
from .minhash import near_duplicates
from .packing import pack
from .pii import pseudonymise
from .quality import quality_rules
from .sharding import reshard
from .whitening import whiten


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op2_nb_char_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_wrapper_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), key=F.col("doc_id"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, threshold=85)


def op6_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # with the checksum taken first, the text itself is not shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    found = reshard(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


#: The key of the registered query; a real run takes its own from a secret store.
PSEUDONYM_KEY = "tidemark-public-example-key"


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_values"), F.array_join("pii_kinds", " ").alias("kinds"))


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed values of the URL query: (verdict, host, path) rules, and words whose hosts are labelled unwanted.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UNWANTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "win")


def weak_url_labels(pages: DataFrame) -> DataFrame:
    """(url, label): the tables hold no URL labels, so a word of the host (between dots and hyphens) gives one."""
    words = F.split(url_filter.host_of(F.col("url")), "[.-]")
    return pages.select("url", F.arrays_overlap(words, F.array(*map(F.lit, UNWANTED_WORDS))).cast("int").alias("label"))


def op10_gbt_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(weak_url_labels(pages))
    return url_filter.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "unwanted")


def op11_spectrum_slicing_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_nb_char_toxicity": op2_nb_char_toxicity,
    "op3_wrapper_html_text": op3_wrapper_html_text,
    "op4_kneser_ney_language_id": op4_kneser_ney_language_id,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_bloom_exact_dedup": op6_bloom_exact_dedup,
    "op7_min_cost_flow_resharding": op7_min_cost_flow_resharding,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_simhash_decontamination": op9_simhash_decontamination,
    "op10_gbt_url_filter": op10_gbt_url_filter,
    "op11_spectrum_slicing_whitening": op11_spectrum_slicing_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_mcd_quality_rules": op13_mcd_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op5_circulant_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q USING (x) WHERE p.doc_id <> q.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op6_bloom_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # brute force: every window of an item's size in the documents that share a shingle with the item
    "op9_simhash_decontamination": """
        WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
        iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
        d AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS h FROM dw WHERE len(w) >= 5),
        b AS (SELECT item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS h FROM iw WHERE len(w) >= 5),
        du AS (SELECT DISTINCT doc_id, unnest(h) AS x FROM d), bu AS (SELECT DISTINCT item_id, unnest(h) AS x FROM b),
        pair AS (SELECT DISTINCT doc_id, item_id FROM du JOIN bu USING (x)),
        win AS (SELECT doc_id, item_id, b.h AS bag, unnest(range(0, greatest(1, len(d.h) - len(b.h) + 1))) AS start, d.h AS h FROM pair JOIN d USING (doc_id) JOIN b USING (item_id)),
        sim AS (
            SELECT doc_id, item_id, start, bag, h[start + 1:start + len(bag)] AS v,
                   list_sum(list_transform(list_distinct(bag), lambda x: least(len(list_filter(bag, lambda y: y = x)), len(list_filter(h[start + 1:start + len(bag)], lambda y: y = x))))) AS k FROM win),
        s AS (SELECT doc_id, item_id, start, len(v) + 4 AS n_words, k::DOUBLE / (len(v) + len(bag) - k) AS similarity FROM sim WHERE k::DOUBLE / (len(v) + len(bag) - k) >= 0.8)
        SELECT doc_id, item_id, start AS start_word, n_words, similarity FROM s
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1""",
    "op12_source_divergence": """
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
        occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        grp AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        gn AS (SELECT lang, source, sum(n) AS n FROM occ GROUP BY ALL), ln AS (SELECT lang, sum(n) AS n FROM occ GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS c, 1 + (1000000000 * (coalesce(o.n, 0) + 1)) // (coalesce(gn.n, 0)::BIGINT + v.v) AS p
              FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
        q AS (SELECT lang, term, 1 + (1000000000 * (sum(c)::BIGINT + 1)) // (ln.n::BIGINT + v.v) AS q FROM p JOIN v USING (lang) JOIN ln USING (lang) GROUP BY lang, term, ln.n, v.v),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
              UNION ALL SELECT lang, source, 'term', term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p.p > q.q)
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
        QUALIFY part = 'pair' OR rank <= 200""",
}
