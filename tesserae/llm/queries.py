"""Queries over the supplied tables, one for each training-data operator, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, decontaminate, fingerprints, html_text, lexical, merkle, packing, pieces, pii, quality, secrets, simhash, token_ids, warc
from tesserae.llm.common import table

#: The key of the surrogates in the query; a deployment passes its own secret to pii.replace.
PII_KEY = "tesserae-demonstration-key"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score; labels whose id hashes to the held-out fifth aren't learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out())
    model = quality.fit(*quality.sample(docs, labels))
    scores = quality.scored(docs, model).drop("text")
    return scores.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_sentencepiece_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, sampled without replacement, with their scores and a decoding check."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.sample(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, with_ids=False, most_states=2_500_000).drop("ids")


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' token ids in ascending doc_id order, read the files back and report on each document."""
    import public_tokenizers

    folder = common.shared_dir(spark) + "/tokens"
    files = token_ids.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_ids.read(spark, folder, files).drop("ids")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs).drop("text"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id that links reach from it."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back and report on each capture."""
    folder = common.shared_dir(spark) + "/warc"
    written = warc.write(warc.marked(table(spark, sf_dir, "pages")), folder)
    captures = warc.assemble(warc.read(spark, folder, written, payload=False))
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "refers_to")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items hit for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, how like they and the next document are, and the class of near documents."""
    where = common.shared_dir(spark)
    rows = common.cut(fingerprints.compare_edits(table(spark, sf_dir, "documents")), where, "compared")
    return fingerprints.with_classes(rows, where)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by surrogates, and counts by type."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.search(docs, items, common.shared_dir(spark), k=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, the roots over it and its proof, which is held against a text in lower case for a third of the ids."""
    columns, id_ = ["doc_id", "source", "lang", "n_chars", "text"], F.col("doc_id").cast("string")
    lowered = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    other = F.when(F.crc32(id_.cast("binary")) % 3 == 0, merkle.leaf(columns, "text", lowered))
    leaves = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), merkle.leaf(columns).alias("digest"), other.alias("other"))
    found = merkle.manifest(leaves, common.shared_dir(spark)).withColumnRenamed("id", "doc_id")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in pieces of at most 1024, packed into sequences of 1024."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), common.shared_dir(spark), end=2, capacity=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece_gumbel": op2_sentencepiece_gumbel,
    "op3_token_id_output": op3_token_id_output,
    "op4_html_extraction": op4_html_extraction,
    "op5_secret_scan": op5_secret_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit_packing": op13_best_fit_packing,
}



def _merkle_sql(levels: int = 7, head_levels: int = 3) -> str:
    """The manifest in SQL, its levels written out: up to 8 ** levels documents of a language, and 8 ** head_levels languages."""
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda t: "sha256(" + " || ".join(map(size, ["doc_id", "source", "lang", "n_chars", t])) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [CAST(-1 AS BIGINT) FOR i IN range(8)])))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), CAST(4294967295 AS BIGINT))"
    parts = [f"v0 AS (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, {leaf('text')} AS d, doc_id, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS o FROM documents)"]
    up = lambda a, b: f"{b} AS (SELECT g, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 7) // 8 ELSE 1 END AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY {a}.i)) ELSE any_value(d) END AS d, list(d ORDER BY {a}.i) AS run, any_value(n) > 1 AS made FROM {a} GROUP BY g, CASE WHEN n > 1 THEN i // 8 ELSE i END)"
    for k in range(levels):
        parts.append(up(f"v{k}", f"v{k + 1}"))
    parts.append(f"h0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, g AS lang FROM v{levels})")
    for k in range(head_levels):
        parts.append(up(f"h{k}", f"h{k + 1}"))
    # A row's place i, its proof so far p, and what its digest o has become.
    parts.append("f0 AS (SELECT doc_id, g, d, i, o, '' AS p FROM v0)")
    step = lambda a, b, of, keep: (
        f"{b} AS (SELECT {keep}, x.i // 8 AS i, array_to_string(x.before || [x.o] || x.after, '') AS w, made, x.o AS o0, x.p || array_to_string(x.before || x.after, '') AS p FROM "
        f"(SELECT {a}.*, made, CASE WHEN made THEN run[: {a}.i % 8] ELSE [] END AS before, CASE WHEN made THEN run[{a}.i % 8 + 2 :] ELSE [] END AS after FROM {a} JOIN {of} ON {a}.g IS NOT DISTINCT FROM {of}.g AND {of}.i = CASE WHEN made THEN {a}.i // 8 ELSE {a}.i END) x), "
        f"{b}_ AS (SELECT {keep}, i, CASE WHEN made THEN sha256(w) ELSE o0 END AS o, p FROM {b})"
    )
    last = "f0"
    for k in range(levels):
        parts.append(step(last, f"f{k + 1}", f"v{k + 1}", "doc_id, g, d"))
        last = f"f{k + 1}_"
    parts.append(f"e0 AS (SELECT f.doc_id, f.d AS leaf, h.d AS subroot, 0 AS g, h.i, f.o, f.p FROM {last} f JOIN h0 h ON f.g IS NOT DISTINCT FROM h.lang)")
    last = "e0"
    for k in range(head_levels):
        parts.append(step(last, f"e{k + 1}", f"h{k + 1}", "doc_id, leaf, subroot, g"))
        last = f"e{k + 1}_"
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, h.d AS root, sha256(p) AS proof_sha256, o AS folded_root, o = h.d AS verified FROM {last}, h{head_levels} h"


ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to
FROM w
""",
    "op8_benchmark_decontamination": r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.n, g.i, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.s = x.s),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN marked m USING (doc_id) LEFT JOIN named n USING (doc_id)
""",
    "op11_ranked_lexical_search": r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM low WHERE len(w) > 0),
tot AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
tf AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM low) GROUP BY ALL),
asked AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM benchmark),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, tot GROUP BY t, docs),
m AS (SELECT doc_id, 100 - 90 + CAST((90 * n * docs) // l AS BIGINT) AS m FROM sizes, tot),
s AS (
  SELECT a.item_id, tf.doc_id, CAST(sum(weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM asked a JOIN tf USING (t) JOIN df USING (t) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""",
    "op12_merkle_manifest": _merkle_sql(),
}
