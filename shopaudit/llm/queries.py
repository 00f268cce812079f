"""The operators over the driver's tables: thin queries that map their columns, and SQL where it can say the same."""
from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import configure
from . import alignment, archives, filter_audit, fingerprints, markup, near_copies, packing, pieces, pseudonyms, quality, shards, toxicity, vectors
from .common import held_out, stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def _documents(spark, folder):
    return _table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), "text")


def _verdicts(spark, folder, label):
    return _table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col(label).alias("label"))


def op1_similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    return vectors.similar_vectors(rows, 0.9).withColumnRenamed("vector_id", "vec_id")


def op2_packed_pages(spark: SparkSession, folder: str) -> DataFrame:
    pieces_ = packing.pack_pages(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces_.select(F.col("page_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                          F.col("page_tokens").alias("doc_tokens"), "sequence_id", "offset", "sequence_length", "step_group")


def op3_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    key = spark.conf.get(pseudonyms.KEY_SETTING, "a key for tests")
    return pseudonyms.pseudonymised(_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), key)


def op4_page_quality(spark: SparkSession, folder: str) -> DataFrame:
    test = held_out(F.col("page_id"), 5, 0)
    found = quality.quality_of_pages(_documents(spark, folder), _verdicts(spark, folder, "quality"), test, stored)
    return found.select(F.col("page_id").alias("doc_id"), test.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.near_copies(_documents(spark, folder), 85).withColumnRenamed("page_id", "doc_id")


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_stability(_documents(spark, folder)).withColumnRenamed("page_id", "doc_id")


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = shards.shard_pages(_documents(spark, folder), 16)
    return found.select(F.col("page_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op8_archives(spark: SparkSession, folder: str) -> DataFrame:
    found = archives.archived(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op9_page_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("page_id")
    test = held_out(key, 3, 1)
    found, _ = toxicity.toxicity_of_pages(_documents(spark, folder), _verdicts(spark, folder, "toxic"), test, held_out(key, 3, 0), stored)
    return found.select(key.alias("doc_id"), test.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encode_pages(_documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("page_id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), "decoded",
                        (F.col("decoded") == F.col("text")).alias("round_trip"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = markup.matched_templates(_documents(spark, folder))
    base = F.filter("places", lambda p: p["kind"] == "phrase")
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["first_word"])
    return found.select(
        F.col("page_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(F.col("places")).alias("labels"), "score")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("site"), "text")
    marks = _table(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.audit_filters(pages, marks).withColumnRenamed("site", "part")


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.align_pages(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("page_id", "doc_id")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(configure(spark), folder)


QUERIES = {f.__name__: f for f in (
    op1_similar_vectors, op2_packed_pages, op3_pseudonyms, op4_page_quality, op5_near_copies, op6_fingerprints, op7_shards, op8_archives,
    op9_page_toxicity, op10_pieces, op11_license_scan, op12_filter_audit, op13_token_alignment, pipeline)}

_LINKS = """
reach AS (
  SELECT id, min(other) AS component FROM (
    WITH RECURSIVE walk(id, other) AS (
      SELECT id, id FROM nodes UNION SELECT w.id, l.b FROM walk w JOIN links l ON w.other = l.a)
    SELECT * FROM walk) GROUP BY id)"""

OP1_SQL = f"""
WITH nodes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL),
usable AS (
  SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM nodes
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (
  SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y ON x.id <> y.id AND len(x.v) = len(y.v)
  AND list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9),
{_LINKS}
SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, r.component AS component_id, n.id = r.component AS kept
FROM nodes n JOIN reach r ON n.id = r.id"""

OP5_SQL = f"""
WITH words AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
nodes AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
shingles AS (SELECT id, len(s) AS n, hash(unnest(s)) AS h FROM nodes),
common AS (
  SELECT x.id AS a, y.id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM shingles x JOIN shingles y ON x.h = y.h AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (n + m - k)),
{_LINKS}
SELECT n.id AS doc_id, len(n.s)::BIGINT AS n_shingles, r.component AS component_id, n.id = r.component AS kept FROM nodes n JOIN reach r ON n.id = r.id"""

OP8_SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest FROM payloads)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to, true AS verified
FROM newest"""

def _notice_pattern(template: str) -> str:
    """A notice as a pattern over words that each follow a blank."""
    out = []
    for part in re.split(r"(\[\[|\]\]|\{\{.*?\}\})", template):
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif part.startswith("{{") and "/" in part:
            out.append(" (?:" + part[2:-2].replace("/", "|") + ")")
        elif part.startswith("{{"):
            out.append("(?: [^ ]+){" + part[2:-2].split()[-1].replace("-", ",") + "}")
        else:
            out += [" " + w for w in part.split()]
    return "".join(out) + " "


def _notice_weight(template: str) -> int:
    """Words outside optional regions and free ones."""
    fixed = re.sub(r"\[\[.*?\]\]", " ", template)
    return len(re.sub(r"\{\{\w+ \d+-\d+\}\}", " ", re.sub(r"\{\{[\w/]+\}\}", " x ", fixed)).split())


def _op11_sql() -> str:
    places = {label: "list_filter(range(0, len(w)), lambda i: " + " AND ".join(
        f"w[i+{k}] = '{word}'" for k, word in enumerate(text.split(), 1)) + ")" for label, text in markup.PHRASES.items()}
    weights = [(f"len({places[x]}) > 0", len(t.split())) for x, t in markup.PHRASES.items()]
    weights += [(f"regexp_matches(t, '{_notice_pattern(t)}')", _notice_weight(t)) for t in markup.NOTICES.values()]
    labels = lambda found: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for x, c in found) + "], lambda x: x IS NOT NULL)"
    base = [(x, f"len({p}) > 0") for x, p in places.items()]
    named = [(x, c) for (c, _), x in zip(weights[len(base):], markup.NOTICES)]
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
texts AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM words),
found AS (
  SELECT doc_id, len(w) AS n_words, list_concat({", ".join(places.values())}) AS places, {labels(base)} AS base, {labels(named)} AS others,
    greatest({", ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in weights)}) AS weight
  FROM texts)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, others))), ',') AS labels,
  weight / (weight + 4.0)::DOUBLE AS score FROM found"""


OP12_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    coalesce(doc_id > (min(doc_id) OVER (PARTITION BY coalesce(text, ''))), false) AS e FROM documents),
marks AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY 1),
masks AS (
  SELECT part, coalesce(good = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n,
    len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, e
  FROM words LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
failed AS (SELECT *, list_filter([if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')], lambda x: x <> '') AS f FROM masks),
steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic, list_contains(f, substr(filter_order, step, 1)) AS fails,
    len(list_filter(f, lambda x: instr(substr(filter_order, 1, step - 1), x) > 0)) = 0 AS there, len(f) = 1 AS alone
  FROM failed, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (there AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (there AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails,
    coalesce(sum(n) FILTER (there AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (there AND fails AND toxic), 0) AS toxic_lost
  FROM steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted"""

ORACLES = {"op1_similar_vectors": OP1_SQL, "op5_near_copies": OP5_SQL, "op8_archives": OP8_SQL, "op11_license_scan": _op11_sql(),
           "op12_filter_audit": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
