"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import (
    conversation_repair, decontaminate, embedding_dedup, license_scan, packing, quality, resharding, sentencepiece_codec, simhash_dedup, source_mix,
    spelling_variants, token_counts, toxicity,
)
from tonelake.llm.common import table, train_fold
from tonelake.session import spread

TOXIC_FROM, QUALITY_FROM = 0.5, 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so every distinct text is encoded."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir), width=4, radius=4)
    return found.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _scored(docs: DataFrame, score, cut: float) -> DataFrame:
    """A row without an id has no remainder: it is never learnt from, and not held out."""
    return (docs.select("doc_id", F.coalesce(~train_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"))
            .select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(spread(docs), toxicity.score(spark, model, F.col("text")), TOXIC_FROM)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(spread(docs), quality.score(spark, machine, F.col("text")), QUALITY_FROM)


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout keeps each source in one of 24 shards, so sizes are far apart; the new one has equal bytes."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(24))
    out = resharding.assign(table(spark, sf_dir, "documents"), old, old_shards=24, shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit(resharding.LAW).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), times=10, least_length=7, least_n=2)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")), there=F.col("there"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_sentencepiece, op2_token_counts, op3_token_packing, op4_embedding_dedup, op5_license_scan, op6_decontaminate,
        op7_simhash_dedup, op8_toxicity, op9_quality, op10_resharding, op11_spelling_variants, op12_conversation_repair, op13_source_mix, pipeline)}


_OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.id),
heads AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN heads ON id = vec_id LEFT JOIN degrees ON u = vec_id"""


def _op5_sql(per_template: int = 8, share: float = 0.75) -> str:
    rows = [(t, x.label, k, w) for t, x in enumerate(license_scan.TEMPLATES) for k, w in enumerate(x.words.split(" "))]
    phrases = [(t, x.label, m) for t, x in enumerate(license_scan.TEMPLATES) for m in x.mandatory]
    values = lambda xs: ", ".join("(" + ", ".join(f"'{y}'" if isinstance(y, str) else str(y) for y in x) + ")" for x in xs)
    return f"""
WITH tpl(t, label, k, w) AS (VALUES {values(rows)}), need(t, label, phrase) AS (VALUES {values(phrases)}),
base(phrase, label, len) AS (VALUES {values((p, b, len(p.split(" "))) for p, b in license_scan.BASE.items())}),
d AS (SELECT doc_id, string_split(trim(regexp_replace(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ') AS ws FROM documents),
p AS (SELECT doc_id, CASE WHEN ws = [''] THEN [] ELSE ws END AS ws, ' ' || array_to_string(ws, ' ') || ' ' AS p FROM d),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM p),
places AS (SELECT w.doc_id, w.i, b.label FROM words w JOIN p USING (doc_id), base b WHERE w.w = split_part(b.phrase, ' ', 1) AND array_to_string(p.ws[w.i + 1 : w.i + b.len], ' ') = b.phrase),
df AS (SELECT w, count(DISTINCT doc_id) AS n FROM words WHERE w IN (SELECT w FROM tpl) GROUP BY w),
ranked AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY COALESCE(n, 0), w) AS r FROM (SELECT DISTINCT t, w FROM tpl) LEFT JOIN df USING (w)),
idx AS (SELECT tpl.* FROM tpl JOIN ranked USING (t, w) WHERE r <= {per_template}),
size AS (SELECT t, label, count(*) AS places, count(DISTINCT w) AS kinds FROM idx GROUP BY t, label),
rare AS (SELECT DISTINCT doc_id, w FROM words WHERE w IN (SELECT w FROM idx)),
near AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, t, count(*) AS n FROM rare JOIN (SELECT DISTINCT t, w FROM idx) USING (w) GROUP BY doc_id, t) JOIN size USING (t) WHERE n >= {share} * kinds),
votes AS (SELECT doc_id, t, max(n) AS best FROM (SELECT doc_id, t, i - k AS o, count(*) AS n FROM words JOIN rare USING (doc_id, w) JOIN near USING (doc_id) JOIN idx USING (w) GROUP BY 1, 2, 3) GROUP BY 1, 2),
told AS (SELECT doc_id, label, best / places AS v FROM votes JOIN size USING (t) JOIN p USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM need WHERE need.t = votes.t AND NOT contains(p.p, ' ' || need.phrase || ' '))),
every AS (SELECT doc_id, label FROM told WHERE v >= {share} UNION SELECT doc_id, label FROM places),
b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
s AS (SELECT doc_id, max(v) AS v FROM told GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_base, a AS first_word, z AS last_word, COALESCE(b.labels, '') AS base_labels,
       COALESCE(m.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE least(1.0, COALESCE(v, 0)) END::DOUBLE AS score
FROM p LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)"""


#: Every quotient is listed here, which the operator avoids.
_OP13_SQL = """
WITH d AS (SELECT doc_id, source IS NULL AS none, COALESCE(source, '') AS name, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY ALL),
w AS (SELECT *, (row_number() OVER (ORDER BY none, name) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size AS top FROM s),
l AS (SELECT *, COALESCE(sum(top) OVER (ORDER BY top / weight, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY top / weight, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_from FROM w),
c AS (SELECT *, top * open_from < (total - full_before) * weight AS stops FROM l),
f AS (SELECT *, CASE WHEN stops THEN top::DOUBLE
                     ELSE CAST(total - sum(CASE WHEN stops THEN top ELSE 0 END) OVER () AS BIGINT)::DOUBLE * weight / CAST(sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS BIGINT) END AS target FROM c),
bids AS (SELECT none, name, unnest(range(1, CAST(ceil(target / 16) + 3 AS BIGINT))) AS k, target, total FROM f WHERE target > 0),
won AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, none, name, k) AS r FROM bids),
q AS (SELECT none, name, count(*) AS seats FROM won WHERE r <= CAST(round(total / 16) AS BIGINT) GROUP BY ALL),
p AS (SELECT f.*, COALESCE(seats, 0) AS seats, greatest(1, ceil(n_docs / 4096), ceil(source_size / 4194304))::BIGINT AS shards FROM f LEFT JOIN q USING (none, name)),
r AS (SELECT d.*, p.source_size, p.target, p.seats, md5('13:' || COALESCE(doc_id::VARCHAR, '') || ':' || size) AS place, p.shards FROM d JOIN p USING (none, name)),
h AS (SELECT *, ('0x' || substr(place, 1, 8))::BIGINT % shards AS shard FROM r),
z AS (SELECT none, name, shard, seats, CAST(sum(size) AS BIGINT) AS shard_size FROM h GROUP BY ALL),
bids2 AS (SELECT none, name, shard, shard_size, seats, unnest(range(1, CAST(ceil(3 * shard_size / 16) + 3 AS BIGINT))) AS k FROM z WHERE shard_size > 0),
won2 AS (SELECT *, row_number() OVER (PARTITION BY none, name ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard, k) AS r FROM bids2),
q2 AS (SELECT none, name, shard, shard_size, least(16 * count(*), 3 * shard_size) AS take, ('0x' || substr(md5('13:' || none::VARCHAR || ':' || name || ':' || shard), 1, 8))::BIGINT % shard_size AS begin
       FROM won2 WHERE r <= seats GROUP BY none, name, shard, shard_size),
a AS (SELECT *, COALESCE(sum(size) OVER (PARTITION BY none, name, shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM h)
SELECT doc_id, size, source_size, target, CASE WHEN none THEN NULL ELSE name END AS source,
       CAST(COALESCE(take // shard_size * size + greatest(0, least(pos + size, least(begin + take % shard_size, shard_size)) - greatest(pos, begin)) + greatest(0, least(pos + size, begin + take % shard_size - shard_size) - pos), 0) AS BIGINT) AS taken
FROM a LEFT JOIN q2 USING (none, name, shard)"""


def oracle_sql() -> dict[str, str]:
    """The others need models, tokenizers, CRC-32, XXH64 or approximate matching; tests hold them against plain versions."""
    return {"op4_embedding_dedup": _OP4_SQL, "op5_license_scan": _op5_sql(), "op13_source_mix": _OP13_SQL}
