"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, html_paths, incidence, manifest, periodic, ppm, raking, retrieval_packing, ring, rules, transducer, transcripts, vector_passes

#: Targets of the mix: flatter over sources, somewhat flatter over languages and topics.
MIX: raking.Targets = {"source": 0.5, "lang": 0.7, "topic": 0.8}
MIX_KEEP = 0.6
SHARDS = 24
TOKEN_LIMIT = 1024
#: The id after every document that is packed.
PACKING_END = 2
#: Share of turns whose speaker marker is left out when transcripts are made from conversations, in sixteenths.
UNMARKED = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(id_remainder(7) == 2, F.lit(False)).alias("held_out"))
    return ppm.score(docs, ppm.train(docs.where("not held_out")))


def op3_vector_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_passes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(table(spark, sf_dir, "documents"), SHARDS)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return rules.quality(docs, labels, id_remainder(5) == 0).select("doc_id", "held_out", "score", "predicted")


def op6_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op8_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.recovered(table(spark, sf_dir, "conversations"), UNMARKED)


def op9_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixed(table(spark, sf_dir, "documents"), MIX, MIX_KEEP)


def op10_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.similar_sets(table(spark, sf_dir, "documents"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = retrieval_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACKING_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by id, with the words from some place on replaced by repetitions of the first of them."""
    rest = "array_join(transform(sequence(0, n - 1), i -> get(w, CAST(if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8))) AS INT))), ' ')"
    for name in "wnga":
        rest = re.sub(rf"\b{name}\b", f"d.{name}", rest)  # bound once for each text, not for each word
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
    sized = f"transform(array({words}), w -> named_struct('w', w, 'n', size(w), 'g', h div 10))"
    placed = f"transform({sized}, d -> named_struct('w', d.w, 'n', d.n, 'g', d.g, 'a', d.g % greatest(d.n, 1)))"
    made = f"if(h % 10 = 0, transform({placed}, d -> if(d.n > 0, {rest}, text))[0], text)"
    return docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).selectExpr("doc_id", f"{made} AS text")


def _hex_digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeated_tails(table(spark, sf_dir, "documents")), finish=_hex_digest)
    exact = "CASE WHEN a.length * b.period <> b.length * a.period THEN if(a.length * b.period > b.length * a.period, a, b)"
    exact += " WHEN a.start <> b.start THEN if(a.start < b.start, a, b) ELSE if(a.period < b.period, a, b) END"
    best = F.expr(f"aggregate(runs, get(runs, 0), (a, b) -> {exact})")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = {"text": F.when(id_remainder(3) == 0, text).otherwise(F.col("text"))}
    return manifest.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered=tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_ppm, op3_vector_passes, op4_ring, op5_rules, op6_html_paths, op7_transducer, op8_transcripts, op9_raking, op10_incidence,
        op11_retrieval_packing, op12_periodic_runs, op13_manifest,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || ({0}::VARCHAR), '-')"
_FIELD_X = "CASE WHEN gone THEN '-' ELSE strlen({0}) || ':' || ({0}) END"
#: crc32 of ``id`` (ASCII): every byte is met by the register, which then shifts eight times.
_CRC32 = """xor(4294967295, list_reduce(
  [4294967295] || flatten(list_transform(string_split(coalesce(id, ''), ''), lambda ch: CASE WHEN ch = '' THEN []::BIGINT[] ELSE [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0] END)),
  lambda r, b: xor(xor(r, b) >> 1, 3988292384 * (xor(r, b) & 1))))"""

ORACLE: dict[str, str] = {
    "op1_decontaminate": f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') gram, least(len(w), 10) size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) w FROM documents),
s AS (SELECT DISTINCT size FROM g),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) i FROM d, s WHERE len(w) >= size),
h AS (
  SELECT p.doc_id, p.i, p.size, g.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') gram FROM p) p JOIN g ON p.gram = g.gram
),
hit AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) k FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op12_periodic_runs": f"""
WITH d AS (SELECT doc_id, doc_id::VARCHAR id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
c AS (SELECT doc_id, w, len(w) n, {_CRC32} AS h FROM d),
a AS (SELECT *, CASE WHEN id_there AND h % 10 = 0 AND n > 0 THEN (h // 10) % n END a, h // 10 g FROM (SELECT *, doc_id IS NOT NULL id_there FROM c)),
t AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END w
  FROM a
),
x AS (SELECT doc_id, n, unnest(range(0, n)) i, unnest(w) word FROM t),
pair AS (
  SELECT p.doc_id, s.i - p.i q, p.i FROM x p JOIN x s ON p.doc_id = s.doc_id AND p.word = s.word AND s.i > p.i AND 4 * (s.i - p.i) <= p.n
),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) k FROM pair),
stretch AS (SELECT doc_id, q, min(i) start, count(*) + q length FROM island GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) period FROM stretch GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) lines FROM run GROUP BY doc_id
),
best AS (
  SELECT doc_id, start, length, period FROM run r
  WHERE NOT EXISTS (
    SELECT 1 FROM run o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
      OR (o.length * r.period = r.length * o.period AND (o.start < r.start OR (o.start = r.start AND o.period < r.period))))
  )
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) x FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) n_runs, start, length, period, 1000 * length // period exponent_milli,
  sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(x, '')) collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op13_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, doc_id::VARCHAR id, coalesce(text, '') x, text IS NULL gone,
    concat_ws('', {_FIELD.format('doc_id')}, {_FIELD.format('source')}, {_FIELD.format('lang')}, {_FIELD.format('n_chars')}) head
  FROM documents
),
c AS (SELECT *, {_CRC32} AS crc FROM d),
t AS (SELECT doc_id, lang, sha256(head || {_FIELD_X.format('x')}) leaf,
  sha256(head || {_FIELD_X.format("CASE WHEN crc % 3 = 0 AND doc_id IS NOT NULL THEN " + _LOWER.replace("text", "x") + " ELSE x END")}) seen FROM c),
node AS (
  SELECT 0 lvl, lang grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY lang) size, leaf digest FROM t
  UNION ALL
  SELECT lvl + 1, grp, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE size > 1 GROUP BY lvl, grp, pos // 8
),
sub AS (SELECT grp, digest, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 pos, count(*) OVER () size FROM node WHERE size = 1),
up AS (
  SELECT 0 lvl, pos, size, digest FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY lvl, pos // 8
),
leaves AS (SELECT doc_id, lang, leaf, seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 pos FROM t),
low AS (
  SELECT lvl, grp, pos, string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY lvl, grp, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) l,
    string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY lvl, grp, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) r FROM node WHERE size > 1
),
high AS (
  SELECT lvl, pos, string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) l,
    string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) r FROM up WHERE size > 1
),
step AS (
  SELECT a.lang grp, a.pos leaf_pos, w.lvl, coalesce(w.l, '') l, coalesce(w.r, '') r
  FROM leaves a JOIN low w ON w.grp IS NOT DISTINCT FROM a.lang AND w.pos = a.pos // CAST(pow(8, w.lvl) AS BIGINT)
  UNION ALL
  SELECT a.lang, a.pos, 100 + h.lvl, coalesce(h.l, ''), coalesce(h.r, '')
  FROM leaves a JOIN sub s ON s.grp IS NOT DISTINCT FROM a.lang JOIN high h ON h.pos = s.pos // CAST(pow(8, h.lvl) AS BIGINT)
),
path AS (SELECT grp, leaf_pos, string_agg(l || r, '' ORDER BY lvl) siblings, list({{'l': l, 'r': r}} ORDER BY lvl) steps FROM step GROUP BY ALL),
fold AS (
  SELECT lang, pos, 1 k, seen x FROM leaves
  UNION ALL
  SELECT f.lang, f.pos, k + 1, sha256(steps[k].l || x || steps[k].r) FROM fold f JOIN path p ON p.grp IS NOT DISTINCT FROM f.lang AND p.leaf_pos = f.pos WHERE k <= len(steps)
)
SELECT a.doc_id, a.leaf, s.digest subroot, (SELECT digest FROM up WHERE size = 1) root, sha256(coalesce(p.siblings, '')) proof_sha256,
  arg_max(f.x, f.k) folded_root, arg_max(f.x, f.k) = (SELECT digest FROM up WHERE size = 1) verified
FROM leaves a JOIN sub s ON s.grp IS NOT DISTINCT FROM a.lang
LEFT JOIN path p ON p.grp IS NOT DISTINCT FROM a.lang AND p.leaf_pos = a.pos
JOIN fold f ON f.lang IS NOT DISTINCT FROM a.lang AND f.pos = a.pos
GROUP BY ALL
""",
}
