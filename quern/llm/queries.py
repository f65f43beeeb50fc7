"""The thin queries of this subpackage: each applies one operator to its whole table and derives its digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, chat, codes, gumbel, langid, lines, overwrite, packing, quality, topk, toxicity
from quern.llm.near_dup import NearDup, near_duplicates
from quern.llm.shared import scratched, shared_dir, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").alias("n_removed"), "removed_lines", "removed_for", F.length("text").alias("kept_chars"), F.xxhash64("text").alias("kept_hash"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(shingle=2)).drop("text_hash")


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS hop FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.hop),
m AS (SELECT id, min(hop) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON m.id = doc_id LEFT JOIN n USING (doc_id)
"""



def op4_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gumbel.Gumbel(public_tokenizers.path("piece_bpe_32k.model"))
    return gumbel.encode_samples(table(spark, sf_dir, "documents"), p, ids=False)


@scratched
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_trees(chat.threads(turns)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '&(amp|lt|#91);', '&amp;\1;', 'g'),
      '<(<SYS>>|</SYS>>|/?s>|/ROLE>)', '&lt;\1', 'g'), '\[(/?INST\]|/?ROLE\])', '&#91;\1', 'g') AS body,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS marks FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + marks)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the folds of the labelled rows. A null doc_id has the remainder -1, so it is not held out; no label goes with it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


@scratched
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = quality.Boosting()
    trees = quality.fit(docs, labels.where(remainder(5) != 0), p)
    held = (remainder(5) == 0).alias("held_out")
    return quality.score(docs, trees).select("doc_id", held, "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@scratched
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN))


@scratched
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = toxicity.Toxicity()
    model = toxicity.fit(docs, labels.where(remainder(4) != 2), p)
    held = (remainder(4) == 2).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    p = langid.LangId(public_tokenizers.path("piece_bpe_32k.model"))
    held = (remainder(5) == 0).alias("held_out")
    return langid.identify(docs, docs.where(remainder(5) != 0), p).select("doc_id", held, "lang_pred", "score")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digest(made, path)


@scratched
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    return out.select("vec_id", code, "error", "label_error", "codebooks_sha256")


def _op12_sql(rounds: int = 4) -> str:
    """Each round as one view: distances to every entry, the least with its index, and the entries' new components."""
    views = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """p AS MATERIALIZED (
  SELECT row_id, vec_id, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(4) t(part))""",
        """b0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS entry FROM p) WHERE entry < 256)""",
    ]
    for r in range(rounds + 1):
        views.append(f"""a{r} AS MATERIALIZED (
  SELECT row_id, part, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := entry)) AS best
  FROM p JOIN b{r} b USING (part) GROUP BY row_id, part)""")
        if r < rounds:
            views.append(f"""b{r + 1} AS MATERIALIZED (
  WITH s AS (
    SELECT part, best.entry AS entry, pos, sum(p.x[pos])::BIGINT AS s, count(*) AS n
    FROM a{r} JOIN p USING (row_id, part), range(1, len(p.x) + 1) t(pos) GROUP BY ALL),
  m AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s GROUP BY ALL)
  SELECT part, entry, coalesce(m.c, o.c) AS c FROM b{r} o LEFT JOIN m USING (part, entry))""")
    return f"""WITH {", ".join(views)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
o AS (
  SELECT row_id, string_agg(lower(printf('%02x', best.entry::INTEGER)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY row_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (row_id), h
"""


OP12_SQL = _op12_sql()


#: 2024-03-20 00:00 UTC in microseconds: rows that arrived before it are early.
OP13_CUTOFF = 1_710_892_800_000_000


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes its layout into a new folder of spark.checkpoint.dir, which stays."""
    sales = table(spark, sf_dir, "sales")
    folder = f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"
    done = overwrite.overwrite_late(overwrite.with_copies(sales), OP13_CUTOFF, 1 + sales.count() // 1100, folder)
    return overwrite.describe(spark, folder, sales, done["start"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_quantisation": op1_additive_quantisation,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_gumbel_segmentations": op4_gumbel_segmentations,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_bpe": op11_bpe,
    "op12_vector_codes": op12_vector_codes,
    "op13_late_overwrite": op13_late_overwrite,
}
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op12_vector_codes": OP12_SQL,
}
