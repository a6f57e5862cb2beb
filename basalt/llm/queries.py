"""The queries opN_<name>: each applies one operator to its whole table with production parameters.

QUERIES maps a name to a callable (spark, sf_dir) -> DataFrame, SQL a name to DuckDB SQL where
SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_scores

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_quality(docs.where(~held_out), _table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    models = fit_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.to_json("shares").alias("shares"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import read_codes, write_codes

    return read_codes(write_codes(_table(spark, sf_dir, "documents"), _vocabulary()))


def _counts(spans: str, kinds: tuple[str, ...]) -> list:
    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, personal_spans

    found = personal_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counts("base", KINDS), F.sha2(_spelled("base"), 256).alias("base_sha256"), _spelled("found").alias("spans"))


def _spelled(spans) -> F.Column:
    """kind:start:end of all spans in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"), _vocabulary())


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "reparameterised")


def op9_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_conversations(format_conversations(turns.union(own)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, secret_spans

    found = secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *_counts("found", BASE), F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(F.col("found")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_language_id, op3_ann_tree, op4_bpe_codec, op5_token_files, op6_pii, op7_ngram_jaccard_join, op8_decontamination, op9_chat_template, op10_secret_scan)
}

_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i+2], chr(1)) FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS g FROM w),
n AS (SELECT d.doc_id, COUNT(g) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b)
SELECT n.doc_id, n.n AS n_shingles, MIN(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

# roles are plain lower-case words in this table, so a mark is as long as its role
_CHAT = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
x AS (SELECT *, 14 + length(role) + length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
  + coalesce(list_sum([length(h) - 2 FOR h IN regexp_extract_all(text, '#{3,}')]), 0) AS chars FROM r)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
SUM(chars)::BIGINT AS formatted_chars FROM x GROUP BY conv_id"""

#: The others rest on learned models, tokenizers or added spans; tests hold them against brute force or libraries.
SQL: dict[str, str] = {"op7_ngram_jaccard_join": _JACCARD, "op9_chat_template": _CHAT}
