"""The registered queries of this package and their DuckDB SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import (align, chat, decontaminate, exact_dedup, language_id, licenses, mixing, packing, pii, quality, simhash,
                           spelling, vectors)
from tokenloom.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_ranking(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


CONTROL_CASE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_prefix_trees(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_CASE, "conv_id long, turn long, role string, text string"))
    nodes = Scratch(spark, "chat").keep(chat.prefix_trees(rows, tokenizer_path()))
    return chat.read_back(nodes)


def op6_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op9_source_mixing(spark, sf_dir):
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "copies", "taken")


def op10_pii_surrogates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymize(docs, key="tokenloom")


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"), spelling.keyed_deletion(199))


def op12_decontamination(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark, sf_dir):
    return align.align(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_ranking, op3_exact_dedup, op4_license_scan, op5_chat_prefix_trees, op6_embedding_near_dedup,
                              op7_language_id, op8_simhash_near_dedup, op9_source_mixing, op10_pii_surrogates, op11_spelling_variants,
                              op12_decontamination, op13_token_alignment)}

ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_chat_prefix_trees": r"""
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
                   VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        a AS (SELECT conv_id, count(*) AS n_turns,
                     string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                     coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                     sum(24 + length(regexp_replace(coalesce(role, ''), '\\|<\||</?s>|\[/?INST\]|<</?SYS>>', '##', 'g'))
                         + length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')))::BIGINT
                       AS formatted_chars
              FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               formatted_chars FROM a""",
    "op12_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM documents),
        i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM benchmark),
        s AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS g
              FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS k
                    FROM (SELECT item, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0))),
        g AS (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS g
              FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM s))),
        h AS (SELECT r, k, g.m, item FROM g JOIN s ON g.m = s.m AND g.g = s.g),
        p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM h) GROUP BY r),
        t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN t ON d.r = t.r""",
    "op9_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
                   FROM documents),
        c AS (SELECT *, length(bin(size)) AS bits, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
              FROM d),
        e AS (SELECT *, bits * 64 + CASE WHEN bits > 6 THEN size >> (bits - 6) ELSE size END AS cls FROM c),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
              FROM d GROUP BY source),
        q AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s),
        l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0))
                        / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
              FROM q WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size,
                     least(cap, w * (SELECT lev FROM l WHERE ratio >= lev ORDER BY ratio, lev LIMIT 1)) AS target FROM l),
        r AS (SELECT *, CASE WHEN target > 0 THEN least(round(target / source_size * 1000000), 3000000)::BIGINT ELSE 0 END AS f
              FROM t),
        n AS (SELECT source, cls, count(*) AS n FROM e GROUP BY source, cls),
        k AS (SELECT n.source, n.cls, f // 1000000 AS whole, target, source_size,
                     coalesce(sum(n) OVER b, 0)::BIGINT AS off, n, f % 1000000 AS part
              FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
              WINDOW b AS (PARTITION BY n.source ORDER BY n.cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        x AS (SELECT e.doc_id, e.size, k.source_size, k.target,
                     (whole + CASE WHEN row_number() OVER (PARTITION BY e.source, e.cls ORDER BY h)
                       <= (500000 + (off + n) * part) // 1000000 - (500000 + off * part) // 1000000
                       THEN 1 ELSE 0 END)::BIGINT AS copies
              FROM e JOIN k ON e.source IS NOT DISTINCT FROM k.source AND e.cls = k.cls)
        SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM x""",
}
