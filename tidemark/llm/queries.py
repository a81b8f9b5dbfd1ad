"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import toxicity
from tidemark.llm.byte_bpe import decode, encode, n_tokens
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.exact_topk import exact_top_k
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.multi_index import multi_index
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.secret_scan import secret_scan
from tidemark.llm.suffix_array import suffix_array_dedup
from tidemark.llm.suffix_tree import suffix_tree_dedup
from tidemark.llm.vector_codes import codebooks_sha256, hex_code, vector_codes, with_label_error


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="largest").drop("uid")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_documents(spark, sf_dir)).drop("text")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Domains are the labelled kinds of documents, quality and toxic; these are the shares of words they are to have.
TARGETS = {"quality 1, toxic 0": 0.80, "quality 0, toxic 0": 0.12, "quality 1, toxic 1": 0.065, "quality 0, toxic 1": 0.015}


def domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.format_string("quality %d, toxic %d", "quality", "toxic").alias("domain")).where("quality IS NOT NULL AND toxic IS NOT NULL")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_error(hex_code(codes)).withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op2_multi_index": op2_multi_index,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_array": op8_suffix_array,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_vector_codes": op13_vector_codes,
}

_INTEGERS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))))"""


def _codes_sql(rounds: int = 2) -> str:
    """Parts p (16), entries c (part, entry, components) before each round, and what each part is assigned to."""
    step = """,
             a{i} AS (SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
                      FROM (SELECT id, p.part, entry, list_sum(list_transform(list_zip(p.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{i} c ON p.part = c.part) GROUP BY id, part)"""
    after = """,
             m{i} AS (SELECT part, entry, place, floor(sum(x) / count(*)) AS x FROM (SELECT p.part, entry, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM a{i} a JOIN p ON a.id = p.id AND a.part = p.part) GROUP BY 1, 2, 3),
             c{j} AS (SELECT c.part, c.entry, coalesce(m.w, c.w) AS w FROM c{i} c LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS w FROM m{i} GROUP BY 1, 2) m ON c.part = m.part AND c.entry = m.entry)"""
    body = "".join(step.format(i=i) + after.format(i=i, j=i + 1) for i in range(rounds)) + step.format(i=rounds)
    return f"""
        WITH {_INTEGERS},
             n AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS id FROM e),
             p AS (SELECT id, part, list_slice(v, len(v) // 16 * part + 1, len(v) // 16 * (part + 1)) AS w FROM n, (SELECT unnest(range(16)) AS part)),
             c0 AS (SELECT part, id - 1 AS entry, w FROM p WHERE id <= 64){body},
             h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM (SELECT part, entry, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM c{rounds})),
             r AS (SELECT n.vec_id, n.label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} a JOIN n ON a.id = n.id GROUP BY n.id, n.vec_id, n.label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r, h"""


ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
             w AS (SELECT doc_id, p, list_extract(a, p) || chr(10) || list_extract(a, p + 1) || chr(10) || list_extract(a, p + 2) AS x
                   FROM l, LATERAL (SELECT unnest(range(1, len(a) - 1)) AS p)),
             r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS n FROM w),
             gone AS (SELECT DISTINCT doc_id, p + j AS p FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
             rows AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS p FROM l)
        SELECT rows.doc_id, count(*) AS n_lines, count(gone.p) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY rows.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
        FROM rows LEFT JOIN gone ON rows.doc_id = gone.doc_id AND rows.p = gone.p GROUP BY rows.doc_id""",
    "op5_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(a, i, i + 4), ' ') AS x FROM w, LATERAL (SELECT unnest(range(1, greatest(len(a) - 3, 2))) AS i) WHERE len(a) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
             r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
             g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g ON t.x = g.x""",
    "op8_suffix_array": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
             s AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 800)) AS m FROM h, LATERAL (SELECT unnest(range(1, n - 398)) AS i)),
             r AS (SELECT doc_id, i, (count(*) OVER (PARTITION BY m) > 1)::INT AS again FROM s),
             p AS (SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(regexp_extract_all(x, '..')) AS byte FROM h),
             c AS (SELECT p.doc_id, p.i, byte, coalesce(max(again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW), 0) AS gone
                   FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i),
             d AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM c)
        SELECT h.doc_id, any_value(h.n)::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
               sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256
        FROM h LEFT JOIN d ON h.doc_id = d.doc_id GROUP BY h.doc_id""",
    "op9_suffix_tree": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
             x AS (SELECT doc_id, i, array_to_string(list_slice(a, i, i + 34), ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(a) - 33)) AS i)),
             r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) > 1 AS again FROM x),
             p AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w),
             c AS (SELECT p.doc_id, p.i, word, coalesce(max(again::INT) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
                   FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i)
        SELECT w.doc_id, count(i) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
        FROM w LEFT JOIN c ON w.doc_id = c.doc_id GROUP BY w.doc_id""",
    "op11_hard_negatives": f"""
        WITH {_INTEGERS},
             l AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM e WHERE label IS NOT NULL),
             s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM l a JOIN l c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_exact_top_k": f"""
        WITH {_INTEGERS}
        SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""",
    "op13_vector_codes": _codes_sql(),
}
