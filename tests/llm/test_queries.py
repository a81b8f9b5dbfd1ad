import pytest

from oracle import compare, connect
from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def test_contracts(spark, sf):
    """Names and kinds of the columns that other programs read."""
    kinds = {
        "op1_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op2_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op10_mixing": {"doc_id": "bigint", "n_tokens": "bigint", "rate": "double"},
        "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
        "op12_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    }
    for name, columns in kinds.items():
        have = dict(QUERIES[name](spark, sf).dtypes)
        assert {c: have[c] for c in columns} == columns
