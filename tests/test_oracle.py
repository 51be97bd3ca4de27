"""Every registered query against its DuckDB oracle on the smallest driver tables.

Set VELLUM_ORACLE_ALL=0 to run only a quick subset."""

import os

import pytest

from tests.conftest import SF_SMALL
from vellum.plans.catalog import QUERIES

QUICK = ["top_words", "word_tokens", "clean_social_text", "score_probabilities", "tfidf", "sample_documents",
         "classification_metrics", "attach_truncated", "parse_time"]
NAMES = sorted(QUERIES) if os.environ.get("VELLUM_ORACLE_ALL", "1") != "0" else QUICK


@pytest.fixture(scope="module")
def con():
    from vellum.plans.verify import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    from vellum.plans.verify import compare
    ok, msg = compare(spark, con, name, SF_SMALL)
    if ok is None:
        pytest.skip(msg)
    assert ok, msg
