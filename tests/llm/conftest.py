import pytest
from llm_fixtures import EDGES, frame


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, blank, short, equal and very long texts; a repeated row and a row without doc_id."""
    ids = [*range(len(EDGES)), 5, None]
    texts = [*EDGES, EDGES[5], EDGES[5]]
    return frame(spark, texts, ids, ["b", None, "a", "b", "b", "a", None, "a", "c", "a", "b"])


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
