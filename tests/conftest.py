import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pagerel.session import local_session

    s = local_session(cores="4", shuffle_partitions=4, app="pagerel-tests")
    yield s


@pytest.fixture(scope="session")
def ps(spark):
    from fixtures import PAGES
    from pagerel.operators.tree import PageSet

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return PageSet(pages)


def node_id(ps, page_id, pred):
    """First node id on a page matching a Column predicate."""
    from pyspark.sql import functions as F

    r = ps.nodes.filter((F.col("page_id") == page_id) & pred).orderBy("node_id").select("node_id").collect()
    return [x[0] for x in r]
