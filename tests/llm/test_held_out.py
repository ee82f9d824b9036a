"""Operator 4 on the held-out rows of the test tables: what README says of them."""

import os

import pytest

from foliant.llm import toxicity
from foliant.llm.base import table

DATA = "/root/testdata"


@pytest.mark.parametrize(("sf", "least", "most_false"), [("sf0.01", 10 / 14, 2), ("sf0.1", 0.95, 11)])
def test_toxic_documents_that_no_label_was_learned_from(spark, sf, least, most_false):
    where = f"{DATA}/{sf}"
    if not os.path.isdir(where):
        pytest.skip("test tables are not there")
    found = toxicity.op4_toxicity(spark, where).where("held_out").select("doc_id", "predicted")
    got = found.join(table(spark, where, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    toxic = n.get((1, 1), 0) + n.get((1, 0), 0)
    assert n.get((1, 1), 0) >= least * toxic - 1e-9 and n.get((0, 1), 0) <= most_false
