"""Documents made from one template that do not link: what the Jaccard join stores must grow with them, not with their pairs."""

from __future__ import annotations

from collections import Counter

import pytest

from causalrisk.llm import jaccard
from causalrisk.llm.jaccard import jaccard_components
from tests.llm.cases import prose


@pytest.mark.parametrize("shared, own", [(85, 15), (60, 40)])
def test_rows_of_templates_grow_with_the_documents(spark, monkeypatch, shared, own):
    written: Counter = Counter()
    plain = jaccard.stored

    def counting(df, label):
        out = plain(df, label)
        written[label] += out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    template = prose(1, shared)
    sizes = {}
    for n in (200, 400, 800):
        own_words = [[f"w{i}x{k}" for k in range(own)] for i in range(n)]
        rows = [(i, " ".join([*w[: own // 2], template, *w[own // 2 :]])) for i, w in enumerate(own_words)]
        written.clear()
        out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert all(r.component_id == r.doc_id for r in out) and len(out) == n
        sizes[n] = sum(v for k, v in written.items() if k in ("asks", "sieved", "links", "wanted"))
    assert sizes[800] <= 4 * 800, sizes
