"""How large buckets of near-duplicate candidates are dealt into cells."""

from collections import Counter

import pytest

from corvane.llm import minhash
from corvane.llm.common import Workspace


def dealt(spark, members):
    named = spark.createDataFrame([(b, 0, i, n, c) for b, i, n, c in members], "bucket long, band int, doc_id long, n long, component long")
    return minhash._dealt(named, Workspace(spark, "test")).collect()


def test_beside_one_outsider_each_member_moves_once(spark):
    rows = dealt(spark, [(1, i, 10, 0) for i in range(20_000)] + [(1, 99_999, 10, 7)])
    ys = -(-20_001 // minhash.BLOCK)
    assert len(rows) == 20_000 + ys and max(Counter(r.y_block for r in rows).values()) < 2 * minhash.BLOCK
    assert sum(r.few for r in rows) == ys and {r.doc_id for r in rows if r.few} == {99_999}


@pytest.mark.parametrize(("block", "shingles"), [(4, 1 << 20), (1 << 12, 60)])
def test_every_pair_across_components_meets_in_one_cell(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    members = [(5, i, 1 + i % 13, 0 if i < 25 else i % 4) for i in range(40)]
    component, met = {i: c for _, i, _, c in members}, Counter()
    cells = {}
    for r in dealt(spark, members):
        cells.setdefault((r.bucket, r.x_block, r.y_block), []).append(r)
    for rows in cells.values():
        assert len({r.doc_id for r in rows}) == len(rows)
        met.update((x.doc_id, y.doc_id) for x in rows for y in rows if x.few and y.many and x.doc_id != y.doc_id)
    main = Counter(component.values()).most_common(1)[0][0]
    assert met == Counter({(x, y): 1 for x in component for y in component if x != y and component[x] != main}) and len(cells) > 4
