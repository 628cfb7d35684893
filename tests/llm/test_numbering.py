from collections import Counter

import lodestone.llm.numbering as m
from lodestone.session import cut_lineage


def test_equal_rows_of_one_hot_group_are_dealt_out_and_numbered(spark, monkeypatch):
    monkeypatch.setattr(m, "PART_ROWS", 10)
    rows = [(0, "same")] * 200 + [(0, str(i)) for i in range(50)] + [(1, "x")] * 3
    df = cut_lineage(spark.createDataFrame(rows, "g int, v string").repartition(3))
    got = m.gapless(df, ["g"], ["v"], "n", len(rows)).collect()
    assert Counter((x.g, x.v) for x in got) == Counter(rows) and got[0].asDict().keys() == {"g", "v", "n"}
    for g in (0, 1):
        assert sorted(x.n for x in got if x.g == g) == list(range(sum(r[0] == g for r in rows)))


def test_empty_table(spark):
    assert m.gapless(cut_lineage(spark.createDataFrame([], "g int, v string")), ["g"], ["v"], "n", 0).collect() == []
