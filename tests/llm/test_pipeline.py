import random
import re
from pathlib import Path

import corpus_pipeline as p
from lodestone.llm.op_anchor_simhash import simhash
from lodestone.session import shared_folder
from tests.llm.conftest import ODD
from tests.llm.test_classifiers import corpus


def folders(spark):
    return [str(x) for x in Path(shared_folder(spark).removeprefix("file:")).glob("pipeline-*/*")]


def test_stages_in_turn(spark, documents, tmp_path):
    rows, langs, toxic = corpus(240)
    r = random.Random(9)
    for k in range(30):
        rows.append((1000 + k, "  " * (k % 3) + r.choice(rows[:40])[1]))
    docs = documents([*ODD, *rows], langs)  # with columns score and fp, which clash with the operators' own
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in p.STAGES] == ["language", "toxicity", "exact_dedup", "near_dedup", "packing"]
    kept = [docs]
    for name, stage in p.STAGES[:4]:
        out = stage(spark, kept[-1], str(tmp_path))
        assert out.columns == p.COLUMNS
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{x.doc_id for x in k.collect()} for k in kept]
    assert not ids[1] & {1, 2, 3} and ids[1] >= set(langs)  # texts without a letter go, clean ones stay
    gone = ids[1] - ids[2]
    assert sum(toxic.get(i, 0) for i in gone) > 0.8 * sum(toxic.values()) and sum(not toxic[i] for i in gone if i in toxic) <= 2
    texts = [re.sub(r"[\x20\x09-\x0D]", "", x.text) for x in kept[3].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", x.text) for x in kept[2].collect()}
    left, before = [simhash(x.text) for x in kept[4].collect()], [simhash(x.text) for x in kept[3].collect()]
    assert all(bin(a ^ b).count("1") > 2 for k, a in enumerate(left) for b in left[:k])
    assert all(any(bin(a ^ b).count("1") <= 2 for b in before) for a in left) and len(left) <= len(before)
    before = set(folders(spark))
    packed = p.run(spark, str(tmp_path)).collect()
    left_over = sorted(set(folders(spark)) - before)
    assert len(left_over) == 1 and left_over[0].endswith("packing")
    assert {x.doc_id for x in packed} == ids[4] and p.ORACLE_SQL is None


def stored(spark, docs, path):
    docs.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def texts_of(out):
    return sorted((str(x.doc_id), x.text or "") for x in out.collect())


LONG = "one two three " * 40_000
CASES = [(5, "a b"), (None, "ab"), (None, "zz"), (7, "a  b "), (8, None), (9, ""), (9, " "), (10, LONG), (11, LONG + " "), (12, "zz"), (12, "zz"), (12, "other words here")]


def test_exact_dedup_tells_rows_apart(spark, documents, tmp_path):
    for clash in ("uid", "_row", "row", "kept", "size"):
        docs = stored(spark, documents(CASES).withColumnRenamed("score", clash), tmp_path / "t")
        # of texts of equal length the smallest id stays, a null one last
        assert texts_of(p.exact(spark, docs, "")) == sorted([("7", "a  b "), ("9", " "), ("11", LONG + " "), ("12", "zz"), ("12", "other words here")])


def test_near_dedup_tells_rows_apart(spark, documents, tmp_path):
    docs = stored(spark, documents(CASES), tmp_path / "t")
    out = p.near(spark, docs, "")
    got = [x.text for x in out.collect()]
    assert out.columns == p.COLUMNS and len({simhash(t) for t in got}) == len(got)
    assert {simhash(t) for t in got} == {simhash(t) for _, t in CASES}
    assert {("5", "a b"), ("8", ""), ("10", LONG), ("12", "zz"), ("12", "other words here"), ("None", "ab")} == set(texts_of(out))


def test_classifier_stages_take_odd_rows(spark, documents, tmp_path):
    rows, langs, toxic = corpus(240)
    docs = stored(spark, documents([*rows, *CASES, (13, rows[0][1]), (13, rows[0][1])], langs), tmp_path / "documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(None, 1, 1), (99999, 0, 1), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = p.language(spark, docs, "")
    assert kept.columns == p.COLUMNS and not {x.doc_id for x in kept.filter("text is null or trim(text) = ''").collect()}
    assert kept.filter("doc_id = 13").count() in (0, 2) and {x.doc_id for x in kept.collect()} >= {i for i, t in toxic.items()}
    clean = p.toxicity(spark, docs, str(tmp_path))
    assert clean.columns == p.COLUMNS and clean.filter("text is null or trim(text) = ''").count() == 3
    assert clean.filter("length(text) > 100000").count() == 2 and clean.filter("doc_id is null").count() == 2


def test_stages_of_an_empty_table(spark, documents, tmp_path):
    docs = stored(spark, documents([]), tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in p.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert p.run(spark, str(tmp_path)).collect() == []


def test_all_stages_equal_brute_force_from_the_predictions(spark, documents, tmp_path):
    """What the classifiers keep is deduplicated as by brute force, and packed whole."""
    rows, langs, toxic = corpus(120, seed=5)
    rows += [(500 + k, " " * k + rows[k][1]) for k in range(20)] + [(600 + k, rows[k][1] + " x") for k in range(20)]
    docs = stored(spark, documents(rows, langs), tmp_path / "documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    judged = stored(spark, p.toxicity(spark, stored(spark, p.language(spark, docs, ""), tmp_path / "l"), str(tmp_path)), tmp_path / "c").collect()
    best = {}
    for x in judged:
        k = re.sub(r"[\x20\x09-\x0D]", "", x.text)
        best[k] = min(best.get(k, (1, 0)), (-len(x.text), x.doc_id, x.text))
    left = {i: simhash(t) for _, i, t in best.values()}
    root = {i: i for i in left}
    for _ in left:
        for a in left:
            for b in left:
                if bin(left[a] ^ left[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {x.doc_id for x in p.run(spark, str(tmp_path)).collect()} == set(root.values())
