from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", reason="the pipeline is not part of this copy", exc_type=ModuleNotFoundError)


def test_stages_act_in_turn(spark, prose, tmp_path):
    texts = prose(12, least=100, most=160)
    bad = {20: "junk", 21: None, 22: "", 23: "x y z " * 50}
    near = {30: texts[0].replace(texts[0].split()[40], "changed", 1)}
    leak = {40: texts[1] + "\n" + " ".join(f"passage{i} of the" for i in range(20))}
    rows = [(i, t, "en", "src", len(t or ""), "more") for i, t in [*enumerate(texts), *bad.items(), *near.items(), *leak.items()]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", " ".join(f"passage{i} of the" for i in range(5)))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted(r.doc_id for r in docs.collect()))
    assert ids[0] == [*range(12), 30, 40]
    assert ids[1] == ids[0]
    assert ids[2][:12] == [*range(12)]
    assert 40 not in ids[3] and ids[3][:12] == [*range(12)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids[3])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)
