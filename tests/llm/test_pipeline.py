import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""))


def texts(n):
    return [" ".join(f"word{k * 97 + j * j % 31}" for j in range(40)) for k in range(n)]


def test_near_duplicates_by_row(spark):
    a, b, c, d = texts(4)
    rows = [row(1, a), row(1, b), row(None, c), row(2, d), row(3, a + " more"), row(None, d + " more"), row(7, b), row(7, b), row(8, None), row(9, ""), row(9, ""), row(None, None)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted([(False, 1, a), (False, 1, b), (True, 0, c), (False, 2, d), (False, 8, ""), (False, 9, ""), (True, 0, "")])


def test_mix_by_row(spark):
    a, b, c, _ = texts(4)
    rows = [row(1, a), row(1, b), row(None, c), row(2, a), row(2, a), row(5, None), row(6, b, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pipeline.mix(spark, docs, "").collect()
    held = {}
    for r in rows:
        held[r] = held.get(r, 0) + 1
    taken = {}
    for r in map(tuple, got):
        taken[r] = taken.get(r, 0) + 1
    assert taken.keys() <= held.keys() and all(n <= 2 * held[r] for r, n in taken.items())
    words = sum(len((r[1] or "").split()) * n for r, n in taken.items())
    assert abs(words - 1.5 * 40 * 6) <= 80
    assert sorted(map(str, got)) == sorted(map(str, pipeline.mix(spark, docs, "").collect()))


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_of_nothing_and_with_other_columns(spark, stage):
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, "").count() == 0
    a, b, *_ = texts(2)
    more = spark.createDataFrame([(*row(1, a), 5, "x", 2.0), (*row(2, b), 5, "x", 2.0)], SCHEMA + ", size int, component_id string, copies double")
    out = stage(spark, more, "")
    if stage is not pipeline.tokens:
        assert out.columns == more.columns
    out.collect()
