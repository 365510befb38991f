"""What a stage of the pipeline and a training hold at a time."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import toxicity
from gaugeline.llm.support import ARROW_BYTES


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "some words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_a_stage_that_runs_alone_bounds_its_batches(spark, tables, name, stage):
    schema = "doc_id long, text string, lang string, source string"
    texts = spark.range(40).selectExpr("id doc_id", "repeat('word ', 20000) text", "'en' lang", "'web' source").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(ARROW_BYTES, None)
    try:
        spark.conf.set(ARROW_BYTES, str(64 << 20))
        stage(spark, spark.createDataFrame([], schema), tables)
        found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)
    assert len(found) >= 4 and max(found) < (1 << 20) + 2 * 100_000


def test_a_vocabulary_is_cut_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    words = list({rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in rng.integers(1, 12, 30_000)})
    size = np.array([len(w) for w in words])
    ends, at_once, seen = np.cumsum(size), toxicity.subwords, []

    def counted(data, starts, ends):
        seen.append(len(starts))
        return at_once(data, starts, ends)

    monkeypatch.setattr(toxicity, "subwords", counted)
    got = toxicity.vocabulary_subwords(words)
    want = at_once(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    assert max(seen) <= 1 << 13 and sum(seen) == len(words)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
