"""Workers of the pipeline hold a few texts of a batch as strings, not the whole batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from hiremill.llm import common, nearcopies, simhash


def test_texts_in_slices():
    texts = [None if i % 7 == 0 else f"text {i}" for i in range(3 * common.SLICE_ROWS + 1)]
    parts = list(common.text_slices(pa.array(texts, pa.string())))
    assert [t for part in parts for t in part] == texts
    assert max(map(len, parts)) == common.SLICE_ROWS and not list(common.text_slices(pa.array([], pa.string())))


def test_prints_of_texts(spark, small):
    texts = [None, "", " \n", "two words", *[r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]]
    texts *= 3  # more than a slice
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").coalesce(1)
    own = nearcopies._prints_column(F.col("text"), 5)
    got = {r["i"]: r["own"] for r in rows.select("i", own.alias("own")).collect()}
    bands = nearcopies.band_keys([nearcopies.shingles(t) for t in texts])
    for i, t in enumerate(texts):
        assert got[i]["node"] == nearcopies.text_key(t) and got[i]["bands"] == bands[i].tolist()
        assert got[i]["fp"] % (1 << 64) == simhash.fingerprint(t, 5)
