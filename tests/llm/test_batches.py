"""Texts are handed to Python in batches of bounded bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import common, near_texts, quality_gam


def _largest(docs):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return docs.select("text").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("stage", [lambda d, _: near_texts.keep_one(d), lambda d, labels: quality_gam.keep_good(d, labels)])
def test_batches_are_bounded(spark, no_labels, stage):
    docs = spark.range(2000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id", F.repeat(F.lit(" a"), 2500)).alias("text"))
    spark.conf.unset(common.ARROW_BYTES_KEY)
    try:
        stage(docs.limit(3), no_labels).count()
        assert _largest(docs) < 2 * common.ARROW_BYTES
        spark.conf.set(common.ARROW_BYTES_KEY, "32m")  # a bound of the session's own stays
        stage(docs.limit(3), no_labels).count()
        assert spark.conf.get(common.ARROW_BYTES_KEY) == "32m"
    finally:
        spark.conf.unset(common.ARROW_BYTES_KEY)
