"""Memory bounds of the corpus operators."""

import pyarrow as pa

from barloom.llm.common import in_small_batches


def test_batches_of_whole_texts_stay_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        rows = in_small_batches(spark.range(0, 3000, 1, 1))
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 3000 and max(got) <= 500
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        in_small_batches(rows)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
