"""What the stored training table holds, and how much text a Python function is given at once."""

from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from harness import roles

TABLES = {
    "documents": ([(i, "de" if i % 3 else "en", "crawl", 900 + 900 * i, f"some report about the subject {i} Zusammenfassung")
                   for i in range(8)], "doc_id long, lang string, source string, n_chars long, text string"),
    "labels": ([(i, 1, 0) for i in range(6)] + [(6, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int"),
    "conversations": ([(i, "user", i) for i in range(3)], "conv_id long, role string, turn int"),
}


def test_the_training_table_is_stored_without_texts_made_of_its_columns(spark, tmp_path):
    for name, (rows, schema) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = roles.stored_training(spark, str(tmp_path))
    key = (spark.sparkContext.applicationId, str(tmp_path), "training")
    assert not {"feature_text", "baseline_text"} & set(roles._stored[key].columns)
    whole = roles.training(spark, str(tmp_path))
    assert got.schema.names == whole.schema.names and got.count() == whole.count() > 0
    assert got.exceptAll(whole).isEmpty()


def test_batches_for_python_functions_are_bounded(spark):
    @pandas_udf("long")
    def size(texts):
        return texts * 0 + len(texts)

    assert spark.range(0, 9000, 1, 1).select(size("id").alias("n")).agg(F.max("n")).first()[0] <= 2000
