"""Tables that several tests read."""

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
