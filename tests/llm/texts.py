"""Small helpers of the text operators' tests."""

import duckdb

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def table_rows(sf_dir, columns="doc_id, text", name="documents"):
    return duckdb.connect().sql(f"select {columns} from read_parquet('{sf_dir}/{name}.parquet')").fetchall()


def docs_frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    data = [(i, t, "en", "s", len(t or ""), 1, "x", -1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "bucket int, ranges string, n_words int")
