import pytest

SF = "/root/testdata/sf0.001"
#: Rows that real tables may hold; the extra columns clash with names that operators use.
EDGE = [
    (900001, None, None, None), (900002, "", "en", "src0"), (900003, " \n\t ", "en", None), (900004, "word", None, "src0"), (None, "an id is missing here, twice", "en", "src1"),
    (900005, "twice the same row of some length to look at", "en", "src0"), (900005, "twice the same row of some length to look at", "en", "src0"),
    (900006, "x" * 300_000, "en", "src0"), (900007, "7 " * 30_000, "de", "src0"), (900008, "日本語のテキスト und Русский text ½", "en", "src0"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, lang, s, 0, 1, "x", True, b"y") for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, spans string, kept boolean, tokens binary")


@pytest.fixture(scope="session")
def folder(spark, edge_docs, tmp_path_factory):
    """The smallest tables, documents with the edge rows added."""
    top = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionByName(edge_docs.select(*docs.columns)).coalesce(3).write.parquet(f"{top}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    long = "<p>" + "é" * 60 + "</p>"
    more = [(9001, None, long), (9002, "http://a\r\nb", long), (9003, "http://c", long), (9003, "http://c", long), (9004, "u", None), (9005, "u", ""), (9006, None, "short"), (9007, "", "short")]
    pages.unionByName(spark.createDataFrame(more, pages.schema)).coalesce(2).write.parquet(f"{top}/pages.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "Same ROW of"), (9004, "same row, of some length to look at twice")], bench.schema)).write.parquet(f"{top}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.fixture(scope="session")
def docs(spark, folder):
    """All documents as (id, text) on the driver."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
