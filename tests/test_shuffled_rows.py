"""How many rows operators shuffle, and how often."""

from quarry.operators import lookups
from quarry.plans import vector_queries


def _shuffled(spark, df):
    """The result, and the rows that its stages wrote for a shuffle."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()

    def stages():
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    rows = df.collect()
    return rows, sum(n for k, n in stages().items() if k not in before)


def test_pairs_of_small_classes_are_not_repeated(spark, monkeypatch):
    titles = spark.createDataFrame([(i, f"word{i} other") for i in range(100)], "title_id int, title string")
    images = spark.createDataFrame([(i, f"word{i} x{i}") for i in range(100)] + [(1000 + i, "word7 copies") for i in range(30)], "image_id int, name string")
    want = sorted([(i, i, 0.5) for i in range(100)] + [(7, 1000 + i, 0.5) for i in range(30)])
    rows, n = _shuffled(spark, lookups.title_images(titles, images))
    assert sorted(map(tuple, rows)) == want and n < 1500  # 100 pairs of classes; sixteen rows for each were 1600 alone
    monkeypatch.setattr(lookups, "COPIES", 4)
    assert sorted(map(tuple, lookups.title_images(titles, images).collect())) == want


def test_vector_records_shuffle_each_document_once(spark, tmp_path):
    texts = [(i, "\n".join(f"line {j} of {i}" for j in range(30))) for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, n = _shuffled(spark, vector_queries.vector_records(spark, str(tmp_path)))
    assert n == len(texts) and len(rows) == len({r["primary_id"] for r in rows}) > 2 * len(texts)
