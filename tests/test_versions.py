"""The index that follows changes: batches against an index of what is left."""

from pyspark.sql import functions as F

from scriptoria.operators.postings import build_term_counts, index_documents
from scriptoria.plans.registry import registered
from scriptoria.streaming import versions as V

SCHEMA = "division_id long, work_slug string, verse_id long, language string, content string"


def rows(df):
    return sorted(tuple(r[c] for c in ("field", "term", "verse_id", "work_slug", "tf")) for r in df.collect())


def test_changes_removals_and_repeated_batches(spark, tmp_path):
    root = str(tmp_path / "index")
    verses = lambda *data: spark.createDataFrame(list(data), SCHEMA)
    removed = lambda *ids: spark.createDataFrame([(i,) for i in ids], "division_id long")
    one, two, three = (1, "w", 10, "la", "in principio erat verbum"), (1, "w", 11, "la", "et verbum erat"), (2, "v", 20, "la", "apud deum")
    changed, back = (1, "w", 10, "la", "in principio creavit"), (2, "v", 20, "la", "apud deum")
    steps = [
        ((one, two, three), (), [one, two, three]),
        ((changed,), (), [changed, three]),  # the division has one verse less, and another text
        ((), (2,), [changed]),
        ((back, two, one), (), [back, two, one]),  # comes again after it went; one as it was before
        ((three, (3, "x", 30, "la", "")), (2, 9), [two, one]),  # both there and removed: it goes
    ]
    for batch, (arrived, gone, left) in enumerate(steps):
        for _ in range(2):  # repeated after a failure
            V.update(verses(*arrived) if arrived else verses(one).where("false"), removed(*gone), batch, root)
        assert rows(V.read_live(spark, root)) == rows(build_term_counts(index_documents(verses(*left))))
    V.compact(spark, root, str(tmp_path / "compacted"))
    assert rows(V.read_live(spark, str(tmp_path / "compacted"))) == rows(V.read_live(spark, root))
    V.update(verses(changed), removed(), 5, str(tmp_path / "compacted"))
    assert rows(V.read_live(spark, str(tmp_path / "compacted"))) == rows(build_term_counts(index_documents(verses(changed))))
    assert V.live_verses(spark, root).where(F.col("division_id") == 2).count() == 0


def test_streamed_index_reads_a_table_in_one_file_or_many(spark, sf_dir, tmp_path):
    rows = [(1, "one two\none", "en", "a", 11), (2, "drei", "de", "b", 4), (3, "two", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{tmp_path}/many/documents.parquet")
    (tmp_path / "one").mkdir()
    docs.toPandas().to_parquet(tmp_path / "one" / "documents.parquet", index=False)
    for kind in ("many", "one"):
        found = registered()["streamed_index"].build(spark, f"{tmp_path}/{kind}")
        assert sorted(map(tuple, found.collect())) == [("a-en", 8, 8), ("b-de", 2, 2)]


def test_batches_and_compaction_exchange_no_entries(spark, tmp_path):
    """The entries of a verse lie in one file, in the batch that brought it and after compaction, and in the index of a stream."""
    from scriptoria.streaming import incremental as I

    verses = spark.createDataFrame([(v % 5, "w", v, "la", "alpha beta gamma delta " * 3) for v in range(60)], SCHEMA)
    V.update(verses, verses.select("division_id").where("false"), 0, str(tmp_path / "changes"))
    V.compact(spark, str(tmp_path / "changes"), str(tmp_path / "compacted"))
    I.update_index(verses, 0, str(tmp_path / "stream"))
    for folder in ("changes", "compacted", "stream"):
        stored = spark.read.parquet(f"{tmp_path}/{folder}/postings/batch=0").withColumn("file", F.input_file_name())
        assert stored.count() == 60 * 2 * 4 and stored.select("file").distinct().count() > 1, folder
        assert stored.groupBy("verse_id").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0, folder
