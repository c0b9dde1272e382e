import json

from pyspark.sql import functions as F

from scriptoria.operators import divisions as D
from scriptoria.operators import transforms as T
from scriptoria.schemas import WORK_ALIASES
from scriptoria.sources import bibles, library, lines, tei


def test_unbound_bible(spark, tmp_path):
    text = "#name\tGreek OT: LXX [A] Accented\n#columns\torig\n01O\t1\t1\t\t10\t ἐν ἀρχῇ \n01O\t1\t2\ta\t20\tb\n01O\t2\t1\t\t30\tc\n02O\t2\t1\t\t40\td\n"
    (tmp_path / "b.txt").write_text(text, encoding="utf-8")
    (tmp_path / "book_names.txt").write_text("01O\tGenesis\n02O\tExodus\n", encoding="utf-8")
    raw = lines.read_lines(spark, str(tmp_path / "b.txt")).withColumn("work", F.lit("w"))
    assert bibles.unbound_names(raw).first().name == "Greek OT: LXX"
    names = bibles.read_book_names(spark, str(tmp_path / "book_names.txt"))
    parsed = bibles.with_book_names(bibles.parse_unbound(raw), names).withColumnRenamed("line_no", "pos")
    assert bibles.unknown_books(bibles.parse_unbound(raw), names.where("code = '01O'")).count() == 1
    islands = D.book_chapter_islands(parsed)
    divisions = [(r.sequence_number, r.descriptor, r.level, r.parent_sequence) for r in D.divisions_of_islands(islands).orderBy("sequence_number").collect()]
    # The same chapter number in a new book is a new chapter.
    assert divisions == [(1, "Genesis", 1, None), (2, "1", 2, 1), (3, "2", 2, 1), (4, "Exodus", 1, None), (5, "2", 2, 4)]
    verses = [(r.chapter_no, r.sequence_number, r.indicator, r.content) for r in D.verses_of_islands(islands).orderBy("pos").collect()]
    assert verses == [(1, 1, "1", "ἐν ἀρχῇ"), (1, 2, "2a", "b"), (2, 1, "1", "c"), (3, 1, "1", "d")]


def test_cited_lines_in_windows_1252(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("Licence line\n1 John 1:2\tIt’s “so”\nJude 1\tx\n".encode("cp1252"))
    raw = lines.read_lines(spark, str(tmp_path / "b.txt"), encoding="ISO-8859-1")
    rows = [(r.book, r.chapter, r.verse, r.text) for r in bibles.parse_cited_lines(raw, encoded_latin_1=True).orderBy("line_no").collect()]
    assert rows == [("1 John", "1", "2", "It’s “so”"), ("Jude", "1", None, "x")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.read_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.value == f"line {r.line_no}" for r in rows) and len(rows) == 5000


def test_line_hook(spark):
    from pyspark.sql import types as Ty

    schema = Ty.StructType([Ty.StructField("n", Ty.LongType()), Ty.StructField("w", Ty.StringType())])
    source = spark.createDataFrame([(1, "a b"), (2, "")], "line_no long, value string")
    got = lines.map_lines(source, lambda n, v: ({"n": n, "w": w} for w in v.split()), schema)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b")]


def test_policy_file(spark, tmp_path):
    rules = [
        {"title": "Drop me", "should_import": False},
        {"file_name": "*_gk.xml", "editor": ["A", "B"], "import_parameters": {"state_set": 1}},
        {"title": ["One", "Two"], "language": "Greek"},
    ]
    (tmp_path / "p.json").write_text(json.dumps(rules))
    policy = T.read_policy(spark, str(tmp_path / "p.json"))
    files = spark.createDataFrame(
        [("f1", None, "Drop me", "Greek", "x_gk.xml", "A"), ("f2", None, "T", "Greek", "x_gk.xml", "B"), ("f3", None, "Two", "Greek", "y.xml", None), ("f4", None, "Two", "English", "y.xml", None)],
        "file_id string, author string, title string, language string, file_name string, editor string",
    )
    got = {r.file_id: (r.rule_pos, r.should_import, r.import_parameters) for r in T.matched_rules(files, policy).collect()}
    assert got == {"f1": (0, False, None), "f2": (1, True, '{"state_set":1}'), "f3": (2, True, None), "f4": (None, None, None)}
    assert {r.file_id for r in T.accepted_files(files, policy).collect()} == {"f2", "f3"}


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.xml").write_text("<a>x&undefined;<b/></a>")
    (tmp_path / "bad.xml").write_text("<a>")
    (tmp_path / "__cts__.xml").write_text("<a/>")
    (tmp_path / "c.txt").write_text("no")
    nodes = tei.parse_nodes(tei.read_files(spark, str(tmp_path)))
    results = tei.file_results(nodes)
    assert tuple(tei.import_counts(results).first()) == (1, 1)
    assert tei.failed_files(nodes).first().file.endswith("bad.xml")
    assert [(r.kind, r.tag, r.node_seq, r.end_seq) for r in nodes.where("error IS NULL").orderBy("node_seq").collect()] == [
        ("element", "a", 1, 5), ("text", None, 2, 2), ("element", "b", 3, 4)
    ]


def test_library_tables(spark, tmp_path):
    rows = spark.createDataFrame([("slug", 1)], WORK_ALIASES)
    library.append_table(rows, str(tmp_path), "work_aliases")
    library.append_table(rows, str(tmp_path), "work_aliases")
    assert library.read_table(spark, str(tmp_path), "work_aliases").count() == 2
