from pyspark.sql import functions as F

from scriptoria.operators import morphology as M
from scriptoria.sources import morphology as R


def tables(spark):
    forms = spark.createDataFrame([(1, "ἄβρα", "αβρα"), (2, "ἄβραν", "αβραν"), (3, "ὁράω", "οραω"), (4, "ὅρα", "ορα")], "form_id long, form string, basic_form string")
    lemmas = spark.createDataFrame([(10, "ἄβρα", "αβρα", 537850), (20, "ὁράω", "οραω", 7)], "lemma_id long, lexical_form string, basic_lexical_form string, reference_number long")
    descriptions = spark.createDataFrame([(1, 10, "slave", "nom"), (2, 10, "slave", "acc"), (3, 20, "see", "pres"), (4, 20, "see", "imperat"), (1, 20, "odd", "x")], "form_id long, lemma_id long, meaning string, description string")
    return forms, descriptions, lemmas


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_related_forms(spark):
    forms, descriptions, _ = tables(spark)
    assert sorted(r.form for r in M.related_forms(words(spark, "ἄβρα"), forms, descriptions).collect()) == sorted(["ἄβρα", "ἄβραν", "ὁράω", "ὅρα"])
    assert M.related_forms(words(spark, "αβραν"), forms, descriptions).count() == 0
    assert sorted(r.form for r in M.related_forms(words(spark, "αβραν"), forms, descriptions, True).collect()) == sorted(["ἄβρα", "ἄβραν"])


def test_parse_passes(spark):
    forms, descriptions, lemmas = tables(spark)
    rows = M.parse_words(words(spark, "ἌΒΡΑΝ", "αβραν", "ἄβραν2", "αβραν2", "none"), forms, descriptions, lemmas).collect()
    assert {r.word: (r.ignoring_diacritics, r.ignoring_numerals) for r in rows} == {
        "ἌΒΡΑΝ": (False, False), "αβραν": (True, False), "ἄβραν2": (False, True), "αβραν2": (True, True)
    }
    assert {r.similarity for r in rows if r.word == "αβραν"} == {67}


def test_analysis_lines(spark):
    line = "a(/bra\t{537850 9 a(/bra_,a(/bra\tfavourite slave\tfem nom/voc/acc dual}{537850 9 a(/bra_,a(/bra\tfavourite slave\tfem nom/voc sg (attic doric aeolic)}[5]{broken}"
    good, bad = R.parse_analyses(spark.createDataFrame([(line,)], "value string"))
    rows = good.orderBy("group_no").collect()
    assert [r.reference_number for r in rows] == [537850, 537850] and rows[1].extra == "5" and rows[0].details == "fem nom/voc/acc dual"
    assert bad.count() == 1
    linked, unmatched = M.link_lemmas(good, tables(spark)[2])
    assert {r.lemma_id for r in linked.collect()} == {10} and unmatched.count() == 0
    described = M.describe_attributes(good).orderBy("group_no").collect()
    assert described[1].dialects == ["attic", "doric", "aeolic"] and described[0].number == 1 and described[0].feminine


def test_two_line_records(spark, tmp_path):
    from scriptoria.sources.lines import read_lines

    file = tmp_path / "analyses.txt"
    file.write_text("﻿!ἄβαις|!ἅβαις\nἥβη : youthful prime : fem dat pl (doric)<br>ἥβα : x : y : adverb\nlost form\n# remark\n\nβ\nβῆ : go : inf\n", encoding="utf-8")
    lines = read_lines(spark, str(file))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, 8))
    good, bad = R.parse_records(R.pair_records(lines))
    rows = sorted((r.line_no, r.form, r.lemma, r.meaning, r.details) for r in good.collect())
    assert rows == [
        (2, "ἄβαις", "ἥβα : x", "y", "adverb"), (2, "ἄβαις", "ἥβη", "youthful prime", "fem dat pl (doric)"),
        (2, "ἅβαις", "ἥβα : x", "y", "adverb"), (2, "ἅβαις", "ἥβη", "youthful prime", "fem dat pl (doric)"),
        (7, "β", "βῆ", "go", "inf"),
    ]
    assert bad.count() == 0 and read_lines(spark, str(file), start_line=6).count() == 2


def test_part_of_speech_conflicts(spark):
    rows = spark.createDataFrame([("fem aor",), ("aor fem",), ("conj prep",)], "details string")
    got = {r.details: (r.part_of_speech, r.conflicting_part_of_speech) for r in M.describe_attributes(rows).collect()}
    assert got == {"fem aor": (0, True), "aor fem": (1, False), "conj prep": (6, True)}


def test_lexicon_keeps_unknown_headwords(spark):
    lemmas = spark.createDataFrame([(1, "λόγος")], "lemma_id long, lexical_form string")
    heads = spark.createDataFrame([(5, 1, "LO/GOS"), (5, 1, "LO/GOS"), (6, 1, "XX")], "verse_id long, work_id long, headword string")
    entries = M.index_lexicon(heads, lemmas)
    assert sorted((r.verse_id, r.lemma_id) for r in entries.collect()) == [(5, 1), (6, None)]
    assert M.index_lexicon(heads, lemmas, entries).count() == 0
    more = lemmas.unionByName(spark.createDataFrame([(2, "ξχ")], "lemma_id long, lexical_form string")).withColumn("lexical_form", F.when(F.col("lemma_id") == 2, "χχ").otherwise(F.col("lexical_form")))
    assert {r.verse_id: r.lemma_id for r in M.fill_lexicon_gaps(entries, more).collect()} == {5: 1, 6: 2}


def test_entries_of_a_lexicon_are_made_once(spark):
    """Entries with and without a lemma are read from what was stored, not made twice."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "verse_id long, work_id long, lemma_id long, headword string"
    entries = spark.createDataFrame([(1, 1, 5, "a"), (2, 1, None, "b"), (3, 1, None, "c")], schema).mapInArrow(count, schema)
    lemmas = spark.createDataFrame([(7, "β")], "lemma_id long, lexical_form string")
    assert {r.verse_id: r.lemma_id for r in M.fill_lexicon_gaps(entries, lemmas).collect()} == {1: 5, 2: 7, 3: None}
    assert made.value == 3


def test_a_vocabulary_is_parsed_without_the_driver(spark, monkeypatch):
    """Beyond few words no side of the joins is collected in the driver; few words are, and both give the same rows."""
    from scriptoria import session

    forms, descriptions, lemmas = tables(spark)
    asked = words(spark, "ἌΒΡΑΝ", "αβραν", "ἄβραν2", "αβραν2", "οραω", "none")
    parse = lambda: M.parse_words(asked, forms, descriptions, lemmas)
    few = sorted(map(tuple, parse().collect()))
    monkeypatch.setattr(session, "_SMALL_ROWS", 3)
    many = parse()
    assert sorted(map(tuple, many.collect())) == few and len(few) == 5
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
