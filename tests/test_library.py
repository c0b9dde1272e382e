"""Citations, linkage, slugs, notes, exports, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import citations as C
from scriptoria.operators import export as E
from scriptoria.operators import hierarchy as H
from scriptoria.operators import linkage as L
from scriptoria.operators import notes as N
from scriptoria.operators import transforms as T
from scriptoria.streaming import incremental as I


def test_descriptions(spark):
    def text(*path, verse=None):
        column = H.describe_path(F.array(*[F.lit(p) for p in path]), None if verse is None else F.lit(verse))
        return spark.range(1).select(column.alias("x")).first().x

    assert text("Matthew", "1") == "Matthew 1"
    assert text("Matthew", "1", verse="1") == "Matthew 1:1"
    assert text("1", "2", "3", verse="4") == "1.2.3.4"
    assert text("Book 2", "3") == "Book 2 3"


@pytest.mark.parametrize("name, lettered, numbered", [("1 Timothy", "I Timothy", "1 Timothy"), ("I Timothy", "I Timothy", "1 Timothy"), ("VII John", "VII John", "VII John"), ("6 John", "6 John", "6 John"), ("Timothy", "Timothy", "Timothy")])
def test_book_numbers(spark, name, lettered, numbered):
    row = spark.createDataFrame([(name,)], "n string").select(C.to_lettered(F.col("n")).alias("a"), C.to_numbered(F.col("n")).alias("b")).first()
    assert tuple(row) == (lettered, numbered)


def test_citations(spark):
    rows = [(1, None, "Matthew", 1), (2, 1, "1", 2), (3, None, "I Timothy", 3), (4, 3, "1", 4), (5, None, "Song of Songs", 5), (6, 5, "2", 6), (7, None, "fr. 1", 7)]
    flat = spark.createDataFrame(rows, "division_id long, parent_id long, descriptor string, sequence_number long").withColumns(
        {"work_slug": F.lit("nt"), "title": F.lit(None).cast("string"), "type": F.lit(None).cast("string")}
    )
    tree = H.with_ancestors(flat)
    asked = ["matthew 1:5", "Matthew 1", "I Timothy 1.3", "Song of Songs 2:1", "Matthew", "nowhere 1", "fr. 1"]
    cited = spark.createDataFrame([(i, "nt", r) for i, r in enumerate(asked)], "citation_id long, work_slug string, reference string")
    got = {asked[r.citation_id]: (r.division_id, r.verse) for r in C.resolve_citations(cited, tree).collect()}
    assert got == {
        "matthew 1:5": (2, "5"), "Matthew 1": (2, None), "I Timothy 1.3": (4, "3"), "Song of Songs 2:1": (6, "1"), "Matthew": (1, None), "fr. 1": (7, None)
    }


def _chain(spark, parents):
    return spark.createDataFrame([(i, p, str(i), i) for i, p in parents], "division_id long, parent_id long, descriptor string, sequence_number long").withColumns(
        {"title": F.lit(None).cast("string"), "type": F.lit(None).cast("string"), "work_slug": F.lit("w")}
    )


def test_trees_of_any_depth(spark):
    tree = H.with_ancestors(_chain(spark, [(i, i - 1 if i else None) for i in range(37)] + [(99, 98)]))
    paths = {r.division_id: r.path for r in tree.collect()}
    assert paths == {i: [str(k) for k in range(i + 1)] for i in range(37)} | {99: ["99"]}
    with pytest.raises(ValueError, match="own ancestor"):
        H.with_ancestors(_chain(spark, [(1, 3), (2, 1), (3, 2), (4, None)]))


def test_citations_of_any_depth(spark):
    tree = H.with_ancestors(_chain(spark, [(i, i - 1 if i else None) for i in range(9)]))
    asked = [" ".join(str(k) for k in range(n)) for n in range(1, 10)] + ["0.1.2.3.4.5.6:77", "0 1 2 3 77", "0 1 2 3 4 9 9"]
    cited = spark.createDataFrame([(i, "w", r) for i, r in enumerate(asked)], "citation_id long, work_slug string, reference string")
    got = {asked[r.citation_id]: (r.division_id, r.verse) for r in C.resolve_citations(cited, tree).collect()}
    assert got == {a: (k, None) for k, a in enumerate(asked[:9])} | {"0.1.2.3.4.5.6:77": (6, "77"), "0 1 2 3 77": (3, "77")}


def test_aliases(spark):
    works = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "title_slug string, work_id long")
    none = spark.createDataFrame([], "title_slug string, work_id long")
    once = L.populate_aliases(works, none)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2)]
    assert L.populate_aliases(works, once).count() == 2
    taken = spark.createDataFrame([("a", 9)], "title_slug string, work_id long")
    with pytest.raises(Exception, match="another work"):
        L.populate_aliases(works, taken).collect()


def test_equivalence_flags(spark):
    works = spark.createDataFrame(
        [(1, "T", ["x", "y"], ["e"]), (2, "T", ["y", "x"], ["f"]), (3, "T", ["x"], ["e"]), (4, "T", ["x", "y"], ["e"])], "work_id long, title string, authors array<string>, editors array<string>"
    )
    divisions = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 5, "b"), (4, 1, "b"), (4, 2, "a")], "work_id long, sequence_number long, descriptor string")
    keyed = L.equivalence_keys(works, L.division_fingerprints(divisions))

    def pairs(**flags):
        found = L.related_of(L.equivalent_groups(keyed, **flags), works)
        return {tuple(r) for r in found.collect()}

    assert pairs() == {(1, 2), (2, 1), (1, 4), (4, 1)}
    assert pairs(either=False) == set()
    assert pairs(either=False, ignore_editors=True) == {(1, 2), (2, 1)}
    assert pairs(either=False, ignore_divisions=True) == {(1, 4), (4, 1)}
    assert all((b, a) in pairs() for a, b in pairs())


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_slugs_against_brute_force(spark, width):
    titles = ["Doc", "doc", "Doc 1", "doc", "Other", "doc", "doc-1"]
    existing = ["doc", "doc-2", "doc-4", "other-1"]
    new = spark.createDataFrame(list(enumerate(titles)), "work_id long, title string")
    old = spark.createDataFrame([(s,) for s in existing], "title_slug string")
    got = {r.work_id: r.title_slug for r in T.assign_slugs(new, old, width).collect()}
    assert len(set(got.values()) | set(existing)) == len(titles) + len(existing)
    # Bases in order of the works; a base another new work owns counts as taken.
    assert got == {0: "doc-3", 1: "doc-5", 2: "doc-1", 3: "doc-6", 4: "other", 5: "doc-7", 6: "doc-1-1"}


def test_unknown_transform(spark):
    with pytest.raises(KeyError):
        T.run_transforms({}, [("no such", None)])


def test_division_must_be_unique(spark):
    divisions = spark.createDataFrame([(1, 1, "a", 1, None, True, "t", "d", 1), (2, 1, "a", 2, None, True, "t", "d", 1)], "division_id long, work_id long, title_slug string, sequence_number long, parent_id long, readable_unit boolean, type string, descriptor string, level int")
    step = spark.createDataFrame([(1, 1, None, "a", None, None, None, False)], "argument_id long, work_id long, sequence_number long, title_slug string, type string, descriptor string, level int, readable boolean")
    with pytest.raises(Exception, match="names 2 divisions"):
        T.run_transforms({"divisions": divisions}, [("set_division_readable", step)])["divisions"].collect()


def test_chapter_text(spark):
    rows = [
        (1, 1, "1", "", "<verse>One<note>First</note> more.</verse>", "English"), (1, 2, "2", "", "<verse>Two<note>Second</note><note>Third</note></verse>", "English"), (1, 3, "", "plain", "", "English"),
    ]
    verses = spark.createDataFrame(rows, "division_id long, sequence_number long, indicator string, content string, original_content string, language string")
    assert E.chapter_texts(verses).first().text == "1. One[1] more. 2. Two[2][3] plain\n\nFootnotes:\n[1] First\n[2] Second\n[3] Third"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("/work/a", "A 1", "text, \"quoted\"", "A", "1", "1")], ", ".join(f"{c} string" for c in E.RESULT_COLUMNS))
    E.write_results_csv(rows, str(tmp_path / "hits"))
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "hits")).collect()] == [tuple(rows.first())]
    chapters = spark.createDataFrame([("a", "line"), ("b", "other")], "work_slug string, text string")
    E.write_chapter_texts(chapters, str(tmp_path / "chapters"))
    assert spark.read.text(str(tmp_path / "chapters")).where("work_slug = 'a'").first().value == "line"


def test_notes(spark):
    notes = spark.createDataFrame([(1, "On Grace", "x"), (2, "b", "GRACE again"), (3, "c", "d")], "note_id long, title string, text string")
    assert sorted(r.note_id for r in N.matching_notes(notes, "grace").collect()) == [1, 2]
    assert N.page_of_notes(notes, 0).count() == 3 and [r.note_id for r in N.page_of_notes(notes, 1, 2).collect()] == [3]
    references = spark.createDataFrame([(1, 1, "nt", 7, "A/1", "2"), (2, 1, "lxx", 8, "A/1", None)], "reference_id long, note_id long, work_title_slug string, division_id long, division_full_descriptor string, verse_indicator string")
    divisions = spark.createDataFrame([("nt", 7, 1, ["A", "1"]), ("lxx", 8, 1, ["a", "1"])], "work_slug string, division_id long, sequence_number long, path array<string>")
    related = spark.createDataFrame([("nt", "lxx")], "work_slug string, related_slug string")
    requests = spark.createDataFrame([(1, "nt", ["A", "1"]), (2, "nt", ["A", "1", "3"])], "request_id long, work_slug string, parts array<string>")
    found = N.notes_for_passages(notes, references, N.allowed_passages(requests, divisions, related))
    assert [(r.request_id, r.note_id) for r in found.collect()] == [(1, 1)]
    row = N.export_rows(notes, references, divisions).where("id = 1").first()
    assert (row.work, row.reference) == ("nt", "A 1:2, a 1")


def test_contested_slugs_go_to_the_next_suffix(spark):
    """Works in order of their ids take the first candidate that is free."""
    wanted = {1: ["one", "two"], 2: ["one", "two"], 3: ["two", "three"], 4: ["one"], 5: ["zero", "three", "four"]}
    works = spark.createDataFrame(
        [(k, "A" if k != 9 else "B", f"old-{k}" if k != 9 else "a-zero", ["E"], "en") for k in (1, 2, 3, 4, 5, 9)],
        "work_id long, title string, title_slug string, editors array<string>, language string",
    )
    asked = spark.createDataFrame(list(wanted.items()), "work_id long, additional_fields array<string>")
    got = {r.work_id: r.title_slug for r in T.update_title_slug({"works": works}, asked)["works"].collect()}
    taken = {"a-zero", *(f"old-{k}" for k in range(1, 6))}
    expected = {9: "a-zero"}
    for k in sorted(wanted):
        free = next((f"a-{f}" for f in wanted[k] if f"a-{f}" not in taken), None)
        expected[k] = free or f"old-{k}"
        taken.add(expected[k])
    assert got == expected


def test_first_rule_among_many(spark):
    rng = np.random.default_rng(2)
    pick = lambda values: None if rng.random() < 0.5 else str(rng.choice(values))
    names = ["a.xml", "b.xml", "ab.xml", "c"]
    files = [(k, pick(["x", "y"]), pick(["t", "u"]), pick(["en", "gr"]), pick(names), pick(["e", "f"])) for k in range(80)]
    many = lambda values: None if rng.random() < 0.6 else [str(v) for v in rng.choice(values, rng.integers(0, 3))]
    rules = [(k, pick(["x", "y"]), many(["e", "f"]), many(["t", "u"]), pick([*names, "a*", "*b*"]), pick(["en"]), bool(k % 2), f"p{k}") for k in range(40)]
    got = T.matched_rules(
        spark.createDataFrame(files, "file_id long, author string, title string, language string, file_name string, editor string"),
        spark.createDataFrame(rules, "rule_pos int, author string, editor array<string>, title array<string>, file_name string, language string, should_import boolean, import_parameters string"),
    ).collect()

    def named(want, have):
        return want is None or have is not None and ((want.replace("*", "") in have) if "*" in want else want == have)

    def first(f):
        _, author, title, language, name, editor = f
        fitting = (
            r for r in rules
            if r[1] in (None, author) and (r[2] is None or editor in r[2]) and (r[3] is None or title in r[3]) and named(r[4], name) and r[5] in (None, language)
        )
        return next(((r[0], r[6], r[7]) for r in fitting), (None, None, None))

    assert {r.file_id: (r.rule_pos, r.should_import, r.import_parameters) for r in got} == {f[0]: first(f) for f in files}


def test_repeated_batches_write_once(spark, tmp_path):
    root = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "a", "en", "x y")], "verse_id long, work_slug string, language string, content string")
    second = spark.createDataFrame([(1, "a", "en", "x y"), (2, "b", "en", "y"), (3, "a", "en", "z")], first.schema)
    I.update_index(first, 0, root)
    for _ in range(2):
        I.update_index(second, 1, root)
    rows = I.read_index(spark, root).where("field = 'content'").collect()
    assert sorted((r.work_slug, r.term, r.tf) for r in rows) == [("a", "x", 1), ("a", "y", 1), ("a", "z", 1), ("b", "y", 1)]
    assert sorted(r.title_slug for r in I.read_aliases(spark, root).collect()) == ["a", "b"]
