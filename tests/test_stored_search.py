"""Search over a stored index, near words, pattern rules, argument matching and long citations against brute force."""

import difflib
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import near_words as N
from scriptoria.operators import search as S
from scriptoria.operators import stored_index as I
from scriptoria.operators import transforms as T
from scriptoria.operators.citations import resolve_citations
from scriptoria.operators.hierarchy import with_ancestors
from scriptoria.plans import adapter as A
from scriptoria.plans.linkage_queries import part_patterns
from scriptoria.sources import tei

TERMS = "query_id long, branch int, clause int, negated boolean, field string, term string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Fifty terms of falling frequency in 300 verses."""
    rng = random.Random(4)
    rows = [("content", f"t{t}", v, f"w{v % 3}", rng.randint(1, 4)) for v in range(300) for t in range(50) if rng.random() < 1 / (1 + t / 4)]
    postings = spark.createDataFrame(rows, "field string, term string, verse_id long, work_slug string, tf long")
    path = str(tmp_path_factory.mktemp("index"))
    I.write_index(postings, path)
    return postings, path


def random_queries(n):
    rng = random.Random(9)
    rows = []
    for q in range(n):
        for b in range(rng.choice([1, 1, 2])):
            for c in range(rng.randint(1, 4)):
                negated = c > 0 and rng.random() < 0.2
                rows += [(q, b, c, negated, "content", f"t{rng.randint(0, 54)}") for _ in range(rng.choice([1, 1, 2]))]
    return rows + [(n, 0, 0, False, "content", "t0"), (n, 0, 1, False, "content", "t1"), (n + 1, 3, 7, False, "content", "t1"), (n + 1, 3, 2, False, "content", "t0")]


def plain(hits):
    return sorted((r.query_id, r.verse_id, r.work_slug, sorted(map(tuple, r.matches))) for r in hits.collect())


def test_stored_search_is_the_search(spark, index):
    postings, path = index
    terms = spark.createDataFrame(random_queries(40), TERMS)
    assert plain(I.match_stored(spark, path, terms)) == plain(S.match(postings, terms)) != []


def test_equal_queries_run_once_and_buckets_are_pruned(spark, index):
    _, path = index
    terms = spark.createDataFrame(random_queries(3), TERMS)
    merged, members = I.merge_equal_queries(terms)
    assert {(r.query_id, r.same_as) for r in members.collect()} >= {(3, 3), (4, 3)} and not merged.where("query_id = 4").count()
    one = spark.createDataFrame([(1, 0, 0, False, "content", "t0"), (1, 0, 1, False, "content", "t40")], TERMS)
    plan = I.match_stored(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    # The driver is the rarest clause.
    wanted = S._with_required(one).withColumn("bucket", I.bucket_of(F.col("term")))
    dictionary = spark.read.parquet(f"{path}/dictionary")
    assert [r.term for r in I._drivers(wanted, dictionary).collect()] == ["t40"]


@pytest.mark.parametrize("first,last", [(0, 0), (1, 1), (0, 9), (3, 17), (5, 5), (6, 7), (1, 64), (127, 1000)])
def test_blocks_cover_an_interval_once(spark, first, last):
    blocks = spark.range(1).select(F.inline(I.dyadic_blocks(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")))).collect()
    numbers = [n for b in blocks for n in range(b.block << b.level, (b.block + 1) << b.level)]
    assert sorted(numbers) == list(range(first, last + 1)) and len(blocks) <= 2 * (last - first + 2).bit_length()


def test_pages(spark):
    rng = random.Random(1)
    rows = [(q, v) for q in range(4) for v in sorted(rng.sample(range(10_000), 10 if q == 3 else 400))]
    hits = spark.createDataFrame(rows, "query_id long, verse_id long")
    for number, length, width in ((1, 20, 7), (3, 20, 100), (2, 37, 10**6), (9, 50, 3)):
        found = S.page(hits, number, length, chunk=F.floor(F.col("verse_id") / width)).select("query_id", "verse_id", "rank").collect()
        wanted = [(q, v, k + 1) for q, own in itertools.groupby(rows, lambda r: r[0]) for k, (_, v) in enumerate(own) if (number - 1) * length <= k < number * length]
        assert sorted(map(tuple, found)) == sorted(wanted)


def test_near_words(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    words += [w[:k] + x + w[k + 1 :] for w in ("logos", "anthropos", "theologia", "en", "ou") for k in range(len(w)) for x in ("", "z", "qu")] + ["aaaaaaaaaa", "aaaaaaaaab", "λόγος", "λόγοι"]
    words = sorted(set(words) - {""})
    asked = words[::2]
    ratio = lambda a, b: int(round(difflib.SequenceMatcher(None, a, b).ratio() * 100, 0))
    for percent in (80, 90):
        found = N.near_words(spark.createDataFrame([(w,) for w in asked] + [(None,)], "word string"), spark.createDataFrame([(w,) for w in words], "word string"), percent)
        assert sorted(map(tuple, found.collect())) == sorted((a, b, ratio(a, b)) for a in asked for b in words if ratio(a, b) >= percent)
    with pytest.raises(ValueError):
        N.near_words(found.select("word"), found.select("word"), 70)


def test_near_words_of_any_form(spark, monkeypatch):
    """Long, empty and equal words, letters beyond 16 bits, and many blocks give what comparing all pairs gives."""
    monkeypatch.setattr(N, "BLOCK_LETTERS", 64)
    rng = random.Random(11)
    long = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (60, 64, 65, 70, 90, 230)]
    words = ["", "a", "b", "ab", "aab", "\U0001d6fc\U0001d6fd\U0001d6fe", "\U0001d6fc\U0001d6fd\U0001d6fe\U0001d6fe"] + ["".join(rng.choice("aeht") for _ in range(rng.randint(4, 12))) for _ in range(60)]
    for w in long:
        words += [w, w[1:], w[:20] + w[25:], w[::-1], w[30:] + w[:30]]
    words = sorted(set(words))
    ratio = lambda a, b: int(round(difflib.SequenceMatcher(None, a, b).ratio() * 100, 0))
    rows = spark.createDataFrame([(w,) for w in words] + [(None,), (words[3],)], "word string")
    expected = sorted((a, b, ratio(a, b)) for a in words for b in words if ratio(a, b) >= 80)
    assert sorted(map(tuple, N.near_words(rows, rows).collect())) == expected
    assert N.near_words(rows.limit(0), rows).count() == N.near_words(rows, rows.limit(0)).count() == 0
    monkeypatch.setattr(N, "ROWS", 3)
    monkeypatch.setattr(N, "PAIRS", 2)
    same = [w for w in words if len(w) == 64]
    i, j = N._can_be_near(words, same, 79.5)
    assert {(words[x], same[y]) for x, y in zip(i, j)} >= {(a, b) for a, b, _ in expected if len(b) == 64}


def test_near_words_compares_few_pairs_in_many_tasks(spark, monkeypatch):
    """Few pairs beyond the result are compared in full, and not by one task."""
    judged = spark.sparkContext.accumulator(0)

    @F.pandas_udf("int")
    def counted(left: pd.Series, right: pd.Series) -> pd.Series:
        judged.add(len(left))
        return pd.Series([int(round(difflib.SequenceMatcher(None, a, b).ratio() * 100, 0)) for a, b in zip(left, right)], dtype="Int32")

    monkeypatch.setattr(N, "similarity", counted)
    rng = random.Random(3)
    parts = "th er on an re he in ed nd ha at en".split()
    words = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(3, 6))),) for _ in range(1500)], "word string")
    rows = N.near_words(words.limit(300), words).select("*", F.spark_partition_id().alias("part")).collect()
    # Spark judges a pair for the filter and, if it stays, for the column.
    assert len(rows) <= judged.value < 3 * len(rows)
    assert len({r.part for r in rows}) > 1


def test_pattern_rules_meet_few_files(spark, sf_dir):
    files, rules = part_patterns(spark, sf_dir)
    tried = T.tested_rules(files, rules, fitting=False).count()
    assert tried < files.count() * rules.count() / 10
    short = rules.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, "*", None, True, None), (0, None, None, None, "q*l", None, False, None)], rules.schema))
    assert {(r.rule_pos, r.should_import) for r in T.matched_rules(files, short).collect()} == {(1, True)}


def test_arguments_must_name_one_division(spark):
    divisions = spark.createDataFrame([(1, 10, "a", 1), (1, 11, "a", 2), (2, 12, "a", 1)], "work_id long, division_id long, slug string, seq long")
    asked = spark.createDataFrame([(1, 1, None, 2), (2, 2, None, None), (3, 2, "a", 1), (4, 1, "a", 1)], "argument_id long, work_id long, s string, q long")
    keys = {"s": "slug", "q": "seq"}
    assert sorted(map(tuple, T._match_given(divisions, asked, keys).collect())) == [(1, 11), (2, 12), (3, 12), (4, 10)]
    for wrong in ((5, 1, "a", None), (6, 1, "b", 1)):
        with pytest.raises(Exception, match="the transform names"):
            T._match_given(divisions, spark.createDataFrame([wrong], asked.schema), keys).collect()
    assert T._match_given(divisions, asked.limit(0), keys).collect() == []


def test_citations_take_the_longest_descriptor(spark):
    rows = [(1, None, "α β", 1), (2, 1, "γ δ", 2), (3, 2, "3", 3), (4, None, "Song of Songs", 4), (5, 4, "of Songs", 5), (6, 5, "2", 6), (7, None, "Song", 7), (8, None, "a. b", 8), (9, 8, "5", 9)]
    tree = with_ancestors(spark.createDataFrame([(*r[:3], None, None, r[3], "w") for r in rows], "division_id long, parent_id long, descriptor string, title string, type string, sequence_number long, work_slug string"))
    cited = {1: ("α β γ δ 3", 3, None), 2: ("α β", 1, None), 3: ("Song of Songs of Songs 2", 6, None), 4: ("Song of Songs:9", 4, "9"), 5: ("a. b 5", 9, None), 6: ("α β:γ δ.7", 2, "7"), 7: ("Song 4", 7, "4"), 8: ("β γ", None, None)}
    found = resolve_citations(spark.createDataFrame([(k, "w", v[0]) for k, v in cited.items()], "citation_id long, work_slug string, reference string"), tree)
    assert {r.citation_id: (r.division_id, r.verse) for r in found.collect()} == {k: v[1:] for k, v in cited.items() if v[1]}


def test_texts_of_many_headings(spark):
    """A file of 100,000 headings, each with its text, inside one element that holds them all."""
    n = 100_000
    heads = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 3 + 2).alias("node_seq"), (F.col("id") * 3 + 4).alias("end_seq"), F.lit("element").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("bigint").alias("parent_seq"))
    texts = heads.select("file", (F.col("node_seq") + 1).alias("node_seq"), (F.col("node_seq") + 1).alias("end_seq"), F.lit("text").alias("kind"), F.col("node_seq").cast("string").alias("text"), F.col("node_seq").alias("parent_seq"))
    found = tei.element_text(heads.unionByName(texts), heads, recurse=True)
    assert found.where(F.col("text") == F.col("node_seq").cast("string")).count() == n
    whole = heads.limit(1).select("file", F.lit(1).cast("bigint").alias("node_seq"), F.lit(3 * n + 5).cast("bigint").alias("end_seq"), "kind", "text", F.lit(None).cast("bigint").alias("parent_seq"))
    assert len(tei.element_text(heads.unionByName(texts), whole, recurse=True, separator=" ").first().text.split()) == n


def test_document_tree_is_in_document_order(spark, sf_dir):
    tree = with_ancestors(A.document_tree(spark, sf_dir))
    sets = {r.division_id: (r.first, r.last) for r in I.nested_sets(tree).collect()}
    rows = tree.collect()
    assert sorted(r.position for r in rows) == list(range(1, len(rows) + 1))
    for r in rows:
        below = [x.position for x in rows if r.division_id in x.ancestor_ids]
        assert sets[r.division_id] == (r.position, r.position + len(below) - 1) == (min(below), max(below))


def test_citations_are_never_sent_whole_to_every_task(spark):
    """Only the few descriptors with blanks, counted before, are broadcast; compressed files say nothing of the size of the rest."""
    tree = with_ancestors(spark.createDataFrame([(1, None, "α β", None, None, 1, "w"), (2, 1, "3", None, None, 2, "w")], "division_id long, parent_id long, descriptor string, title string, type string, sequence_number long, work_slug string"))
    found = resolve_citations(spark.createDataFrame([(1, "w", "α β 3")], "citation_id long, work_slug string, reference string"), tree)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") >= 2
    assert [tuple(r) for r in found.collect()] == [(1, 2, None)]


def test_patterns_of_common_short_pieces_meet_few_files(spark):
    """Names of two signs: every piece of three is held by most files, one of twelve by few; a file_id may come twice."""
    codes = [f"{k * 37 % 4096:012b}" for k in range(300)]
    files = spark.createDataFrame([(k % 299, None, "t", None, f"x_{c}.xml", "e") for k, c in enumerate(codes)], "file_id long, author string, title string, language string, file_name string, editor string")
    rules = spark.createDataFrame(
        [(k, None, None, None, f"*_{c}.xml", None, k % 2 == 0, None) for k, c in enumerate(codes)],
        "rule_pos int, author string, editor array<string>, title array<string>, file_name string, language string, should_import boolean, import_parameters string",
    )
    assert T.tested_rules(files, rules, fitting=False).count() < 10 * 300
    assert {(r.file_id, r.rule_pos) for r in T.matched_rules(files, rules).collect()} == {(k % 299, k % 299) for k in range(300)}


def test_entries_stay_in_the_segment_that_counted_them(spark, index, tmp_path):
    postings, _ = index
    path = str(tmp_path / "segments")
    I.write_index(postings.repartition(3, "verse_id"), path)
    stored = spark.read.parquet(f"{path}/postings").withColumn("segment", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1))
    assert stored.select("segment").distinct().count() == 3
    assert stored.groupBy("verse_id").agg(F.count_distinct("segment").alias("n")).where("n > 1").count() == 0
    names = ["field", "term", "verse_id", "work_slug", "tf"]
    assert sorted(map(tuple, stored.select(*names).collect())) == sorted(map(tuple, postings.select(*names).collect()))


def test_rows_that_meet_no_key_are_left_out(spark, index, monkeypatch):
    """Rows that can meet a key are found where they lie, by the keys or by bits of their hashes; none of them is lost."""
    from scriptoria import session
    from scriptoria.operators.prefilter import meeting

    large = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id") * 7).alias("verse_id"), F.col("id").alias("other"))
    small = spark.range(600).select(F.when(F.col("id") != 5, F.col("id") * 70).alias("verse_id"))
    keys = {70 * k for k in range(1, 600) if k != 5}
    exact = [r.verse_id for r in meeting(large, small, "verse_id").collect()]
    assert set(exact) == keys and len(exact) == len(keys)
    monkeypatch.setattr(session, "_SMALL_ROWS", 10)
    passed = meeting(large, small, "verse_id")
    rows = passed.collect()
    assert passed.columns == large.columns and keys <= {r.verse_id for r in rows} and len(rows) < 40_000 / 8
    assert meeting(large, small.where("false"), "verse_id").count() == 0
    postings, _ = index
    terms = spark.createDataFrame([(1, 0, 0, False, "content", "t0")], TERMS).withColumn("bucket", I.bucket_of(F.col("term")))
    found = spark.createDataFrame([(1, 3)], "query_id long, verse_id long")
    plan = I.entries_of(postings.withColumn("bucket", I.bucket_of(F.col("term"))), found, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
