import unicodedata

from pyspark.sql import functions as F

from scriptoria.operators import divisions as D
from scriptoria.operators import tei_build as B
from scriptoria.session import cut_lineage
from scriptoria.sources import lexicon, tei

HEAD = """<TEI.2><teiHeader><fileDesc><titleStmt><title type="sub">Machine text</title><title>Vita <hi>Iosephi</hi> (Greek).</title>
<author>Header Author</author><editor>B. Niese</editor></titleStmt><sourceDesc><biblStruct><author>Flavius Josephus</author></biblStruct></sourceDesc></fileDesc>
<encodingDesc>{states}</encodingDesc><profileDesc><langUsage><language id="x">{language}</language></langUsage></profileDesc></teiHeader><text><body>{body}</body></text></TEI.2>"""
SECTION = '<refsDecl><state unit="section"/></refsDecl>'


def build(spark, body, states=SECTION, language="English", **options):
    xml = HEAD.format(states=states, body=body, language=language)
    nodes = cut_lineage(tei.parse_nodes(spark.createDataFrame([("f.xml", xml)], "file string, xml string")))
    chosen = B.parameters(tei.header_metadata(nodes))
    for name, value in options.items():
        chosen = chosen.withColumn(name, F.lit(value))
    return B.build(nodes, tei.state_sets(nodes), chosen)


def listed(tables):
    divisions = [(r.sequence_number, r.parent_no, r.level, r.descriptor, r.title, r.readable_unit) for r in tables["divisions"].orderBy("division_no").collect()]
    verses = [(r.division_no, r.sequence_number, r.indicator, r.content) for r in tables["verses"].orderBy("division_no", "sequence_number").collect()]
    return divisions, verses


def test_header(spark):
    xml = HEAD.format(states="<step refunit='line'/>", body="", language=" Greek ")
    row = tei.header_metadata(tei.parse_nodes(spark.createDataFrame([("f", xml)], "file string, xml string"))).first()
    assert (row.language, row.title, row.author, row.editors, row.numbers_lines) == ("Greek", "Vita Iosephi (Greek)", "Flavius Josephus", ["B. Niese"], True)


def test_nested_divisions_and_mixed_content(spark):
    body = (
        '<div1 type="Book" n="1"><head>Book I</head><div2 type="Chapter" n="1"><p><milestone unit="section" n="1"/>one <hi>two</hi>'
        '<milestone unit="section" n="2"/>three</p><p>four</p></div2><div2 type="Chapter" n="2"><p>bare</p></div2></div1>'
        '<div1 type="intro"><p>preface</p></div1>'
    )
    tables = build(spark, body)
    divisions, verses = listed(tables)
    assert divisions == [
        (1, None, 1, "1", "Book I", False), (2, 1, 2, "1", None, True), (3, 1, 2, "2", None, True), (4, None, 1, "2", "Introduction", True)
    ]
    assert verses == [(2, 1, "1", "one two"), (2, 2, "2", "threefour"), (3, 1, "", "bare"), (4, 1, "", "preface")]
    markup = {(r.division_no, r.sequence_number): r.original_content for r in tables["verses"].collect()}
    assert markup[(2, 1)] == "<verse>one <hi>two</hi></verse>"
    assert markup[(2, 2)] == "<verse>three<p>four</p></verse>"
    chapter = {r.division_no: r.original_content for r in tables["divisions"].collect()}
    assert chapter[2].startswith('<chapter><p><milestone unit="section" n="1"></milestone>one')


def test_cards_get_line_ranges(spark):
    body = '<div1 n="1"><milestone unit="card" n="1"/><l>a</l><l>b</l><l>c</l><milestone unit="card" n="40"/><l n="40">d</l><l>e</l></div1>'
    tables = build(spark, body, use_line_count=True)
    divisions, verses = listed(tables)
    assert [d[4] for d in divisions] == [None, "lines 1-39", "lines 40-41"]
    assert [d[3] for d in divisions] == ["1", "1", "40"]
    assert [v[3] for v in verses] == ["abc", "de"]


def test_options(spark):
    body = '<div1 n="1"><p>before<milestone unit="section" n="1"/>text<note>n</note></p><div2 n="x"><p>deep</p></div2></div1>'
    assert [v[3] for v in listed(build(spark, body, ignore_content_before_first_milestone=True))[1]] == ["textn"]
    assert [v[3] for v in listed(build(spark, body, ignore_notes=True))[1]] == ["before", "text", "deep"]
    assert [d[3] for d in listed(build(spark, body, division_tags=["div2"]))[0]] == ["1", "x"]
    assert [(d[3], d[5]) for d in listed(build(spark, body, only_leaf_divisions_readable=True))[0]] == [("1", False), ("x", True)]
    assert [v[3] for v in listed(build(spark, body, division_min=1))[1]] == ["beforetextn", "deep"]
    assert [r.error for r in build(spark, body, ignore_division_markers=True)["rejects"].collect()] == []
    assert build(spark, "<p>x</p>")["rejects"].count() == 1


def test_lexicon_keys_are_beta_code(spark):
    body = '<div0 n="a"><entry key="a)a/atos"><orth>a)a/atos</orth> hurt</entry></div0>'
    tables = build(spark, body, division_tags=["entry"], language="Greek")
    got = listed(tables)[0]
    assert [unicodedata.normalize("NFKC", d[3]) for d in got] == [unicodedata.normalize("NFKC", "ἀάατος")]
    heads = lexicon.headwords(tables["verses"].select(F.lit(1).alias("verse_id"), F.lit(1).alias("work_id"), "original_content"))
    assert [r.headword for r in heads.collect()] == ["a)a/atos"]


def test_greek_text_and_heads(spark):
    body = '<div1 n="1"><head lang="greek">lo/gos</head><p>kai\\ to\\</p></div1>'
    divisions, verses = listed(build(spark, body, language="Greek"))
    assert verses[0][3] == "καὶ τὸ"


def test_orphans(spark):
    divisions = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, None)], "division_id long, parent_id long")
    verses = spark.createDataFrame([(2,)], "division_id long")
    assert sorted(r.division_id for r in D.without_orphans(divisions, verses).collect()) == [1, 2]


def test_integer_keys_are_unique(spark):
    tables = build(spark, '<div1 n="1"><p>a</p></div1><div1 n="2"><p>b</p></div1>')
    ids = B.number_files(tables["divisions"])
    keyed = B.with_ids(tables, ids)
    joined = keyed["verses"].join(keyed["divisions"], "division_id")
    assert joined.count() == 2 and keyed["verses"].select("verse_id").distinct().count() == 2


def test_all_states_but_the_last_divide(spark):
    states = '<refsDecl><state unit="page"/><state unit="section"/></refsDecl>'
    body = '<p><milestone unit="page" n="1"/>a<milestone unit="section" n="1"/>b<milestone unit="page" n="2"/>c</p>'
    divisions, verses = listed(build(spark, body, states=states, only_last_state_is_non_chunk=True))
    assert [(d[2], d[3]) for d in divisions] == [(1, "1"), (1, "2")]
    assert [(v[0], v[3]) for v in verses] == [(1, "a"), (1, "b"), (2, "c")]


def test_nodes_within_an_element_come_from_whole_files(spark):
    """Rows outside the element are left out, but a file is read to its end; small files share a batch."""
    whole = "<r><x a='1' b='&lt;'>t<y/></x><body>words<z/></body><x>u</x></r>"
    files = spark.createDataFrame([("f", whole), ("bad", "<r><x>t</x><body></r>"), ("none", "<r>w</r>")], "file string, xml string").coalesce(1)
    every = tei.parse_nodes(files)
    some = tei.parse_nodes(files, within="x")
    rows = lambda df: sorted(((r.file, r.node_seq, r.end_seq, r.kind, r.tag, r.attrs, r.text) for r in df.collect()), key=repr)
    spans = [(r.node_seq, r.end_seq) for r in every.where("file = 'f' AND tag = 'x'").collect()]
    inside = [r for r in rows(every) if r[0] != "f" or r[1] == 1 or any(a <= r[1] and r[2] <= b for a, b in spans)]
    assert rows(some) == [r for r in inside if r[0] != "none" or r[3] == "element"] and len(rows(some)) < len(rows(every))
    assert some.where("file = 'bad'").first().error is not None
    assert some.where("file = 'f' AND node_seq = 2").first().attrs == {"a": "1", "b": "<"}


def test_headers_and_events_are_stored_slim(spark):
    """Headers are taken from the nodes once for all their parts, and events keep what is read, attributes at start tags only."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    xml = """<TEI.2><teiHeader><fileDesc><titleStmt><title>T</title><author>A</author><editor>B and C</editor></titleStmt></fileDesc><encodingDesc>
      <refsDecl><state unit="section"/></refsDecl></encodingDesc><profileDesc><langUsage><language>en</language></langUsage></profileDesc></teiHeader>
      <text><body><div1 type="chapter" n="1"><p><milestone unit="section" n="1"/>one <hi rend="it">two</hi></p></div1></body></text></TEI.2>"""
    nodes = tei.parse_nodes(spark.createDataFrame([("f", xml)], "file string, xml string"))
    rows = nodes.count()
    headers = tei.header_metadata(nodes.mapInArrow(count, nodes.schema))
    row = headers.first()
    assert (row.title, row.author, row.editors, row.language) == ("T", "A", ["B", "C"], "en") and made.value <= 3 * rows
    events = B.cut_up(nodes, tei.state_sets(nodes), B.parameters(headers))
    assert not {"states", "__state", "division_tags", "state_set"} & set(events.columns)
    assert {r.ev for r in events.where("attrs IS NOT NULL").collect()} == {"o"}
    assert [(r.indicator, r.content, r.original_content) for r in B.verses_of(events).collect()] == [("1", "one two", '<verse>one <hi rend="it">two</hi></verse>')]
