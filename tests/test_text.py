import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptoria.functions import betacode as B
from scriptoria.functions import markup, normalize, strings, tokens


def one(spark, column, **values):
    frame = spark.createDataFrame(pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in values.items()}), ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


GREEK = {
    "H)/LIOS": "ἤλιος", "O( KO/SMOS": "ὁ κόσμος", "KAI\\": "καὶ", "KAT)": "κατʼ", "*(ikanw=s me\\n": "Ἱκανῶς μὲν",
    "au)th=|": "αὐτῇ", "STH/SAI": "στήσαι", "*)epafro/dite,": "Ἐπαφρόδιτε,", "par' h(mi=n": "παρ' ἡμῖν",
}


@pytest.mark.parametrize("beta", GREEK)
def test_beta_code(spark, beta):
    got = one(spark, normalize.normalize(B.beta_to_unicode(F.col("s"))), s=beta)
    assert got == one(spark, normalize.normalize(F.col("s")), s=GREEK[beta])


@pytest.mark.parametrize("beta", ["H)/LIOS", "KAI\\", "*KAI E)GE/NETO E)N TW=| TETA/RTOW", "A/E/H/O/I/U/W/"])
def test_beta_code_round_trip(spark, beta):
    assert one(spark, B.unicode_to_beta(B.beta_to_unicode(F.col("s"))), s=beta) == beta


def test_tonos_and_oxia_go_back_alike(spark):
    assert one(spark, B.unicode_to_beta(F.col("s")), s="άά") == "A/A/"


def test_final_sigma_and_accents(spark):
    assert one(spark, B.fix_final_sigma(F.col("s")), s="κόσμοσ σοφόσ.") == "κόσμος σοφός."
    assert one(spark, normalize.strip_accents(F.col("s")), s="θεός ﬁn Ça") == "θεος fin Ca"
    assert one(spark, normalize.normalize(F.col("s")), s="ﬁ é") == "fi é"


def test_transform_by_language(spark):
    assert one(spark, B.transform_text(F.col("s"), F.col("l")), s="LOGOS", l="GREEK") == "λογος"
    assert one(spark, B.transform_text(F.col("s"), F.col("l")), s="LOGOS", l=None) == "LOGOS"


def test_whitespace_slugs_titles(spark):
    assert one(spark, strings.collapse_whitespace(F.col("s")), s="  a\n\nb \t c ") == "ab c"
    assert one(spark, strings.collapse_whitespace(F.col("s"), False), s="  a\n\nb") == "a\nb"
    assert one(spark, strings.slugify(F.col("s")), s=" Éloge: of the -- Sea_man! ") == "eloge-of-the-sea_man"
    assert one(spark, strings.unslugify(F.col("s")), s="new-testament_greek") == "New Testament Greek"
    assert one(spark, strings.clean_title(F.col("s")), s=" Works (Greek). Machine readable text") == "Works"
    assert one(spark, strings.person_surname(F.col("s")), s="William Whiston, A.M.") == "Whiston"


def test_line_numbers(spark):
    number = strings.line_number(F.col("s"))
    assert one(spark, strings.format_line_number(number, 1), s="a354b") == "a355b"
    assert one(spark, strings.format_line_number(number), s="12") == "12"
    assert one(spark, number, s="tr") is None


def test_tokens_keep_beta_signs(spark):
    assert one(spark, tokens.word_tokens(F.col("s")), s="NO/MOU, a.b. x") == ["no/mou", "a.b", "x"]
    assert one(spark, tokens.section_tokens(F.col("s")), s="Book 1,book-1") == ["book 1", "book-1"]
    assert one(spark, tokens.standard_tokens(F.col("s")), s="The Life of Josephus") == ["life", "josephus"]


def test_snippet_keeps_short_texts_whole(spark):
    assert one(spark, tokens.snippet(F.col("s"), 5), s="abc defg hij") == "abc defg"
    assert one(spark, tokens.snippet(F.col("s"), 50), s="abc") == "abc"


def test_highlights(spark):
    shown = tokens.highlight_fragments(F.col("s"), F.array(F.lit("amet")), surround=1)
    assert one(spark, shown, s="lorem ipsum dolor Amet, sit x y amet") == "dolor <b>Amet</b>, sit...y <b>amet</b>"


def test_html_spans(spark):
    convert = markup.html_converter()
    got = one(spark, convert(F.col("x"), F.col("l")), x='<verse n="1">a &amp; <hi rend="b">c</hi><!-- no --><lb/></verse>', l="English")
    assert got == '<span class="verse" data-n="1">a &amp; <span class="hi" data-rend="b">c</span><span class="lb"></span></span>'
    words = markup.html_converter(wrap_words=True)
    got = one(spark, words(F.col("x"), F.col("l")), x="<v>KAI\\, <note>in English</note></v>", l="Greek")
    assert got == '<span class="v"><span class="word">καὶ</span>, <span class="note">in English</span></span>'


def test_html_hooks(spark):
    convert = markup.html_converter(text_hook=lambda text, element: text.upper(), node_hook=lambda tag, a: "<i>" if tag == "hi" else None)
    assert one(spark, convert(F.col("x"), F.col("l")), x="<v>a<hi>b</hi></v>", l=None) == '<span class="v">A<i>B</span></span>'


def test_notes_and_hidden_parts(spark):
    xml = "<verse>text<note>one <hi>two</hi></note> more<note>three</note></verse>"
    assert one(spark, markup.footnotes(F.col("x"), F.col("l")), x=xml, l="English") == ["one two", "three"]
    got = one(spark, markup.text_and_notes(F.col("x"), F.col("l"), F.lit(4)), x=xml, l="English")
    assert (got.text, got.notes) == ("text[4] more[5]", ["one two", "three"])
    assert one(spark, markup.prune_hidden(F.col("x")), x='<a><sup class="x hide">n</sup>t<span class="hide">z</span></a>') == "<a>t</a>"
    assert one(spark, markup.prune_hidden(F.col("x")), x="<a>") == "<a>"
