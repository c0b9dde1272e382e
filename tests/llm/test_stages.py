"""Stages of the pipeline on inputs where a looser rule would lose documents."""

from collections import Counter

import numpy as np

import corpus_pipeline
from scriptoria.llm import langid
from tests.conftest import SF_DIR
from tests.llm.cases import ascii_lower, blank_words, documents, rows, text


def brute_known(model, t):
    """Kernel scores of the pieces of a text, summed bit by bit, against the floors of their sizes."""
    if not t or not any(c.isalpha() for c in t):
        return False
    scores, floor = np.zeros(len(model.languages)), 0.0
    for _, share, bits in langid._pieces([t]):
        on = np.flatnonzero(bits)
        scores += share * model.matrix[on].astype(np.float64).sum(axis=0) / np.sqrt(len(on))
        floor += share * model.floors[len(on).bit_length()]
    return scores.max() >= floor


def brute_kept(data, n_words=5, percent=80):
    """(id, text) of the rows that stay when documents are linked by sets of ``n_words`` consecutive words."""
    words = [blank_words(ascii_lower(t or "")) for _, t in data]
    sets = [{tuple(w[p : p + n_words]) for p in range(max(1, len(w) - n_words + 1))} if w else set() for w in words]
    group = list(range(len(data)))
    for x in range(len(data)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if group[x] != group[y] and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                group = [group[y] if g == group[x] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, data):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return Counter({(i, t) for k, (g, (i, t)) in enumerate(zip(group, data)) if not sets[k] or i == least.get(g)})


def test_near_dedup_takes_five_words(spark):
    apart = text(1, 60).split()
    apart[10] = apart[30] = apart[50] = "other"  # two-word similarity above 0.8, five-word far below
    for data in (rows() + [(300, " ".join(apart))], [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]):
        found = corpus_pipeline.near_dedup(spark, documents(spark, data).repartition(3), SF_DIR)
        assert Counter((r.doc_id, r.text) for r in found.collect()) == brute_kept(data) != brute_kept(data, 2)


def test_near_dedup_judges_rows_by_their_text(spark):
    """Ids that repeat, and rows without id, stay or go by their own text."""
    a, b, c = text(1, 60), text(150, 50), text(77, 40)
    data = [(1, a), (2, a), (2, b), (None, a), (None, b), (None, c), (None, c), (None, ""), (None, None), (3, ""), (2, b), (1, a), (4, c + " end"), (5, b)]
    found = corpus_pipeline.near_dedup(spark, documents(spark, data).repartition(4), SF_DIR)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == brute_kept(data)


def test_language_stage_rejects_by_score(spark):
    """What is made of letters but of no learned language goes; every document of the languages stays."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) > 0").select("doc_id", "text", "lang", "source")
    rng = np.random.default_rng(3)
    junk = [(10_000 + k, "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 300 + 500 * k)), None, "s") for k in range(8)]
    junk += [(20_000, "漢字仮名交じり文の例です" * 30, None, "s"), (20_001, "²½Ⅷ" * 9, "en", "s")]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, SF_DIR).collect()}
    assert not kept & {j[0] for j in junk}
    model = langid.trained_on_the_rest(both)
    assert kept == {r.doc_id for r in both.collect() if brute_known(model, r.text)}
    lettered = [r.doc_id for r in docs.where("lang IS NOT NULL").collect() if any(c.isalpha() for c in r.text)]
    assert len(set(lettered) - kept) <= 0.01 * len(lettered)


def test_signs_that_are_no_letters():
    model = langid.Model(["a", "b"], np.ones((langid.CELLS, 2)))
    assert [f[0] for f in model.predict(["²", "½", "Ⅷ", "ª", "漢", "_1", None])] == ["und", "und", "und", "a", "a", "und", "und"]


def test_language_stage_without_languages(spark):
    """Nothing to learn from is not the same as no letter."""
    wanted = sorted(str(t) for _, t in rows() if t and any(c.isalpha() for c in t))
    nothing = documents(spark)
    for lang in ("CAST(NULL AS STRING)", "'und'"):
        found = corpus_pipeline.language(spark, nothing.selectExpr("doc_id", "text", f"{lang} AS lang", "source"), SF_DIR)
        assert found.columns == ["doc_id", "text", "lang", "source"]
        assert sorted(r.text for r in found.collect()) == wanted
    assert corpus_pipeline.language(spark, nothing.limit(0), SF_DIR).collect() == []
