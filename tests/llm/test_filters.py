"""URL filters, decontamination, language ID and quality grades."""

import hashlib
import re

import numpy as np
import pytest

from scriptoria.llm import langid, quality
from scriptoria.llm.decontaminate import find_leaks, tables_of, words_of
from scriptoria.llm.url_filter import PATTERN_RULES, SITE_RULES, judge_urls
from tests.conftest import SF_DIR
from tests.llm.cases import ascii_lower, documents, rows, text

RULES = "rule string, action string"


def brute_verdict(url, sites, patterns):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host, path = (ascii_lower(found[1]), found[2]) if found else ("", "")
    fits = [
        (len(r), len(r.split("/")[0]), r, a) for r, a in sites if r is not None
        for h, _, p in [r.partition("/")]
        if (host == h or host.endswith("." + h)) and (path.startswith("/" + p) if "/" in r else True) and found
    ]
    low, hits = ascii_lower(url or ""), []
    for r, a in patterns if url is not None else []:
        start, body = ("||", r[2:]) if r.startswith("||") else ("|", r[1:]) if r.startswith("|") else ("", r)
        end, body = (r"\Z", body[:-1]) if body.endswith("|") else ("", body)
        regex = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in ascii_lower(body))
        head = {"||": r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", "|": r"\A", "": ""}[start]
        if re.search(head + regex + end, low, re.DOTALL):
            hits.append((a == "allow", len(r), r, a))
    site, pattern = max(fits, default=None), max(hits, default=None)
    return host, path, site and site[2], pattern and pattern[2], (site or pattern or ("allow",))[-1]


def test_url_verdicts(spark):
    sites = SITE_RULES + [("b.org/fr/", "block"), ("org/f", "block"), ("example.net/en/x", "block"), ("bare.io", "block"), (None, "block")]
    patterns = PATTERN_RULES + [("track", "block"), ("*nt*x^", "block"), ("|https://m.", "allow"), ("a+b(c", "block"), ("é/ü^", "block")]
    urls = [None, "", "no address", "net/", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "http://a.example.net/en/1", "http://example.net/EN/1",
            "http://example.net/en", "http://a.org/fr/1", "http://a.b.org/fr/", "http://org/fr?x=/fr/", "http://b.org/foo#y", "http://example.net/en/xyz?q#f", "https://bare.io", "https://x.bare.io?a",
            "https://bare.io.net", "http://m.ads-track.example.com/1", "http://xads-track.com", "http://ads-track.io/spam-farm/help/", "ftp://a/b", "http://a/b.exe", "http://a/b.exe?x", "http://h/a/adserver",
            "http://h/adserverx", "http://h/banner12/q/click?x", "http://h/?utm_campaign=sponsored&x", "https://m.io/a+b(c", "http://h/nt--x", "http://h/zé/ü", "http://h/a\nb://net/", "http://user@net/x", "http://net:80/x"] * 2
    pages = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(urls)], "page_id long, url string, row string, verdict string")
    found = judge_urls(pages, spark.createDataFrame(sites, RULES), spark.createDataFrame(patterns, RULES))
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in found.collect()}
    assert got == {k: brute_verdict(u, sites, patterns) for k, u in enumerate(urls)}
    assert found.columns == ["page_id", "url", "row", "host", "path", "rule", "pattern", "verdict"]
    assert judge_urls(pages.limit(0), spark.createDataFrame(sites, RULES), spark.createDataFrame(patterns, RULES)).collect() == []
    none = spark.createDataFrame([], RULES)
    assert {r.verdict for r in judge_urls(pages, none, none).collect()} == {"allow"}


def brute_leaks(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[p : p + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        hit, found = set(), set()
        for p in range(len(w)):
            for m in range(1, window + 1):
                if p + m <= len(w) and tuple(w[p : p + m]) in wins:
                    hit.update(range(p, p + m))
                    found |= wins[tuple(w[p : p + m])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("block_words", [200_000, 10])
def test_leaks(spark, block_words):
    """Small blocks search the benchmark in several passes."""
    items = [(1, text(1, 25)), (2, text(200, 20).upper()), (10, "short one"), (9, text(5, 10)), (None, text(5, 12)), (11, None), (12, "!!"), (9, text(5, 10)), (13, "é12"), (14, "x x x x x x x x x x x")]
    docs = rows() + [(50, "a short, ONE! and " + text(5, 14)), (51, "é12"), (52, "short"), (53, text(1, 9)), (54, "x " * 30)]
    benchmark = spark.createDataFrame([(i, t, "r") for i, t in items], "item_id long, text string, row string")
    found = find_leaks(documents(spark, docs).drop("items"), benchmark, block_words=block_words)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=lambda r: tuple((v is None, v) for v in r)) == brute_leaks(docs, items)
    assert found.columns[:4] == ["doc_id", "text", "lang", "source"] and [r.key for r in found.limit(2).collect()] == ["k", "k"]


def test_leaks_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(documents(spark, []), empty).collect() == []
    assert {r.n_hit for r in find_leaks(documents(spark), empty).collect()} == {0}


def test_shift_tables_find_every_occurrence():
    rng = np.random.default_rng(1)
    items = [(k, " ".join(rng.choice(list("abc"), rng.integers(1, 15))).encode()) for k in range(30)]
    words = words_of(" ".join(rng.choice(list("abc"), 3000)).encode())
    for t in tables_of(items):
        wins = {tuple(w[p : p + t.length]) for _, x in items for w in [words_of(x)] for p in range(len(w) - t.length + 1) if t.length == min(10, len(w))}
        assert [s for s, _ in t.search(words)] == [p for p in range(len(words) - t.length + 1) if tuple(words[p : p + t.length]) in wins]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(SF_DIR.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.trained_on_the_rest(docs)
    judged = langid.identify(docs.where(langid.held_out()), model).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in judged]) > 0.98
    assert all(0 <= r.score <= 1 for r in judged)


def test_language_of_awkward_documents(spark):
    docs = documents(spark)
    model = langid.train(docs.where("doc_id < 12"))
    found = langid.identify(docs, model)
    assert found.columns == docs.columns + ["lang_pred", "score", "lang_known"] and found.count() == docs.count()
    for r in found.collect():
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert r.lang_pred in ("und", "xx")
    nobody = langid.train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(docs, nobody).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_presence_covers_the_whole_text(monkeypatch):
    """Pieces of a very long text overlap, so none of its n-grams is lost."""
    t = " ".join(f"wörd{k}" for k in range(300))
    whole = langid.presence(t)
    monkeypatch.setattr(langid, "_PIECE", 37)
    assert (langid.presence(t) == whole).all()


def rich_text(language, n_chars, seed):
    """Invented words of a language's own syllables, a fifth of them random letters that all languages share."""
    own, rng = np.random.default_rng(language), np.random.default_rng([seed, language])
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    syllables = np.array(["".join(own.choice(letters, own.integers(2, 4))) for _ in range(400)])
    n = n_chars // 5
    words = np.char.add(syllables[rng.integers(0, 400, n)], syllables[rng.integers(0, 400, n)])
    noise = ["".join(w) for w in letters[rng.integers(0, 26, (n, 6))]]
    return " ".join(np.where(rng.random(n) < 0.2, noise, words))[:n_chars]


def test_language_of_long_texts_of_rich_vocabulary(spark):
    """So many different n-grams that a text as a whole would have nearly all of them."""
    data = [(100 * g + k, rich_text(g, int(n), k), f"l{g}") for g in range(5) for k, n in enumerate(np.geomspace(500, 40_000, 16))]
    model = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    long = [(100 * g + k, rich_text(g, n, 900 + k), f"l{g}") for g in range(5) for k, n in enumerate((60, 300_000, 600_000))]
    judged = langid.identify(spark.createDataFrame(long, "doc_id long, text string, lang string"), model).collect()
    assert [r.lang_pred for r in judged] == [r.lang for r in judged]
    assert all(0 < r.score <= 1 for r in judged)


def test_training_sample_is_bounded_over_all_languages(spark, monkeypatch):
    """Many strings in lang - region tags, typing errors - share one bound; the frequent ones are learned."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(langid, "LANDMARKS", 12)
    data = [(50 * g + k, rich_text(g % 5, 300, k), f"l{g}") for g in range(40) for k in range(20 if g < 5 else 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    bits, labels, _ = langid.training_sample(docs)
    assert len(labels) == len(bits) <= 60 and len(set(labels)) == 12
    assert {x: labels.count(x) for x in labels if x in {f"l{g}" for g in range(5)}} == {f"l{g}": 5 for g in range(5)}
    seen, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: seen.append(len(m)) or eigh(m))
    assert len(langid.fit(bits, labels).languages) == 12 and seen[0] <= 12


def test_pieces_cover_the_whole_text(monkeypatch):
    """A change of any byte changes a piece; the pieces' n-grams are those of the text, and their shares make one."""
    monkeypatch.setattr(langid, "PIECE_BYTES", 37)
    for t in ("", "a", " ".join(f"wörd{k}" for k in range(300))):
        pieces = list(langid._pieces([None, t]))
        assert {k for k, _, _ in pieces} == {1} and np.isclose(sum(share for _, share, _ in pieces), float(bool(t)))
        assert (np.max([bits for _, _, bits in pieces], axis=0) == langid.presence(t)).all()
    monkeypatch.setattr(langid, "BLOCK_PIECES", 3)
    model = langid.Model(["a", "b"], np.random.default_rng(2).random((langid.CELLS, 2)) / 100)
    t = "some wörds " * 50
    wanted = sum(share * (bits @ model.matrix) / np.sqrt(bits.sum()) for _, share, bits in langid._pieces([t]))
    (lang, score, _), other = list(model.predict([t, None]))
    assert other == ("und", 0.0, False) and lang == "ab"[wanted.argmax()] and np.isclose(score, min(wanted.max(), 1), atol=1e-5)


def test_folded_scores_are_kernel_ridge_regression():
    texts = [f"the {w} of and" for w in "abcdefgh"] + [f"der {w} und die" for w in "abcdefgh"]
    bits = np.stack([langid.presence(t) for t in texts])
    labels = ["en"] * 8 + ["de"] * 8
    model = langid.fit(bits, labels, landmarks_per_language=8)
    unit = bits / np.sqrt(bits.sum(axis=1))[:, None]
    kernel = unit @ unit.T
    wanted = np.array([[x == "de", x == "en"] for x in labels], float)
    exact = kernel @ np.linalg.solve(kernel + langid.RIDGE * 16 * np.eye(16), wanted)
    assert np.allclose(bits @ model.matrix / np.sqrt(bits.sum(axis=1))[:, None], exact, atol=1e-3)


def test_grades_of_held_out_documents(spark):
    folder = SF_DIR.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = quality.ratings_of(spark.read.parquet(f"{folder}/labels.parquet"))
    model = quality.train(docs, rated.where("doc_id % 4 <> 1"))
    judged = quality.grade_documents(docs.join(rated.where("doc_id % 4 = 1"), "doc_id"), model, 2).select("grade", "kept", "expected_grade", "p_tail").collect()
    kept = {g: np.mean([r.kept for r in judged if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.97 and kept[0] < 0.1 and kept[1] < 0.2
    assert all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in judged)
    assert (np.diff(model.thresholds) > 0).all()


def test_grades_of_awkward_documents(spark):
    docs = documents(spark)
    rated = spark.createDataFrame([(8, 2), (9, 0), (11, 1), (12, 0), (None, 2), (14, None), (8, 2), (99, 1)], "doc_id long, grade int")
    found = quality.grade_documents(docs, quality.train(docs, rated), 2)
    assert found.columns == docs.columns + ["expected_grade", "p_tail", "kept"] and found.count() == docs.count()
    untaught = quality.train(docs, rated.limit(0))
    assert quality.grade_documents(docs, untaught, 2).count() == docs.count()
    assert quality.grade_documents(docs.limit(0), untaught, 2).collect() == []


def test_tails_are_sums_of_grade_probabilities():
    model = quality.Model(np.zeros(quality.CELLS), np.array([-1.0, 0.5, 2.0]))
    expected, tails = model.grades([np.zeros(0, np.int64)])
    below = np.concatenate([[0], 1 / (1 + np.exp(-model.thresholds)), [1]])
    assert np.isclose(expected[0], (np.diff(below) * np.arange(4)).sum()) and np.allclose(tails[0], 1 - below[1:-1])
