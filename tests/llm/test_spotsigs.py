"""Spot signatures against brute force."""

import bisect
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from scriptoria.llm import spotsigs as S
from tests.llm.cases import ascii_lower, documents, rows, text


def brute_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t))


def brute_signatures(t, anchors, chain, distance):
    w, out = brute_words(t), set()
    content = [k for k, y in enumerate(w) if y not in anchors]
    for i, x in enumerate(w):
        at = bisect.bisect_right(content, i)
        following = [w[k] for k in content[at : at + chain * distance][distance - 1 :: distance]]
        if x in anchors and len(following) == chain:
            out.add(" ".join([x, *following]))
    return out or ({" ".join(w)} if w else set())


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b and min(len(a), len(b)) >= S.LEAST * max(len(a), len(b)) else 0.0


def brute(data, anchors=None):
    if anchors is None:
        counts = Counter(w for _, t in data for w in brute_words(t or ""))
        anchors = [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[: S.ANCHORS]]
    texts = defaultdict(list)
    for i, t in data:
        texts[i].append(t or "")
    order = sorted((i for i in texts if i is not None), reverse=True) + [None] * (None in texts)
    after = {i: min(texts[n]) for i, n in zip(order, order[1:] + order[:1])}
    out = []
    name = lambda s: f"{len(s)}:{hashlib.sha256(chr(10).join(sorted(s, key=str.encode)).encode()).hexdigest()}"
    for i, t in data:
        t, following = t or "", after[i]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        own, other, nxt = (brute_signatures(x, anchors, S.CHAIN, S.DISTANCE) for x in (t, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), digest, name(own), name(other), brute_likeness(own, other), brute_likeness(own, nxt), len(own), len(other)))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "n_edited_signatures"]


def same(spark, data, **options):
    found = S.fingerprints(documents(spark, data).repartition(3), **options)
    key = lambda r: tuple(map(str, r))
    got, wanted = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=key), sorted(brute(data, options.get("anchors")), key=key)
    assert got == wanted and found.columns == COLUMNS


@pytest.mark.parametrize("chunk_rows,quantiles", [(1, 1), (3, 4), (256, 16)])
def test_every_id_once(spark, chunk_rows, quantiles):
    """Ids far apart, close together, negative and missing; chunks of one row and more."""
    once = list({i: t for i, t in rows()}.items())
    spread = [(i * 10**12 if i and i % 3 == 0 else i, t) for i, t in once] + [(2**62, "the end of it, <b>the</b> end"), (-(2**62), text(9, 50))]
    same(spark, spread + [(100 + k, text(k, 5 + 3 * k)) for k in range(30)], chunk_rows=chunk_rows, quantiles=quantiles)


def test_repeated_ids(spark):
    same(spark, rows() + [(8, "a smaller text under the id 8")] + [(10, text(1, 60))] * 40, chunk_rows=4, quantiles=3)


def test_anchors_given(spark):
    data = [(1, "The cat, and the dog and a bird saw a hat"), (2, "the the the"), (3, "the cat sat on the mat"), (4, "cat " * 30), (5, None), (6, "... !!")]
    same(spark, data, anchors=["the", "and", "a"])
    own = S.with_signatures(documents(spark, data[:1]), "text", "s", ["the", "and", "a"], 2, 1).first().s
    assert own == ["a bird saw", "and bird saw", "and dog bird", "the cat dog", "the dog bird"]
    same(spark, data, anchors=[])


def test_one_and_none(spark):
    same(spark, [(5, text(3, 40))])
    assert S.fingerprints(documents(spark, [])).collect() == []
