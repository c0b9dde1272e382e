"""Exact, substring and near-duplicate removal against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm.exact_dedup import PRIMES, Fingerprint, combine, exact_duplicates, same_bytes
from scriptoria.llm.minhash import components, near_duplicates
from scriptoria.llm.recompression import Numbers, recompress
from scriptoria.llm.substring_dedup import remove_repeats
from tests.llm.cases import ascii_lower, blank_words, documents, rows, text


def key(row):
    return tuple((v is None, v) for v in row)


def brute_exact(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[ascii_lower(t or "")].append(i)
    out = []
    for i, t in data:
        t = ascii_lower(t or "")
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("primes", [PRIMES, (3, 2)])
@pytest.mark.parametrize("group_rows", [1000, 1, 3])
def test_exact_duplicates(spark, primes, group_rows):
    """Tiny primes make unequal texts share fingerprints; groups of one or three rows make copies meet in rounds."""
    data = rows() + [(100 + k, t) for k, t in enumerate(["ab", "ba", "cd", "AB", "ab", "Cd"] * 3)]
    found = exact_duplicates(documents(spark, data), group_rows, primes).collect()
    assert sorted((tuple(r) for r in found), key=key) == brute_exact(data)
    assert exact_duplicates(documents(spark, [])).collect() == []


def test_exact_duplicates_of_a_hot_id(spark):
    """One id in all rows of a group: rows are dealt out by row, and several rounds bring the group together."""
    data = [(7, "same text") for _ in range(40)] + [(9, "Same Text"), (8, "other")]
    found = exact_duplicates(documents(spark, data), 2).collect()
    assert sorted((tuple(r) for r in found), key=key) == brute_exact(data)


@given(st.binary(max_size=300), st.binary(max_size=300), st.integers(2, 40))
@settings(max_examples=60, deadline=None)
def test_fingerprints_compose(a, b, chunk):
    make = Fingerprint(chunk_bytes=chunk)
    assert make(a + b) == [combine(x, y, len(b), p) for x, y, p in zip(make(a), make(b), PRIMES)]
    assert make(a) == Fingerprint()(a)
    assert same_bytes(a, b, 7) == (a == b)


def brute_repeats(data, window=13):
    first = {}
    split = [(i, blank_words(t)) for i, t in data]
    for i, w in split:
        for p in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [13, 5])
def test_remove_repeats(spark, window):
    rng = np.random.default_rng(3)
    passages = [text(int(a), int(n)) for a, n in zip(rng.integers(0, 300, 12), rng.integers(9, 70, 12))]
    mixed = [
        (1000 + k, " ".join(passages[j] + " " + " ".join(f"u{x}" for x in rng.integers(0, 5, rng.integers(0, 9))) for j in rng.integers(0, 12, 3)))
        for k in range(60)
    ]
    data = rows() + mixed + [(2000 + k, " ".join(["a", "b"][: 1 + k % 2] * (20 + k))) for k in range(6)]
    found = remove_repeats(documents(spark, data).repartition(5), window).collect()
    assert sorted((tuple(r) for r in found), key=key) == brute_repeats(data, window)


def test_remove_repeats_of_nothing(spark):
    assert remove_repeats(documents(spark, [])).collect() == []


@given(st.lists(st.sampled_from("abc"), min_size=13, max_size=40), st.lists(st.sampled_from("abcd"), max_size=15), st.lists(st.sampled_from("abcd"), max_size=15))
@settings(max_examples=150, deadline=None)
def test_symbols_whose_reach_is_inside_stand_in_every_occurrence(core, before, after):
    """The promise that the tests of a window rest on."""
    numbers = Numbers()

    def inside(words, at):
        words = [w.encode() for w in words] + [b" "]
        wall = np.array([w == b" " for w in words])
        s = recompress(numbers(words)[:, 0], wall)
        return {
            (int(n), int(a) - at, int(e) - at) for n, a, e, low, high in zip(s.name, s.start, s.end, s.low, s.high)
            if low >= at and high <= at + len(core)
        }

    assert inside(core + after, 0) == inside(before + core, len(before)) == inside(before + core + after, len(before))


def brute_near(data, percent=80, n_words=2):
    sets = []
    for i, t in data:
        w = blank_words(ascii_lower(t or ""))
        sets.append({tuple(w[p : p + n_words]) for p in range(max(1, len(w) - n_words + 1))} if w else set())
    label = list(range(len(data)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for x in range(len(data)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
                label[root(x)] = root(y)
    least = defaultdict(list)
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[root(k)].append(i)
    out = []
    for k, (i, _) in enumerate(data):
        c = i if not sets[k] else min(least[root(k)], default=None)
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=key)


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    data = rows()
    for family in range(6):
        base = [f"f{family}x{k}" for k in range(80)]
        for k in range(14):  # chains: each is a change of the one before, far ends are not linked
            at = int(rng.integers(0, 78))
            base = base[:at] + [f"n{family}{k}"] + base[at + 1 :]
            data.append((5000 - 14 * family - k, " ".join(base)))
    found = near_duplicates(documents(spark, data).repartition(4)).collect()
    assert sorted((tuple(r)[:4] for r in found), key=key) == brute_near(data)


def test_word_hashes(monkeypatch):
    """Equal words, wherever blocks are cut, have equal hashes; different ones do not."""
    from scriptoria.llm import wordhash

    texts = [t.encode() if t is not None else None for _, t in rows()] + [b"y" * 90 + b" " + b"y" * 91 + b" " + b"z" * 33, b" A\x0bB\rc\td "]
    wanted = [ascii_lower(w) for t in texts for w in blank_words(t.decode() if t else "")]
    for block in (1, 50, 1 << 18):
        monkeypatch.setattr(wordhash, "BLOCK_BYTES", block)
        hashes, counts = wordhash.word_hashes(texts)
        assert counts.tolist() == [len(blank_words(t.decode() if t else "")) for t in texts]
        assert len(set(zip(hashes.tolist(), wanted))) == len(set(wanted)) == len(set(hashes.tolist()))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    assert [r.kept for r in near_duplicates(documents(spark, [(1, None), (2, "")])).collect()] == [True, True]


def test_components_of_a_long_chain(spark):
    links = [(f"{k:03d}".encode(), f"{k + 1:03d}".encode()) for k in range(60)] + [(b"zb", b"za")]
    found = {bytes(r.node): bytes(r.label) for r in components(spark.createDataFrame(links, "x binary, y binary")).collect()}
    assert found == {f"{k:03d}".encode(): b"000" for k in range(61)} | {b"za": b"za", b"zb": b"za"}
