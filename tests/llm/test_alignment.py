"""Sparse products and token alignment against brute force."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm import alignment as A
from scriptoria.llm.csr import from_entries, product_blocks, transposed
from tests.conftest import SF_DIR
from tests.llm.cases import documents, rows


@given(st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.randoms(use_true_random=False), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_products(n, m, k, random, block):
    a, b = (np.array([[random.choice([0, 0, 1, 2]) for _ in range(w)] for _ in range(h)], dtype=np.int64).reshape(h, w) for h, w in ((n, m), (k, m)))
    left, right = (from_entries(*np.nonzero(x), *x.shape, x[np.nonzero(x)]) for x in (a, b))
    out = np.zeros((n, k), np.int64)
    for rows_, columns, values in product_blocks(left, transposed(right), block):
        out[rows_, columns] += values
    assert (out == a @ b.T).all()


def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A.BYTE_TOKENIZER)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=A.PIECE_TOKENIZER)


def ranges(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(table(i))))
        at += len(table(i))
    return out


def brute(data):
    t, model = tokenizers()
    alphabet = A.byte_level_alphabet()
    assert sorted(alphabet.values()) == list(range(256))
    a_bytes = lambda i: bytes(alphabet[c] for c in t.id_to_token(i))
    b_bytes = lambda i: bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    out, linked = [], []
    for i, text in data:
        a, b = (ranges(t.encode(" " + text, add_special_tokens=False).ids, a_bytes), ranges(model.encode(text), b_bytes)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(f(x[0]) for x in own) != whole for own, f in ((a, a_bytes), (b, b_bytes))):
            out.append((i, 0, 0, 0, "", 0))
            linked.append(Counter())
            continue
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        of = {cut: ([], []) for cut in cuts}
        for side, own in enumerate((a, b)):
            for x in own:
                of[cuts[bisect.bisect_left(cuts, x[2])]][side].append(x)
        groups = list(of.values())
        text_of = ";".join(",".join(str(x[0]) for x in g) + "|" + ",".join(str(y[0]) for y in h) for g, h in groups)
        overlaps = sum(x[1] < y[2] and y[1] < x[2] for g, h in groups for x in g for y in h)
        out.append((i, len(a), len(b), len(groups), hashlib.sha256(text_of.encode()).hexdigest(), overlaps))
        linked.append(Counter((x[0], y[0]) for g, h in groups for x in g for y in h))
    counts = Counter(pair for own in linked for pair in own)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    done = []
    for (i, n_a, n_b, n_groups, digest, overlaps), own in zip(out, linked):
        done.append((i, n_a, n_b, n_groups, sum(own.values()), sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()), digest, overlaps))
    return done


AWKWARD = [
    (900, "▁looks like a blank"), (901, "<|endoftext|> and <s> </s> <unk> <0x41>"), (902, "  two  blanks \n\n\t and  more   "), (903, "½ＡＢ é 漢字漢字 🙂‍👩‍👩‍👧 ȁ́ ​ 　 x"),
    (904, "x" * 3000), (905, "don't we'll they're 1234567 12,345.67 ----====____"), (906, "a\x00b\x01\x7f"), (907, " leading"), (908, "كتاب इतिहास ไทย Ελλάς"), (909, "!" * 501),
]


def by_row(rows_):
    return sorted(map(tuple, rows_), key=str)


def test_alignment(spark):
    data = rows() + AWKWARD + AWKWARD[:2]
    assert by_row(A.align_tokens(documents(spark, data).repartition(4)).collect()) == by_row(brute(data))
    assert A.align_tokens(documents(spark, [])).collect() == []


def test_query(spark):
    from scriptoria.llm.queries import QUERIES

    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert by_row(QUERIES["op13_tokenizer_alignment"](spark, SF_DIR).collect()) == by_row(brute(data))


@pytest.mark.parametrize("most", [1, 7, 60])
def test_pieces_change_no_token(most):
    texts = [t.encode() for _, t in rows() + AWKWARD if t] + ["one two, three  four\nfive 'six seven_8 9 ＡＢ é".encode(), ("漢字 かな " * 9).encode()]
    whole = A.Encoder(A.BYTE_TOKENIZER, A.PIECE_TOKENIZER)
    cut = A.Encoder(A.BYTE_TOKENIZER, A.PIECE_TOKENIZER, most)
    assert cut.b.cuts
    assert list(whole._encoded(texts)) == list(cut._encoded(texts))
    assert any(len(A.pieces(t.decode(), most)) > 1 for t in texts)


def test_links_of_one_slice():
    """Overlaps lie inside groups; the products of ids add up what the product of tokens lists."""
    encoder = A.Encoder(A.BYTE_TOKENIZER, A.PIECE_TOKENIZER)
    a, b = encoder([t.encode() if t else None for _, t in AWKWARD])
    groups = A.token_groups(a, b, *encoder.lengths)
    listed = [(x, y) for xs, ys, _ in A.group_links(groups) for x, y in zip(xs.tolist(), ys.tolist())]
    overlapping = {(x, y) for xs, ys, _ in A.overlap_links(a, b, *encoder.lengths) for x, y in zip(xs.tolist(), ys.tolist())}
    assert overlapping <= set(listed) and len(set(listed)) == len(listed)
    shared = sum(int(n.sum()) for _, _, n in A.overlap_links(a, b, *encoder.lengths))
    assert shared == int(encoder.lengths[0][a.ids].sum())
    by_id = Counter()
    for doc, x, y, n in A.id_links(a, b, groups, tuple(map(len, encoder.lengths))):
        by_id.update(dict(zip(zip(doc.tolist(), x.tolist(), y.tolist()), n.tolist())))
    wanted = Counter((int(np.searchsorted(a.ends, x, side="right")), int(a.ids[x]), int(b.ids[y])) for x, y in listed)
    assert by_id == wanted


def test_ranks_of_the_vocabulary_are_the_tokenizer():
    """The fast encoder gives the tokens of the tokenizer's own library, around every code point."""
    own, (t, _) = A.ByteTokens(A.BYTE_TOKENIZER), tokenizers()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0)]
    texts = [f" a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}  {chr(c)}\n{chr(c)} !{chr(c)}" for c in points] + [x or "" for _, x in AWKWARD]
    assert own.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
