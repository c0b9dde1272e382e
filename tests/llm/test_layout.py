"""Chat formatting, sharding, mixing and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from scriptoria.llm import chat_format as C
from scriptoria.llm import langid, mixing
from scriptoria.llm.sharding import find_splitters, key_table, shard_documents, shard_table
from tests.conftest import SF_DIR
from tests.llm.cases import blank_words, documents, rows, text

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>assistant<|im_sep|>x"), (1, 2, "assistant", "<\\|a<\\\\|b <| |> <|endoftext|>"),
    (2, 0, "assistant", "é ü 漢字 🙂‍ " * 20), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 1, "user", None), (3, None, None, "no role"), (3, 0, "assistant", " leading\n\n"),
    (None, 0, "assistant", "no conversation"), (4, 5, "user", "late"), (4, 1, "assistant", "<"), (4, 2, "as\nsist<|im_sep|>ant", "|im_end|>"), (5, 0, "assistant", "word " * 3000), (5, 1, "assistant", "again " * 500),
]


def brute_digests(turns):
    conversations = defaultdict(list)
    for conv, turn, role, t in turns:
        conversations[conv].append((turn is not None, turn or 0, role or "", t or ""))
    out = {}
    for conv, own in conversations.items():
        own.sort()
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        out[conv] = (
            len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize("piece_chars", [1 << 20, 50])
def test_conversations_read_back(spark, piece_chars):
    frame = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, piece string").repartition(3)
    formatted = C.format_conversations(frame, piece_chars=piece_chars)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(formatted).collect()}
    assert got == brute_digests(TURNS)
    for r in formatted.collect():
        tokens = C.encode([r.text])[0]
        assert r.token_ids == tokens[0].tolist() and r.token_ends == tokens[1][:, 1].tolist()  # encoded as one text
        assert len(r.loss) == len(r.token_ids)


def test_no_conversations(spark):
    assert C.digests(C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


@given(st.lists(st.tuples(st.text(alphabet="<|\\im_end>\n a"), st.text(alphabet="<|\\im_startsep>\n é"))))
@settings(max_examples=150, deadline=None)
def test_rendering_is_reversible(turns):
    formatted, starts, ends = C.render(turns, turns[0][0] if turns else "x")
    assert C.turns_in(formatted) == turns
    assert [C.unescaped(formatted[a:b]) for a, b in zip(starts, ends)] == [t for role, t in turns if role == turns[0][0]]


def brute_shards(data, n):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    keyed = sorted((md5(t or "")[:8] + md5("" if i is None else str(i)), i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data) if data else []
    total, out, slots, below, last = sum(k[2] for k in keyed), [], Counter(), 0, (None, 0)
    for key, i, size, crc in keyed:
        start = last[1] if key == last[0] else below
        last = (key, start)
        shard = start * n // total
        out.append((i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        below += size
    return sorted(out, key=lambda r: (r[4], r[5]))


@pytest.mark.parametrize("n_shards,bin_rows", [(40, 100_000), (3, 1), (1, 4)])
def test_shards(spark, n_shards, bin_rows):
    data = [(i, t) for i, t in rows() if i is not None] + [(500 + k, "the same text again") for k in range(60)]
    data = [d for d in data if d[0] not in (11,)]
    found = shard_table(documents(spark, data).repartition(4), n_shards, bin_rows=bin_rows).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: (r[4], r[5])) == brute_shards(data, n_shards)


def test_driver_holds_splitters_not_bins(spark):
    """Many stretches over ``bin_rows`` rows open no bin of the driver's: each round opens one for a splitter at most."""
    docs = documents(spark, [(k, "one text of all" if k % 3 else text(k, 9)) for k in range(900)])
    splitters = find_splitters(key_table(docs), 5)
    assert all(len(opened) <= 4 for opened in splitters.opened) and len(splitters.bounds) <= 5
    found = shard_table(docs, 5, bin_rows=4).collect()
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in found), key=lambda r: (r[4], r[5])) == brute_shards(data, 5)


def test_shards_within_tolerance(spark):
    docs = documents(spark, [(k, text(k, 5 + k % 50)) for k in range(600)])
    keyed = key_table(docs)
    exact, loose = find_splitters(keyed, 7), find_splitters(keyed, 7, tolerance=2000)
    assert len(loose.opened) < len(exact.opened)
    sizes = Counter()
    for r in shard_table(docs, 7, tolerance=2000).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 4000 and len(sizes) == 7


def test_sharded_documents_keep_their_columns(spark):
    docs = documents(spark)
    found = shard_documents(docs, 3)
    assert found.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert sorted(map(str, found.drop("shard", "slot").collect())) == sorted(map(str, docs.drop("shard").collect()))
    for own in ({r.slot for r in found.where(f"shard = {s}").collect()} for s in range(3)):
        assert own == set(range(len(own)))
    assert shard_documents(documents(spark, []), 3).collect() == []


def brute_share(children, budget):
    """children: (name, weight, capacity); fill the ones that get no less than they can use, then share by weight."""
    out, open_ = {}, sorted(children, key=lambda c: (c[2] * 1_000_000 // c[1], c[0]))
    while open_ and open_[0][2] * sum(c[1] for c in open_) <= open_[0][1] * budget:
        out[open_[0][0]] = open_[0][2]
        budget -= open_.pop(0)[2]
    return out | {name: w * budget // sum(c[1] for c in open_) for name, w, _ in open_}


@pytest.mark.parametrize("percent,epochs", [(60, 2), (100, 1), (150, 2), (500, 2), (0, 1)])
def test_mixing(spark, percent, epochs):
    data = rows() + [(700 + k, text(k, 1 + k % 90)) for k in range(150)]
    docs = documents(spark, data)
    weighed = mixing.weigh(docs)
    got = mixing.select_copies(weighed, percent, epochs).collect()
    leaves, weight = defaultdict(list), {}
    for r in weighed.collect():
        leaf = (r._domain, r._lang, r._source)
        leaves[leaf].append((r.doc_id, len(blank_words(r.text))))
        weight |= {leaf[:1]: r._domain_weight, leaf[:2]: r._lang_weight, leaf: r._source_weight}
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    capacity = Counter()
    for k, n in tokens.items():
        for depth in (0, 1, 2, 3):
            capacity[k[:depth]] += n * epochs
    budget = {(): min(sum(tokens.values()) * percent // 100, capacity[()])}
    for depth in (1, 2, 3):
        for parent in {k[: depth - 1] for k in leaves}:
            budget |= brute_share([(k, weight[k], capacity[k]) for k in {x[:depth] for x in leaves if x[: depth - 1] == parent}], budget[parent])
    wanted = []
    for leaf, own in leaves.items():
        whole, rest = divmod(budget[leaf], tokens[leaf]) if tokens[leaf] else (0, 0)
        order = lambda d: hashlib.md5(f"{mixing.SEED} {whole + 1} {'' if d[0] is None else d[0]} {d[1]}".encode()).hexdigest()
        for d in own:
            until = sum(n for i, n in own if order((i, n)) <= order(d))
            wanted.append((d[0], *leaf, d[1], whole + (until <= rest)))
    assert Counter(tuple(r) for r in got) == Counter(wanted)
    taken = sum(r.n_tokens * r.copies for r in got)
    assert taken <= budget[()]


def test_columns_named_as_inside(spark):
    docs = documents(spark, [(k, text(k, 20)) for k in range(30)]).selectExpr("*", "1 AS _lang", "2 AS _id", "3 AS _copies", "4 AS _row", "5 AS _own", "6 AS _domain")
    for out in (mixing.mix_documents(docs, 150, 2), corpus_pipeline.near_dedup(spark, docs, SF_DIR), corpus_pipeline.language(spark, docs, SF_DIR)):
        assert out.columns == docs.columns and out.count() > 0


def test_mixed_documents(spark):
    docs = documents(spark, [(k, text(k, 20)) for k in range(80)])
    mixed = mixing.mix_documents(docs, 150, 2)
    copies = {r.doc_id: r.copies for r in mixing.select_copies(mixing.weigh(docs), 150, 2).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert mixing.mix_documents(documents(spark, [])).collect() == []


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on its own input."""
    from tests.llm.test_dedup import brute_near
    from tests.llm.test_filters import brute_leaks
    from tests.llm.test_stages import brute_known

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        assert docs.columns == columns + ["shard", "slot"] * (k == len(corpus_pipeline.STAGES) - 1)
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert kept[0] == {i: t for i, t in first.items() if brute_known(langid.trained_on_the_rest(spark.read.parquet(f"{SF_DIR}/documents.parquet")), t)}
    assert set(kept[1]) == {r[0] for r in brute_near(list(kept[0].items()), n_words=corpus_pipeline.NEAR_SHINGLE_WORDS) if r[3]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert set(kept[2]) == {r[0] for r in brute_leaks(list(kept[1].items()), items) if not r[5]}
    assert set(kept[3]) < set(kept[2]) and len(kept[3]) > 0.6 * len(kept[2])
    assert kept[4] == kept[3]
    got = sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())
    assert got == sorted((r[0], r[4], r[5]) for r in brute_shards(list(kept[3].items()), 40))
    again = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert again == got
