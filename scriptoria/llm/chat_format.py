"""Chat formatting with loss masks that follow the turns to the character.

A conversation is rendered as one text, each turn as
``<|im_start|>role<|im_sep|>text<|im_end|>\\n``.  Inside roles and texts every
``<``, any number of backslashes, ``|`` gets one backslash more, so no control
string can appear there and the escape can be undone.  The text is encoded
once, with offsets; the three control strings are tokens of their own, so no
token reaches from one turn's text into a mark.  The spans of the assistant's
texts and the tokens' offsets are both sorted, and a binary search of the span
ends among the offsets gives the tokens under the loss.

Turns are sorted within partitions by conversation and streamed.  A
conversation longer than ``piece_chars`` continues in a further row; pieces end
between turns, where the encoding is cut by a control token anyway, so memory
is bounded by that size or the longest turn, however long a conversation is.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.rows import column_of, record, table, _arrow_schema

# Marks of the template: fixed values.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_CHARS = 1 << 20
LOSS_ROLE = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(rf"{re.escape(START)}(.*?){re.escape(SEPARATOR)}(.*?){re.escape(END)}\n", re.DOTALL)


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[int], list[int]]:
    """Text of (role, text) turns and the sorted starts and ends of the texts under the loss."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEPARATOR}", escaped(text)
        if role == loss_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, ends


def turns_in(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a rendered text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


@functools.cache
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (START, SEPARATOR, END)])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # blanks belong to their token
    return tokenizer


def encode(texts: list[str], path: str = TOKENIZER) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and (start, end) offsets in characters of each text."""
    found = _tokenizer(path).encode_batch(texts, add_special_tokens=False)
    return [(np.array(e.ids, dtype=np.int32), np.array(e.offsets, dtype=np.int64).reshape(-1, 2)) for e in found]


def loss_tokens(offsets: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """For each token whether it lies in one of the sorted spans, by binary search of the spans among the offsets."""
    first = np.searchsorted(offsets[:, 0], starts, side="left")
    last = np.searchsorted(offsets[:, 1], ends, side="right")
    change = np.zeros(len(offsets) + 1, dtype=np.int64)
    some = first < last
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    return np.cumsum(change)[:-1] > 0


_FORMATTED = "conv_id bigint, piece int, text string, token_ids array<int>, token_ends array<int>, loss array<boolean>"


def format_conversations(
    turns: DataFrame, tokenizer: str = TOKENIZER, piece_chars: int = PIECE_CHARS, loss_role: str = LOSS_ROLE
) -> DataFrame:
    """Rows conv_id, piece, text, token_ids, token_ends (offset of each token's end in ``text``) and loss from turns.

    ``turns`` has conv_id, turn, role, text.  Turns are ordered by turn, ties
    by role and text, null turns first; a repeated row is a repeated turn.  A
    null text or role is an empty one; rows without conv_id are one
    conversation without id.  Other columns are not read; an empty table gives
    no rows.  Pieces of a conversation come in order within one partition.
    """
    kinds = _arrow_schema(turns.sparkSession, _FORMATTED)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current, piece, held, size, begun = None, 0, [], 0, False
        for batch in batches:
            for conv, role, text in zip(*(column_of(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                if begun and (conv != current or size >= piece_chars):
                    yield current, piece, *render(held, loss_role)
                    piece, held, size = (piece + 1 if conv == current else 0), [], 0
                current, begun = conv, True
                held.append((role, text))
                size += len(role) + len(text) + 40
        if begun:
            yield current, piece, *render(held, loss_role)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for found in pieces(batches):
            ready.append(found)
            size += len(found[2])
            if size >= piece_chars:
                yield encoded(ready)
                ready, size = [], 0
        if ready:
            yield encoded(ready)

    def encoded(ready: list[tuple]) -> pa.RecordBatch:
        tokens = encode([text for _, _, text, _, _ in ready], tokenizer)
        masks = [loss_tokens(offsets, starts, ends) for (_, offsets), (_, _, _, starts, ends) in zip(tokens, ready)]
        return record({
            "conv_id": [r[0] for r in ready], "piece": [r[1] for r in ready], "text": [r[2] for r in ready],
            "token_ids": [ids for ids, _ in tokens], "token_ends": [o[:, 1].astype(np.int32) for _, o in tokens], "loss": masks,
        }, kinds)

    return rows.mapInArrow(run, _FORMATTED)


def loss_text(text: str, ends: np.ndarray, loss: np.ndarray) -> str:
    """What stands under the loss mask, unescaped: runs of tokens under the mask, each from the end of the token before."""
    change = np.diff(np.concatenate([[0], loss.astype(np.int8), [0]]))
    out = []
    for first, last in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
        out.append(unescaped(text[ends[first - 1] if first else 0 : ends[last - 1]]))
    return "".join(out)


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the output of ``format_conversations``, whose pieces stream by in order."""
    kinds = _arrow_schema(formatted.sparkSession, _DIGESTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state = [], None
        for batch in batches:
            columns = [column_of(batch, c) for c in ("conv_id", "piece", "text", "token_ends", "loss")]
            for k in range(batch.num_rows):
                conv, piece, text = (c[k].as_py() for c in columns[:3])
                ends, loss = (c[k].values.to_numpy(zero_copy_only=False) for c in columns[3:])
                if piece == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                turns = turns_in(text)
                for role, body in turns:
                    state[2].update(f"{role}\n{body}\n".encode())
                under = loss_text(text, ends, loss)
                state[4].update(under.encode())
                for at, n in ((1, len(turns)), (3, len(under)), (5, len(text)), (6, len(loss)), (7, int(loss.sum()))):
                    state[at] += n
            if len(done) >= 5000:
                yield rows(done)
                done = []
        if state:
            yield rows([*done, state])

    def rows(done: list[list]) -> pa.RecordBatch:
        return record({n: [s[k].hexdigest() if k in (2, 4) else s[k] for s in done] for k, n in enumerate(kinds.names)}, kinds)

    return formatted.mapInArrow(run, _DIGESTS)


# A conversation that writes the marks themselves.
_MARKS_AS_TEXT = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", _MARKS_AS_TEXT), (-1, 1, "assistant", _MARKS_AS_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return digests(format_conversations(turns.unionByName(own))).drop("n_tokens", "n_loss_tokens")


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || '<|im_sep|>' || '<|im_end|>') + 1 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
