"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks by prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank file of the byte-level vocabulary lies.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The template: each turn is OPEN role SEP text CLOSE. The three stand for reserved ids after the vocabulary.
OPEN, SEP, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that mean something to this or another public chat template, escaped inside texts.
CONTROL = (OPEN, SEP, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_UNESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    """Put one more backslash after the first character of each control string, those with some already too."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file. Its word pattern is the file's public one."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(role: str, text: str, tokens, first_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one turn. The mask covers an assistant's text alone: a step up at its start, down at its end, summed."""
    segments = [[first_id], tokens.encode_ordinary(escape(role)), [first_id + 1], tokens.encode_ordinary(escape(text)), [first_id + 2]]
    ends = np.cumsum([len(s) for s in segments])
    steps = np.zeros(int(ends[-1]) + 1, dtype=np.int8)
    if role == "assistant":
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return np.fromiter((i for s in segments for i in s), dtype=np.int32, count=int(ends[-1])), np.cumsum(steps[:-1], dtype=np.int8)


def read_turn(ids: np.ndarray, mask: np.ndarray, tokens, first_id: int) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, code points of the formatted turn), from the assembled turn alone."""
    at = np.flatnonzero(ids >= first_id)
    if list(ids[at]) != [first_id, first_id + 1, first_id + 2] or at[0] != 0 or at[2] != len(ids) - 1:
        raise ValueError("not one well-formed turn")
    decode = lambda part: tokens.decode_bytes(part.tolist()).decode("utf-8")
    role, text = decode(ids[at[0] + 1 : at[1]]), decode(ids[at[1] + 1 : at[2]])
    learnt = ids[mask == 1]
    return unescape(role), unescape(text), unescape(decode(learnt)) if len(learnt) else "", len(OPEN) + len(role) + len(SEP) + len(text) + len(CLOSE)


def format_turns(turns: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row for each turn: conv_id, turn, role, input_ids, loss_mask.

    Each turn is encoded by itself where it lies, so no conversation is gathered. Concatenated in order of (turn, role, input_ids)
    the rows of a conversation are its formatted sample. Null roles and texts are empty strings; equal turns stay separate rows;
    other columns are dropped; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks)
        first = tokens.n_vocab
        for batch in batches:
            roles, texts = (batch.column(c).to_pylist() for c in ("role", "text"))
            made = [assemble(r or "", t or "", tokens, first) for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array([r or "" for r in roles], pa.string()), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.int8()))],
                names=["conv_id", "turn", "role", "input_ids", "loss_mask"],
            )

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, input_ids array<int>, loss_mask array<tinyint>")


def conversation_digests(formatted: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Read formatted turns back and sum up each conversation.

    Rows of a conversation meet in order and flow through running digests: one turn at a time is in memory, however long the
    conversation. Rows with a null conv_id are one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks)
        first = tokens.n_vocab
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        key, state, out = None, None, []

        def close():
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("input_ids"), batch.column("loss_mask")):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learnt, chars = read_turn(ids.values.to_numpy(), mask.values.to_numpy(), tokens, first)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    order = ["conv_id", "turn", "role", "input_ids"]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
