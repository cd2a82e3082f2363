"""Chat formatting at token level: segments encoded apart, reserved ids spliced between.

A conversation becomes one sequence of ids. Role and text of each turn are encoded
separately, so no token spans a border, and the marks of turns are reserved ids above
the vocabulary, which no text can produce. Control strings that occur inside texts are
escaped, reversibly. The loss mask is the prefix sum of +1 and -1 at the borders of
what is to be learnt.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, strings, struct

START, END = "<|im_start|>", "<|im_end|>"
#: "<", any backslashes, "|": a text gets one backslash more, so "<|" never stands in it.
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: White space on which the tokenizer library would recurse too deep.
LONG_SPACE = re.compile(r"\s{1000}")


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ChatTokenizer:
    """Byte-level vocabulary with two reserved ids on top: start and end of a turn."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1

    def encode(self, text: str) -> list[int]:
        """Ids of any text. Texts with long runs of white space are cut into pieces by the same pattern here, and the pieces merged by the library."""
        if LONG_SPACE.search(text):
            one = self.encoding._encode_single_piece
            return [i for m in self.pieces.finditer(text) for i in one(m[0])]
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def turn(self, role: str, text: str, learnt: bool) -> tuple[list[int], np.ndarray]:
        """Ids of one turn, <start> role LF text <end> LF, and its loss mask."""
        head, body, feed = self.encode(escape(role) + "\n"), self.encode(escape(text)), self.encode("\n")
        ids = [self.start, *head, *body, self.end, *feed]
        border = np.zeros(len(ids) + 1, np.int8)
        if learnt:
            border[1 + len(head)] += 1
            border[1 + len(head) + len(body)] -= 1
        return ids, np.cumsum(border, dtype=np.int8)[:-1]

    def text(self, ids: list[int]) -> str:
        """The formatted text of ids."""
        out, at = [], 0
        for i in np.flatnonzero(np.array(ids, np.int32) >= self.start).tolist():
            out += [self.decode(ids[at:i]), START if ids[i] == self.start else END]
            at = i + 1
        return "".join([*out, self.decode(ids[at:])])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ChatTokenizer:
    return ChatTokenizer(path, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return path or default_path(), pattern


def format_turns(
    conversations: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    learnt_roles: tuple[str, ...] = ("assistant",),
    carry: list[str] | None = None,
) -> DataFrame:
    """conversations (conv_id, turn, role, text) with input_ids and loss_mask, by turn.

    The ids and the mask of a conversation are those of its rows in order of turn, put
    one behind the other; so even a conversation that fills a table needs no one task
    to hold it. Null roles and texts count as empty. The mask covers the text of
    learnt roles and no marks. Long texts are encoded whole, runs of white space or of
    one letter included; other columns stay, but input_ids and loss_mask are replaced.
    """
    path, pattern = _settings(path, pattern)

    def make():
        tokenizer = load(path, pattern)

        def work(roles, texts):
            done = [tokenizer.turn(r, t, r in learnt_roles) for r, t in zip(strings(roles), strings(texts), strict=True)]
            offsets = pa.array(np.cumsum([0, *[len(i) for i, _ in done]]).astype(np.int32))
            ids = pa.array(np.array([x for i, _ in done for x in i], np.int32))
            mask = pa.array(np.concatenate([np.zeros(0, np.int8), *[m for _, m in done]]))
            return [pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, mask)]

        return work

    out = struct(("input_ids", T.ArrayType(T.IntegerType())), ("loss_mask", T.ArrayType(T.ByteType())))
    return arrow_columns(conversations, ["role", "text"], out, make, carry)


def assemble(turns: DataFrame) -> DataFrame:
    """One row (conv_id, input_ids, loss_mask) per conversation from format_turns().

    Each row holds a whole conversation; for those too long for a row, keep the turns.
    """
    part = F.struct("turn", F.xxhash64("input_ids").alias("h"), "input_ids", "loss_mask")
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(part)).alias("p"))
        .select("conv_id", F.flatten("p.input_ids").alias("input_ids"), F.flatten("p.loss_mask").alias("loss_mask"))
    )


DIGESTS = struct(
    ("conv_id", T.LongType()),
    ("n_turns", T.LongType()),
    ("turns_sha256", T.StringType()),
    ("loss_chars", T.LongType()),
    ("loss_sha256", T.StringType()),
    ("formatted_chars", T.LongType()),
)


class _Reader:
    """Reads one conversation back from its ids and mask, piece by piece."""

    def __init__(self, tokenizer: ChatTokenizer, conv: int | None):
        self.t, self.conv = tokenizer, conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def feed(self, ids: list[int], mask: np.ndarray) -> None:
        t = self.t
        self.chars += len(t.text(ids))
        held = np.zeros(len(mask) + 2, np.int8)
        held[1:-1] = mask
        edge = np.flatnonzero(held[1:] != held[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            text = unescape(t.decode(ids[a:b]))
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        at = 0
        while at < len(ids):
            start = ids.index(t.start, at)
            end = ids.index(t.end, start)
            role, _, text = t.decode(ids[start + 1 : end]).partition("\n")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.n += 1
            at = end + 1
            while at < len(ids) and ids[at] != t.start:
                at += 1

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per conversation the digests of what its ids and mask say.

    Rows are sorted inside their partition and read in a stream: a task holds one batch
    and one running hash, however long a conversation is. Repeated turns follow each
    other, ordered by their ids. A role may not hold a line feed.
    """
    path, pattern = _settings(path, pattern)
    # A mark before the batch's first row can't be told from a new conversation but by its id.
    ordered = (
        turns.select("conv_id", "turn", "input_ids", "loss_mask", F.xxhash64("input_ids").alias("h"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "h")
        .select("conv_id", "input_ids", "loss_mask")
    )

    def run(batches):
        tokenizer, reader, rows = load(path, pattern), None, []
        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(i) for i in range(3)), strict=True):
                conv = conv.as_py()
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(tokenizer, conv)
                reader.feed(ids.values.to_numpy().tolist(), mask.values.to_numpy())
            if rows:
                yield _batch(rows)
                rows = []
        if reader is not None:
            yield _batch([*rows, reader.row()])

    return ordered.mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in DIGESTS.fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], DIGESTS.fieldNames())
