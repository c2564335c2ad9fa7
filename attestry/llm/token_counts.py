"""Token counts by the whole-token shortcut.

In a piece vocabulary where the space symbol only ever starts a piece, no
merge reaches across a space, so a text is a row of pre-tokens (a run of
spaces with the word after it) that are encoded one by one. For each piece of
the vocabulary the library itself proves beforehand whether the string of
that piece encodes to it alone. Such pre-tokens count one at sight; only the
rest goes through the merges.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestry.llm.common import Batches, Memo, mapped, texts_of

SPACE = "▁"
#: Chunks that a worker remembers (see Memo).
REMEMBERED = 300_000
#: A line feed, a word with the spaces before it, or spaces that no word follows.
PRE_TOKEN = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class PieceCounter(Memo):
    """chunk between spaces -> its number of tokens with one space before it."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        crossing = [p for _, p in pieces if re.search(f"[^{SPACE}]{SPACE}|\n", p)]
        if crossing:
            raise ValueError(f"pieces hold a space after a word or a line feed, as {crossing[0]!r}: texts can't be cut there")
        # A line feed is in no piece. It keeps the space that the library puts
        # before a text apart from what is measured.
        lead = self.sp.encode("\n")
        if self.sp.encode("\n\n") != [*lead, lead[-1]]:
            raise ValueError("a line feed is not encoded on its own")
        self.lead, self.line_feed = len(lead), 1
        got = self.sp.encode(["\n" + p for _, p in pieces])
        self.whole = {p for (i, p), ids in zip(pieces, got) if ids[self.lead :] == [i]}

    def of_pre_token(self, p: str) -> int:
        return 1 if p in self.whole else len(self.sp.encode("\n" + p)) - self.lead

    def compute(self, chunk: str) -> int:
        if chunk[0] == "\n":
            return self.line_feed + (self.of_pre_token(chunk[1:]) if len(chunk) > 1 else 0)
        return self.of_pre_token(SPACE + chunk)

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        # "a\nb" becomes the chunks "a" and "\nb"; an empty chunk tells of
        # spaces that do not stand singly between words.
        chunks = text.replace("\n", " \n").split(" ")
        if "" not in chunks:
            return sum([self[c] for c in chunks])
        return sum([self.line_feed if p == "\n" else self[p[1:]] if p[0] == SPACE and len(p) > 1 and p[1] != SPACE else self.of_pre_token(p) for p in PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))])


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """Once for each worker process."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text is the empty text and has no tokens. Texts count whole, rows
    that repeat count alike, and an empty table gives an empty table. Other
    columns are not read.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Batches) -> Batches:
        count = counter(path).count
        for b in batches:
            texts = texts_of(b, text_col)
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return mapped(docs.select(id_col, text_col), run, schema)
