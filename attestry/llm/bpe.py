"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever yields a token of the vocabulary. Two neighbouring bytes
that no token holds side by side can therefore never end up in one token, and
the place between them is a certain cut: what stands left and right of it is
merged as if the other side did not exist. White space is in no token at all,
so a text falls apart at its spaces first, and a word then falls apart at the
byte pairs that the vocabulary does not know. Fragments are encoded one by
one and put together again.

A batch of texts is worked on as columns. Its chunks between spaces and then
its words are each looked at once, however often they occur; all fragments of
all different words are merged together, a step of every fragment at a time;
and ids and decoded tokens are gathered by position. Nothing is remembered
from one batch to the next.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from attestry.llm.common import Batches, mapped

#: Fragments of more symbols wait in a heap for their merges, one at a time.
LONGEST_TOGETHER = 64
#: Ids that are decoded at once.
DECODED_AT_ONCE = 1 << 20
NONE = 1 << 30
#: Begins a word that is a special string: the byte is in no UTF-8 text.
SPECIAL = b"\xff"

#: The vocabulary's pre-tokens, for text below BELOW, where its white space is this much.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
#: The first combining character: NFC leaves text without these and what follows as it is.
BELOW = "\u0300"


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


BYTE_OF = {s: b for b, s in enumerate(byte_symbols())}


def ragged_take(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows `which` of a list column, as values and offsets; row i is values[offsets[i] : offsets[i + 1]]."""
    sizes = np.diff(offsets)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(offsets[:-1][which] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), ends


class ForcedBoundaryBpe:
    """A word-level BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        tokens = np.full(max(*vocab.values(), *special.values()) + 1, "", object)
        for t, i in [*vocab.items(), *special.items()]:
            tokens[i] = t
        self.tokens = pa.array(tokens, pa.string())
        self.special = {SPECIAL + s.encode(): i for s, i in special.items()}
        self.at_special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        pairs, made = [], []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append(vocab[left] << 32 | vocab[right])
            made.append(vocab[left + right])
        self.made = np.array(made, np.int64)
        self.rank = {p: r for r, p in enumerate(pairs)}
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.sorted_pairs, self.sorted_ranks = np.array(pairs, np.int64)[order], order
        #: The id of each byte, inside a word and at its end.
        self.symbol = np.array([[vocab[s] for s in BYTE_OF], [vocab[s + suffix] for s in BYTE_OF]])
        self.together = self._pairs(vocab)

    def _pairs(self, vocab: dict[str, int]) -> np.ndarray:
        """For two bytes: whether a token holds them side by side.

        A token that ends with the suffix counts with and without it: the same
        characters may also be bytes of a text. More pairs mean fewer cuts, so
        this errs on the safe side.
        """
        found = np.zeros(1 << 16, bool)
        for t in vocab:
            b = [BYTE_OF[c] for c in t]
            for x, y in zip(b, b[1:]):
                found[x << 8 | y] = True
        return found

    def fragments(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of words (bytes) between certain cuts: their symbols' ids and offsets in it, each one's word, and its first fragment by word."""
        data, ends = strings(words)
        data, ends = data[ends[0] : ends[-1]].astype(np.int64), ends - ends[0]
        starts = np.zeros(len(data) + 1, bool)
        starts[ends] = True  # a word has a byte at least
        starts[1:-1] |= ~self.together[data[:-1] << 8 | data[1:]]
        offsets = np.flatnonzero(starts)
        ids = self.symbol[0][data]
        ids[ends[1:] - 1] = self.symbol[1][data[ends[1:] - 1]]
        first = np.searchsorted(offsets, ends)
        return ids, offsets, np.repeat(np.arange(len(words)), np.diff(first)), first

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE for one that no merge takes."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.sorted_pairs, pair), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == pair, self.sorted_ranks[at], NONE)

    def merged(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments after all merges, as values and offsets.

        In each fragment the pair of the lowest rank goes first and, within a
        rank, the leftmost. A step takes a pair of every fragment with as many
        symbols left; the next step joins them to those that begin with so many.
        """
        sizes = np.diff(offsets)
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(LONGEST_TOGETHER + 2))
        done: list[tuple[np.ndarray, np.ndarray]] = []  # fragments, their ids in rows
        who, rows, rank = np.zeros(0, np.int64), np.zeros((0, LONGEST_TOGETHER), np.int64), np.zeros((0, LONGEST_TOGETHER - 1), np.int64)
        for n in range(LONGEST_TOGETHER, 0, -1):
            new = order[bounds[n] : bounds[n + 1]]
            if len(new):
                fresh = ids[offsets[:-1][new][:, None] + np.arange(n)]
                who, rows = np.concatenate([who, new]), np.concatenate([rows, fresh])
                rank = np.concatenate([rank, self.ranks(fresh[:, :-1], fresh[:, 1:])])
            if n == 1 or not len(who):
                done.append((who, rows))
                rows, rank = rows[:, : n - 1], rank[:, : max(0, n - 2)]
                continue
            at = rank.argmin(1)
            least = rank[np.arange(len(who)), at]
            stays = least < NONE
            done.append((who[~stays], rows[~stays]))
            who, rows, rank, at, least = who[stays], rows[stays], rank[stays], at[stays], least[stays]
            i = np.arange(len(who))
            rows[i, at] = self.made[least]
            keep = np.ones(rows.shape, bool)
            keep[i, at + 1] = False
            rows = rows[keep].reshape(len(who), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[i, at] = False
            rank = rank[keep].reshape(len(who), n - 2)
            has = at > 0
            rank[i[has], at[has] - 1] = self.ranks(rows[i[has], at[has] - 1], rows[i[has], at[has]])
            has = at < n - 2
            rank[i[has], at[has]] = self.ranks(rows[i[has], at[has]], rows[i[has], at[has] + 1])
        left = np.zeros(len(sizes), np.int64)
        for fragments, x in done:
            left[fragments] = x.shape[1]
        long = {int(f): np.array(self._merged_long(ids[offsets[f] : offsets[f + 1]].tolist())) for f in order[bounds[-1] :]}
        for f, x in long.items():
            left[f] = len(x)
        ends = np.concatenate([[0], np.cumsum(left)])
        out = np.empty(ends[-1], np.int64)
        for fragments, x in done:
            out[ends[:-1][fragments][:, None] + np.arange(x.shape[1])] = x
        for f, x in long.items():
            out[ends[f] : ends[f + 1]] = x
        return out, ends

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for one fragment, with the pairs in a heap: n log n for n symbols."""
        n, rank, made = len(ids), self.rank, self.made
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = int(made[r]), False, right[j]
            if (k := right[j]) < n:
                left[k] = i
                if (s := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (k := left[i]) >= 0 and (s := rank.get(ids[k] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (s, k, ids[k], ids[i]))
        return [x for x, here in zip(ids, alive) if here]

    def plain_words(self, part: str) -> list[bytes]:
        """The pre-tokens, as bytes, of a part without special strings. The library does what lies beyond plain Latin text."""
        if part and max(part) >= BELOW:
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            return [bytes(BYTE_OF[c] for c in w) for w, _ in found]
        low = part.lower()
        return [low.encode()] if low.isalpha() else [w.encode() for w in PRE_TOKEN.findall(low)]

    def words(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk; a special string in it is one behind the byte SPECIAL."""
        if self.at_special is None or not self.at_special.search(chunk):
            return self.plain_words(chunk)
        out, start = [], 0
        for m in self.at_special.finditer(chunk):
            out += [*self.plain_words(chunk[start : m.start()]), SPECIAL + m[0].encode()]
            start = m.end()
        return out + self.plain_words(chunk[start:])

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words (bytes), as values and offsets: those of a word's fragments, one after the other."""
        ids, offsets, _, first = self.fragments(words)
        out, ends = self.merged(ids, offsets)
        ends = ends[first]
        for w, i in self.special.items():
            at = pc.index(words, pa.scalar(w, pa.binary())).as_py()
            if at >= 0:  # what its bytes were merged to gives way
                out = np.concatenate([out[: ends[at]], [i], out[ends[at + 1] :]])
                ends = np.concatenate([ends[: at + 1], ends[at + 1 :] + 1 - (ends[at + 1] - ends[at])])
        return out, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, as values and offsets.

        Space and line feed are in no token, and no normalisation reaches
        across them. Other white space stays in its chunk and is dropped there.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        different = chunks.dictionary
        # A chunk of ASCII letters is one word. The others are taken apart.
        simple = pc.ascii_is_alpha(different)  # not of the empty chunk
        lowered = pc.ascii_lower(different.filter(simple)).cast(pa.large_binary())
        others = [self.words(c) for c in different.filter(pc.invert(simple)).to_pylist()]
        flat = pa.array([w for ws in others for w in ws], pa.large_binary())
        words = pa.chunked_array([lowered, flat]).combine_chunks().dictionary_encode() if len(lowered) + len(flat) else pa.array([], pa.large_binary()).dictionary_encode()
        values, offsets = self.word_ids(words.dictionary.cast(pa.binary()))
        word = words.indices.to_numpy().astype(np.int64)
        # Words in the order of the different chunks.
        is_simple = simple.to_numpy(zero_copy_only=False)
        n_words = np.ones(len(different), np.int64)
        n_words[~is_simple] = [len(ws) for ws in others]
        word_ends = np.concatenate([[0], np.cumsum(n_words)])
        in_order = np.empty(word_ends[-1], np.int64)
        of_simple = np.repeat(is_simple, n_words)
        in_order[of_simple], in_order[~of_simple] = word[: len(lowered)], word[len(lowered) :]
        values, offsets = ragged_take(values, offsets, in_order)
        values, offsets = ragged_take(values, offsets[word_ends], chunks.indices.to_numpy().astype(np.int64))
        return values, offsets[split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """The library's decode() for a vocabulary without a decoder: each row's tokens with spaces between.

        Gives rows in blocks, as (first row, texts). A row that is longer than
        a block is a block of its own.
        """
        at = 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODED_AT_ONCE, "right")) - 1)
            taken = self.tokens.take(pa.array(ids[offsets[at] : offsets[end]]))
            yield at, pc.binary_join(pa.ListArray.from_arrays((offsets[at : end + 1] - offsets[at]).astype(np.int32), taken), " ").to_pylist()
            at = end


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBpe:
    """The vocabulary, once for each worker process."""
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's kept columns with ids (array<int>) and decoded (string).

    A null text is the empty text: no ids, and it decodes to the empty string.
    Texts are encoded whole, whatever their length or that of a word in them,
    repeated rows alike, and an empty table gives an empty table. Columns other
    than those kept don't appear, so none clashes.
    """
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Batches) -> Batches:
        bpe = load(path)
        for b in batches:
            ids, offsets = bpe.encode(b.column(text_col))
            decoded = [t for _, texts in bpe.decode(ids, offsets) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [lists, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return mapped(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the number of ids, and SHA-256 digests of the ids and of the decoded text.

    The ids themselves never leave the worker, so a row costs some hundred
    bytes however long its text is. Null and repeated texts are as in encode().
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Batches) -> Batches:
        bpe = load(path)
        for b in batches:
            ids, offsets = bpe.encode(b.column(text_col))
            little, ends = memoryview(ids.astype("<u4")).cast("B"), (4 * offsets).tolist()
            of_ids = [hashlib.sha256(little[s:e]).hexdigest() for s, e in zip(ends, ends[1:])]
            of_text = [hashlib.sha256(t.encode()).hexdigest() for _, texts in bpe.decode(ids, offsets) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(id_col, text_col), run, schema)
