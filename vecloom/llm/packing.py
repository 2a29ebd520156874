"""Packing token sequences: first-fit decreasing in randomised groups of documents.

Documents are dealt to groups by a hash of their id. A group cuts whole sequences off its
documents, packs the remainders by first-fit decreasing, finding the first bin with room
by descending a tournament tree of bin capacities, and then dissolves its emptiest bins:
their pieces are cut to fill the gaps of the others, and what is left over becomes
sequences whose lengths are powers of two. So a group has no padding at all.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.packed import arrow_rows, id_and_text, rows_of

SEQUENCE = 4096
END_ID = 2
GROUP_DOCS = 4096
#: Words after which a task forgets those it has not seen lately.
CACHE_WORDS = 200_000
#: Bytes of text whose words are looked up at a time.
SLICE_BYTES = 4_000_000
#: Words of letters that are encoded as one text.
LINE_WORDS = 200
#: ASCII punctuation: composes with nothing before it, and is never part of a word's letters.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))

Encoder = Callable[[list[str]], list[list[int]]]

_IDS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, `offset` long, ids array<int>"
)


class TournamentTree:
    """Free room of bins 0, 1, 2, …; each inner node holds the larger room of its two."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.best = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The lowest bin with at least ``need`` room."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < need:
                node += 1
        return node - self.size

    def take(self, number: int, amount: int) -> None:
        best, node = self.best, number + self.size
        best[node] -= amount
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Items by bin; sizes are at most ``room``. Equal sizes go in the order given."""
    tree = TournamentTree(max(1, len(sizes)), room)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        number = tree.first_fit(sizes[item])
        tree.take(number, sizes[item])
        while number >= len(bins):
            bins.append([])
        bins[number].append(item)
    return bins


def pack_lengths(lengths: list[int], room: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover every document exactly."""
    sequences, rest = [], []
    for number, length in enumerate(lengths):
        whole = length - length % room
        sequences += [[(number, start, room)] for start in range(0, whole, room)]
        if length > whole:
            rest.append((number, whole, length - whole))
    bins = [[rest[i] for i in items] for items in first_fit_decreasing([r[2] for r in rest], room)]
    bins.sort(key=lambda pieces: -sum(p[2] for p in pieces))
    full = sum(r[2] for r in rest) // room
    kept = bins[:full]
    loose = [piece for pieces in bins[full:] for piece in pieces]
    for pieces in kept:
        gap = room - sum(p[2] for p in pieces)
        while gap:
            number, start, length = loose.pop()
            used = min(gap, length)
            pieces.append((number, start, used))
            if length > used:
                loose.append((number, start + used, length - used))
            gap -= used
    sequences += kept
    left = sum(p[2] for p in loose)
    for power in range(room.bit_length() - 1, -1, -1):
        if left & (1 << power):
            need, pieces = 1 << power, []
            while need:
                number, start, length = loose.pop()
                used = min(need, length)
                pieces.append((number, start, used))
                if length > used:
                    loose.append((number, start + used, length - used))
                need -= used
            sequences.append(pieces)
    return sequences


class WordCache:
    """Ids of texts as the ids of their white-space separated words, remembered by word.

    For tokenizers that lower-case, and that split at white space and drop it, a text's ids
    are those of its words one after another. Arrow finds the distinct words of a slice of text, each with the
    white space behind it, and puts their ids in order; Python sees a distinct word of a slice once. Words without
    the punctuation at their end, which such a tokenizer splits off, are remembered too. When
    a store is full, the words not seen since it was last full go.
    """

    def __init__(self, encode: Encoder, kind: str, last_ids: np.ndarray | None = None):
        self.encode = encode
        self.kind = kind
        #: Ids that are the last of a word; with them words of letters are encoded many at a time.
        self.last_ids = last_ids
        self.words: list[dict[bytes, bytes]] = [{}, {}]
        self.stems: list[dict[bytes, bytes]] = [{}, {}]

    @staticmethod
    def stem(word: bytes) -> tuple[bytes, bytes]:
        """A word's lower-cased part up to its last letter or digit, and its punctuation."""
        if b"<|" in word:  # may spell a special token
            return word, b""
        stem = word.rstrip(PUNCTUATION)
        last = stem[-1:]
        if last.isalnum() or last > b"\x7f" and len(end := stem.decode("utf-8", "replace")[-1].lower()) == 1 and end.isalpha():
            return stem.lower(), word[len(stem) :]
        return word.lower(), b""

    def _encode(self, parts: list[bytes]) -> None:
        new, old = self.stems
        letters, others = [], []
        for part in parts:
            if part not in new:
                if (ids := old.get(part)) is not None:
                    new[part] = ids
                elif self.last_ids is not None and (part.isalpha() or part.decode("utf-8", "replace").isalpha()):
                    letters.append(part)
                else:
                    others.append(part)
        # A word has one last id at least. If a line of words has no more, they tell its words apart.
        lines = [letters[start : start + LINE_WORDS] for start in range(0, len(letters), LINE_WORDS)]
        for some, ids in zip(lines, self.encode([b" ".join(line).decode() for line in lines]), strict=True):
            ids = np.array(ids, self.kind)
            ends = np.flatnonzero(self.last_ids[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                others += some
                continue
            buffer, width = ids.tobytes(), ids.itemsize
            ends = (ends * width).tolist()
            new.update((part, buffer[a:b]) for part, a, b in zip(some, [0, *ends[:-1]], ends, strict=True))
        for start in range(0, len(others), 20_000):
            some = others[start : start + 20_000]
            for part, ids in zip(some, self.encode([p.decode("utf-8", "replace") for p in some]), strict=True):
                new[part] = np.array(ids, self.kind).tobytes()

    def _distinct(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct words, each with white space behind it or none."""
        for store in (self.words, self.stems):
            if len(store[0]) > CACHE_WORDS:
                store[:] = [{}, store[0]]
        new, old = self.words
        found = list(map(new.get, pieces))
        places, heads, tails = [], [], []
        for at, ids in enumerate(found):
            if ids is None:
                piece = pieces[at]
                if (ids := old.get(piece)) is None:
                    word = piece.rstrip()
                    if word.isalpha():
                        head, tail = word.lower(), b""
                    elif word[:-1].isalpha() and word[-1:] in PUNCTUATION:
                        head, tail = word[:-1].lower(), word[-1:]
                    else:
                        head, tail = self.stem(word)
                    places.append(at)
                    heads.append(head)
                    tails.append(tail)
                else:
                    new[piece] = found[at] = ids
        self._encode(list({*heads, *tails} - {b""}))
        stems = self.stems[0]
        stems[b""] = b""
        for at, head, tail in zip(places, heads, tails, strict=True):
            new[pieces[at]] = found[at] = stems[head] + stems[tail] if tail else stems[head]
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        buffer = b"\n".join([*texts, b""])
        blank = _BLANK[np.frombuffer(buffer, np.uint8)]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        if not len(starts):
            return [b""] * len(texts)
        edges = np.append(starts, len(buffer)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buffer)]
        ).dictionary_encode()
        distinct = self._distinct(_bytes_of(words.dictionary))
        _, offsets, data = pa.array(distinct, pa.large_binary()).take(words.indices).buffers()
        ends, stream = np.frombuffer(offsets, np.int64, len(words) + 1), data.to_pybytes() if data else b""
        # A text's words are those that start before its end.
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = ends[np.searchsorted(starts, text_ends)].tolist()
        return [stream[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def _bytes_of(words: pa.LargeBinaryArray) -> list[bytes]:
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8).tolist()
    data = data.to_pybytes()
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _worker_cache(load: Callable[[], Encoder], kind: str) -> WordCache:
    """The words that this Python worker knows, kept from task to task for one tokenizer."""
    held = sys.modules.setdefault("_vecloom_worker", ModuleType("_vecloom_worker"))
    # A class that travels with a job is a new one in every task; the path of its file is not.
    key = (getattr(load, "path", load), kind)
    if getattr(held, "word_cache_of", None) != key:
        encode = load()
        held.word_cache = WordCache(encode, kind, getattr(encode, "last_ids", None))
        held.word_cache_of = key
    return held.word_cache


def _tokenise(load: Callable[[], Encoder], end_id: int, kind: str):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker_cache(load, kind)
        end = np.array([end_id], kind).tobytes()
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return arrow_rows(
                _IDS, [(*key, tokens + end) for key, tokens in zip(ids, cache.ids(texts), strict=True)]
            )

        for row, doc_id, text in rows_of(batches):
            ids.append((row, doc_id))
            texts.append(text or b"")
            size += len(texts[-1])
            if size > SLICE_BYTES:
                yield flush()
                ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return tokenise


def _pack_group(room: int, with_ids: bool, kind: str):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "row"], kind="stable")
        buffers = group["ids"].tolist()
        docs = group["doc_id"].astype("Int64").tolist()
        buffers = [np.frombuffer(b, kind) for b in buffers]
        lengths = [len(b) for b in buffers]
        out = []
        for number, pieces in enumerate(pack_lengths(lengths, room)):
            offset = 0
            for doc, start, length in pieces:
                ids = buffers[doc][start : start + length].astype("<u4")
                out.append(
                    (
                        None if pd.isna(docs[doc]) else int(docs[doc]),
                        start,
                        length,
                        zlib.crc32(ids.tobytes()),
                        lengths[doc],
                        (int(key[0]) << 32) + number,
                        offset,
                        ids.astype("int32") if with_ids else None,
                    )
                )
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return pack


def pack_documents(
    documents: DataFrame,
    load_encoder: Callable[[], Encoder],
    id_col: str = "doc_id",
    text_col: str = "text",
    room: int = SEQUENCE,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    id_bytes: int = 4,
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``load_encoder`` makes, inside a task, a function from texts to ids that treats white
    space as a separator only. A document is its ids and then ``end_id``; a null or empty
    text is the end id alone. ``id_bytes`` (2 or 4) is the width of an id in the shuffle; an
    id that does not fit raises. A group holds about ``group_docs`` documents. Rows that share
    an id, or have none, are packed each on their own. Sequence ids are unique. Other
    columns are not read. An empty table gives an empty result.
    """
    docs = id_and_text(documents, id_col, text_col).select(
        F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text"
    )
    kind = f"<u{id_bytes}"
    groups = max(1, -(-documents.count() // group_docs))
    return (
        docs.mapInArrow(_tokenise(load_encoder, end_id, kind), "row long, doc_id long, ids binary")
        .groupBy(F.pmod(F.xxhash64("row", F.lit(17)), F.lit(groups)).alias("pack_group"))
        .applyInPandas(_pack_group(room, with_ids, kind), PIECES)
    )


class TokenizerEncoder:
    """Encoder of a tokenizer of the ``tokenizers`` library; ``last_ids`` where a suffix marks a word's last id."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.last_ids = None
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last_ids = np.zeros(tokenizer.get_vocab_size(), bool)
            for token, number in tokenizer.get_vocab().items():
                self.last_ids[number] = token.endswith(suffix)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@dataclass(frozen=True)
class word_tokenizer:
    """Loads the encoder of a tokenizer file of the ``tokenizers`` library, once in each worker."""

    path: str

    def __call__(self) -> Encoder:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return TokenizerEncoder(Tokenizer.from_file(self.path))
