"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, bounded_batches, distinct, text_chunks, word_spans

LENGTH = 2048
END_ID = 1
#: Attention cost of a piece of n tokens: n + QUADRATIC * n * n.
QUADRATIC = 1.0 / 1024
#: Tokens that a task gathers before it packs them: the bound of its memory.
GROUP_TOKENS = 2_000_000
#: Distinct words whose ids a worker remembers before it starts anew.
MEMO = 500_000
CHUNK_BYTES = 1 << 21
#: Fixed value: how the vocabulary that WordTokenizer is made for cuts a text.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters alone, which are one word to the vocabulary.
_LETTERS = re.compile("[A-Za-z\u00DF-\u00F6\u00F8-\u00FF]+").fullmatch
_POINT = np.zeros(256, bool)
_POINT[list(b".,")] = True
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return n + QUADRATIC * n * n


class WordTokenizer:
    """Ids of whole texts, with each word encoded once.

    The vocabulary of this kind drops white space and never merges over it, so a text's ids are its words' ids in a row: no combining
    mark composes with a blank. Points after an ASCII letter or digit are a word of their own to it, and it is lower case, so A-Z are
    lowered first where no special token or combining mark is near. What is known is kept by the words' bytes.

    A tokenizer whose parts are not those that this rests on is asked for the ids of whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self._splits_words()
        self._forget()

    def _splits_words(self) -> bool:
        """Whether a text's ids are those of its words, points apart, A-Z lowered."""
        parts = json.loads(self.tokenizer.to_str())
        norm = (parts["normalizer"] or {}).get("normalizers", [])
        cut = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
            and (norm[1]["pattern"], norm[1]["content"]) == ({"Regex": "\\s+"}, " ")
            and [c["type"] for c in cut] == ["Split", "ByteLevel"]
            and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": _WORDS}, "Removed", True)
            and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"] or parts["truncation"] or parts["padding"])
            and all(a["content"].startswith("<|") and not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in parts["added_tokens"])
        )

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, one row after the other, and where each row's begin."""
        raw = data.tobytes()
        if not self.by_word:
            texts = [raw[a:z].decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.append(0, np.cumsum([len(e) for e in each], dtype=np.int64))
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            data = LOWER[data]
        starts, ends, rows = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        core = ends.copy()
        while True:
            at = np.flatnonzero((core - starts > 1) & _POINT[data[core - 1]])
            if not len(at):
                break
            core[at] -= 1
        core[~_PLAIN_END[data[core - 1]]] = ends[~_PLAIN_END[data[core - 1]]]
        tails = core < ends
        # Pieces in order: each word's core, then its points if it has any.
        place = np.arange(len(starts)) + np.append(0, np.cumsum(tails)[:-1])
        total = len(starts) + int(tails.sum())
        a, z = np.empty(total, np.int64), np.empty(total, np.int64)
        a[place], z[place] = starts, core
        a[place[tails] + 1], z[place[tails] + 1] = core[tails], ends[tails]
        first, kind = distinct(data, a, z)
        whole = data.tobytes()
        slots = self._slots([whole[x:y] for x, y in zip(a[first].tolist(), z[first].tolist(), strict=True)])[kind]
        sizes = self.size[slots]
        out = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(self.begin[slots] - out[:-1], sizes) + np.arange(out[-1])]
        return ids, out[np.append(place, total)[rows]]

    def _slots(self, keys: list[bytes]) -> np.ndarray:
        if self.used + len(keys) > MEMO:
            self._forget()
        known = list(map(self.slot.get, keys))
        if None in known:
            new = [k for k, s in enumerate(known) if s is None]
            words = [keys[k].decode() for k in new]
            plain = [k for k, w in enumerate(words) if _LETTERS(w)]
            rest = [k for k, w in enumerate(words) if not _LETTERS(w)]
            for k in range(0, len(plain), 4096):
                own = plain[k : k + 4096]
                e = self.tokenizer.encode(" ".join([words[x] for x in own]), add_special_tokens=False)
                ids, number = np.array(e.ids, "<u4"), np.array(e.word_ids)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(ids)]])
                if len(cuts) == len(own) + 1:
                    self._keep([keys[new[x]] for x in own], ids, np.diff(cuts))
                else:
                    rest += own
            for k in range(0, len(rest), 4096):
                own = rest[k : k + 4096]
                each = [e.ids for e in self.tokenizer.encode_batch_fast([words[x] for x in own], add_special_tokens=False)]
                self._keep([keys[new[x]] for x in own], np.array([i for e in each for i in e], "<u4"), np.array([len(e) for e in each]))
            known = list(map(self.slot.get, keys))
        return np.array(known)

    def _keep(self, keys: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, filled = self.used, int(self.begin[self.used - 1] + self.size[self.used - 1]) if self.used else 0
        while filled + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while n + len(keys) > len(self.size):
            self.begin, self.size = np.append(self.begin, np.zeros_like(self.begin)), np.append(self.size, np.zeros_like(self.size))
        self.ids[filled : filled + len(ids)] = ids
        self.size[n : n + len(keys)] = sizes
        self.begin[n : n + len(keys)] = filled + np.append(0, np.cumsum(sizes)[:-1])
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used = n + len(keys)


@lru_cache(2)
def tokenizer_at(path: str) -> WordTokenizer:
    """A worker's tokenizer, with what it knows of earlier tasks."""
    return WordTokenizer(path)


def assign(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Sequences as lists of (document, start in it, length, offset in the sequence).

    Full-length cuts come first, each a sequence of its own. What is left, whole documents and tails, goes in descending length to the
    sequence of least cost that still has room for it; a piece that fits nowhere is cut over the gaps, in order of cost. Only the last
    sequences of a call can have padding, less than one sequence in all."""
    out: list[list[tuple[int, int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        full = n - n % capacity
        out += [[(doc, k, capacity, 0)] for k in range(0, full, capacity)]
        if n > full:
            rest.append((n - full, doc, full))
    rest.sort(key=lambda r: (-r[0], r[1]))
    open_ = -(-sum(r[0] for r in rest) // capacity)
    base = len(out)
    out += [[] for _ in range(open_)]
    room, spent = [capacity] * open_, [0.0] * open_
    heap = [(0.0, k) for k in range(open_)]
    parked: list[tuple[int, int]] = []  # sequences too full for the pieces so far, the emptiest first
    late: list[tuple[int, int, int]] = []

    def put(k: int, doc: int, start: int, n: int) -> None:
        out[base + k].append((doc, start, n, capacity - room[k]))
        room[k] -= n
        spent[k] += cost(n)

    for n, doc, start in rest:
        while parked and -parked[0][0] >= n:
            k = heapq.heappop(parked)[1]
            heapq.heappush(heap, (spent[k], k))
        while heap:
            k = heapq.heappop(heap)[1]
            if room[k] >= n:
                put(k, doc, start, n)
                if room[k]:
                    heapq.heappush(heap, (spent[k], k))
                break
            heapq.heappush(parked, (-room[k], k))
        else:
            late.append((n, doc, start))
    gaps = sorted((k for k in range(open_) if room[k]), key=lambda k: (spent[k], k), reverse=True)
    for n, doc, start in late:
        while n:
            k = gaps[-1]
            cut = min(n, room[k])
            put(k, doc, start, cut)
            n, start = n - cut, start + cut
            if not room[k]:
                gaps.pop()
    return [s for s in out if s]


def packed(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids if `with_ids`.

    A document is its ids and one end id; a null or empty text is the end id alone, a null key stays null, repeated rows are packed as
    often as they come, an empty table gives no rows, keys may be of any type. Each task packs its own rows, about `group_tokens` at a time (a longer document is
    a group of its own), so there is no shuffle, memory is bounded, and a source of any size is just more tasks. sequence_id is made of
    the task's number, the group's and the sequence's, and does not change when a task is run again."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    end, kind = np.asarray([end_id], "<u4"), to_arrow_type(rows.schema["doc_id"].dataType)

    def flush(names: list, held: list[np.ndarray], group: int) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        for k, sequence in enumerate(assign([len(d) for d in held], capacity)):
            number = (part << 40) | (group << 20) | k
            for doc, start, n, offset in sequence:
                own = held[doc][start : start + n]
                rows.append((names[doc], start, n, zlib.crc32(own), len(held[doc]), number, offset) + ((own.astype(np.int32),) if with_ids else ()))
        fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:7]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[7:]]
        return pa.RecordBatch.from_arrays(arrays, names=fields + ["ids"] * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer_at(tokenizer)
        names, held, tokens, group = [], [], 0, 0
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(1), CHUNK_BYTES):
                ids, begins = words.encode(data, offsets)
                names += b.column(0).slice(first, last - first).to_pylist()
                held += [np.append(ids[x:y], end) for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                tokens += len(ids) + last - first
                if tokens >= group_tokens:
                    yield flush(names, held, group)
                    names, held, tokens, group = [], [], 0, group + 1
        if held:
            yield flush(names, held, group)

    return rows.mapInArrow(pack, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + SCHEMA + ", ids array<int>" * with_ids)
