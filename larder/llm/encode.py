"""Encoding of a whole corpus with a public byte-level tokenizer by a minimal acyclic transducer lexicon.

The frequent words of the corpus are encoded once, exactly, and compiled into a minimal acyclic transducer: states with the
same futures are shared, every arc carries an additive output, and the sum along a word is its rank in a table of id lists.
All tables lie in one array that executors memory-map. A batch of words walks the transducer together, one byte a step;
words it does not hold are merged exactly by rank, so the ids are those of the tokenizer for any text.
"""

from __future__ import annotations

import base64
import heapq
import io
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.runtime import write_shared

#: Folder of the tokenizer files, and the most words the lexicon holds; other words are merged exactly.
TOKENIZERS, LEXICON_WORDS = "/opt/tokenizers", 50_000
#: Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words a counting task holds before it emits them.
_HELD = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, the order of merging, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: always the adjacent pair of least rank, the leftmost of equal ones, is merged; n log n for any length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (rank := ranks.get(word[i : i + 2])) is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        j = ends[i]
        if not alive[j]:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (rank := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        h = before[i]
        if h >= 0 and (rank := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (rank, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Lexicon:
    """A minimal acyclic transducer from words to id lists over one flat int64 array.

    Sections: arc keys (state * 256 + byte, sorted), arc targets, arc outputs, final flags by state, offsets of id lists by
    rank, ids; the header has the six lengths."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        sizes, at, parts = flat[:6].astype(int), 6, []
        for size in sizes:
            parts.append(flat[at : at + size])
            at += size
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = parts

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from sorted words; equal futures (finality, arcs) are registered once."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        finals: list[int] = []
        arcs: list[tuple] = []  # by state: ((byte, target), ...)

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs)
                finals.append(int(node[0]))
                arcs.append(key[1])
            return state

        path: list[list] = [[False, []]]  # unsettled nodes along the last word
        previous = b""
        for word in words:
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            for depth in range(len(previous), common, -1):
                state = settle(path.pop())
                path[-1][1].append((previous[depth - 1], state))
            for _ in word[common:]:
                path.append([False, []])
            path[-1][0] = True
            previous = word
        for depth in range(len(previous), 0, -1):
            state = settle(path.pop())
            path[-1][1].append((previous[depth - 1], state))
        root = settle(path.pop())
        # children are settled before parents, so one pass counts the words of each state
        count = np.zeros(len(arcs), np.int64)
        for s, out in enumerate(arcs):
            count[s] = finals[s] + sum(count[t] for _, t in out)
        keys, targets, outputs = [], [], []
        rename = lambda s: 0 if s == root else s + 1  # the root is state 0
        for s, out in enumerate(arcs):
            run = finals[s]
            for byte, t in out:
                keys.append(rename(s) * 256 + byte)
                targets.append(rename(t))
                outputs.append(run)
                run += count[t]
        final = np.zeros(len(arcs) + 2, np.int64)
        for s, f in enumerate(finals):
            final[rename(s)] = f
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        lists = [entries[w] for w in words]
        offsets = np.cumsum([0, *map(len, lists)])
        ids = [i for x in lists for i in x]
        parts = [np.array(x, np.int64) for x in (np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(outputs, np.int64)[order], final, offsets, ids)]
        return cls(np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where the transducer does not accept it; all words walk together."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8)
        state, rank, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.flatnonzero(lengths > 0)
        dead = lengths == 0
        step, last = 0, len(self.keys) - 1
        while len(live):
            key = state[live] * 256 + text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), last)
            hit = self.keys[at] == key
            dead[live[~hit]] = True
            at, live = at[hit], live[hit]
            state[live] = self.targets[at]
            rank[live] += self.outputs[at]
            step += 1
            live = live[lengths[live] > step]
        return np.where(dead | (self.final[state] == 0), -1, rank)


class Encoder:
    """Encodes batches of texts; one per worker process and lexicon."""

    MISSES = 100_000  # merged words kept at most; a memory bound without effect on the ids

    def __init__(self, ranks_path: str, lexicon: Lexicon):
        self.ranks, self.lexicon, self.misses = load_ranks(ranks_path), lexicon, {}
        self.words = regex.compile(WORDS)

    def _merged(self, word: bytes) -> list[int]:
        found = self.misses.get(word)
        if found is None:
            found = merge_word(word, self.ranks)
            if len(self.misses) >= self.MISSES:
                self.misses.clear()
            self.misses[word] = found
        return found

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by text, ids): null and empty texts have no ids."""
        codes: dict[str, int] = {}
        sequence, words_of = [], []
        for text in texts:
            found = self.words.findall(text) if text else []
            words_of.append(len(found))
            sequence.extend(codes.setdefault(w, len(codes)) for w in found)
        distinct = [w.encode("utf-8") for w in codes]
        rank = self.lexicon.find(distinct)
        offsets, ids = self.lexicon.offsets, self.lexicon.ids
        missed = np.flatnonzero(rank < 0)
        extra = [self._merged(distinct[i]) for i in missed]
        known = np.maximum(rank, 0)
        length = np.where(rank >= 0, offsets[known + 1] - offsets[known], 0) if len(offsets) > 1 else np.zeros(len(distinct), np.int64)
        start = np.where(rank >= 0, offsets[known], 0) if len(offsets) > 1 else np.zeros(len(distinct), np.int64)
        length[missed] = [len(x) for x in extra]
        start[missed] = len(ids) + np.cumsum(length[missed]) - length[missed]
        pool = np.concatenate([np.asarray(ids), np.array([i for x in extra for i in x], np.int64)])
        seq = np.array(sequence, np.int64)
        sizes = length[seq]
        ends = np.cumsum(sizes)
        gather = np.repeat(start[seq] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        by_word = np.concatenate([[0], ends])
        return by_word[np.concatenate([[0], np.cumsum(words_of)])], pool[gather].astype(np.int32)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def worker_encoder(ranks_path: str, name: str) -> Encoder:
    """The encoder of this worker process; the lexicon file is memory-mapped, not read."""
    key = (ranks_path, name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks_path, Lexicon(np.load(SparkFiles.get(name), mmap_mode="r")))
    return _ENCODERS[key]


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """(word BINARY, n): how often each word of the corpus occurs, over all texts; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = regex.compile(WORDS), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array([w.encode("utf-8") for w in held], pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    held.update(pattern.findall(value))
                    if len(held) > _HELD:
                        yield out()
        if held:
            yield out()

    return documents.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def publish(spark: SparkSession, flat: np.ndarray) -> str:
    """Write an array to the shared folder and have every executor fetch it; returns its name for ``SparkFiles.get``."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    buffer = io.BytesIO()
    np.save(buffer, flat)
    spark.sparkContext.addFile(write_shared(spark, name, buffer.getvalue()))
    return name


def corpus_lexicon(documents: DataFrame, text: str, ranks_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile and publish the lexicon of a corpus: its ``words`` most frequent words, ties by bytes. Returns its name."""
    top = word_counts(documents, text).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    ranks = load_ranks(ranks_path)
    lexicon = Lexicon.compile({bytes(r["word"]): merge_word(bytes(r["word"]), ranks) for r in top})
    return publish(documents.sparkSession, lexicon.flat)


def encode_texts(documents: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, sizes_only: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>), or (key, n_tokens) with ``sizes_only``: the ids of every text, without special tokens.

    Defined cases: null and empty texts give an empty list; names of special tokens in a text are ordinary text; texts of
    any length are encoded whole; repeated keys and rows are kept; an empty table gives an empty one; other columns do not
    matter. No shuffle of texts: the corpus is read once for the word counts and once for the ids."""
    ranks_path = f"{folder}/{tokenizer}.tiktoken"
    used = documents.select(F.col(key), F.col(text).alias("_text"))
    name = corpus_lexicon(used, "_text", ranks_path)
    kind = dict(used.dtypes)[key]
    out = f"`{key}` {kind}, " + ("n_tokens int" if sizes_only else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks_path, name)
        for batch in batches:
            step = 256  # texts encoded together: bounds memory for long texts
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                if sizes_only:
                    value = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    value = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), value], names=[key, "n_tokens" if sizes_only else "ids"])

    return used.mapInArrow(run, out)
