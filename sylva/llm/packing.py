"""Hierarchical packing of token streams into windows of several context sizes."""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, read

WINDOW = 4096
#: Context sizes that documents are routed to by length, each packed into sequences of its own; the last is the window.
TIERS = (256, 512, 1024, 2048, WINDOW)
#: The id after each document.
END = 2
#: Tokens that a task holds before it packs them: the bound of its memory, besides one document.
POOL = 1 << 20
#: Tokens of a step group, whose sequences are of one size.
STEP = 16 * WINDOW
#: Sequences, without their ids, that a task holds to deal them to step groups evenly: those of over 100 MB of text.
BALANCED = 1 << 15
#: Pieces of text whose ids a worker keeps, in two halves: the older half goes when the younger is full.
CACHE = 800_000
SPECIAL = b"<|"
#: Marks that the tokenizer's own pattern parts from a letter before them.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
ARROW = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.int32()) for x in SCHEMA.split(", ")])


class Words:
    """Ids of texts by a tokenizer that drops white space, merges nothing across it, and parts letters from marks.

    So a text's ids are those of its pieces between ASCII white space, and the ids of pieces met before are kept as bytes.
    Texts that may hold the string of a special token are encoded whole.
    """

    def __init__(self, path: str, cache: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        self.cache = CACHE if cache is None else cache
        # for lower-case Latin letters and spaces, which the file's normalizer and pattern leave as they are; of the same model,
        # which is held once
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, pieces: list[bytes]) -> None:
        """Learns pieces of Latin letters, each of which is one word to the tokenizer, by one call."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(pieces).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
        joined, to = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        self.known.update(zip(pieces, [joined[i:j] for i, j in zip([0, *to[:-1]], to, strict=True)], strict=True))

    def learn(self, pieces: set[bytes]) -> None:
        known, old, words, parted = self.known, self.old, set(), []
        if len(known) > self.cache // 2:
            self.old, self.known = old, known = known, {}
        for p in pieces:
            if p in old:
                known[p] = old[p]
                continue
            c = p.rstrip(MARKS)
            if not c or not (c.isalpha() or LATIN.fullmatch(c.decode())):
                known[p] = self.whole(p)
            elif len(c) == len(p):
                words.add(p)
            else:
                m = p[len(c) :]
                if m not in known:
                    known[m] = self.whole(m)
                if c in old:
                    known[c] = old[c]
                elif c not in known:
                    words.add(c)
                parted.append((p, c, m))
        if words:
            self.letters([*words])
        for p, c, m in parted:
            known[p] = known[c] + known[m]

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if SPECIAL in text:
            return self.whole(text)
        words = text.split()
        if new := {*words}.difference(self.known):
            self.learn(new if len(self.known) <= self.cache // 2 else {*words})
        return b"".join(map(self.known.__getitem__, words))


_words: dict[tuple[str, int | None], Words] = {}


def words_of(path: str, cache: int | None = None) -> Words:
    """The worker's one Words of a tokenizer file, for all its tasks."""
    if (path, cache) not in _words:
        _words[path, cache] = Words(path, cache)
    return _words[path, cache]


def tier_of(length: int) -> int:
    return next(i for i, t in enumerate(TIERS) if length <= t)


class Packer:
    """Cuts token streams into windows and packs each tier into sequences of its size; what is left at the end goes into
    sequences of powers of two, so nothing is padded."""

    def __init__(self, task: int):
        self.sequence = self.step = task << 32
        self.tiers, self.held, self.rows = [deque() for _ in TIERS], [0] * len(TIERS), []
        self.full: dict[int, list] = {}

    def put(self, piece: tuple) -> None:
        """piece: (doc_id, start, ids as bytes, the document's tokens), shorter than a window."""
        t = tier_of(len(piece[2]) // 4)
        self.tiers[t].append(piece)
        self.held[t] += len(piece[2]) // 4

    def take(self, t: int) -> tuple:
        piece = self.tiers[t].popleft()
        self.held[t] -= len(piece[2]) // 4
        return piece

    def add(self, doc_id, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= WINDOW:
            self.close(WINDOW, [(doc_id, at, ids[4 * at : 4 * (at + WINDOW)], n)])
            at += WINDOW
        if at < n:
            self.put((doc_id, at, ids[4 * at :], n))
        if sum(self.held) >= POOL:
            self.pack(POOL // 4)

    def fill(self, size: int) -> None:
        """A sequence of so many tokens: the longest tier's piece that fits, gaps filled from shorter tiers, the last one cut to measure."""
        pieces, gap = [], size
        while gap:
            fits = next((t for t in reversed(range(len(TIERS))) if self.tiers[t] and len(self.tiers[t][0][2]) <= 4 * gap), None)
            if fits is not None:
                p = self.take(fits)
            else:
                doc_id, start, ids, n = self.take(next(t for t in range(len(TIERS)) if self.tiers[t]))
                p = (doc_id, start, ids[: 4 * gap], n)
                self.put((doc_id, start + gap, ids[4 * gap :], n))
            pieces.append(p)
            gap -= len(p[2]) // 4
        self.close(size, pieces)

    def pack(self, keep: int) -> None:
        """Sequences from what is held, the longest tier's first and with gaps filled from shorter tiers, until less than
        `keep` tokens are left or no tier has enough for one of its size."""
        for t in reversed(range(len(TIERS))):
            while self.tiers[t] and sum(self.held) >= keep and sum(self.held[: t + 1]) >= TIERS[t]:
                self.fill(TIERS[t])

    def end(self) -> None:
        self.pack(0)
        while rest := sum(self.held):
            self.fill(min(WINDOW, 1 << (rest.bit_length() - 1)))
        self.deal(True)

    def close(self, size: int, pieces: list[tuple]) -> None:
        cost = sum(len(p[2]) ** 2 for p in pieces)
        self.full.setdefault(size, []).append((cost, [(doc_id, start, len(ids) // 4, zlib.crc32(ids), n) for doc_id, start, ids, n in pieces]))

    def deal(self, last: bool = False) -> None:
        """Numbers the sequences and deals them to step groups of STEP tokens and one size, so that groups have about the same
        sum of squares of their pieces' lengths, which attention costs. What fills no group waits; the last ones make one."""
        rest: list[tuple[int, tuple]] = []
        for size in sorted(self.full, reverse=True):
            found, each = self.full[size], STEP // size
            groups = len(found) // each
            dealt, left = found[: groups * each], found[groups * each :]
            for i, one in enumerate(sorted(dealt, key=lambda x: -x[0])):
                lap, k = divmod(i, groups)
                self.number(size, one, self.step + (groups - 1 - k if lap % 2 else k))
            self.step += groups
            self.full[size] = [] if last else left
            rest += [(size, one) for one in left] if last else []
        tokens = 0
        for size, one in rest:
            if tokens + size > STEP:
                self.step, tokens = self.step + 1, 0
            self.number(size, one, self.step)
            tokens += size
        self.step += bool(tokens)

    def number(self, size: int, one: tuple, step: int) -> None:
        offset = 0
        for doc_id, start, length, crc, n in one[1]:
            self.rows.append((doc_id, start, length, crc, n, self.sequence, offset, size, step))
            offset += length
        self.sequence += 1

    def out(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.rows), 10_000):
            columns = zip(*self.rows[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)
        self.rows = []


def pack(docs: DataFrame, tokenizer: str, cache: int | None = None) -> DataFrame:
    """The pieces (SCHEMA) of documents(doc_id, text), whose ids by the tokenizer of that path, and END, fill sequences.

    Each task packs its own partition: no row moves. Documents are routed by length to TIERS, those over a window after
    whole windows are cut off; each tier is packed into sequences of its size, the longest tier first: a sequence takes the
    longest piece that fits and fills its gap from shorter tiers, the last piece cut to measure; a task's last tokens go
    into sequences of powers of two. So no sequence is padded and each id lies in one piece. `tier` is the sequence's size
    and `step_id` its step group: sequences of one size and STEP tokens together, dealt so that groups cost alike. A null or
    empty text is END alone; null ids and repeated rows are packed like others; an empty table gives none; other columns
    are ignored. Tasks that are run again number their sequences alike: by partition, then in order. `cache` bounds the pieces
    whose ids a worker keeps (None: CACHE); fewer take more time, and the result is the same.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, end = words_of(tokenizer, cache), Packer(TaskContext.get().partitionId()), np.array([END], "<u4").tobytes()
        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, words.ids(text.as_py()) + end)
                if sum(map(len, packer.full.values())) >= BALANCED:
                    packer.deal()
                    yield from packer.out()
        packer.end()
        yield from packer.out()

    batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())
