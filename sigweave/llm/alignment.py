"""Alignment of two tokenizers on the same texts, and how often their tokens end together.

Both tokenizers cut the same bytes, a space and the text. Where tokens of both end, a group ends: the groups are the
connected components of the tokens that overlap. They are found by pointer jumping: every token points to the token of the other
tokenizer that holds its last byte and so reaches farthest right, the last token of a component points to itself, and all
pointers are doubled at once until none moves; then every token points to the last token of its component, which labels the group.

No token of either tokenizer goes on from a character that is not white space into a space, so a text is cut there into chunks, each
distinct chunk is encoded and aligned once in a task's store, and the results of a text are those of its chunks.

Two tokens can only end together if the bytes of one end with those of the other. The pairs that can be are found from the two
vocabularies alone, so the counts of pairs have a size that no corpus changes (some hundred thousand numbers): a task adds them up
in an array, and the sums are broadcast. Texts are encoded once; their links are written as numbers of pairs, and a second pass over these gives
each text how its links compare with the corpus.

Results for odd input: null and empty texts have no tokens, nor have texts whose bytes a tokenizer does not give back (one that holds the
piece tokenizer's own space marker); repeated rows count each; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.pieces import ChunkStore
from sigweave.llm.shared import stash
from sigweave.llm.text import Words, slices

MARK = "▁"
_SCANNED = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pair", "n", "groups"]
_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
#: Chunks that are encoded as one text.
TOGETHER = 500
# Fixed value: how byte-level tokenizers of this kind part a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that all regular expression engines take for the same kind: ASCII, Latin, Greek, Cyrillic, kana, common Chinese characters, Korean syllables.
_COMMON = re.compile("[\t\n -~\u00A1-\u01BF\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u3041-\u3093\u30A1-\u30F6\u4E00-\u9FA5\uAC00-\uD7A3]*")
_SEPARATORS = np.frombuffer(b",|;", np.uint8)
#: What cannot stand before the space that parts two chunks: white space beyond ASCII, and characters without width.
_BLANK = re.compile(rb"(?:\xC2[\x85\xA0]|\xE1\x9A\x80|\xE1\xA0\x8E|\xE2\x80[\x80-\x8F\xA8-\xAF]|\xE2\x81[\x9F-\xAF]|\xE3\x80\x80|\xEF\xBB\xBF)\Z")
SLICE = 1 << 20
#: Longer texts are not encoded by ranks: the regular expression engine there gives up on a million blanks in a row.
RANKED_CHARS = 1 << 19


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones stand for themselves, the others for what follows U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """a_id * len(b) + b_id, ascending, for all tokens of which one's bytes end with the other's."""
    by_bytes: tuple[dict, dict] = ({}, {})
    for side, tokens in zip(by_bytes, (a, b), strict=True):
        for i, token in enumerate(tokens):
            if token:
                side.setdefault(token, []).append(i)
    found = set()
    for token, ids in by_bytes[0].items():
        for k in range(len(token)):
            found.update(i * len(b) + j for j in by_bytes[1].get(token[k:], ()) for i in ids)
    for token, ids in by_bytes[1].items():
        for k in range(1, len(token)):
            found.update(i * len(b) + j for i in by_bytes[0].get(token[k:], ()) for j in ids)
    return np.array(sorted(found), np.int64)


def farthest(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The label of each token of a, then of b: the number of its component's last token, by pointer jumping. Both cut the same bytes; ends are ascending."""
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a - 1, side="right")  # the token of b that holds the last byte
    to_a = np.searchsorted(ends_a, ends_b - 1, side="right")
    own = n + np.arange(len(ends_b))
    pointer = np.concatenate((n + to_b, np.where(ends_a[to_a] > ends_b, to_a, own)))
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def ranked_encoding(path: str, tokenizer):
    """The same byte-level tokenizer by ranks, which is several times faster; None unless it is certain to give the same ids.

    Merging by rank takes any two neighbours that make up a token, the list of merges only those that the token was made of. If ids follow the
    order of the merges, and every token's own bytes come back as that token, then two neighbours that span a token's bytes are
    always those that it is made of, since nothing has crossed its ends before; so both give the same."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    named = byte_characters()
    vocab = model["vocab"]
    made = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    single = [vocab[c] for c in named if c in vocab]
    of = {i: t for t, i in vocab.items()}
    if len(single) < 256 or made != sorted(made) or max(single) > min(made):
        return None
    merging = tokenizer.model
    if not all([x.id for x in merging.tokenize(of[i])] == [i] for i in made):
        return None
    ranks = {bytes(named[c] for c in of[i]): i for i in [*single, *made]}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """A byte-level tokenizer (a) and a piece tokenizer (b), with a store of aligned chunks.

    A chunk's row in the store is made of 32-bit numbers: tokens of a, tokens of b, groups, 1 if the bytes are given back; the place of each link's
    pair among ``pairs``; the tokens of each group, those of a and then those of b, four times the id plus the separator behind it."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.ranked = ranked_encoding(byte_level, self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        named = byte_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(named[c] for c in entry) if all(c in named for c in entry) else entry.encode()
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(names[i][1:-1], 16)]) if self.b.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        crossing = [x for x in names if MARK in x.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces go on into a space: {crossing[:3]}")
        self.length_a, self.length_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.pairs = possible_pairs(self.bytes_a, self.bytes_b)
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.array([len(x) for x in names], np.uint8)
        self.decimals = np.frombuffer(b"".join(x.ljust(6) for x in names), np.uint8)
        self.store = ChunkStore(self._encode)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks are encoded as one text, a chunk behind the other; those whose end or bytes would not part them are encoded alone."""
        mark = MARK.encode()
        odd = {i for i, c in enumerate(chunks) if not c or c[-1] <= 0x20 or c[-1] == 0x7F or mark in c or (c[-1] >= 0x80 and _BLANK.search(c[-3:]))}
        plain, rare = [], []
        for i, chunk in enumerate(chunks):
            if i not in odd:
                (plain if _COMMON.fullmatch(chunk.decode()) else rare).append(i)
        order, found = [], []
        for some in [x[k : k + TOGETHER] for x in (plain, rare) for k in range(0, len(x), TOGETHER)]:
            text = b" ".join(chunks[i] for i in some)
            both = self._pair(text)
            if both is None:
                odd.update(some)
            else:
                order += some
                found.append(both)
        none = np.zeros(4, np.uint32)
        alone: dict[int, np.ndarray] = {}
        for i in sorted(odd):
            both = self._pair(chunks[i])
            if both is None:
                alone[i] = none
            else:
                order.append(i)
                found.append(both)
        sizes, values = self._rows(*(np.concatenate([x[side] for x in found] or [np.empty(0, np.int64)]) for side in (0, 1)), np.fromiter((len(chunks[i]) + 1 for i in order), np.int64, len(order)))
        for i, row in alone.items():
            order.append(i)
            sizes, values = np.append(sizes, len(row)), np.append(values, row)
        # back to the order of the chunks
        order = np.array(order)
        begins = np.cumsum(sizes) - sizes
        back = np.argsort(order)
        own = sizes[back]
        ends = np.cumsum(own)
        return own, values[np.repeat(begins[back] - (ends - own), own) + np.arange(int(ends[-1]))]

    def _pair(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both tokenizers; None if one of them does not give the bytes back."""
        text = chunk.decode()
        if self.ranked and len(text) < RANKED_CHARS and _COMMON.fullmatch(text):
            a = self.ranked.encode_ordinary(" " + text)
        else:
            a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        whole = b" " + chunk
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def _rows(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The store's rows of chunks of so many bytes, from the ids of all of them."""
        chunk_ends = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        label = farthest(ends_a, ends_b) if len(a) else np.empty(0, np.int64)
        last_a, last_b = (np.diff(x, append=-1) != 0 for x in (label[: len(a)], label[len(a) :]))
        links = np.searchsorted(self.pairs, a[last_a] * len(self.bytes_b) + b[last_b])
        groups = [np.cumsum(last) - last for last in (last_a, last_b)]
        ends = [ends_a, ends_b, ends_a[last_a]]
        counts = [np.diff(np.searchsorted(x, chunk_ends, side="right"), prepend=0) for x in ends]
        tokens = np.concatenate((4 * a + last_a, 4 * b + 2 * last_b))
        # a group's tokens of a stand before those of b
        tokens = tokens[np.argsort(np.concatenate((2 * groups[0], 2 * groups[1] + 1)), kind="stable")]
        rows = 4 + counts[2] + counts[0] + counts[1]
        begin = np.cumsum(rows) - rows
        out = np.empty(int(rows.sum()), np.uint32)
        for k, head in enumerate((*counts, np.ones(len(sizes), np.int64))):
            out[begin + k] = head
        ramp = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin + 4, counts[2]) + ramp(counts[2])] = links
        both = counts[0] + counts[1]
        out[np.repeat(begin + 4 + counts[2], both) + ramp(both)] = tokens
        return rows, out

    def chunks(self, part) -> tuple[np.ndarray, np.ndarray]:
        """The store's rows of a slice's chunks, and where each document's begin and end. A chunk is taken without the space before it."""
        data, offsets = part.data, part.offsets
        full = np.flatnonzero(np.diff(offsets))
        one, two, three = (np.concatenate((np.zeros(k, np.uint8), data))[: len(data)] for k in (1, 2, 3))
        # the last byte of a white space character, or of one without width
        blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & ((two == 0x9A) & (one == 0x80) | (two == 0xA0) & (one == 0x8E))
        blank |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8F) | (one >= 0xA8) & (one <= 0xAF)) | (two == 0x81) & (one >= 0x9F) & (one <= 0xAF))
        blank |= (three == 0xE3) & (two == 0x80) & (one == 0x80) | (three == 0xEF) & (two == 0xBB) & (one == 0xBF)
        cut = (data == 0x20) & ((one > 0x20) & (one < 0x7F) | (one >= 0x80) & ~blank)
        # neither a text's first byte begins a chunk of its own, nor its last one, behind which nothing would stand
        cut[offsets[:-1][full]] = False
        cut[offsets[1:][full] - 1] = False
        spaces = np.flatnonzero(cut)
        w = Words.__new__(Words)
        w.slice = part
        w.starts = np.sort(np.concatenate((offsets[:-1][full], spaces + 1)), kind="stable")
        ends = np.concatenate((spaces, offsets[1:][full]))
        w.ends = ends[np.argsort(ends, kind="stable")]
        at = np.concatenate(([0], np.cumsum(np.bincount(np.searchsorted(offsets, spaces, side="right") - 1, minlength=part.n) + (np.diff(offsets) > 0)))) if part.n else np.zeros(1, np.int64)
        if not len(w.starts):
            return np.empty(0, np.int64), at
        return self.store.rows(w.hashes(lower=False), w.hashes(lower=False, kind=1), w.chunk), at

    def heads(self, rows: np.ndarray) -> np.ndarray:
        """The four numbers of each row."""
        return self.store.pool[self.store.at[rows][:, None] + np.arange(4)].astype(np.int64)

    def inner(self, skip: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``size`` numbers of each row from number ``skip`` on, one row after the other."""
        ends = np.cumsum(size)
        return self.store.pool[np.repeat(self.store.at[rows] + skip - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def text(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens as decimal text, the separator behind each; and where each token's text ends."""
        size = self.digits[tokens >> 2].astype(np.int64) + 1
        ends = np.cumsum(size)
        out = self.decimals[np.repeat(6 * (tokens >> 2).astype(np.int64) - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        out[ends - 1] = _SEPARATORS[tokens & 3]
        return out, ends


@lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
    return Aligner(byte_level, pieces)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values)))
    return run[at[1:]] - run[at[:-1]]


def _scan(paths: tuple[str, str], with_groups: bool, batches):
    """A row for each text with its links; at the end of a task, rows (pair, n) of how often it linked each pair."""
    al = aligner(*paths)
    total = np.zeros(len(al.pairs), np.int64)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        numbers: list[list] = [[], [], []]
        digests, texts, links, ends = [], [], [], [np.zeros(1, np.int64)]
        for part in slices(batch.column(1), SLICE):
            rows, at = al.chunks(part)
            each, inverse, times = np.unique(rows, return_inverse=True, return_counts=True)
            heads = al.heads(each)
            good = (_sums(heads[inverse, 3], at) == np.diff(at)) & (np.diff(at) > 0)
            mine = np.repeat(good, np.diff(at))
            if not mine.all():
                times = np.bincount(inverse[mine], minlength=len(each))
            np.add.at(total, al.inner(np.full(len(each), 4), heads[:, 2], each), np.repeat(times, heads[:, 2]))
            for out, k in zip(numbers, range(3), strict=True):
                out += np.where(good, _sums(heads[inverse, k], at), 0).tolist()
            size = np.where(mine, heads[inverse, 2], 0)
            links.append(al.inner(np.full(len(rows), 4), size, rows).astype(np.int32))
            ends.append(ends[-1][-1] + np.cumsum(size)[at[1:] - 1] * (at[1:] > 0) if len(size) else np.repeat(ends[-1][-1], part.n))
            size = np.where(mine, (heads[:, 0] + heads[:, 1])[inverse], 0)
            text, run = al.text(al.inner((4 + heads[:, 2])[inverse], size, rows))
            text, run = memoryview(text), np.concatenate(([0], run))[np.concatenate(([0], np.cumsum(size)))[at]].tolist()
            for i in range(part.n):
                own = text[run[i] : max(run[i], run[i + 1] - 1)]
                digests.append(hashlib.sha256(own).hexdigest() if good[i] else "")
                texts.append(str(own, "ascii") if with_groups else None)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(links or [np.empty(0, np.int32)])))
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), lists, none, none, pa.array(texts, pa.string())], names=_SCANNED)
    pair = np.flatnonzero(total)
    sums = {"pair": pa.array(pair), "n": pa.array(total[pair])}
    yield pa.RecordBatch.from_arrays([sums.get(c, pa.nulls(len(pair), kind)) for c, kind in zip(_SCANNED, kinds, strict=True)], names=_SCANNED)


def _compare(pairs: np.ndarray, size_b: int, counts: np.ndarray, batches):
    """Links of each text to how many are the best of their token of b, and the sum of their counts."""
    most = np.zeros(size_b, np.int64)
    np.maximum.at(most, pairs % size_b, counts)
    best = (counts == most[pairs % size_b]).astype(np.int64)
    for batch in batches:
        links = batch.column(5)
        ends, flat = links.offsets.to_numpy(), links.values.to_numpy(zero_copy_only=False)
        values = [pa.array(_sums(x[flat[ends[0] : ends[-1]]], ends - ends[0])) for x in (best, counts)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(3), *values, batch.column(4), batch.column(6)], names=_COLUMNS)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _paths(byte_level: str | None, pieces: str | None) -> tuple[str, str]:
    paths = (byte_level, pieces) if byte_level and pieces else default_vocabularies()
    if not all(map(os.path.isabs, paths)):
        raise ValueError("vocabularies must be absolute paths")
    return paths


def _scanned(docs: DataFrame, paths: tuple[str, str], with_groups: bool) -> tuple[DataFrame, DataFrame]:
    """Texts with their links, and the counts of pairs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pair long, n long, groups string"
    found = stash(rows.mapInArrow(lambda batches: _scan(paths, with_groups, batches), schema), "links")
    return found.where("pair is null").drop("pair", "n"), found.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))


def _counted(sums: DataFrame, size: int) -> np.ndarray:
    found = sums.toArrow()  # as many rows as there are possible pairs, at most
    counts = np.zeros(size, np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    return counts


def pair_counts(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """(a, b, n): how often tokens of both end together in all texts. The files must be there on every executor."""
    paths = _paths(byte_level, pieces)
    al = aligner(*paths)
    counts = _counted(_scanned(docs, paths, False)[1], len(al.pairs))
    some = np.flatnonzero(counts)
    return docs.sparkSession.createDataFrame(pa.table({"a": al.pairs[some] // len(al.bytes_b), "b": al.pairs[some] % len(al.bytes_b), "n": counts[some]}))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, with_groups: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their token of b), count_sum, groups_sha256, and groups as text if asked for."""
    paths = _paths(byte_level, pieces)
    al = aligner(*paths)
    texts, sums = _scanned(docs, paths, with_groups)
    size_b = len(al.bytes_b)
    shared = docs.sparkSession.sparkContext.broadcast((al.pairs, size_b, _counted(sums, len(al.pairs))))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    found = texts.mapInArrow(lambda batches: _compare(*shared.value, batches), schema)
    return found if with_groups else found.drop("groups")
