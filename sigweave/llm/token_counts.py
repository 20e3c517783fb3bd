"""Exact token counts at every prefix, by dynamic programming over prefixes.

A byte-pair piece never spans the start of a run of spaces or a line break (no piece of the model has
a space marker after another character, or a line break at all), nor two characters that no piece has next to each
other (``joined``: a letter and a digit, most marks behind a word). Texts are cut into chunks at all of these, so the
count of a prefix that ends between two chunks is count(previous prefix) + count(chunk), and inside a chunk the programme
goes on character by character: the last piece of each prefix is unique, so count[i] = count[i - len(last piece)] + 1, where
the last piece is the one that follows the last piece before it unchanged. ``chunk_prefixes`` runs it once
for each distinct chunk, whose counts at all prefixes are stored as differences; ``PrefixCounts`` adds up the
chunks of a text. Counts of texts, cuts, budgets and truncations are look-ups in these tables; no text is
encoded. The library only tells whether a string is a piece and whether two pieces that meet stay apart.

Results for odd input: null and empty texts have 0 tokens; texts with a literal space marker are counted
with spaces in its place, as the library does; repeated rows are counted each by itself; only doc_id and
text of the input are read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.pieces import ChunkStore
from sigweave.llm.text import Slice, mix, slices

MARK = "▁"
_MARK = MARK.encode()
#: Chunks are runs of bytes that are neither a space nor a line break, or parts of these.
_CHUNK = np.array([b not in (0x20, 0x0A) for b in range(256)])
#: Appended to a model's bytes it switches off the space that is put before a text (normalizer_spec.add_dummy_prefix = false).
_NO_PREFIX = b"\x1a\x02\x18\x00"


class Tokenizer:
    """A sentencepiece BPE model that encodes a chunk exactly as it stands."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.raw.id_to_piece(i) for i in range(self.raw.get_piece_size())]
        inner = [p for p in pieces if MARK in p.lstrip(MARK) or ("\n" in p and p != "\n")]
        if inner:
            raise ValueError(f"pieces of this model span chunks: {inner[:3]}")
        # pairs of bytes that lie next to each other in a piece or a character: nothing is merged over others
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for i, p in enumerate(pieces):
            if not (self.raw.is_control(i) or self.raw.is_unknown(i) or self.raw.is_byte(i)):
                own = np.frombuffer(p.encode(), np.uint8)
                self.joined[own[:-1], own[1:]] = True
        self.pieces = {p for p, own in zip(pieces, self.raw.encode(pieces, out_type=str), strict=True) if own == [p]}
        self.longest = max(map(len, self.pieces))
        self.apart: dict[tuple[str, str], bool] = {}
        self.store = ChunkStore(self._steps, np.int16, 800_000)

    def _steps(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What each character adds to the count of the prefix that it ends (less than nothing where it completes a longer piece)."""
        texts = [c.decode().replace(" ", MARK) for c in chunks]
        counts: list[list[int]] = [[]] * len(texts)
        count, last, before = [0], [""], ""
        for k in sorted(range(len(texts)), key=texts.__getitem__):
            # a prefix that the chunk has in common with the one before is not worked out again
            same = len(os.path.commonprefix((before, texts[k])))
            del count[same + 1 :], last[same + 1 :]
            self._extend(texts[k], count, last)
            counts[k], before = count[:], texts[k]
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        flat = np.fromiter((x for own in counts for x in own), np.int64, int(sizes.sum()))
        within = np.ones(len(flat), bool)
        within[np.cumsum(sizes) - sizes] = False
        return sizes - 1, (flat - np.concatenate(([0], flat[:-1])))[within]

    def counts(self, hashes: np.ndarray, checks: np.ndarray, chunk) -> np.ndarray:
        if not len(hashes):
            return np.empty(0, np.int64)
        rows = self.store.rows(hashes, checks, chunk)
        return self.store.total[rows]

    def prefixes(self, hashes: np.ndarray, checks: np.ndarray, chunk) -> np.ndarray:
        """The stored counts of one chunk at all its prefixes, from the empty one on."""
        steps, _ = self.store.values(self.store.rows(hashes, checks, chunk))
        return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))

    def follows(self, before: str, piece: str) -> bool:
        """Two pieces that meet stay as they are."""
        if len(self.apart) > 300_000:
            self.apart.clear()
        out = self.apart[before, piece] = self.raw.encode(before + piece, out_type=str) == [before, piece]
        return out

    def _extend(self, chunk: str, count: list[int], last: list[str]) -> None:
        """The dynamic programme over prefixes: count and last (the last piece of each prefix) are carried on to the chunk's end."""
        pieces, apart, longest = self.pieces, self.apart, self.longest
        for i in range(len(count), len(chunk) + 1):
            for start in range(i - longest if i > longest else 0, i):
                piece = chunk[start:i]
                if piece in pieces:
                    before = last[start]
                    meets = not before or apart.get((before, piece))
                    if meets or (meets is None and self.follows(before, piece)):
                        count.append(count[start] + 1)
                        last.append(piece)
                        break
            else:  # a character outside the vocabulary falls back to bytes and joins nothing
                count.append(count[i - 1] + len(chunk[i - 1].encode()))
                last.append("")

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Token counts of chunk[:0], chunk[:1], ..., chunk."""
        count = [0]
        self._extend(chunk, count, [""])
        return count


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class PrefixCounts:
    """For the documents of a slice: ``ends`` are byte positions between chunks, ``total[j]`` the exact token count of the document's text up to ends[j]; document i has rows at[i] to at[i + 1].

    joined: the pairs of bytes that a piece may span; by default any. Runs of characters that no piece joins to another,
    as numbers are, stay in one chunk, so that long ones don't have a chunk for each byte."""

    def __init__(self, part: Slice, tok: Tokenizer, joined: np.ndarray | None = None):
        self.part, self.tok = part, tok
        cuts = None
        if joined is not None and len(part.data):
            spanned = np.concatenate(([False], joined[part.data[:-1], part.data[1:]], [False]))
            cuts = ~spanned[:-1]
            cuts[1:] &= spanned[:-2] | spanned[2:]
        w = part.words(_CHUNK, cuts)
        data, n = part.data, len(part.data)
        where = np.arange(n)
        begins = part.offsets[np.searchsorted(part.offsets, where, side="right") - 1] if n else where
        # spaces directly before each byte position; the text begins with one more
        not_space = np.maximum.accumulate(np.where(data != 0x20, where, -1)) if n else where
        runs = lambda at: at - 1 - np.maximum(np.where(at > 0, not_space[at - 1], -1), begins[at] - 1) + (np.where(at > 0, not_space[at - 1], -1) < begins[at])
        spaces = runs(w.starts).astype(np.int64)
        hashes = mix(w.hashes(lower=False) + spaces.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        checks = mix(w.hashes(lower=False, kind=1) + spaces.astype(np.uint64))
        chunk_tokens = tok.counts(hashes, checks, lambda i: b" " * int(spaces[i]) + w.chunk(i))
        # spaces with no chunk behind them stand before a line break or at the end of a text
        breaks = np.flatnonzero(data == 0x0A)
        lens = np.diff(part.offsets)
        full = np.flatnonzero(lens > 0)
        tails = part.offsets[1:][full]
        before_break = runs(breaks).astype(np.int64)
        last = np.where(tails > 0, not_space[tails - 1], -1)
        at_tail = tails - 1 - np.maximum(last, part.offsets[full] - 1) + (last < part.offsets[full])
        alone = np.concatenate((before_break, at_tail))
        run_hashes = mix(alone.astype(np.uint64) + np.uint64(1 << 40))
        alone_tokens = tok.counts(run_hashes, mix(run_hashes), lambda i: b" " * int(alone[i]))
        ends = np.concatenate((w.ends, breaks + 1, tails))
        tokens = np.concatenate((chunk_tokens, alone_tokens[: len(breaks)] + 1, alone_tokens[len(breaks) :]))
        order = np.argsort(ends, kind="stable")
        ends, tokens = ends[order], tokens[order]
        self.keys = [np.concatenate(x)[order] for x in ((hashes, run_hashes), (checks, mix(run_hashes)))]
        self.at = np.searchsorted(ends, part.offsets, side="right")
        self.at[0] = 0
        run = np.concatenate(([0], np.cumsum(tokens)))
        self.total = run[1:] - np.repeat(run[self.at[:-1]], np.diff(self.at))
        self.ends = ends - np.repeat(part.offsets[:-1], np.diff(self.at))
        self.last = run[self.at[1:]] - run[self.at[:-1]]

    def fit(self, i: int, budget: int) -> int:
        """The bytes of the longest prefix of document i, cut between characters, with at most ``budget`` tokens.

        Totals never fall from one chunk boundary to the next, but inside a chunk a longer prefix may have fewer tokens: all are looked at."""
        own = self.total[self.at[i] : self.at[i + 1]]
        j = int(np.searchsorted(own, budget, side="right"))
        done, left = (int(self.ends[self.at[i] + j - 1]), budget - int(own[j - 1])) if j else (0, budget)
        if j == len(own) or left <= 0:
            return done
        begin, k = int(self.part.offsets[i]), self.at[i] + j
        chunk = self.part.data[begin + done : begin + self.ends[k]].tobytes().removesuffix(b"\n")
        # the text begins with one more space
        first = int(done == 0)
        counts = self.tok.prefixes(self.keys[0][k : k + 1], self.keys[1][k : k + 1], lambda _: b" " * first + chunk)[first:]
        counts[0] = 0
        return done + len(chunk.decode()[: int(np.flatnonzero(counts <= left)[-1])].encode())


def _counts(path: str, limit: int, batches):
    tok = tokenizer(path)
    for batch in batches:
        out: list[list[int]] = [[], [], []]
        for part in slices(batch.column(1), 1 << 20):
            if _MARK in part.data.tobytes():
                texts = pa.array([part.bytes_of(i).decode().replace(MARK, " ") for i in range(part.n)])
                lengths, inner = np.diff(part.offsets).tolist(), [p for t in range(part.n) for p in slices(texts.slice(t, 1))]
            else:
                lengths, inner = np.diff(part.offsets).tolist(), [part]
            fits = []
            for p in inner:
                counts = PrefixCounts(p, tok, tok.joined)
                out[1] += counts.last.tolist()
                fits += [counts.fit(i, limit) if counts.last[i] > limit else int(p.offsets[i + 1] - p.offsets[i]) for i in range(p.n)]
            if inner[0] is not part:
                # back to the bytes of the texts with their own markers
                fits = [len(part.bytes_of(i).decode()[: len(p.bytes_of(0)[:fit].decode())].encode()) for i, (p, fit) in enumerate(zip(inner, fits, strict=True))]
            out[2] += fits
            out[0] += lengths
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_bytes", "n_tokens", "fit_bytes"])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, limit: int = 4096, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_bytes: the bytes of the longest prefix, in whole characters, with at most ``limit`` tokens.

    model: a file that is there on every executor."""
    path = model or default_model()
    if not os.path.isabs(path):
        raise ValueError("model must be an absolute path")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _counts(path, limit, batches), "doc_id long, n_bytes long, n_tokens long, fit_bytes long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
