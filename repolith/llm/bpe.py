"""Byte-level BPE encoding and decoding by longest matches with backtracking.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
all tokens finds, in one pass, the longest token that begins at each byte.  A
piece is then read left to right: the longest token is tried first, shorter
prefixes after it, and a token is taken only if it is compatible with the token
before it, that is, if merging would never join across their border.  A set of
byte positions that have already failed bounds the backtracking, so the work is
linear in the piece.  Compatibility of adjacent tokens is memoised.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm._common import prepare, release

#: Pieces of a generation of the memo; a full one takes the place of the one before it.
MEMO = 400_000


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return f.read()


class BytePairCodec:
    """Encodes as the ranks' merges would, decodes ids to bytes."""

    def __init__(self, rank_lines: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        #: Bytes and decimal text of each id.
        self.parts = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.names = [str(i) for i in range(len(self.parts))]
        self.size_of = list(map(len, self.parts))
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        reach = {}
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            parts = self._merge(token, i)
            if len(parts) == 1 or len(parts) == 2:
                self.halves[i] = (i, i) if len(parts) == 1 else (parts[0], parts[1])
                reach[token] = i
                if len(token) > 1:  # single bytes are looked up
                    self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, i))
        self.automaton.make_automaton()
        self.single = [reach.get(bytes([b])) for b in range(256)]
        #: The longest token that is a proper prefix of a token, if any.
        self.shorter = {i: next((reach[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reach), None) for t, i in reach.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The parts left when a token's bytes are merged by lower ranks only."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 1:
            best = min(
                ((r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None and r < below),
                default=None
            )
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] if p in self.ranks else -1 for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two adjacent tokens: undo the latest merge on either side, and see that no pair across the border would have come earlier."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, latest, ok = left, right, 1 << 40, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < latest:
                ok = False
                break
            inner, outer = self.halves[a][1], self.halves[b][0]
            if inner == a and outer == b:
                break
            # the side that was merged last is undone; on the right, a merge of the same rank comes later
            if outer == b or (inner != a and a > b):
                latest, a = a, inner
            else:
                latest, b = b + 1, outer
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def _longest(self, raws: list[bytes]) -> list[int]:
        """The longest token that begins at each byte of the pieces, one place of no meaning between two pieces.

        Matches come by where they end, so of those that begin at a place the last is the longest.
        """
        found = list(map(self.single.__getitem__, b" ".join(raws)))
        for end, (before, i) in self.automaton.iter("\u0100".join([r.decode("latin-1") for r in raws])):
            found[end - before] = i
        found.append(-1)
        return found

    def _cover(self, longest: list[int], at: int, stop: int) -> list[int]:
        """The ids from one place to another, by backtracking."""
        fits, size_of, shorter = self.fits, self.size_of, self.shorter
        out: list[int] = []
        dead: set[int] = set()
        token, last = longest[at], None
        while at < stop:
            end = at + size_of[token]
            if end not in dead:
                ok = last is None or fits.get((last, token))
                if ok or (ok is None and self._compatible(last, token)):
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            less = shorter[token]
            while less is None:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else None
                at -= size_of[token]
                less = shorter[token]
            token = less
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece's ids."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._cover(self._longest([piece]), 0, len(piece))

    def _learn(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Encode new pieces together, with one pass of the automaton over all of them."""
        raws = [p.encode("utf-8") for p in pieces]
        longest, whole, cover, found, at = self._longest(raws), self.ranks.get, self._cover, {}, 0
        for p, raw in zip(pieces, raws):
            known, stop = whole(raw), at + len(raw)
            found[p] = (known,) if known is not None else tuple(cover(longest, at, stop))
            at = stop + 1
        return found

    def encode_block(self, block: list[str]) -> list[tuple[int, ...]]:
        """Ids of each piece, from the memo's two generations or anew."""
        less = set(block).difference(self.memo)
        if not less:
            return list(map(self.memo.__getitem__, block))
        back = {p: x for p in less if (x := self.older.get(p))}
        if len(back) < len(less):
            back |= self._learn([p for p in less if p not in back])
        if len(self.memo) + len(back) > MEMO:
            kept = {p: self.memo[p] for p in set(block).difference(back)}
            self.older, self.memo = self.memo, kept
        self.memo |= back
        found = list(map(self.memo.__getitem__, block))
        for p in less:
            if len(p) > 40:
                del self.memo[p]
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_block(self.pattern.findall(text))))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids and SHA-256 of the ids and of the decoded bytes; long texts go in blocks of pieces."""
        n, digest, back, sep = 0, hashlib.sha256(), hashlib.sha256(), ""
        pieces = (m.group() for m in self.pattern.finditer(text)) if len(text) > 1 << 20 else iter(self.pattern.findall(text))
        name = self.names.__getitem__
        while block := list(islice(pieces, 50_000)):
            ids = list(chain.from_iterable(self.encode_block(block)))
            digest.update((sep + ",".join(map(name, ids))).encode())
            back.update(self.decode(ids))
            n += len(ids)
            sep = ","
        return n, digest.hexdigest(), back.hexdigest()


_codecs: dict[tuple[int, str], BytePairCodec] = {}


def codec(rank_lines: bytes, pattern: str) -> BytePairCodec:
    """One codec for each vocabulary and Python worker."""
    key = hash(rank_lines), pattern
    if key not in _codecs:
        _codecs[key] = BytePairCodec(rank_lines, pattern)
        # the tables stay for the worker's life and hold no cycles: collecting garbage over and over them is in vain
        gc.freeze()
        gc.set_threshold(100_000, 50, 100)
    return _codecs[key]


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Encode and decode whole texts; row by row, so nothing is shuffled and hot keys don't matter.

    The vocabulary is broadcast: its size is that of the rank file.  Null texts
    count as empty (no ids, the digests of nothing); repeated rows give repeated
    results; other columns are ignored.  With ``ids``, the token ids themselves
    are returned too, as column ``ids``.  An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids

    def run(batches):
        c = codec(ranks.value, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [c.digest(t) for t in texts]
            cols = [b.column(0), *map(list, zip(*rows))] if rows else [[], [], [], []]
            cols += [[c.encode(t) for t in texts]] * ids
            release()
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, types)], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).mapInArrow(run, schema)
