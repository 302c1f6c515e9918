"""Token ids of whole texts, by the tokenizers library, with a memo of pieces of words.

Where the tokenizer drops white space, lower-cases, and splits words by PATTERN before
its merges (its file says so), a text's ids are its words' pieces' ids one after the
other. Each distinct piece goes to the library once while it is remembered; the memo is
ordered by 64-bit hashes, bounded, and refilled from the texts at hand when full. A piece
is only taken for another, or for a remembered one, when its bytes are the same; where
two different pieces have one hash, the texts at hand go to the library. Words with quotes, with letters from U+0240 on, or that could hold a special token go to the
library whole; so do whole texts with any other tokenizer.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .word_hash import distinct, hashed_pieces, same

#: Pieces that a worker remembers.
MEMO = 300_000
#: Bytes of text encoded at a time.
CHUNK_BYTES = 1 << 20
#: The word pattern of the public tokenizer (a fixed value). Pieces are cut by its rules.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        # pieces by hash, in order: how many ids, where they are in `flat`, how many
        # bytes, and where they are in `pool`; the first is no piece, as none is empty
        self.keys = np.array([0], np.uint64)
        self.count = self.place = self.length = self.spot = np.array([0], np.int64)
        self.flat, self.pool = np.zeros(0, self.dtype), b""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = self._fits(spec)
        self.last = np.zeros(max(spec["model"].get("vocab", {"": 0}).values(), default=0) + 1, bool)
        if self.by_piece:
            suffix = spec["model"]["end_of_word_suffix"]
            for token, k in spec["model"]["vocab"].items():
                self.last[k] = token.endswith(suffix)

    @staticmethod
    def _fits(spec: dict) -> bool:
        """Is it a tokenizer of the kind described above?"""
        try:
            norm = [x["type"] for x in spec["normalizer"]["normalizers"]]
            split, rest = spec["pre_tokenizer"]["pretokenizers"]
            return bool(
                norm == ["NFC", "Replace", "Lowercase"]
                and split["type"] == "Split"
                and split["pattern"]["Regex"] == PATTERN
                and split["invert"]
                and split["behavior"] == "Removed"
                and rest["type"] == "ByteLevel"
                and not rest["add_prefix_space"]
                and spec["model"]["end_of_word_suffix"]
                and all(not x["lstrip"] and not x["rstrip"] and x["content"].startswith("<|") for x in spec["added_tokens"])
            )
        except (KeyError, TypeError, ValueError):
            return False

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.array(e.ids, self.dtype).tobytes() for e in fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], whole: list[bool]) -> list[bytes]:
        """The ids of new pieces. Many go to a call: each ends where a token ends a word.
        Words marked whole go to the library one by one."""
        out: list[bytes] = [b""] * len(pieces)
        single = [k for k, w in enumerate(whole) if w]
        many = [k for k, w in enumerate(whole) if not w]
        size = self.dtype.itemsize
        for at in range(0, len(many), 2_000):
            part = many[at : at + 2_000]
            raw = self._library([b" ".join([pieces[k] for k in part]).decode()])[0]
            ends = (np.flatnonzero(self.last[np.frombuffer(raw, self.dtype)]) + 1) * size
            if len(ends) == len(part):
                begin = 0
                for k, e in zip(part, ends.tolist(), strict=True):
                    out[k] = raw[begin:e]
                    begin = e
            else:
                single += part
        if single:
            for k, x in zip(single, self._library([pieces[k].decode() for k in single]), strict=True):
                out[k] = x
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each UTF-8 text; null is empty. Each piece that the memo lacks is
        looked up once, and ids are gathered."""
        if not self.by_piece:
            return self._whole(texts)
        # ASCII letters are lower-cased at once, but for texts that may hold special tokens
        low = [(t if b"<|" in t else t.lower()) if t else b"" for t in texts]
        buf = b" ".join(low)
        start, end, h, whole = hashed_pieces(buf)
        if not len(start):
            return [np.zeros(0, self.dtype) for _ in texts]
        first, which, plain = distinct(buf, start, end, h)
        if not plain:
            return self._whole(texts)
        hashes, begin, size = h[first], start[first], (end - start)[first]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        old = at[known]
        if not ((self.length[old] == size[known]).all() and same(buf, begin[known], self.pool, self.spot[old], size[known])):
            return self._whole(texts)
        new = [buf[a : a + n] for a, n in zip(begin[~known].tolist(), size[~known].tolist(), strict=True)]
        learned = self._learn(new, whole[first[~known]].tolist())
        sizes = np.fromiter(map(len, learned), np.int64, len(learned)) // self.dtype.itemsize
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(learned), self.dtype)])
        n, place, spot = (np.empty(len(hashes), np.int64) for _ in range(3))
        n[known], place[known], spot[known] = self.count[old], self.place[old], self.spot[old]
        n[~known], place[~known] = sizes, len(self.flat) + np.cumsum(sizes) - sizes
        spot[~known] = len(self.pool) + np.cumsum(size[~known]) - size[~known]
        m = n[which]
        upto = np.cumsum(m)
        out = flat[np.repeat(place[which] - (upto - m), m) + np.arange(int(upto[-1]))]
        self._remember(hashes, known, (n, place, size, spot), flat, self.pool + b"".join(new))
        # the texts' ends, in pieces and then in ids
        edge = np.cumsum([len(t) + 1 for t in low])
        cut = np.r_[0, upto][np.searchsorted(start, edge)]
        return np.split(out, cut[:-1])

    def _whole(self, texts: list[bytes | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.dtype) for x in self._library([(t or b"").decode() for t in texts])]

    def _remember(self, hashes, known, rows, flat, pool) -> None:
        new = ~known
        if len(self.keys) + int(new.sum()) > MEMO:  # keep what these texts use
            n, place, size, spot = rows
            self.keys, self.count, self.length = hashes, n, size
            self.place, self.spot = np.cumsum(n) - n, np.cumsum(size) - size
            self.flat = flat[np.repeat(place - self.place, n) + np.arange(int(n.sum()))]
            self.pool = b"".join([pool[a : a + k] for a, k in zip(spot.tolist(), size.tolist(), strict=True)])
            return
        where = np.searchsorted(self.keys, hashes[new])
        self.keys = np.insert(self.keys, where, hashes[new])
        self.count, self.place, self.length, self.spot = (np.insert(x, where, y[new]) for x, y in zip((self.count, self.place, self.length, self.spot), rows, strict=True))
        self.flat, self.pool = flat, pool


def text_chunks(batches, text: int = 1):
    """(batch slice, its texts as bytes), of about CHUNK_BYTES at most, one row at least."""
    for batch in batches:
        col = batch.column(text).cast(pa.binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        at, n = 0, len(sizes)
        total = np.cumsum(sizes)
        while at < n:
            upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK_BYTES, "right"))
            upto = min(n, max(at + 1, upto))
            yield batch.slice(at, upto - at), col.slice(at, upto - at).to_pylist()
            at = upto


def crc_u32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
