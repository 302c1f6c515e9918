"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary matches of a word, end by end and
longest first; dynamic programming carries the best score and its piece count, no paths.
The rules are those of the unigram model of the tokenizers library: of equal scores the
match that starts first wins, a character without a piece of its own may be covered at
the least score minus 10, and such characters become as many pieces as they have bytes
where the vocabulary has byte pieces (else one piece for a run of them). Texts are split
as its Metaspace step does: at every space, which opens the next word as a meta symbol,
with one put before the first.

The vocabulary is a public SentencePiece file, its scores taken as they are; control
and byte pieces never match text.

Defined cases: a null or empty text has no tokens; an empty table gives no rows; rows
that repeat stay; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only_columns, table
from .ids import text_chunks

META = "▁"
UNKNOWN_PENALTY = 10.0
#: Score of pieces that must never match text.
NEVER = -1e9
MEMO_WORDS = 150_000
#: Longer words are counted, but not remembered.
MEMO_BYTES = 64

_models: dict[str, Unigram] = {}


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """([(piece, score)] by id, id of the unknown piece) of a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    out = []
    for k in range(sp.get_piece_size()):
        special = sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k)
        out.append((sp.id_to_piece(k), NEVER if special else float(sp.get_score(k))))
    return out, sp.unk_id()


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        known = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.trie = ahocorasick.Automaton()
        for p, s in pieces:
            self.trie.add_word(p, (len(p), s))
        self.trie.make_automaton()
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def of(path: str) -> Unigram:
        if path not in _models:
            _models[path] = Unigram(vocabulary(path)[0])
        return _models[path]

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of one word, meta symbol included."""
        n = len(word)
        best = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        open_unknown = [False] * (n + 1)
        matches = self.trie.iter(word)
        end, value = next(matches, (n, None))
        for e in range(n):
            top, at, c, unk = None, 0, 0, False
            while end == e:
                size, score = value
                start = e + 1 - size
                got = best[start] + score
                if top is None or got > top:
                    top, c = got, pieces[start] + 1
                end, value = next(matches, (n, None))
            ch = word[e]
            if ch not in self.single:
                got = best[e] + self.unknown
                if top is None or got > top:
                    top, unk = got, True
                    c = pieces[e] + (len(ch.encode()) if self.bytes else 0 if open_unknown[e] else 1)
            best[e + 1], pieces[e + 1], open_unknown[e + 1] = top, c, unk
        return pieces[n]

    def text(self, text: bytes | None) -> int:
        """Pieces of a whole UTF-8 text."""
        if not text:
            return 0
        words = text.replace(META.encode(), b" ").split(b" ")
        if not words[0]:
            words = words[1:]
        memo = self.memo
        for w in set(words).difference(memo):
            if len(w) > MEMO_BYTES:
                continue
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[w] = self.count(META + w.decode())
        get = memo.get
        total = 0
        for w in words:
            n = get(w)
            total += n if n is not None else self.count(META + w.decode())
        return total


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text."""

    def run(batches):
        model = Unigram.of(path)
        for rows, texts in text_chunks(batches):
            yield pa.record_batch([rows.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([model.text(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return only_columns(docs, ("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
