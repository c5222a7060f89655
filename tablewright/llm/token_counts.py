"""Token counts of a unigram tokenizer by a Viterbi pass that only counts.

Words are runs between white space, each with the mark U+2581 before it.  An
Aho-Corasick automaton names all vocabulary pieces that end at a character; dynamic
programming carries the best score and its number of pieces, and no path.  Ties
follow the tokenizer's rule: scores are added from the left as doubles, and among
equal scores that end at one place the piece that starts first stays.  A character
no piece of its own covers costs the least score minus ten, and counts as its UTF-8
bytes (byte fallback) or, with its unknown neighbours, as one unknown token.

Counts of frequent words are remembered, within a bound, so the pass runs over each
distinct word about once a task.

Defined results: a null or blank text has no tokens; a word of any length takes time
in proportion to it; repeated rows count alike; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_WORD = re.compile("[^\x20\x09-\x0D]+")
_KNOWN, _LONG = 1 << 18, 64


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary and byte pieces, in order of
    their ids; the file orders pieces by frequency, so piece number r gets the
    log-probability -log(r + 2) of Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    return [(sp.id_to_piece(i), -math.log(r + 2)) for r, i in enumerate(keep)]


class Counter:
    """Counts the pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """(tokens, unknown characters) of one marked word."""
        n = len(word)
        score, count, fused, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        last, value = next(matches, (n, None))
        for end in range(1, n + 1):
            best = None
            while last == end - 1:  # the longest piece comes first, so an earlier start wins ties
                length, s = value
                start = end - length
                if best is None or score[start] + s > best:
                    best = score[start] + s
                    count[end], fused[end], odd[end] = count[start] + 1, False, odd[start]
                last, value = next(matches, (n, None))
            c, start = word[end - 1], end - 1
            if c not in self.single and (best is None or score[start] + self.unknown > best):
                best = score[start] + self.unknown
                more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not fused[start])
                count[end], fused[end], odd[end] = count[start] + more, True, odd[start] + 1
            score[end] = best
        return count[n], odd[n]

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown characters) of a text."""
        found, known = _WORD.findall(text), self.known
        tokens = odd = 0
        for w in found:
            c = known.get(w)
            if c is None:
                c = self.word(MARK + w)
                if len(w) <= _LONG:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[w] = c
            tokens += c[0]
            odd += c[1]
        return len(found), tokens, odd


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of ``docs``."""
    def run(batches):
        counter = Counter(pieces, byte_fallback)
        for b in batches:
            rows = [counter.text(t.as_py() or "") for t in b.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
