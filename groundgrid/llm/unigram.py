"""Token counts (2): unigram segmentation of distinct pre-tokens over a shared trie."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_loaded: dict = {}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> dict[str, float]:
    """Score of each ordinary piece of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class PrefixTrie:
    """Forward scores of unigram segmentation, one for each prefix that any pre-token has had.

    A node is a prefix; its score is that of the best segmentation of the prefix, from the
    scores of the nodes above it. A character in no piece costs the least score less 10 and
    counts as one token. Equal scores: fewer tokens, then fewer unknown ones. Past most_nodes
    a word goes on without nodes, from the scores of its last positions, and the next word
    starts the trie anew, so memory is bounded however long a word is.
    """

    def __init__(self, pieces: dict[str, float], most_nodes: int = 400_000):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.most_nodes = most_nodes
        # By their last four characters, or all of a shorter one, the lengths of pieces: few places have to be looked at.
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                lengths.setdefault(p[-4:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v)) for k, v in lengths.items()}
        self.clear()

    def clear(self) -> None:
        self.below: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, -tokens, -unknown

    def insert(self, word: str) -> tuple[int, int]:
        """(tokens, unknown tokens) of the word."""
        if len(self.best) > self.most_nodes:
            self.clear()
        below, best, pieces, ends, longest = self.below, self.best, self.pieces, self.ends, self.longest
        at, new, state = 0, False, best[0]
        recent = [state]  # at the last positions
        for end, ch in enumerate(word, 1):
            node = None if new else below.get((at, ch))
            if node is None:
                new = True
                score, tokens, odd = state
                p = pieces.get(ch)
                top = (score + self.unknown, tokens - 1, odd - 1) if p is None else (score + p, tokens - 1, odd)
                for last in (2, 3, 4):
                    if last > end:
                        break
                    for n in ends.get(word[end - last : end], ()):
                        if n > end:
                            break
                        p = pieces.get(word[end - n : end])
                        if p is not None:
                            score, tokens, odd = recent[-n]
                            if (score + p, tokens - 1, odd) > top:
                                top = (score + p, tokens - 1, odd)
                state = top
                if at >= 0 and len(best) <= self.most_nodes:
                    node = below[at, ch] = len(best)
                    best.append(top)
                else:
                    node = -1
            else:
                state = best[node]
            at = node
            recent.append(state)
            if len(recent) > 64 + 2 * longest:
                del recent[:-longest]
        return -state[1], -state[2]


def token_counts(docs: DataFrame, path: str | None = None, most_words: int = 300_000) -> DataFrame:
    """docs with n_words, n_tokens and n_unknown (long) instead of text: unigram tokens of the whole text.

    Pre-tokens are the runs between ASCII white space, each with the word mark before it. Each
    task inserts the distinct pre-tokens it meets into one trie and keeps terminal counts (at
    most most_words of them) for the next texts; nothing is shuffled and memory doesn't grow with the input.
    Null and empty texts count 0; every row keeps its own; columns so named are replaced.
    """
    path = path or default_pieces()
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_tokens", "n_unknown")]

    def run(batches):
        if path not in _loaded:
            _loaded[path] = pieces_of(path)
        trie, counts = PrefixTrie(_loaded[path]), {}
        for b in batches:
            rows = []
            for t in b.column("text"):
                words = Counter((t.as_py() or b"").split())
                tokens = unknown = 0
                for w, n in words.items():
                    c = counts.get(w)
                    if c is None:
                        if len(counts) >= most_words:
                            counts.clear()
                        c = counts[w] = trie.insert("▁" + w.decode("utf-8", "replace"))
                    tokens += n * c[0]
                    unknown += n * c[1]
                rows.append((sum(words.values()), tokens, unknown))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in cols)], names=[*kept, "n_words", "n_tokens", "n_unknown"])

    zero = F.lit(0).cast("long")
    schema = docs.select(*kept, zero.alias("n_words"), zero.alias("n_tokens"), zero.alias("n_unknown")).schema
    return map_arrow(docs.select(*kept, F.col("text").cast("binary").alias("text")), run, schema)
