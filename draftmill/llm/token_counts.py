"""Token counts of a unigram model (operator 5): dynamic programming over a trie of pre-tokens.

A pre-token is a word `[^\\x20\\x09-\\x0D]+` with the word mark before it. Distinct pre-tokens are inserted in a trie. A
node stands for a prefix; its forward score (the best over all ways to cut the prefix into pieces) and the number of
pieces of that way are computed once, when the node is made, from the nodes above it, however many words share the
prefix. The last node of a word is its terminal and holds the word's count. Pieces and scores are those of the vocabulary
file, as they stand there; nothing is trained. A character outside the vocabulary costs its UTF-8 bytes, each a byte
piece of a score below every piece's.

Defined results: null and empty texts have no tokens; of equally good ways the one with fewer pieces counts; equal rows
get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Nodes of a task's trie, about: a full trie is emptied, which changes no result. Words of more characters than LONG are
#: counted on a path of their own, which isn't kept.
NODES, LONG = 600_000, 64
#: The file gives pieces that it never uses a score below this.
UNUSED = -1e8


def pieces(path: str) -> dict[str, float]:
    """Score of each piece, from the vocabulary file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class Trie:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min((v for v in scores.values() if v > UNUSED), default=0.0) - 2.0
        #: every end of a piece, so that the search up from a node stops early
        self.tails = {s[k:] for s in scores for k in range(len(s))}
        self.clear()

    def clear(self) -> None:
        """Node 0 is the root. child: (node, character) -> node; best, used: score and pieces of a node's prefix;
        terminal: the count of each word at its last node."""
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.used = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _step(self, s: str, d: int, best: list[float], used: list[int]) -> tuple[float, int]:
        """Score and pieces of the prefix of d characters, from those of the shorter ones."""
        n, scores, tails = len(s[d - 1].encode()), self.scores, self.tails
        top, count = best[d - 1] + n * self.byte_score, used[d - 1] + n
        for j in range(d - 1, max(-1, d - 1 - self.longest), -1):
            piece = s[j:d]
            if piece not in tails:
                break
            p = scores.get(piece)
            if p is not None:
                v = best[j] + p
                if v > top or v == top and used[j] + 1 < count:
                    top, count = v, used[j] + 1
        return top, count

    def insert(self, word: str) -> None:
        s, node, at = MARK + word, 0, 0
        best, used = [0.0], [0]
        while at < len(s) and (below := self.child.get((node, s[at]))) is not None:  # the shared prefix
            node, at = below, at + 1
            best.append(self.best[node])
            used.append(self.used[node])
        for d in range(at + 1, len(s) + 1):
            top, count = self._step(s, d, best, used)
            best.append(top)
            used.append(count)
            self.child[node, s[d - 1]] = node = len(self.best)
            self.best.append(top)
            self.used.append(count)
        self.terminal[word] = used[-1]

    def long(self, word: str) -> int:
        s = MARK + word
        best, used = [0.0], [0]
        for d in range(1, len(s) + 1):
            top, count = self._step(s, d, best, used)
            best.append(top)
            used.append(count)
        return used[-1]

    def counts(self, words: set[str]) -> dict[str, int]:
        """The words' counts; those not met before are inserted."""
        if len(self.best) > NODES:
            self.clear()
        more = {}
        for w in words - self.terminal.keys():
            if len(w) > LONG:
                more[w] = self.long(w)
            else:
                self.insert(w)
        return {w: more[w] if w in more else self.terminal[w] for w in words} if more else self.terminal


_READY: dict[str, Trie] = {}


def _ready(path: str) -> Trie:
    if path not in _READY:
        _READY[path] = Trie(pieces(path))
    return _READY[path]


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    path = path or _vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _ready(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                b = batch.slice(k, 2048)
                rows = [_split(x) for x in b.column(1).to_pylist()]
                get = trie.counts({w for r in rows for w in r}).__getitem__
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([sum(map(get, r)) for r in rows], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def _split(x: str | None) -> list[str]:
    """On the bytes, as str.split() also cuts at other white space."""
    return [w.decode() for w in x.encode().split()] if x else []


def op5_trie_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts for every document of the whole table."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
