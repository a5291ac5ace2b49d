"""BPE encoding and decoding by a tokenization automaton (operator 10).

States of the automaton are classes of what may follow a token inside one pre-split word; its arcs carry tokens. It
starts as one state with a loop for each byte symbol. A merge (u, v) -> uv is applied as a gadget: the u-arcs are led to
a copy of their state that lacks the v-arc, and an arc uv, to where v led, joins every state that has a u-arc. After all
merges each word has exactly one path of arcs, the one that applying the merges in order would give.

As all arcs of a label end in one state, the copies need not be written out: a state is the chain of labels that it was
copied from (a new uv starts as the copy of v's state), each with the rank at which an arc was cut. So the gadgets
compile to three tables, the cut ranks by (u, v) and the left and right part of each token, and an arc is looked up by
walking two chains; arcs that a task has used are held in a transition table. As there is one path at most for every
prefix of a word, a place of the word has one state at most: a word is read once from left to right, each place handing
its state on along the arcs that leave it, without a search, in steps that grow with its length alone.

decode() joins the arc labels with blanks, as the library does for a file without a decoder.

Defined results: null and empty texts have no tokens and decode to ''; equal rows get equal results; an empty table gives
an empty result; extra columns are ignored; special tokens in a text are cut out first and map to their ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftmill.llm._text import runs, tidied

#: Words and arcs that a task remembers at most, and the longest such word; full tables are emptied, which changes no
#: result.
REMEMBERED, LONGEST = 300_000, 64
#: An id of ranks that no merge has.
NEVER = 1 << 30

#: What parts a normalized text into words (fixed by the vocabulary file, which is checked against it).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        #: cut[u, v]: the merge that took the v-arc from the state of u; born[t]: the merge that made t's arcs
        self.cut: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.delta: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if uv in self.born or not (self._live(u, a) and self._live(v, b) and self._walk(u, v)):
                continue  # no state has a u-arc to a state with a v-arc: the gadget changes nothing
            self.cut[u, v], self.born[uv], self.left[uv], self.right[uv] = rank, rank, u, v
        self.ends = {t.removesuffix(suffix): i for t, i in vocab.items() if t.endswith(suffix) and self._live(i, t)} if suffix else {}
        inner = {t: i for t, i in vocab.items() if not (suffix and t.endswith(suffix)) and self._live(i, t)}
        self.ends = self.ends or inner
        #: every prefix of a token that can stand inside a word, with the token or -1
        self.prefixes = {t[:k]: -1 for t in inner for k in range(1, len(t))} | inner
        self.longest_end = max(map(len, self.ends), default=0)
        self.seen: dict[str, tuple[int, ...]] = {}

    def _live(self, i: int, t: str) -> bool:
        """Has any state an arc of this token? Of a symbol, or one that a merge has made."""
        return i in self.born or len(t.removesuffix(self.suffix) if self.suffix else t) == 1

    def _walk(self, x: int, y: int) -> bool:
        """Has x's state a y-arc? A cut (x', y') at rank r, of labels on x's chain of right parts and y's chain of left
        parts, holds here if it came before x's state was copied from that of x' and before y's arcs from those of y'."""
        cut, born, left, right = self.cut, self.born, self.left, self.right
        until_x = NEVER
        while True:
            z, until_z = y, NEVER
            while True:
                r = cut.get((x, z))
                if r is not None and r < until_x and r <= until_z:  # of (u, u), the copy without a u-arc gets no uu-arc
                    return False
                b = born.get(z)
                if b is None:
                    break
                until_z = min(until_z, b)
                z = left[z]
            b = born.get(x)
            if b is None:
                return True
            until_x = min(until_x, b)
            x = right[x]

    def arc(self, x: int, y: int) -> bool:
        key = x << 32 | y
        ok = self.delta.get(key)
        if ok is None:
            if len(self.delta) >= REMEMBERED:
                self.delta.clear()
            ok = self.delta[key] = self._walk(x, y)
        return ok

    def _read(self, s: str) -> tuple[int, ...]:
        """Tokens of a word: last[i] is the one token that ends at place i on a path from the start."""
        n, arc, prefixes, ends = len(s), self.arc, self.prefixes, self.ends
        last: list[int | None] = [None] * (n + 1)
        begins = [0] * (n + 1)
        for at in range(n):
            state = last[at]
            if at and state is None:
                continue
            if n - at <= self.longest_end and (t := ends.get(s[at:])) is not None and last[n] is None and (not at or arc(state, t)):
                last[n], begins[n] = t, at
            for end in range(at + 1, n):
                t = prefixes.get(s[at:end])
                if t is None:
                    break
                if t >= 0 and last[end] is None and (not at or arc(state, t)):
                    last[end], begins[end] = t, at
        path, at = [], n
        while at:
            path.append(last[at])
            at = begins[at]
        return tuple(path[::-1])

    def word(self, s: str) -> tuple[int, ...]:
        """Tokens of one pre-split word, given as byte symbols."""
        got = self.seen.get(s)
        if got is None:
            got = self._read(s)
            if len(s) <= LONGEST:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[s] = got
        return got


class Tokenizer:
    """Encodes as the vocabulary file says: special tokens, NFC, lower case, pre-split words, automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = {"NFC", "Replace", "Lowercase"}
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or {x["type"] for x in spec["normalizer"]["normalizers"]} != plain or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != WORDS or spec["decoder"]:
            raise ValueError(f"{path}: only word-end BPE with NFC, lower case and byte-level words is built")
        self.automaton = Automaton(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(WORDS)
        self._symbols = str.maketrans({chr(b): c for b, c in enumerate(byte_symbols())})
        self._seen: dict[str, tuple[int, ...]] = {}

    def _piece(self, s: str) -> tuple[int, ...] | list[int]:
        if s.isascii() and s.isalpha():
            return self.automaton.word(s.lower())
        s = unicodedata.normalize("NFC", s)
        s = "".join(c.lower() for c in s) if "Σ" in s else s.lower()
        out: list[int] = []
        for w in self._words.findall(s):
            out += self.automaton.word(w.encode().decode("latin-1").translate(self._symbols))
        return out

    def chunk(self, s: str) -> tuple[int, ...]:
        """Tokens of a run of text without ASCII white space. No rule of the file looks across white space."""
        got = self._seen.get(s)
        if got is None:
            out: list[int] = []
            for part in self._cut.split(s) if self._cut and "<|" in s else (s,):
                out += (self.special[part],) if part in self.special else self._piece(part) if part else ()
            got = tuple(out)
            if len(s) <= LONGEST:
                if len(self._seen) >= REMEMBERED:
                    self._seen.clear()
                self._seen[s] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        seen = self._seen.get
        for s in runs(text):
            got = seen(s)
            out += self.chunk(s) if got is None else got
        return out

    def decode(self, ids) -> str:
        return " ".join([self.labels[i] for i in ids])


_READY: dict[str, Tokenizer] = {}


def ready(path: str) -> Tokenizer:
    if path not in _READY:
        _READY[path] = Tokenizer(path)
    return _READY[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of every document. The vocabulary file must be at `path` on every executor."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                rows = [np.asarray(t.encode(x), np.int32) for x in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(tidied(run), T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded_sha256: every document's token ids and the hash of the text decoded from them, in one pass."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                rows, hashes = [], []
                for x in b.column(1).to_pylist():
                    ids = t.encode(x)
                    rows.append(np.asarray(ids, np.int32))
                    hashes.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
                ends = np.cumsum([0, *map(len, rows)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows))), pa.array(hashes, pa.string())], ["doc_id", "ids", "decoded_sha256"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(tidied(run), T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]))


def decoded(tokens: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of every row of token ids."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(doc_id, ids).mapInArrow(tidied(run), T.StructType([T.StructField("doc_id", tokens.schema[doc_id].dataType), T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding of each text in one pass."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ready(path)
        labels = [t.labels[i].encode() for i in range(len(t.labels))]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                n, a, d = [], [], []
                for x in b.column(1).to_pylist():
                    ids = t.encode(x)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    d.append(hashlib.sha256(b" ".join([labels[i] for i in ids])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(tidied(run), T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op10_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole documents table."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
