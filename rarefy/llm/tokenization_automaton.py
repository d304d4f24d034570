"""Op 13: BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled, in order, into a deterministic
automaton over its tokens that accepts exactly the token sequences BPE makes.
It begins with one state that every symbol leads back to.  The gadget of the
merge (u, v) makes ``uv`` out of every path u, v: the state q that u leads to
is copied without its arc v, u leads to the copy from now on, and wherever u
could be read, ``uv`` can, and leads where v leads from q.

All arcs of one label lead to one state, so the tables hold a target state per
label, and per state the one arc its gadget removed and the state it is a copy
of: two numbers a merge instead of states times labels.  An arc exists unless
a state along that chain removed the label, or what the label's left part was
then.  Looked-up arcs are kept in a bounded transition table.

A text is cut into words by the vocabulary's own normalizer and pre-tokenizer.
A word has one accepted path that spells it; the walk takes the longest token
whose arc exists, and goes back where no token fits.  A position reached is
always reached in the same state, so none is left twice and the walk is linear
in the word.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, public_vocabulary, text_or_empty
from .text_encoding import grouped

VOCABULARY = "word_bpe_49k.json"
# Bounds of the per-worker memory: arcs, chunks and words kept, and the longest of them.
TABLE_ARCS = 400_000
CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
# Characters encoded together.
GROUP_CHARS = 2_000_000
# White space at which every pre-tokenizer of this kind cuts.
CUT_AT = ("\n", "\t")
# A chunk the pre-tokenizer cuts after its letters only (probed when a file is loaded).
PLAIN = re.compile(r"([A-Za-z]+)([.,]?)")


class MergeAutomaton:
    """Deterministic automaton of the token sequences a list of merges makes.

    Tokens are strings of symbols (one character each); ``merges`` are pairs of
    tokens in order.  Each part must be a symbol or made by an earlier merge,
    and each token by one merge: there, merging by rank and merge by merge agree.
    """

    def __init__(self, symbols: Sequence[str], merges: Sequence[tuple[str, str]]):
        names = list(symbols) + [u + v for u, v in merges]
        number = {t: i for i, t in enumerate(names)}
        if len(number) != len(names):
            raise ValueError("a token is made by two merges")
        self.names = names
        self.target = [0] * len(names)   # the state a label's arcs lead to
        self.left = [-1] * len(names)    # left part of a token
        self.made = [0] * len(names)     # the gadget that made it
        self.inherit = [0] * len(names)  # the state a token led to when it was made
        self.owner = [-1]                # per state: the label whose target was copied
        self.gadget: dict[int, int] = {}  # (owner, removed label) -> state
        self.table: dict[int, bool] = {}
        self.width = len(names)
        # Labels by their spelling.
        self.label = {t: number[t] for t in symbols}
        for k, (u, v) in enumerate(merges, 1):
            u, v, w = number[u], number[v], len(symbols) + k - 1
            if max(u, v) >= w:
                raise ValueError("a merge comes before one of its parts")
            self._add_gadget(k, u, v, w)
        # Per prefix of a label, the longest label it begins with (-1: none); per label, the next.
        self.prefix: dict[str, int] = {}
        self.shorter = [-1] * len(names)
        for t in sorted(self.label, key=len):
            longest = -1
            for size in range(1, len(t)):
                longest = self.prefix.setdefault(t[:size], longest)
            self.prefix[t], self.shorter[self.label[t]] = self.label[t], longest

    def _add_gadget(self, k: int, u: int, v: int, w: int) -> None:
        self.left[w], self.made[w] = u, k
        self.owner.append(u)
        if not self._arc(self.target[u], v):
            return  # v never follows u: no path to merge, the token has no arcs
        after = self.target[v]
        self.gadget[u * self.width + v] = k
        self.target[u] = k
        self.target[w] = self.inherit[w] = after
        self.label[self.names[w]] = w

    def _arc(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``, from the chain of its copies."""
        while state:
            owner = self.owner[state]
            part, until = label, len(self.owner)
            while part >= 0:
                removed = self.gadget.get(owner * self.width + part)
                if removed is not None and removed <= state and removed <= until:
                    return False
                until, part = self.made[part], self.left[part]
            state = self.inherit[owner]
        return True

    def arc(self, state: int, label: int) -> bool:
        key = state * self.width + label
        found = self.table.get(key)
        if found is None:
            found = self._arc(state, label)
            if len(self.table) < TABLE_ARCS:
                self.table[key] = found
        return found

    def path(self, word: str) -> list[int]:
        """The labels of the accepted path that spells ``word``."""
        one = self.label.get(word)
        if one is not None:  # the first state has every arc
            return [one]
        prefix, shorter, target, table, width = (self.prefix, self.shorter, self.target, self.table,
                                                 self.width)
        at, state, end = 0, 0, len(word)
        path: list[tuple[int, int, int]] = []
        closed = set()
        t = None
        while at < end:
            if t is None:  # the longest label from here on
                t, size = -1, 1
                while at + size <= end and (longer := prefix.get(word[at:at + size])) is not None:
                    t, size = longer, size + 1
            while t >= 0:
                if closed and at + len(self.names[t]) in closed:
                    t = shorter[t]
                    continue
                found = table.get(state * width + t)
                if found is None:
                    found = self.arc(state, t)
                if found:
                    break
                t = shorter[t]
            if t >= 0:
                path.append((at, state, t))
                at, state, t = at + len(self.names[t]), target[t], None
            elif path:
                closed.add(at)
                at, state, t = path.pop()
                t = shorter[t]
            else:
                raise ValueError(f"no path spells {word!r}")
        return [t for _, _, t in path]


class Codec:
    """ids and labels of whole texts, as the vocabulary file defines them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") \
                or spec.get("decoder") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies without a decoder step")
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        vocabulary = model["vocab"]
        # A symbol that ends a word is one character of its own.
        ends = {c + suffix: chr(0x10000 + ord(c)) for c in map(chr, range(0x10000))
                if suffix and c + suffix in vocabulary}
        self.ends = {k[:len(k) - len(suffix)]: v for k, v in ends.items()}

        def spell(token: str) -> str:
            if suffix and token.endswith(suffix):
                stem = token[:len(token) - len(suffix)]
                return stem[:-1] + self.ends[stem[-1:]]
            return token
        made = {u + v for u, v in merges}
        symbols = [t for t in vocabulary if t not in made]
        self.automaton = MergeAutomaton([spell(t) for t in symbols],
                                        [(spell(u), spell(v)) for u, v in merges])
        self.id = [vocabulary[t] for t in symbols] + [vocabulary[u + v] for u, v in merges]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
               for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must be plain strings")
        self.special = special
        self.special_at = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        label = {i: t for t, i in vocabulary.items()} | {i: t for t, i in special.items()}
        self.labels = [label.get(i) for i in range(max(label, default=-1) + 1)]

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.plain = ([self._cut("Ab"), self._cut("Ab."), self._cut("Ab,")]
                      == [["ab"], ["ab", "."], ["ab", ","]])
        if self._cut("a\nb\tc d") != ["a", "b", "c", "d"]:
            raise ValueError("the pre-tokenizer must drop white space")
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def _cut(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [w for w, _ in self.pre.pre_tokenize_str(text)]

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelled = word[:-1] + self.ends[word[-1]] if self.ends else word
            path = self.automaton.path(spelled)
            found = pack(f"<{len(path)}I", *map(self.id.__getitem__, path))
            if len(self.words) < CACHE_ENTRIES and len(word) <= CACHE_CHARS:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """ids of a chunk without white space of the cut."""
        if self.plain and (m := PLAIN.fullmatch(chunk)):
            ids = self._word(m[1].lower())
            return ids + self._word(m[2]) if m[2] else ids
        parts = self.special_at.split(chunk) if self.special_at else [chunk]
        return b"".join(pack("<I", self.special[part]) if k % 2 else b"".join(map(self._word, self._cut(part)))
                        for k, part in enumerate(parts))

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers.

        Texts are cut at blanks, tabs and line ends, where the pre-tokenizer always cuts
        and nothing composes; each distinct chunk is encoded once.
        """
        for white in CUT_AT:
            texts = [t.replace(white, " ") for t in texts]
        cut = [t.split(" ") for t in texts]
        known = self.chunks
        here = {}
        for chunks in cut:
            for c in set(chunks):
                if c not in here:
                    data = known.get(c)
                    if data is None:
                        data = self._chunk(c)
                        if len(known) < CACHE_ENTRIES and len(c) <= CACHE_CHARS:
                            known[c] = data
                    here[c] = data
        for chunks in cut:
            yield b"".join(map(here.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, joined by a blank (a vocabulary without a decoder)."""
        labels = self.labels
        found = [labels[i] if i < len(labels) else None
                 for i in np.frombuffer(ids, dtype="<u4").tolist()]
        return " ".join(x for x in found if x is not None)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file (compiled once per process)."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in grouped(texts, GROUP_CHARS):
            ids = list(bpe.encode(texts[a:b]))
            columns = [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(bpe.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "ids", "decoded"][:len(columns)])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for batch in batches:
        ids = batch.column(1).to_pylist()
        for a, b in grouped(ids, 4 * GROUP_CHARS):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(map(bpe.decode, ids[a:b]), pa.string())],
                names=["doc", "decoded"])


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: each whole text's ids as little-endian unsigned 32-bit integers.

    ``decoded`` adds the decoded text.  Strings of special tokens in a text give
    those tokens, as in a plain call of the tokenizers library.  Null and empty
    texts have no ids; a null id stays null; repeated rows give a row each;
    other columns are ignored; an empty table gives no rows.  No shuffle.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), text_or_empty(text).alias("text"))
    out = rows.mapInArrow(on_workers(_encoded, vocabulary or public_vocabulary(VOCABULARY), decoded),
                          f"doc {kind}, ids binary" + (", decoded string" if decoded else ""))
    return out.withColumnRenamed("doc", doc_id)


def decode_ids(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids",
               vocabulary: str | None = None) -> DataFrame:
    """``doc_id, decoded``: the labels of each row's ids (null: none), special ones included.

    Ids that the vocabulary does not have emit nothing, as in the tokenizers library.
    """
    kind = tokens.schema[doc_id].dataType.simpleString()
    rows = tokens.select(F.col(doc_id).alias("doc"),
                         F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(on_workers(_decoded, vocabulary or public_vocabulary(VOCABULARY)),
                           f"doc {kind}, decoded string").withColumnRenamed("doc", doc_id)


def round_trip_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text (see :func:`encode_texts`)."""
    out = encode_texts(docs, doc_id, text, vocabulary, decoded=True)
    return out.select(doc_id, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
