"""Whole-text encoding with the tokenizers library, one call per distinct chunk.

A byte-level or word-end BPE vocabulary first cuts a text at fixed places
(``pre_tokenizer``) and then encodes every cut part on its own.  Parts repeat:
a text is cut at single spaces and line ends, where those pre-tokenizers
always cut, and only chunks the worker has not met are given to the library.
Cutting, finding the distinct chunks of a batch (Arrow dictionary encoding) and
putting the ids together (one numpy gather) work on whole batches; Python
touches distinct chunks only.
The result equals encoding the whole text in one call; texts where the cuts
could differ (white space next to white space, rare space characters) and
vocabularies of another kind are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts with these are encoded whole: neighbouring white space, control
# characters, and white space other than single spaces and line ends.
NEIGHBOURS = ("  ", " \n", "\n ", "\n\n")
CONTROLS = "\x00\x01\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = ("\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u200b\u2028\u2029\u202f\u205f\u3000\ufeff")
# Stands between chunks while a batch is cut (texts that hold it are irregular).
UNIT = "\x01"
# Chunks given to the library in one string.
PER_CALL = 64
# Bounds of the per-worker memory: entries, and the longest chunk kept.
CACHE_ENTRIES = 350_000
CACHE_CHUNK = 48
# Characters whose chunks are looked up together (bounds the memory of one step).
GROUP_CHARS = 4_000_000
# Characters whose results are handed on together.
OUTPUT_CHARS = 2_000_000

_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, offsets: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file (loaded once per process)."""
    key = (path, offsets)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, offsets)
    return _ENCODERS[key]


def _cut_rule(path: str) -> str:
    """``spaces`` (chunks keep their leading space), ``words`` (white space is
    dropped) or ``whole``, read from the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
            and not pre.get("add_prefix_space"):
        return "spaces"
    steps = pre.get("pretokenizers", [])
    if pre.get("type") == "Sequence" and steps and steps[0].get("type") == "Split" \
            and steps[0].get("behavior") == "Removed" and steps[0].get("invert") \
            and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace",
                                                                            "Lowercase"]:
        return "words"
    return "whole"


def irregular(text: str) -> bool:
    return (any(x in text for x in NEIGHBOURS) or any(x in text for x in CONTROLS)
            or not text.isascii() and any(x in text for x in WIDE_SPACES))


def lower_latin(text: str) -> str:
    """Latin-1 texts in lower case, where a lower-casing vocabulary gives the same ids.

    Their capitals map one to one and none composes anew; others stay as they are.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """ids (and character spans) of whole texts as little-endian bytes."""

    def __init__(self, path: str, offsets: bool = False, special_as_text: bool = False):
        # A task owns one core: threads of the library would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # By default a special token's string inside a text is that token, as in the
        # library; such texts are encoded whole.
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = () if special_as_text else tuple(
            t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.rule = _cut_rule(path)
        self.offsets = offsets
        self.cache: dict[str, bytes] = {"": b""}
        self.mark, self.mark_id = {"spaces": "\n", "words": " \x01 "}.get(self.rule), None
        one = self.tokenizer.encode(self.mark or "", add_special_tokens=False).ids
        self.mark_id = one[0] if one else None
        if len(one) != 1 or offsets:
            self.mark = None
        self.points: dict[str, bytes] = {}
        if self.mark:
            self.points = dict(zip(".,", self._encode_whole([".", ","])))
        if self.rule == "spaces":
            self.cache["\n"] = self._encode_whole(["\n"])[0]

    def _encode_whole(self, texts: Sequence[str]) -> list[bytes]:
        if self.offsets:
            return [np.array(e.offsets, dtype="<i4").tobytes()
                    for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, new: Sequence[str]) -> Iterable[bytes]:
        if self.mark is None:
            yield from self._encode_whole(new)
            return
        # Some chunks a call: the mark stands between chunks and never inside one.
        joined = [self.mark.join(new[i:i + PER_CALL]) for i in range(0, len(new), PER_CALL)]
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            for end in (4 * np.flatnonzero(ids == self.mark_id)).tolist():
                yield data[at:end]
                at = end + 4
            yield data[at:]

    def _lookup(self, distinct: list[str]) -> list[bytes]:
        """The data of distinct chunks: known ones, and new ones from the library."""
        known = self.cache
        data = list(map(known.get, distinct))
        missing = [i for i, d in enumerate(data) if d is None]
        new = {distinct[i]: b"" for i in missing}
        stems = {}
        if self.points:
            # A letter and a closing point or comma are encoded apart by these rules
            # (a few letters end in a mark once they are in lower case).
            stems = {x: x[:-1] for x in new
                     if x[-1] in self.points and x[-2:-1].lower()[-1:].isalpha()}
            for x, w in stems.items():
                del new[x]
                if w not in new and w not in known:
                    new[w] = b""
        words = list(new)
        new = dict(zip(words, self._encode_new(words)))
        for i in missing:
            x = distinct[i]
            w = stems.get(x)
            if w is None:
                data[i] = new[x]
            else:
                data[i] = (new.get(w) or known[w]) + self.points[x[-1]]
        room = CACHE_ENTRIES - len(known)
        if room > 0:
            known.update((x, new[x]) for x in words[:room] if len(x) <= CACHE_CHUNK)
        return data

    def _cut(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Chunks of regular texts: ends per text, chunk numbers, the distinct chunks."""
        if self.rule == "words":
            texts = [lower_latin(t) for t in texts]
        batch = pa.array(texts, pa.string())
        if self.rule == "words":
            cut = pc.split_pattern(pc.replace_substring(batch, "\n", " "), " ")
        else:
            marked = pc.replace_substring(pc.replace_substring(batch, " ", UNIT + " "),
                                          "\n", UNIT + "\n" + UNIT)
            cut = pc.split_pattern(marked, UNIT)
        chunks = cut.flatten().dictionary_encode()
        return (np.asarray(cut.offsets)[1:], chunks.indices.to_numpy(zero_copy_only=False),
                chunks.dictionary.to_pylist())

    def _gather(self, texts: Sequence[str], width: int) -> Iterator[tuple]:
        """Per text, the int32 rows (``width`` numbers a token) of its tokens, and
        the start of the chunk each token is in.

        Distinct chunks are looked up for all texts together; the rows of one
        text exist at a time.
        """
        odd = [self.rule == "whole" or irregular(t) or any(s in t for s in self.special) for t in texts]
        regular = [t for t, x in zip(texts, odd) if not x]
        start, last = 0, iter(())
        if regular:
            ends, numbers, distinct = self._cut(regular)
            data = self._lookup(distinct)
            table = np.frombuffer(b"".join(data), dtype="<i4").reshape(-1, width)
            size = np.fromiter(map(len, data), dtype=np.int32, count=len(data)) // (4 * width)
            first = np.cumsum(size, dtype=np.int32) - size
            chars = None
            if width > 1:
                chars = np.fromiter(map(len, distinct), dtype=np.int32, count=len(distinct))
            last = iter(ends.tolist())
            del data, distinct, regular
            # What the cut has used goes back to the system, not to the worker's pool.
            pa.default_memory_pool().release_unused()
        for text, alone in zip(texts, odd):
            if alone:
                yield np.frombuffer(self._encode_whole([text])[0], dtype="<i4").reshape(-1, width), None
                continue
            end = next(last)
            chunk = numbers[start:end]
            start, n = end, size[chunk]
            done = np.cumsum(n, dtype=np.int32)
            at = np.repeat(first[chunk] - done + n, n) + np.arange(int(n.sum()), dtype=np.int32)
            begin = None
            if width > 1:
                wide = chars[chunk]
                begin = np.repeat(np.cumsum(wide, dtype=np.int32) - wide, n)
            yield table[at], begin

    def ids(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        for rows, _ in self._gather(texts, 1):
            yield rows.tobytes()

    def spans(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Per text, an (n, 2) array of its tokens' character spans, end exclusive.

        Only for vocabularies whose chunks join to the text (``spaces``, ``whole``).
        """
        if self.rule == "words":
            self.rule = "whole"
        for rows, starts in self._gather(texts, 2):
            yield rows if starts is None else rows + starts[:, None]


def grouped(texts: Sequence[str], chars: int = GROUP_CHARS) -> Iterable[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``chars`` characters (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
