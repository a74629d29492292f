"""Exact token ids of the public tokenizer files, with a word memo and overlap resynchronisation for huge texts.

A tokenizer of these files cuts a text into words by a pattern that looks at nothing to the left, then encodes
each word alone. So the ids of a text are the ids of its words, and the library encodes each distinct word once.
Texts with characters for which the library's tables and Python's might differ go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np

#: Characters on which Python's and the library's classes and case tables agree.
_UNSAFE = re.compile("[^\t\n\r -~\u00a0-\u0148\u014a-\u017e]")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ž"
_NUMBER = "0-9²³¹¼-¾"
_BYTE_WORDS = re.compile(rf" [{_LETTER}]+|[{_LETTER}]+| ?[{_NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_GAP = re.compile(r"(?<=\S)\s")
#: What the pattern or a special string may look at beyond a boundary.
_MARGIN = 40
#: New words that go to the library at once.
_TOGETHER = 4096

_KEPT: dict[tuple, Encoder] = {}


@contextmanager
def encoding(path: str, splice: bool = True, memo: int = 500_000, keep: bool = False) -> Iterator[Encoder]:
    """One encoder per Python worker, whose memo serves one task: a worker that goes on to other work keeps no words.

    keep: the words stay for the worker's next tasks, which saves a tenth of the time and holds some 100 MB.
    """
    key = (path, splice, memo)
    if key not in _KEPT:
        _KEPT[key] = Encoder(path, memo, splice=splice)
    try:
        yield _KEPT[key]
    finally:
        if not keep:
            _KEPT[key].memo.clear()


class Encoder:
    """memo: distinct words kept at most; when more come, it starts anew. splice: long texts are encoded from
    overlapping chunks even where they could be cut between words."""

    def __init__(self, path: str, memo: int = 500_000, chunk: int = 1 << 15, overlap: int = 512, splice: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo_limit, self.memo, self.chunk, self.overlap, self.splice = memo, {}, chunk, overlap, splice
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.words, self.lower, self.edge = None, False, None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
                self.words = _BYTE_WORDS
            kinds = [x.get("type") for x in norm.get("normalizers", [])]
            parts = [x.get("pattern", {}).get("Regex", "") for x in pre.get("pretokenizers", [])]
            if kinds == ["NFC", "Replace", "Lowercase"] and parts[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]:
                self.words, self.lower = _LOWER_WORDS, True
        if self.words:
            names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
            self.edge = np.array([x.endswith("</w>") if self.lower else x.startswith("Ġ") for x in names])

    def _plain(self, text: str) -> bool:
        return self.words is not None and not _UNSAFE.search(text) and not any(s in text for s in self.special)

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        words = {}
        for i, text in enumerate(texts):
            plain = self._plain(text)
            if len(text) > self.chunk and not self.lower and (self.splice or not plain):
                out[i] = self.spliced(text)
            elif len(text) > self.chunk and plain and len(pieces := self._at_spaces(text)) > 1:
                out[i] = np.concatenate([self.ids([x])[0] for x in pieces])
            elif plain:
                words[i] = self.words.findall(text.lower() if self.lower else text)
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.memo) > self.memo_limit:
            self.memo.clear()
        known, new = {}, set()
        for i, found in words.items():
            codes = list(map(self.memo.get, found))
            gaps = [] if all(codes) else [k for k, code in enumerate(codes) if code is None]
            new.update(found[k] for k in gaps)
            known[i] = codes, gaps
        self._learn(list(new))
        for i, (codes, gaps) in known.items():
            for k in gaps:
                codes[k] = self.memo[words[i][k]]
            out[i] = np.frombuffer(b"".join(codes), "<u4")
        return out

    def _learn(self, new: list[str]) -> None:
        """Put words into the memo. Those that stay words with a space before them go to the library in one text."""
        for at in range(0, len(new), _TOGETHER):
            some = new[at : at + _TOGETHER]
            joined = some if self.lower else [w for w in some if w[0] == " " and not w[-1].isspace()]
            text = (" " if self.lower else "").join(joined)
            if joined and not any(s in text for s in self.special):
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                edges = np.flatnonzero(self.edge[ids]) + self.lower  # a word's last token, or its first one
                if len(edges) == len(joined):
                    cuts, code = (4 * np.concatenate(([0], edges) if self.lower else (edges, [len(ids)]))).tolist(), ids.tobytes()
                    self.memo.update((w, code[a:b]) for w, a, b in zip(joined, cuts, cuts[1:]))
                    some = [] if self.lower else [w for w in some if w not in self.memo]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.memo[word] = array("I", e.ids).tobytes()

    def _at_spaces(self, text: str) -> list[str]:
        """Pieces of a plain text, cut where white space begins: a word ends there, whatever follows."""
        out, at = [], 0
        while len(text) - at > self.chunk and (space := _GAP.search(text, at + self.chunk // 2)):
            out.append(text[at : space.start()])
            at = space.start()
        return [*out, text[at:]]

    def _piece(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word's first token its place in the text and its index."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        at = np.array([o[0] for o in e.offsets], np.int64)
        first = np.flatnonzero((word == -1) | np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
        _, index, times = np.unique(at[first], return_index=True, return_counts=True)
        first = first[index[times == 1]]  # one character may lower to two words: no place to join
        return np.array(e.ids, "<u4"), at[first], first

    def spliced(self, text: str) -> np.ndarray:
        """Ids of a long text from overlapping chunks.

        Where a word begins in both chunks, all to its right is the same for both, and for the whole text: the
        pattern looks only ahead. There the chunks are joined. Without such a place the overlap is doubled, up to
        the last joint, from where the text is encoded anew.
        """
        n, joint, parts = len(text), 0, []
        end = min(n, self.chunk)
        ids, at, first = self._piece(text[:end])
        at = at + joint
        while end < n:
            width = self.overlap
            while True:
                begin, stop = max(joint, end - width), min(n, end + self.chunk)
                ids2, at2, first2 = self._piece(text[begin:stop])
                at2 = at2 + begin
                if begin == joint:
                    cut, cut2 = 0, 0
                    break
                common = np.intersect1d(at[at < end - _MARGIN], at2[at2 > begin + _MARGIN])
                if len(common):
                    joint = int(common[-1])
                    cut, cut2 = first[np.searchsorted(at, joint)], first2[np.searchsorted(at2, joint)]
                    break
                width *= 2
            parts.append(ids[:cut])
            keep = first2 >= cut2
            ids, at, first, end = ids2[cut2:], at2[keep], first2[keep] - cut2, stop
        return np.concatenate([*parts, ids])
