"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker.

The vocabulary's pre-tokenizer never joins anything across white space, so a text's ids are those of its words in
order, and those of a word without an apostrophe are those of its runs of letters, its digits and its other runs.
What the library has encoded is kept by word; texts for which the shortcut isn't proven go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import regex

#: Words remembered by a worker; then it starts anew. About 150 bytes a word.
CACHE_WORDS = 800_000
_PARTS = regex.compile(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = regex.compile(r"[\x1c-\x1fΣ]")


def _latin(text: str) -> bool:
    """Whether all characters are in Latin-1, which composition leaves alone and all libraries lower alike."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Encodes texts as little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith("</w>")
        self.size = len(self.ends)
        self.words: dict[str, bytes] = {}
        self.specials = [s for s in (t.content for t in self.library.get_added_tokens_decoder().values())]

    def _plain(self, text: str) -> str | None:
        """The text as its words may be looked up, in lower case if that is sure to be the library's; None if it isn't."""
        if any(s in text for s in self.specials) or _ODD.search(text):
            return None
        return text.lower() if _latin(text) else text

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        words, parts = self.words, {}
        plain: set[str] = set()
        lone: list[str] = []
        for w in missing:
            if w.isalpha():
                plain.add(w)
            elif "'" in w or not _latin(w):  # beyond Latin-1, libraries disagree on what a letter is
                lone.append(w)
            else:
                parts[w] = p = _PARTS.findall(w)
                plain.update(x for x in p if x not in words)
        for w, ids in zip(lone, self._whole(lone), strict=True):
            words[w] = ids
        order = list(plain)
        for at in range(0, len(order), 2000):
            some = order[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and (not len(stops) or stops[-1] == len(ids)):
                data, last = ids.tobytes(), 0
                for w, stop in zip(some, (stops * 4).tolist(), strict=True):
                    words[w] = data[last:stop]
                    last = stop
            else:
                words.update(zip(some, self._whole(some), strict=True))
        for w, p in parts.items():
            words[w] = b"".join([words[x] for x in p])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        out: list[bytes] = []
        for text in texts:
            low = self._plain(text or "")
            if low is None:
                out.append(self._whole([text or ""])[0])
                continue
            split = low.split()
            try:
                out.append(b"".join(map(self.words.__getitem__, split)))
            except KeyError:
                self._learn(set(split).difference(self.words))
                out.append(b"".join(map(self.words.__getitem__, split)))
        return out


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a worker and file."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
