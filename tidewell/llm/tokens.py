"""Token ids of whole texts by a byte-level BPE of the tokenizers library, with a bounded memo of frequent chunks.

A text is cut where the tokenizer's own pre-tokenisation always cuts: before a single space that stands between two
other characters, and before a single line feed likewise. Each chunk is then encoded on its own, and kept in the memo.
Texts with other white space or runs of it are encoded as they are. The ids are the same.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

#: Chunks that a worker's memo holds before it starts anew.
MEMO = 600_000
#: White space other than the space and the line feed, as Unicode has it; ASCII's four separators are added with care.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
#: Neither letters, digits nor white space: after letters they always form a piece of their own.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-\u024f]+)([.,;:!?*#%&$|-]*)").fullmatch


def _shown() -> dict[int, str]:
    """The characters by which byte-level vocabularies show bytes: printable ones as they are, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_plainly(spec: dict) -> bool:
    """Whether the tokenizer is of the kind whose pieces this module cuts itself; any other encodes texts as they are.

    That is: bytes shown as characters, cut by the usual pattern, merged by pairs; nothing else done to the text; and no
    added token that a text without markup could hold.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    marked = all(t["content"].startswith("<|") and t["content"].endswith("|>") and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return bool(plain and byte_level and merges and marked)


def _crowded(text: str) -> bool:
    """Whether the text has white space beside white space, or other than spaces and line feeds."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return not text.replace("\n", "").isprintable() and bool(_ODD.search(text))  # white space but the space isn't printable


class _Memo(dict):
    """Ids of chunks, learnt where they are missed."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


class Encoder:
    """encode(texts) gives for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary())
        self.memo = _Memo(self._learn)
        self.most = memo
        self.feed = self._plain("\n")
        self.splits = splits_plainly(json.loads(self.tokenizer.to_str()))
        self.tokenize = self.tokenizer.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {}
        self.shown = _shown()
        self.space = self.shown[0x20]

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, space: str, word: str) -> bytes:
        """Ids of one word after a space or none; letters with marks after them need the merges alone."""
        if not (m := _WORD(word)):
            return self._plain(space + word)
        letters, marks = m.groups()
        text = f"{space}{letters}" if not letters.isascii() else f"{self.space if space else ''}{letters}"
        if not letters.isascii():
            text = text.encode().decode("latin-1").translate(self.shown)
        ids = b"".join([self.bytes_of[t.id] for t in self.tokenize(text)])
        if marks:
            ids += self.marks[marks] if marks in self.marks else self.marks.setdefault(marks, self._plain(marks))
        return ids

    def _learn(self, p: str) -> bytes:
        if p[:1] == "\n":
            return self.feed + (self._word("", p[1:]) if len(p) > 1 else b"")
        return self._word(" ", p) if p else self._plain(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """A group of texts should be of a few megabytes at most; null counts as empty."""
        out = []
        get = self.memo.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.splits or _crowded(text):
                out.append(self._plain(text))
            else:
                if len(self.memo) > self.most:
                    self.memo.clear()
                head, *parts = text.replace("\n", " \n").split(" ")
                first = self.feed + self._word("", head[1:]) if head[:1] == "\n" and len(head) > 1 else self._word("", head) if head else b""
                out.append(first + b"".join(map(get, parts)))
        return out


def crc(data: bytes) -> int:
    return zlib.crc32(data)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; its memo lasts from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
