"""Public tokenizer files behind one interface; made once per Python worker."""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Fixed value: the public pre-tokenization pattern of byte-level BPE.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters assigned in recent Unicode versions are mostly here; libraries may disagree on them.
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevelEncoder:
    """A byte-level BPE ``.json``. Where the file is plain (ids in merge order, the standard
    pattern, plain added tokens), a faster library encodes the same ranks; the tokenizers
    library itself is used for other files and for texts beyond the basic plane.

    ``splices`` says that a blank after a visible ASCII character always starts a new piece of
    text for the encoder, whatever stands before it: the rules look ahead, never back.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self.splices = False
        self._fast = None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = (
            spec["model"]["type"] == "BPE" and not spec["normalizer"]
            and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"
            and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"]["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
            and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        )
        if not plain:
            return
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in k): i for k, i in vocab.items() if k not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if len(ranks) != 256 + len(merges) or any(vocab["".join(m)] != 256 + i for i, m in enumerate(merges)):
            return
        self.splices = all(not re.search(r"\s", t) for t in added)
        self._fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
        self.guard = max([8, *(len(t) for t in added)])
        self.lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.lengths[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None or _ASTRAL.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast.encode_to_numpy(text, allowed_special="all")

    def can_splice(self, text: str) -> bool:
        return self.splices and not _ASTRAL.search(text)


class PieceEncoder:
    """A sentencepiece ``.model``; texts are always encoded whole."""

    splices = False

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text), np.uint32)

    def can_splice(self, text: str) -> bool:
        return False


def encoder(path: str) -> ByteLevelEncoder | PieceEncoder:
    """The encoder of a file. Functions reach workers by value, so what a worker should keep between
    tasks hangs on a module that is imported there."""
    kept = np.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path) if path.endswith(".model") else ByteLevelEncoder(path)
    return kept[path]


class _WordPieces:
    """Ids of plain words by a faster library, where they provably equal those of merge rules.

    The faster one joins neighbours whenever the joined bytes are a token, the rules only listed pairs.
    What ends up as one token was joined inside that token alone, in the order of the tokens' numbers. So
    if joining the bytes of each resulting token takes listed pairs only, both do the same; other
    words have no answer here. A word's end is the byte FF, which no text holds.
    """

    #: After lower-casing; only words of printable ASCII and the letters of Latin-1 are plain.
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
    _PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

    def __init__(self, spec: dict):
        import tiktoken

        suffix, alphabet = spec["model"]["end_of_word_suffix"], _byte_alphabet()
        added = {t["content"] for t in spec["added_tokens"]}
        self._starts = {t[:1] for t in added}

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(alphabet[c] for c in (token.removesuffix(suffix) if end else token)) + b"\xff" * end

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self._ranks = {raw(k): i for k, i in vocab.items() if k not in added}
        pairs = [tuple(raw(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in merges]
        self._listed = set(pairs)
        # Numbers in merge order, bytes and ends of words first, and a splitting rule that is this one.
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        self._usable = (
            rule == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and len(self._ranks) == len(pairs) + 512 == len(set(self._ranks.values()))
            and all(self._ranks.get(a + b) == 512 + i for i, (a, b) in enumerate(pairs))
            and all(self._ranks.get(bytes([b]), 512) < 256 <= self._ranks.get(bytes([b, 255]), 0) < 512 for b in range(256)))
        if self._usable:
            self._fast = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=self._ranks, special_tokens={})
        self._bytes = {i: t for t, i in self._ranks.items()}
        self._proven: set[int] = set()

    def _by_rules(self, token: int) -> bool:
        parts = [bytes([b]) for b in self._bytes[token]]
        while len(parts) > 1:
            ranks = [self._ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            if ranks[at] >= 512 and (parts[at], parts[at + 1]) not in self._listed:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return True

    def ids(self, word: str) -> bytes | None:
        if not self._usable or not self._PLAIN.fullmatch(word) or any(c in word for c in self._starts):
            return None
        found = []
        for piece in self._SPLIT.findall(word.lower()):
            found += self._fast._encode_single_piece(piece.encode() + b"\xff")
        if not self._proven.issuperset(found):
            self._proven.update(t for t in found if self._by_rules(t))
            if not self._proven.issuperset(found):
                return None
        return struct.pack(f"<{len(found)}I", *found)


#: Characters of which words are held at a time.
SLICE = 1 << 20
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def _slices(text: str):
    """A text in parts that end behind white space, of ``SLICE`` characters and what is left of a word."""
    at = 0
    while len(text) - at > SLICE:
        blank = _BLANK.search(text, at + SLICE)
        if not blank:
            break
        yield text[at:blank.end()]
        at = blank.end()
    yield text[at:]


class WordEncoder:
    """A tokenizer whose ids follow from each run of text between blanks, line ends and tabs alone: ids of
    words are remembered, up to a bound, and the library sees each new word once.

    It holds for files that drop white space and normalise, split and merge inside words only: those with
    a word-end suffix whose splitting rule removes all white space, and whose added tokens have none. Texts
    go to the library whole for any other file.
    """

    def __init__(self, path: str, most: int = 1 << 18):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._most = most
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_words = (
            bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")
            and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in (spec["normalizer"] or {}).get("normalizers", [{"type": ""}]))
            and not spec["post_processor"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )

        self._pieces = _WordPieces(spec) if self.by_words else None

    def _words(self, words: list[bytes]) -> list[bytes]:
        out = [self._pieces.ids(w.decode()) for w in words]
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(others, self._encoded([words[i].decode() for i in others]), strict=True):
            out[i] = ids
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._library.encode_batch(texts, add_special_tokens=False)]

    def data(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers. Words are held of about ``SLICE`` characters at a time, of
        one text or of several."""
        if not self.by_words:
            return self._encoded(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _slices(text):
                held.append((i, part))
                size += len(part)
                if size >= SLICE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return [b"".join(parts) for parts in out]

    def _add(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        for (i, _), data in zip(held, self._some([part for _, part in held]), strict=True):
            out[i].append(data)

    def _some(self, texts: list[str]) -> list[bytes]:
        split = [text.encode().split() for text in texts]
        if len(self._known) > self._most:
            # What was not asked for since the last time is forgotten.
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        new = []
        for word in set().union(*split):
            if word not in known:
                if (ids := older.get(word)) is not None:
                    known[word] = ids
                else:
                    new.append(word)
        for i in range(0, len(new), 1 << 14):
            some = new[i:i + (1 << 14)]
            known.update(zip(some, self._words(some), strict=True))
        return [b"".join([known[w] for w in words]) for words in split]


def word_encoder(path: str) -> WordEncoder:
    """As ``encoder``, for files of words."""
    kept = np.__dict__.setdefault("_kept_encoders", {})
    if ("words", path) not in kept:
        kept["words", path] = WordEncoder(path)
    return kept["words", path]
