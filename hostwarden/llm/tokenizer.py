"""A public tokenizer applied to white-space separated pre-tokens."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Cached pre-tokens of one worker; the cache starts anew when full, results do not depend on it.
CACHE_ENTRIES = 500_000
#: Longer pre-tokens are encoded each time, so that the cache stays small.
CACHE_BYTES = 64

# The normaliser and the split pattern that the pre-tokens below are right for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once per worker process."""
    if path not in _LOADED:
        # Spark runs a worker per core; threads inside a worker would only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def checked(path: str) -> str:
    """The path of a tokenizer file whose texts may be cut at white space; another kind of file is refused.

    Other vocabularies keep white space or letter case in their ids, so the ids of a text
    would not be those of its pre-tokens.
    """
    try:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        normalizers = rules["normalizer"]["normalizers"]
        split, pieces = rules["pre_tokenizer"]["pretokenizers"]
        known = normalizers == NORMALIZERS and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"]
        known = known and pieces["type"] == "ByteLevel" and not pieces["add_prefix_space"] and not pieces["use_regex"]
        known = known and rules["model"]["end_of_word_suffix"] == "</w>"
        known = known and all(token["content"].startswith(_SPECIAL.decode()) for token in rules["added_tokens"])
    except (KeyError, TypeError, ValueError):
        known = False
    if not known:
        raise ValueError(f"{path} does not cut texts at white space after lower-casing them")
    return path


def pre_tokens(text: bytes | None) -> list[bytes]:
    """The pre-tokens of a text: its stretches without ASCII white space.

    The vocabulary's normaliser (NFC, white space, lower case), its special strings and
    its split pattern never reach across white space, so the ids of a text are the ids
    of its pre-tokens one after the other.
    """
    return text.split() if text else []


#: A comma or full stop before white space that does not follow an ASCII or Latin-1 letter or a digit.
_OTHER_STOP = re.compile(rb"[,.](?=[ \n])(?<![a-z0-9][,.])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][,.])").search
#: Words of lower-case ASCII letters pass normaliser and split pattern unchanged.
_PLAIN = re.compile(rb"[a-z]+").fullmatch
#: Special strings are matched before lower-casing.
_SPECIAL = b"<|"
_JOINED = 400


class IdCache:
    """Little-endian ids of pre-tokens, encoded once per worker while they stay in the cache."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.ids: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])

    def encode(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Every piece with its ids."""
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for piece in pieces:
            if _PLAIN(piece):
                yield piece, np.array([token.id for token in tokenize(piece.decode())], dtype="<u4").tobytes()
            else:
                rest.append(piece)
        texts = [p.decode("utf-8", "replace") for p in rest]
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        single = [i for i, t in enumerate(texts) if not t.isalpha()]
        # A word of letters ends in the only id with a word end, so words can be encoded together.
        for start in range(0, len(words), _JOINED):
            part = words[start : start + _JOINED]
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                yield from ((rest[i], a.tobytes()) for i, a in zip(part, np.split(ids, stops[:-1]), strict=True))
            else:
                single += part
        found = self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False)
        yield from ((rest[i], np.array(e.ids, dtype="<u4").tobytes()) for i, e in zip(single, found, strict=True))

    def text_ids(self, text: bytes | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if text and _SPECIAL not in text:
            text = text.lower()
            if not _OTHER_STOP(text):
                # Such a sign after a letter or digit is a pre-token of its own; this keeps the distinct ones few.
                text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" ,\n").replace(b".\n", b" .\n")
        pieces = pre_tokens(text)
        distinct = set(pieces)
        missing = distinct.difference(self.ids)
        if missing:
            if len(self.ids) > CACHE_ENTRIES:
                self.ids.clear()
                missing = distinct
            self.ids.update(self.encode(list(missing)))
        out = b"".join(map(self.ids.__getitem__, pieces))
        for piece in missing:
            if len(piece) > CACHE_BYTES:
                del self.ids[piece]
        return out


_CACHES: dict[str, IdCache] = {}


def id_cache(path: str) -> IdCache:
    """The cache of a worker process; it outlives a task."""
    if path not in _CACHES:
        _CACHES[path] = IdCache(path)
    return _CACHES[path]
