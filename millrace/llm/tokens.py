"""Token ids of whole texts, one encoder in each Python worker."""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The normal form and the split of the vocabulary file that piece-wise encoding stands for.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same split, for lower-cased Latin-1 text.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Texts with any of these go to the whole encoder: other scripts, separators that Python takes for blanks, special tokens.
_OTHER = re.compile("[^\x00-\x1b\x20-\xff]|<\\|")
_ENCODERS: dict[tuple[str, int], TokenEncoder] = {}


class TokenEncoder:
    """Encodes texts with a `tokenizers` file, add_special_tokens=False, and keeps the ids of pieces seen before.

    BPE works on one piece of the pre-tokenizer's split at a time, so a text's ids are those of its pieces in order
    and a piece met before costs a dictionary lookup. Latin-1 texts without special tokens (NFC leaves them as they
    are and each character has one lower-case form) are split here; all other texts, and vocabularies with another
    split, are encoded whole. `cache_bytes` bounds the dictionary; it is emptied when full, which changes no result.
    """

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        normal, split = said.get("normalizer") or {}, (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_piece = (
            [x["type"] for x in normal.get("normalizers", [])] == _NORMALIZERS
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": _SPLIT}
            and all(x["special"] and x["content"].startswith("<|") for x in said.get("added_tokens", []))
        )
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, cache_bytes

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        for k in range(0, len(pieces), 8192):
            part = pieces[k : k + 8192]
            got = self.pieces.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(got.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.asarray(got.word_ids), np.arange(len(part)), side="right") * 4
            start = 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.cache[piece] = ids[start:end]
                self.held += 2 * len(piece) + (end - start) + 190
                start = end

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        import numpy as np

        out: list[bytes] = []
        at = 0
        while at < len(texts):  # groups of about two million characters, so that new pieces are learnt together
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < 2_000_000):
                size += len(texts[stop])
                stop += 1
            split = [_PIECES.findall(t.lower()) if self.by_piece and not _OTHER.search(t) else None for t in texts[at:stop]]
            cache = self.cache
            self._learn([p for p in set().union(*(s for s in split if s)) if p not in cache])
            for text, found in zip(texts[at:stop], split, strict=True):
                if found is None:
                    out.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                else:
                    out.append(b"".join(map(cache.__getitem__, found)))
            if self.held > self.cache_bytes:
                self.cache, self.held = {}, 0
            at = stop
        return out


def encoder(path: str, cache_bytes: int = 96 << 20) -> TokenEncoder:
    """The worker's encoder for this file."""
    key = (path, cache_bytes)
    if key not in _ENCODERS:
        _ENCODERS[key] = TokenEncoder(path, cache_bytes)
    return _ENCODERS[key]
