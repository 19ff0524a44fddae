"""Public tokenizer vocabularies, read from the folder that a parameter names and kept per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Folder of vocabulary files; the operators take it as a parameter.
DEFAULT_FOLDER = "/opt/tokenizers"
#: Pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Byte-level BPE by the tiktoken library: the fast way to token counts."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def encode(self, units: list[bytes]) -> list[list[int]]:
        """Token ids of each unit; bytes that are not UTF-8 become U+FFFD."""
        out: list[list[int]] = [[]] * len(units)
        many: list[int] = []
        for i, u in enumerate(units):
            if u[:1].isspace():
                many.append(i)
            else:
                out[i] = self.enc.encode_ordinary(u.decode("utf-8", "replace"))
        for lo in range(0, len(many), 20_000):
            part = many[lo : lo + 20_000]
            text = [units[i].decode("utf-8", "replace") for i in part]
            ids = self.enc.encode_ordinary("".join(text))
            ends = np.cumsum([len(t.encode()) for t in text])
            cut = [0, *(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()]
            for j, i in enumerate(part):
                out[i] = ids[cut[j] : cut[j + 1]]
        return out


class PieceBpe:
    """Piece vocabulary with byte fallback by the sentencepiece library; a unit is encoded without its white space."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(n)])
        self.starts = np.array([self.sp.id_to_piece(i).startswith("▁") for i in range(n)])

    def encode(self, units: list[bytes]) -> list[list[int]]:
        words = [u.decode("utf-8", "replace").strip() for u in units]
        out: list[list[int]] = [[]] * len(words)
        many = []
        for i, w in enumerate(words):
            if not w:
                continue
            if "▁" in w or any(map(str.isspace, w)):
                out[i] = self.sp.encode(w, num_threads=1)
            else:
                many.append(i)
        for lo in range(0, len(many), 20_000):
            part = many[lo : lo + 20_000]
            ids = self.sp.encode(" ".join(words[i] for i in part), num_threads=1)
            cut = np.flatnonzero(self.starts[ids]).tolist() + [len(ids)]
            if len(cut) != len(part) + 1:
                for i in part:
                    out[i] = self.sp.encode(words[i], num_threads=1)
            else:
                for j, i in enumerate(part):
                    out[i] = ids[cut[j] : cut[j + 1]]
        return out


@lru_cache(maxsize=8)
def byte_bpe(folder: str, name: str = "byte_bpe_50k.tiktoken") -> ByteBpe:
    return ByteBpe(os.path.join(folder, name))


@lru_cache(maxsize=8)
def piece_bpe(folder: str, name: str = "piece_bpe_32k.model") -> PieceBpe:
    return PieceBpe(os.path.join(folder, name))
