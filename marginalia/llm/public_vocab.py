"""Public vocabularies, read from files whose paths are parameters."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers


def default_path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def rank_file(path: str) -> dict[bytes, int]:
    """Byte-level vocabulary: token bytes -> rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def piece_model(path: str):
    """A sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], frozenset[int]]:
    """Text pieces of a sentencepiece model with their ids, and the ids of byte pieces."""
    model = piece_model(path)
    text, byte = {}, set()
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte.add(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text[model.id_to_piece(i)] = i
    return text, frozenset(byte)
