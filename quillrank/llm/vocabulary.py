"""Public token vocabularies, one encoder a worker process, shared by the operators that count or emit tokens."""

from __future__ import annotations

from collections.abc import Callable

_found: dict = {}


def encoder(name: str) -> Callable[[str], list[int]]:
    """text -> ids under the tiktoken file `name`, all of it ordinary text."""
    if name not in _found:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _found[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _found[name]


def added_tokens(name: str) -> dict[str, int]:
    """Strings that the tokenizer file `name` reads as one id wherever a text holds them."""
    if ("added", name) not in _found:
        import json

        import public_tokenizers

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            rows = json.load(f)["added_tokens"]
        if any(r["single_word"] or r["lstrip"] or r["rstrip"] for r in rows):
            raise ValueError(f"{name}: added tokens that take in their surroundings are not supported")
        _found["added", name] = {r["content"]: r["id"] for r in rows}
    return _found["added", name]
