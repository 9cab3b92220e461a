"""Token ids by a tokenizer file, as little-endian unsigned 32-bit bytes.

``tokenizers`` defines the ids. Where the file is a byte-level BPE whose ids are its merge ranks, the
same ranks are given to ``tiktoken``, which is several times as fast; its ids are compared with those
of ``tokenizers`` when the encoder is made, and texts that it refuses or that hold an added token of
the file, such as ``<|endoftext|>``, go to ``tokenizers``.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

#: The pre-tokenizer pattern of byte-level BPE files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ("It's  a test,\n\n 12 + 345 äöü ¿qué? \t x<|endoftex|>", " a b ", "", "日本語 emoji 🙂!!", "x" * 600 + " y")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type", "BPE") != "BPE":
        return None
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    for n, merge in enumerate(model["merges"]):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        if model["vocab"].get("".join(pair)) != n + 256:
            return None
    return {t: i for t, i in ranks.items() if i < 256 + len(model["merges"])}


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.vocabulary = self.tool.get_vocab_size()
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        ranks = _ranks(spec)
        if ranks:
            import tiktoken

            twin = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            if all(twin.encode_ordinary(t) == self.tool.encode(t, add_special_tokens=False).ids for t in _PROBES):
                self.fast = twin

    def whole(self, text: str) -> bytes:
        return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
            except Exception:
                return self.whole(text)
        return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
