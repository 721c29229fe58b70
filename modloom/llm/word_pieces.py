"""Ids of texts under a tokenizers file whose pre-tokenizer drops white space, by way of a bounded cache of words.

The pieces of such a tokenizer never cross ASCII white space, so a text's ids are its words' ids in a row. Each distinct
word is encoded by the library once per cache; a text that holds the start of a special string ("<|") goes to the library
as a whole, as special strings are matched before anything else.
"""

from __future__ import annotations

import os
import numpy as np

from .common import held

#: ASCII punctuation that forms one run of its own after a letter or digit (no apostrophe: that may bind letters).
TAIL = '.,!?;:%$&*#"()[]{}+=/\\|~^@`'
#: Entries kept before the cache starts anew; about 220 bytes each.
MAX_ENTRIES = 1_200_000


def encoder(path: str, operator: str) -> "WordEncoder":
    """One encoder per Python worker, operator and file."""
    encoders = held(operator)
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


class WordEncoder:
    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        if not (steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")):
            raise ValueError("this encoder needs a pre-tokenizer that drops white space")
        self.folds = "Lowercase" in str(spec.get("normalizer"))
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.special = tuple(t["content"][:2] for t in spec.get("added_tokens", ()))
        self.max_entries = max_entries
        self.cache: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        """Ids of a text straight from the library, as little-endian unsigned 32-bit integers."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """The words whose ids in a row are the text's; None for a text that may hold a special string."""
        if any(s in text for s in self.special):
            return None
        if self.folds:
            text = text.encode().lower().decode()  # ASCII letters only; the library folds the rest
        return text.replace("\n", " ").split(" ")

    def _cores(self, cores: set[str]) -> dict[str, bytes]:
        got = {c: self.cache[c] for c in cores if c in self.cache}
        plain = [c for c in cores if c not in got and c.isalpha()]
        rest = [c for c in cores if c not in got and not c.isalpha()]
        for i in range(0, len(plain), 2000):
            block = plain[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(block), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(block) and (not len(block) or stops[-1] == len(ids)):
                raw, a = ids.tobytes(), 0
                for c, b in zip(block, (stops * 4).tolist(), strict=True):
                    got[c] = raw[a:b]
                    a = b
            else:
                rest += block
        for i in range(0, len(rest), 2000):
            block = rest[i : i + 2000]
            for c, e in zip(block, self.tokenizer.encode_batch(block, add_special_tokens=False), strict=True):
                got[c] = np.asarray(e.ids, "<u4").tobytes()
        return got

    def learn(self, new: set[str]) -> None:
        """Add words that the cache lacks."""
        parts: list[tuple[str, str, str]] = []
        cores: set[str] = set()
        for w in new:
            core = w.rstrip(TAIL)
            # the tail is a piece of its own only after a letter or digit that no normaliser turns into something else
            if core == w or not core or not (core[-1].isalnum() and (core[-1].isascii() or "à" <= core[-1] <= "ÿ")):
                cores.add(w)
            else:
                parts.append((w, core, w[len(core) :]))
                cores.add(core)
                cores.add(parts[-1][2])
        got = self._cores(cores)
        self.cache.update(got)
        self.cache.update([(w, got[core] + got[tail]) for w, core, tail in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the words of all of them are learnt together."""
        cut = [self.words(t) for t in texts]
        distinct: set[str] = set()
        for words in cut:
            if words is not None:
                distinct.update(words)
        if len(self.cache) > self.max_entries:
            self.cache = {"": b""}
        self.learn(distinct.difference(self.cache))
        find = self.cache.__getitem__
        return [self.whole(t) if words is None else b"".join(map(find, words)) for t, words in zip(texts, cut, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0]
