"""Whole-text encoding with a public tokenizer, through a bounded cache of words.

The tokenizer lower-cases, drops white space and never joins characters across it, so a text's ids are the ids of
its space-separated words, one after another, in lower case.  It also starts anew where a letter is followed by
a mark, so a word's ids are those of the word without a mark at its end, and of the mark.  Each worker keeps up to
``CACHED_WORDS`` words, of which those met first stay for good, and encodes the others again; the cache bounds
memory only.  Texts that hold the beginning of a special token keep their case and are encoded word by word.

Another tokenizer need not be like that: what is assumed is tried on ``PROBES`` when an encoder is made, and if any of
them comes out otherwise, every text is encoded whole.

Words that are not cached go to the tokenizer many at a time.  If the vocabulary marks a word's last piece, words of
letters are parted by blanks and cut behind the marked pieces; where these are not as many as the words, and for
other words, special tokens part them; words that could form one are encoded alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 800_000
#: Longer words are encoded but not kept.
LONGEST_CACHED = 64
MARKS = frozenset(b".,;:!?|")
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
TOGETHER = 64
#: Texts on which word by word and whole encoding must agree.
PROBES = ("", "a", " lead  and trail ", "One, two; three.\nFOUR: five!\tsix? seven|", "don't we'll it's", "x=1 (y_2) [z-3] <b> http://a.b/c?d=e&f #tag @me 50% $9", "caf\u00e9 stra\u00dfe \u4f60\u597d \U0001f600 na\u00efve.", "a.b.c... wait-- what?! 1,000.50", "AbC dEf GHI", "tokenization Unbelievable antidisestablishmentarianism")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes UTF-8 texts to little-endian ids of ``width`` bytes (2 if the vocabulary allows it, else 4)."""

    def __init__(self, path: str | None = None, cached: int = CACHED_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.cached = cached
        self.words: dict[bytes, bytes] = {}
        # A special token may part words that are encoded together, as no word holds it.
        self.separator, self.separator_id = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)), (None, None))
        self.lower = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.ends = self._ends()
        self.whole = False
        self.whole = any(self.ids(t.encode()).tolist() != self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES)
        self.words.clear()

    def _ends(self) -> np.ndarray | None:
        """Which ids are a word's last piece, if the vocabulary marks them and any byte can be one."""
        from tokenizers import pre_tokenizers

        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(with_added_tokens=False)
        if not suffix or any(c + suffix not in vocab for c in pre_tokenizers.ByteLevel.alphabet()):
            return None
        ends = np.zeros(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()), bool)
        ends[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        return ends

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        out: list[bytes] = [b""] * len(texts)
        letters, others, alone = [], [], []
        for i, t in enumerate(texts):
            if self.ends is not None and t.isalpha():
                letters.append(i)
            elif self.separator is None or "<" in t:
                alone.append(i)
            else:
                others.append(i)
        for group, ids in self._together(letters, texts, " "):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                self._cut(out, group, ids, [0, *cuts.tolist()], 0)
            else:  # some word is more than one to the tokenizer
                (alone if self.separator is None else others).extend(group)
        for group, ids in self._together(others, texts, self.separator):
            cuts = np.flatnonzero(ids == self.separator_id) + 1
            if len(cuts) + 1 == len(group):
                self._cut(out, group, ids, [0, *cuts.tolist(), len(ids) + 1], 1)
            else:  # some word holds a special token
                alone += group
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _together(self, at: list[int], texts: list[str], between: str | None) -> Iterator[tuple[list[int], np.ndarray]]:
        """Groups of ``at`` and the ids of their texts joined; few are held at once."""
        groups = [at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)]
        for i in range(0, len(groups), TOGETHER):
            some = groups[i : i + TOGETHER]
            found = self.tokenizer.encode_batch_fast([between.join([texts[k] for k in g]) for g in some], add_special_tokens=False)
            for group, e in zip(some, found, strict=True):
                yield group, np.array(e.ids, self.dtype)

    def _cut(self, out: list[bytes], group: list[int], ids: np.ndarray, starts: list[int], between: int) -> None:
        raw, w = ids.tobytes(), self.width
        for i, a, b in zip(group, starts, starts[1:], strict=False):
            out[i] = raw[a * w : (b - between) * w]

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        known, marks, new = self.words, {}, []
        split: list[tuple[bytes, bytes, bytes]] = []
        for w in missing:
            if len(w) > 2 and w[-1] in MARKS and w[-2] in LETTERS:
                split.append((w, w[:-1], w[-1:]))
            else:
                new.append(w)
        if split:
            need = {s for _, s, _ in split if s not in known}.difference(new)
            new += need
            new += {m for _, _, m in split if m not in known}.difference(new)
        found = dict(zip(new, self._encoded(new), strict=True)) if new else {}
        for w, stem, mark in split:
            marks[w] = (found[stem] if stem in found else known[stem]) + (found[mark] if mark in found else known[mark])
        return found | marks

    def encode(self, text: bytes) -> bytes:
        if self.whole:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        if self.lower and b"<|" not in text:
            text = text.lower()
        words = text.split()  # ASCII white space only
        found = list(map(self.words.get, words))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            new = self._learn(list({words[i] for i in at}))
            for i in at:
                found[i] = new[words[i]]
            self._keep(new)
        return b"".join(found)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column, null as empty: every distinct word is looked up once."""
        if self.whole or not len(texts):
            return [self.encode(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        texts = texts.fill_null("")
        if self.lower:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.words.get, words))
        at = [i for i, x in enumerate(found) if x is None]
        if at:
            new = self._learn([words[i] for i in at])
            for i in at:
                found[i] = new[words[i]]
            self._keep(dict(islice(new.items(), self.cached // 2)))
        # In place of each word its ids; they lie one after another, as the words do.
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, starts, data = ids.buffers()
        cuts = np.frombuffer(starts, np.int64)[split.offsets.to_numpy()].tolist()
        raw = data.to_pybytes() if data is not None else b""
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _keep(self, new: dict[bytes, bytes]) -> None:
        if len(self.words) + len(new) > self.cached:
            self.words = dict(islice(self.words.items(), self.cached // 2))
        if len(new) <= self.cached // 2:
            self.words.update((w, x) for w, x in new.items() if len(w) <= LONGEST_CACHED)

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> WordEncoder:
    """The process's own encoder: its cache serves all tasks of a worker."""
    return WordEncoder(path)
