"""Token identifiers of whole texts by a public word-end BPE, computed for a batch at once.

The tokenizer file is read with the `tokenizers` library and stays the authority. What is sped up is only repetition:
the pre-tokens of a batch are found and hashed as byte spans, each distinct pre-token is given to the library once
(a running cache per worker process), and the identifiers are laid out again by index. Rows that the byte scan does not
cover (characters above U+00FF, the strings of special tokens, broken UTF-8) go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from loomgraph.llm.common import LOWER, slices_by_bytes, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pre-tokens kept per worker process; beyond it the cache starts anew (only speed depends on it).
CACHE_WORDS = 3_000_000
#: Bytes of text scanned at a time; the scan's arrays take some 30 times as many.
SCAN_BYTES = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LETTER, _NUMBER, _OTHER, _BLANK = 1, 2, 3, 0


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each ASCII byte, and of the second byte of two-byte characters led by 0xC2 and by 0xC3."""
    import regex

    kinds = np.full(256, _OTHER, np.uint8)
    for code in range(256):
        c = chr(code)
        if regex.fullmatch(r"\p{L}", c):
            kinds[code] = _LETTER
        elif regex.fullmatch(r"\p{N}", c):
            kinds[code] = _NUMBER
        elif regex.fullmatch(r"\p{White_Space}", c):
            kinds[code] = _BLANK
    ascii_, c2, c3 = np.full(256, _OTHER, np.uint8), np.full(256, _OTHER, np.uint8), np.full(256, _OTHER, np.uint8)
    ascii_[:128] = kinds[:128]
    c2[0x80:0xC0], c3[0x80:0xC0] = kinds[0x80:0xC0], kinds[0xC0:0x100]
    return ascii_, c2, c3


class WordTokenizer:
    """encode(raw, offsets) gives the identifiers of all rows end to end and the rows' offsets in them."""

    _made: dict[tuple[str, bool], "WordTokenizer"] = {}

    @classmethod
    def at(cls, path: str, literal: bool = False) -> "WordTokenizer":
        """The worker process's tokenizer of that file; literal: strings of special tokens in a text are ordinary text."""
        if (path, literal) not in cls._made:
            cls._made[path, literal] = cls(path, literal)
        return cls._made[path, literal]

    def __init__(self, path: str, literal: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = literal
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for word, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.ends[i] = word.endswith("</w>")
        self.ascii, self.c2, self.c3 = _classes()
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at_ = np.zeros(0, np.int64)  # where the word's identifiers start in self.ids
        self.len_ = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32)

    def _spans(self, raw: np.ndarray, offsets: np.ndarray):
        """Lower-cased bytes, spans of pre-tokens, the rows' offsets in them, and the rows to be left to the library."""
        kind = self.ascii[raw]
        low = LOWER[raw]
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
        join = np.zeros(len(raw), bool)
        if len(lead):
            lead = lead[lead + 1 < len(raw)]
            after, three = raw[lead + 1], raw[lead] == 0xC3
            k = np.where(three, self.c3[after], self.c2[after])
            kind[lead] = k
            kind[lead + 1] = k
            join[lead + 1] = True
            up = three & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
            low[lead[up] + 1] += 0x20
        high = np.flatnonzero(raw >= 0x80)
        starts_row = lambda at: offsets[np.minimum(np.searchsorted(offsets, at), len(offsets) - 1)] == at
        second, led = (raw[high] < 0xC0), (raw[np.maximum(high - 1, 0)] >> 1) == 0x61  # 0xC2 or 0xC3 before it
        followed = (raw[np.minimum(high + 1, len(raw) - 1)] & 0xC0) == 0x80
        fine = np.where(second, led & ~starts_row(high), followed & ~starts_row(high + 1))
        odd = high[(raw[high] >= 0xC4) | ~fine]
        pipe = np.flatnonzero(raw == 0x7C)
        pipe = pipe[pipe > 0]
        odd = np.concatenate([odd, pipe[raw[pipe - 1] == 0x3C]])
        slow = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        first = np.empty(len(raw), bool)
        if len(raw):
            first[0] = True
            first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
            first &= ~join
            edge = offsets[1:-1]
            first[edge[edge < len(raw)]] = True
        self._contractions(low, kind, offsets, first)
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(raw))
        keep = kind[begin] != _BLANK
        begin, end = begin[keep], end[keep]
        return low, begin, end, np.searchsorted(begin, offsets), slow

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> None:
        """Let 's 't 're 've 'm 'll 'd be pre-tokens of their own where a pre-token starts with the apostrophe."""
        at = np.flatnonzero(low == 0x27)
        at = at[first[at]]
        if not len(at):
            return
        stop = offsets[np.searchsorted(offsets, at, "right")]  # the row's end
        one, two = low[np.minimum(at + 1, len(low) - 1)], low[np.minimum(at + 2, len(low) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (at + 2 <= stop)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        length = np.where(short, 1, np.where(pair & (at + 3 <= stop), 2, 0))
        first[at[length > 0] + 1] = False
        first[at[length > 1] + 2] = False
        after = (at + 1 + length)[length > 0]
        first[after[after < len(first)]] = True

    def _learn(self, low: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Have the library tokenize words not seen before, all in a few calls, and add them to the cache."""
        data = low.tobytes()
        words = [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        parts = [b" ".join(words[i : i + 4096]).decode("utf-8") for i in range(0, len(words), 4096)]
        got = self.tok.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, self.ids.dtype) for x in got])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            raise ValueError("a pre-token did not end with an end-of-word piece")
        start = np.concatenate([[0], stop[:-1]])
        self.keys = np.concatenate([self.keys, keys])
        self.at_ = np.concatenate([self.at_, start + len(self.ids)])
        self.len_ = np.concatenate([self.len_, stop - start])
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at_, self.len_ = self.keys[order], self.at_[order], self.len_[order]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _encode_some(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, begin, end, rows, slow = self._spans(raw, offsets)
        if len(slow):
            keep = np.ones(len(begin), bool)
            for r in slow:
                keep[rows[r] : rows[r + 1]] = False
            kept = np.concatenate([[0], np.cumsum(keep)])
            begin, end, rows = begin[keep], end[keep], kept[rows]
        keys, where, back = np.unique(span_hashes(low, begin, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.reset()
        at, known = self._find(keys)
        if not known.all():
            new = where[~known]
            self._learn(low, keys[~known], begin[new], end[new])
            at, _ = self._find(keys)
        n = self.len_[at][back]
        stop = np.cumsum(n)
        place = np.repeat(self.at_[at][back] - np.concatenate([[0], stop[:-1]]) if len(n) else n, n)
        ids = self.ids[place + np.arange(len(place))] if len(place) else np.zeros(0, self.ids.dtype)
        offs = np.concatenate([[0], stop])[rows]
        if not len(slow):
            return ids, offs
        texts = [raw[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in slow]
        whole = dict(zip(slow.tolist(), (np.asarray(x.ids, ids.dtype) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False))))
        each = [whole[r] if r in whole else ids[offs[r] : offs[r + 1]] for r in range(len(offsets) - 1)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        """Yield (first row, last row, identifiers, offsets) for runs of rows of bounded size."""
        for lo, hi in slices_by_bytes(offsets, SCAN_BYTES):
            a, b = offsets[lo], offsets[hi]
            ids, offs = self._encode_some(raw[a:b], offsets[lo : hi + 1] - a)
            yield lo, hi, ids, offs
