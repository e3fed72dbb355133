"""Word-level memo in front of the tokenizers library.

Both BPE files isolate pre-tokens with a regex in which no match holds a non-space character
followed by white space. A text may therefore be cut before any white-space run that follows a
non-space character, and the token ids of the parts, put one after the other, are those of the
whole. Distinct parts are encoded once by the library and kept in a bounded memo.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .shingles import LONG, blocks_of, windows, word_bounds, word_hashes

#: The characters of Unicode's White_Space property, as the library's \s has them.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Segments beyond this length are encoded but not kept.
LONGEST_KEPT = 80


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LengthMemo:
    """Token counts of segments of at most LONGEST_KEPT characters; a memo of more than `most_bytes` bytes starts anew."""

    #: Bytes of an entry besides its characters, about: its slot, the string's head, a part of a shared number.
    ENTRY = 150

    def __init__(self, path: str, most_bytes: int = 48 << 20):
        self.tokenizer, self.most_bytes, self.known, self.held = load(path), most_bytes, {}, 0

    def lengths(self, texts: list[str]) -> list[int]:
        parts = [SEGMENT.findall(t) for t in texts]
        known = self.known
        missing = list({x for x in chain.from_iterable(parts) if x not in known})
        extra: dict[str, int] = {}
        for lo in range(0, len(missing), 20_000):
            block = missing[lo : lo + 20_000]
            for key, got in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False), strict=True):
                extra[key] = len(got)
        short = {k: v for k, v in extra.items() if len(k) <= LONGEST_KEPT}
        cost = sum(self.ENTRY + len(k) for k in short)
        if self.held + cost > self.most_bytes:
            extra |= {x: known[x] for x in set(chain.from_iterable(parts)) if x not in extra}
            known.clear()
            self.held = 0
        known.update(short)
        self.held += cost
        get = lambda x: extra[x] if x in extra else known[x]
        return [sum(map(get, p)) for p in parts] if extra else [sum(map(known.__getitem__, p)) for p in parts]


class WordPieces:
    """Token ids for a lower-casing word-level BPE whose pre-tokens are letter runs, single digits and symbol runs.

    Texts of plain characters (ASCII and precomposed Latin letters, where lower-casing and NFC are the
    same in Python and in the library) are cut into exactly those pre-tokens here; any other segment
    goes to the library as it stands. Both ways every id comes from the library. Words of up to LONG bytes are
    looked up by a 64-bit hash and compared byte by byte with the known word of that hash; should two differ, the library
    encodes the word. Longer words are not kept. Words and the pieces that they are cut into have a memo each, which holds
    about `most_bytes` bytes at most and then starts anew.
    """

    #: Letters that NFC leaves alone and whose lower case is one letter of the same set.
    LETTERS = "a-zß-öø-ÿ"
    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
    #: Words learned in one go, and bytes of a known piece besides its characters and ids, about.
    GO = 20_000
    ENTRY = 150

    def __init__(self, path: str, most_bytes: int = 40 << 20):
        self.tokenizer, self.most_bytes = load(path), most_bytes
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[0-9]|[^\\s{self.LETTERS}0-9]+")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        #: 64-bit hashes of the known words, rising, and their places: ids[begins[place] : begins[place + 1]] are a
        #: word's ids, text[starts[place] : starts[place + 1]] its bytes.
        self.known, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.starts, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def held(self) -> int:
        """Bytes of the memo."""
        return 32 * len(self.known) + self.ids.nbytes + self.text.nbytes

    def _library(self, block: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(block, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> list[bytes]:
        """Ids of lower-cased plain words without white space."""
        cuts = list(map(self.cut.findall, words))
        if self.ENTRY * len(self.pieces) > self.most_bytes:
            self.pieces.clear()
        missing = list(set(chain.from_iterable(cuts)).difference(self.pieces))
        self.pieces.update(zip(missing, self._library(missing), strict=True))
        coded = [b"".join(map(self.pieces.__getitem__, c)) for c in cuts]
        for piece in missing:
            if len(piece) > LONG:
                del self.pieces[piece]
        return coded

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Add words, in rising order of their hashes."""
        coded = [c for lo in range(0, len(words), self.GO) for c in self._coded([w.decode() for w in words[lo : lo + self.GO]])]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(words), np.uint8)])
        for name, sizes in (("begins", np.fromiter(map(len, coded), np.int64, len(coded)) // 4), ("starts", np.fromiter(map(len, words), np.int64, len(words)))):
            ends = getattr(self, name)
            setattr(self, name, np.concatenate([ends, ends[-1] + np.cumsum(sizes)]))
        at = np.searchsorted(self.known, hashes)
        self.places = np.insert(self.places, at, len(self.places) + np.arange(len(words)))
        self.known = np.insert(self.known, at, hashes)

    def _same(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each word of data has the bytes of the known word at its place."""
        here, at = windows(data), self.starts[place]
        own = windows(self.text)
        same = self.starts[place + 1] - at == size
        left = np.flatnonzero(same)
        k = 0
        while len(left):
            equal = blocks_of(here, begin[left], size[left], k) == blocks_of(own, at[left], size[left], k)
            same[left[~equal]] = False
            k += 1
            left = left[equal & (size[left] > 8 * k)]
        return same

    def _plain(self, texts: list[str]) -> list[bytes]:
        coded = [t.lower().encode() for t in texts]
        raw = b"".join(coded)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in coded])])
        begin, end = word_bounds(data, offsets)  # white space of plain texts is ASCII
        size = end - begin
        short = np.flatnonzero(size <= LONG)
        kinds, first, which = np.unique(word_hashes(data, begin[short], end[short]), return_index=True, return_inverse=True)
        if self.held() > self.most_bytes:
            self._forget()
        place = np.searchsorted(self.known, kinds)
        fresh = np.flatnonzero((place == len(self.known)) | (self.known[np.minimum(place, len(self.known) - 1)] != kinds)) if len(self.known) else np.arange(len(kinds))
        if len(fresh):
            self._learn([raw[b:e] for b, e in zip(begin[short[first[fresh]]].tolist(), end[short[first[fresh]]].tolist(), strict=True)], kinds[fresh])
            place = np.searchsorted(self.known, kinds)
        at = self.places[place][which]
        sound = self._same(data, begin[short], size[short], at)
        begins = self.begins[at]
        n = np.zeros(len(begin), np.int64)
        n[short] = self.begins[at + 1] - begins
        plain = np.zeros(len(begin), bool)
        plain[short] = sound
        odd = np.flatnonzero(~plain)  # long words, and any whose hash is another word's
        parts = self._coded([raw[b:e].decode() for b, e in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)]) if len(odd) else []
        n[odd] = [len(p) // 4 for p in parts]
        ends = np.cumsum(n)
        flat = np.empty(ends[-1] if len(ends) else 0, "<u4")
        good = short[sound]
        source, target, count = begins[sound], ends[good] - n[good], n[good]
        stretch = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat[np.repeat(target, count) + stretch] = self.ids[np.repeat(source, count) + stretch]
        for i, p in zip(odd.tolist(), parts, strict=True):
            flat[ends[i] - n[i] : ends[i]] = np.frombuffer(p, "<u4")
        cuts = np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]
        return [flat[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [bool(self.PLAIN.match(t)) and not ("<|" in t and any(s in t for s in self.special)) for t in texts]
        own = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        out = []
        for t, p in zip(texts, plain, strict=True):
            if p:
                out.append(next(own))
                continue
            parts = SEGMENT.findall(t)
            kinds = list(set(parts))
            known = dict(zip(kinds, self._library(kinds), strict=True))
            out.append(b"".join(map(known.__getitem__, parts)))
        return out
