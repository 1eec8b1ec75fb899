"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from kindred.llm.words import HEAD, SPACE, U, eights, padded, same_bytes, text_bytes, word_hashes
from kindred.shared import KEPT, trim


def public_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies; everywhere else its path is a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words kept with their ids in each Python worker (at most 2**SLOT_BITS places hold them); beyond, those met least often are forgotten.
CACHED_WORDS, SLOT_BITS = 350_000, 20
#: Bytes of words that are kept; beyond, words are forgotten likewise.
CACHED_BYTES = 16 << 20
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 18
#: Stands between words that are encoded together; words with it are encoded alone.
MARK = "`"
#: Words of ASCII and Latin-1 letters, in lower case alone and with the capitals that are left.
_BARE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), [ord("."), ord(",")])


class Slots:
    """Numbers of keys, by open addressing, many at once; checks beside the keys tell most words of one key apart."""

    def __init__(self, bits: int):
        self.mask = U((1 << bits) - 1)
        self.keys, self.checks, self.values = np.zeros(1 << bits, dtype=U), np.zeros(1 << bits, dtype=U), np.full(1 << bits, -1, dtype=np.int32)
        self.probes = 1

    def add(self, keys: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = (keys[left] + U(probe)) & self.mask
            free = np.flatnonzero(self.values[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = left[free[one]]
            at = slot[free[one]]
            self.keys[at], self.checks[at], self.values[at] = keys[won], checks[won], values[won]
            keep = np.ones(len(left), dtype=bool)
            keep[free[one]] = False
            left, probe = left[keep], probe + 1
        self.probes = max(self.probes, probe)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        out = self.values[slot].astype(np.int64)
        miss = (self.keys[slot] != keys) | (self.checks[slot] != checks)
        open_ = np.flatnonzero(miss & (out >= 0))
        out[miss] = -1
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = (keys[open_] + U(probe)) & self.mask
            value = self.values[slot]
            hit = (self.keys[slot] == keys[open_]) & (self.checks[slot] == checks[open_]) & (value >= 0)
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value >= 0)]
        return out


class Encoder:
    """Ids of texts under a tokenizer that lower-cases and whose tokens never cross white space.

    That holds where the file's normaliser and pre-tokenizer only look within runs of non-space
    characters (as in word_bpe_49k.json, whose white space is dropped), so a text's ids are its
    words' ids in order, and each word needs the tokenizers library only once a cache. A full stop
    or comma after a letter and before white space is a word of its own to the tokenizer; cut so,
    words repeat more often. A word that the cache finds is compared with its bytes there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._ids(MARK)
        self.mark, self._mark_bytes = int(mark[0]) if len(mark) == 1 else None, MARK.encode()
        vocab = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[k for w, k in vocab.items() if w.endswith(suffix)]] = True
        self.fast = self._letters_only(Tokenizer) if suffix else None
        self._reset()
        del vocab
        trim()  # what reading the file left behind

    def _letters_only(self, kind):
        """The same model for words of _BARE between spaces, which the known normalisers and pre-tokenizers leave as they are."""
        spec = json.loads(self.tokenizer.to_str())
        steps = lambda part, inner: [x["type"] for x in (spec[part] or {}).get(inner, [spec[part]] if spec[part] else [])]
        if not (set(steps("normalizer", "normalizers")) <= {"NFC", "Replace", "Lowercase"} and steps("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]):
            return None
        return kind.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}, "added_tokens": [], "post_processor": None}))

    def _ids(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _reset(self) -> None:
        self.slots, self.known = Slots(SLOT_BITS), 0
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.text, self.written = np.zeros(1 << 16, dtype=np.uint8), 0  # the bytes of all words, one after the other
        self.begin, self.size, self.hits, self.at, self.wide = (np.zeros(1 << 14, dtype=np.int32) for _ in range(5))

    def _store(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, place: np.ndarray, sizes: np.ndarray, low: np.ndarray, at: np.ndarray, wide: np.ndarray, hits: int = 0) -> None:
        """Add words with their ids (``sizes`` from ``place`` of ``ids`` on) and their bytes (``wide`` from ``at`` of ``low`` on)."""
        n, ends = self.known + len(keys), np.cumsum(wide)
        grow = lambda x, least: x if least <= len(x) else np.concatenate([x, np.zeros(max(len(x), least - len(x)), dtype=x.dtype)])
        total = int(ends[-1]) if len(ends) else 0
        self.flat, self.text = grow(self.flat, self.used + len(ids)), grow(self.text, self.written + total + 8)
        self.begin, self.size, self.hits, self.at, self.wide = (grow(x, n) for x in (self.begin, self.size, self.hits, self.at, self.wide))
        self.flat[self.used : self.used + len(ids)] = ids
        self.text[self.written : self.written + total] = low[np.arange(total) + np.repeat(at - (ends - wide), wide)]
        new = slice(self.known, n)
        self.begin[new], self.size[new], self.hits[new], self.at[new], self.wide[new] = self.used + place, sizes, hits, self.written + ends - wide, wide
        self.slots.add(keys, checks, np.arange(self.known, n, dtype=np.int32))
        self.known, self.used, self.written = n, self.used + len(ids), self.written + total

    def _shrink(self) -> None:
        """Forget the words that were met least often, and of words that are long all but the most frequent ones."""
        hits, least = self.hits[: self.known], 2
        while (often := hits >= least).any() and (np.count_nonzero(often) > CACHED_WORDS // 2 or int(self.wide[: self.known][often].sum(dtype=np.int64)) > CACHED_BYTES // 2):
            least += 1
        keep = np.flatnonzero(often)
        number, slot = np.unique(self.slots.values, return_index=True)
        slot = slot[np.searchsorted(number, keep)]
        keys, checks = self.slots.keys[slot], self.slots.checks[slot]
        begin, size, flat, text, at, wide = self.begin[keep].astype(np.int64), self.size[keep].astype(np.int64), self.flat, self.text, self.at[keep].astype(np.int64), self.wide[keep].astype(np.int64)
        self._reset()
        if len(keep):
            place = np.cumsum(size) - size
            self._store(keys, checks, flat[np.arange(int(size.sum())) + np.repeat(begin - place, size)], place, size, text, at, wide, 1)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words, where each word's begin, and how many they are."""
        # Words of Latin letters are one piece to the tokenizer, so they end where a token ends a word.
        every = lambda p, some: np.fromiter((k and p.fullmatch(w) is not None for w, k in zip(words, some.tolist(), strict=True)), dtype=bool, count=len(words))
        bare = every(_BARE, np.full(len(words), self.fast is not None))
        plain = every(_PLAIN, ~bare & (self.ends is not None))
        marked = ~plain & ~bare & np.fromiter((self.mark is not None and self._mark_bytes not in w and b"<|" not in w for w in words), dtype=bool, count=len(words))
        text = [w.decode("utf-8", "surrogatepass") for w in words]
        sizes, place = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        pieces, at = [np.zeros(0, dtype=np.uint32)], 0
        for which, glue, by in ((bare, " ", self.fast), (plain, " ", None), (marked, f" {MARK} ", None)):
            if which.any():
                ids = self._ids(glue.join(itertools.compress(text, which)), by)
                if glue == " ":
                    stops = np.flatnonzero(self.ends[ids]) + 1
                else:
                    marks = np.flatnonzero(ids == self.mark)
                    stops = np.append(marks - np.arange(len(marks)), len(ids) - len(marks))
                    ids = np.delete(ids, marks)
                sizes[which] = np.diff(stops, prepend=0)
                place[which] = at + stops - sizes[which]
                pieces.append(ids)
                at += len(ids)
        for k in np.flatnonzero(~bare & ~plain & ~marked):
            pieces.append(self._ids(text[k]))
            sizes[k], place[k] = len(pieces[-1]), at
            at += len(pieces[-1])
        return np.concatenate(pieces), place, sizes

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit numbers; null is empty."""
        raw, at = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        out: list[np.ndarray] = []
        begin = 0
        while begin < len(at) - 1:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + AT_ONCE, "right")) - 1)
            out += self._encode(raw[at[begin] : at[end]], at[begin : end + 1] - at[begin])
            begin = end
        return out

    def _encode(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        if not len(raw):
            return [np.zeros(0, dtype=np.uint32)] * (len(at) - 1)
        if self.known > CACHED_WORDS or self.written > CACHED_BYTES:
            self._shrink()
        solid = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)  # before a byte: another word or text begins
        edge[at[at < len(raw)]] = True
        edge[1:-1] |= solid[1:] != solid[:-1]
        edge[0] = edge[-1] = True
        stop = np.flatnonzero(_STOP[raw])
        stop = stop[(stop > 0)]
        stop = stop[_LETTER[raw[stop - 1]] & edge[stop + 1] & ~edge[stop]]
        edge[stop] = True
        cuts = np.flatnonzero(edge)
        word = solid[cuts[:-1]]
        starts, ends = cuts[:-1][word], cuts[1:][word]
        first = np.searchsorted(starts, at)
        keys = word_hashes(raw, starts, ends)
        # Most words of one hash are told apart by their length and their first seven bytes; the rest below.
        low, length = padded(raw), ends - starts
        checks = (eights(low)[starts] & HEAD[np.minimum(length, 7)]) | (length.astype(U) << U(56))
        place = self.slots.find(keys, checks)
        alone = np.zeros(len(place), dtype=bool)  # words that are encoded alone
        angle = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        if len(angle):  # names of special tokens are told from other text by their case: such words are encoded as they stand
            alone[np.searchsorted(starts, angle, "right") - 1] = True
        had = np.flatnonzero(place >= 0)
        sized = self.wide[place[had]] == length[had]
        alone[had[~sized]] = True
        had = had[sized & (length[had] > 7)]
        alone[had[~same_bytes(low, starts[had], self.text, self.at[place[had]].astype(np.int64), length[had])]] = True
        place[alone] = 0
        new = np.flatnonzero(place < 0)
        if len(new):
            _, one, back = np.unique(keys[new], return_index=True, return_inverse=True)
            picked = new[one]
            first_of = picked[back]
            equal = length[first_of] == length[new]
            equal[equal] = same_bytes(low, starts[new[equal]], low, starts[first_of[equal]], length[new[equal]])
            low_bytes = low.tobytes()
            ids, where, sizes = self._encode_words([low_bytes[a:b] for a, b in zip(starts[picked].tolist(), ends[picked].tolist(), strict=True)])
            place[new] = self.known + back
            alone[new[~equal]] = True
            self._store(keys[picked], checks[picked], ids, where, sizes, low, starts[picked], length[picked])
        own = np.flatnonzero(alone)
        place[own] = 0
        begin, size, flat = self.begin, self.size, self.flat
        self.hits[: self.known] += np.bincount(place, minlength=self.known)[: self.known] if self.known else 0
        if len(own):
            exact = raw.tobytes()
            ids, where, sizes = self._encode_words([exact[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            place[own] = self.known + np.arange(len(own))
            begin, size, flat = np.concatenate([begin[: self.known], self.used + where]), np.concatenate([size[: self.known], sizes]), np.concatenate([flat[: self.used], ids])
        n = size[place].astype(np.int64)
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        ids = flat[np.arange(total) + np.repeat(begin[place] - (stops - n), n)]
        return np.split(ids, np.concatenate([[0], stops])[first[1:-1]])


#: The use of tasks that encode, as tidy() has it.
USE = "encoder"


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker, as long as the worker's tasks encode."""
    held = KEPT.setdefault(USE, {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
