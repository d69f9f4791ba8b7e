"""Token ids of whole texts, by the tokenizers library, with a bounded cache of encoded segments.

A batch of texts is cut into segments where both vocabularies cut anyway, so the joined ids equal those of the whole
text; the library encodes each distinct segment that the cache lacks. Cutting, hashing and joining are vectorised.

* byte-level BPE puts a space in front of the word that follows it. Cuts before a space, around a line feed, and between
  an ASCII letter or digit and one full stop or comma that ends a word are exact where no white space has other white
  space beside it and none begins or ends the text; other texts are encoded whole.
* the word BPE drops white space and lower-cases, so cuts at spaces and line feeds are exact everywhere, and those before
  such a full stop or comma, too.

A text that contains an added token of the vocabulary (such as the end of a text) is encoded whole: the library's default
takes it for that token.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from merganser.llm.hashing import distinct

#: Segments of the newer generation that a worker keeps with their ids; then it becomes the older one, which is dropped
#: in turn. A bound on memory: at most twice as many are held, and none that are longer than LONGEST bytes.
CACHE = 400_000
LONGEST = 64

_BESIDE = re.compile(r"\s\s|\A\s|\s\Z")
_BLANKS, _BLANKS_AND_BAR = re.compile(r"\s"), re.compile(r"[\s|]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lead bytes and second bytes of the white space outside ASCII; a text with such a pair is looked at more closely.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SECOND = np.zeros(256, bool)
_SECOND[[0x80, 0x81, 0x85, 0x9A, 0xA0]] = True


class Encoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str, spaces: str = "kept"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        #: The library takes these for one id wherever they stand: a text that has one is encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = spaces == "kept"
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment. Ordinary ones are encoded in rows, between separators that neither vocabulary merges with
        anything: a row costs the library half as much as its segments one by one."""
        separator, forbidden = ("\n", _BLANKS) if self.kept else (" | ", _BLANKS_AND_BAR)
        (mark,) = self.tokenizer.encode(separator, add_special_tokens=False).ids
        out: list[bytes | None] = [None] * len(segments)
        # a leading space belongs to the segment
        plain = [i for i, s in enumerate(segments) if len(s) > 1 and not forbidden.search(s, s[0] == " ")]
        rows = [plain[k : k + 64] for k in range(0, len(plain), 64)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([separator.join([segments[i] for i in r]) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == mark).tolist()
            if len(at) == len(row) - 1:
                raw = ids.tobytes()
                for i, a, b in zip(row, [0, *[k + 1 for k in at]], [*at, len(ids)], strict=True):
                    out[i] = raw[4 * a : 4 * b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.whole([segments[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the segments of texts that are separated by line feeds; a separator is one, too, if kept."""
        feed, blank = data == 10, data == 32
        if not self.kept:
            gap = feed | blank
            edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
            edges = np.concatenate([[0], edge, [len(data)]])
            solid = ~gap[edges[:-1]]
            starts, ends = edges[:-1][solid], edges[1:][solid]
            stop = (ends - starts > 1) & _STOP[data[ends - 1]] & _WORD[data[ends - 2]]
            order = np.argsort(np.concatenate([starts, ends[stop] - 1]), kind="stable")
            return np.concatenate([starts, ends[stop] - 1])[order], np.concatenate([ends - stop, ends[stop]])[order]
        start = feed | blank
        start[0] = True
        start[1:] |= feed[:-1]
        start[1:-1] |= _STOP[data[1:-1]] & _WORD[data[:-2]] & (feed[2:] | blank[2:])
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(data))

    def _ids(self, segments: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        out = [cache.get(s) for s in segments]
        unknown = []
        for i, ids in enumerate(out):
            if ids is None:
                s = segments[i]
                ids = older.get(s)
                if ids is None:
                    unknown.append(i)
                else:
                    cache[s] = out[i] = ids
        for i, ids in zip(unknown, self.apart([segments[i].decode() for i in unknown]), strict=True):
            out[i] = ids
            if len(segments[i]) <= LONGEST:
                cache[segments[i]] = ids
        return out

    def _odd(self, data: np.ndarray, bounds: np.ndarray, texts: list[str]) -> np.ndarray:
        """Texts that have to be encoded whole."""
        space = _SPACE[data]
        doubtful = np.zeros(len(data), bool)
        doubtful[1:] = space[1:] & space[:-1]
        doubtful[1:] |= _LEAD[data[:-1]] & _SECOND[data[1:]]
        at = np.unique(np.searchsorted(bounds, np.flatnonzero(doubtful), "right") - 1)
        near = np.unique(np.clip(np.concatenate([at - 1, at, at + 1]), 0, len(texts) - 1)) if len(at) else at
        odd = np.zeros(len(texts), bool)
        odd[[i for i in near if _BESIDE.search(texts[i])]] = True
        return odd

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        encoded = [t.encode() for t in texts]
        raw = b"\n".join(encoded) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        bounds = np.cumsum([0] + [len(t) + 1 for t in encoded])
        odd = np.zeros(len(texts), bool)
        if self.kept:
            odd = self._odd(data, bounds, texts)
            if texts[-1][-1:].isspace() or texts[0][:1].isspace():
                odd[[0, -1]] |= [bool(_BESIDE.search(texts[0])), bool(_BESIDE.search(texts[-1]))]
        else:
            data = _LOWER[data]
            raw = data.tobytes()
        folded = raw.lower()
        for content in self.added:
            if content.lower().encode() in folded:
                odd |= [content.lower() in t.lower() for t in texts]
        starts, ends = self._cuts(data)
        owner = np.searchsorted(bounds, starts, "right") - 1
        use = ~odd[owner]
        if self.kept:
            use &= starts != bounds[1:][owner] - 1  # separators
        starts, ends, owner = starts[use], ends[use], owner[use]
        keys, where = distinct(data, starts, ends)
        ids = self._ids([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        offsets = np.cumsum(sizes) - sizes
        n = sizes[keys]
        total = np.cumsum(n)
        out = flat[np.repeat(offsets[keys] - total + n, n) + np.arange(total[-1] if len(total) else 0)].tobytes()
        stops = np.concatenate([[0], np.cumsum(np.bincount(owner, n, len(texts)).astype(np.int64))]) * 4
        result = [out[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        if odd.any():
            at = np.flatnonzero(odd).tolist()
            for i, got in zip(at, self.whole([texts[i] for i in at]), strict=True):
                result[i] = got
        return result


#: Bytes of text that encoders take at once: distinct segments are looked up once in each.
AT_ONCE = 8 << 20

_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, spaces: str) -> Encoder:
    """The worker's encoder for a vocabulary file; loaded once a process."""
    key = (vocabulary, spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, spaces)
    return _ENCODERS[key]
