"""Token ids by the tokenizers library, with a bounded memo of the units that a pre-tokeniser never joins."""

from __future__ import annotations

import os
import re
import string
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, filterfalse

import numpy as np

#: Entries that one worker's memo holds, in two halves: when one is full it takes the place of the other, and what is met
#: again moves on, so frequent units stay. A longer unit is kept for one batch only.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
#: Texts encoded together (few, so that their units stay in a CPU's cache), units sent to the library in one call.
TEXTS, UNITS = 48, 512
#: Byte-level: bytes of text cut into units together, so that the memo is asked once for each distinct unit among them.
BYTES = 6 << 20
#: Bytes of them that are classed at once, and units whose ids are put in place at once.
SLICE = 1 << 16
#: Byte-level: what may stand between texts and marks their ends, since UTF-8 has no such byte.
BETWEEN = b"\xff"
#: Classes of bytes: letters and digits, other printable ASCII, the quote, space, other blanks, first bytes of characters
#: that are never blank, what stands between texts, and whatever is not told apart.
ALNUM, SIGN, QUOTE, SPACE, BLANK, LEAD, EDGE, OPEN = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, OPEN, np.uint8)
    out[0x21:0x7F] = SIGN
    out[np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8)] = ALNUM
    out[[ord(c) for c in "\t\n\r"]] = BLANK
    out[ord(" ")], out[ord("'")], out[0xFF] = SPACE, QUOTE, EDGE
    # blanks beyond ASCII begin with C2, E1, E2 or E3
    out[0xC3:0xE0] = out[0xE4:0xF5] = LEAD
    return out


def _pairs() -> np.ndarray:
    """What two classes that follow each other tell, as bits.

    1, 2: a unit starts at the second, at the first; 4, 8: a character before a blank, after one.
    """
    out = np.zeros((8, 8), np.uint8)
    seen = [ALNUM, SIGN, QUOTE]
    for a in seen:
        out[a, [SPACE, BLANK]] |= 1
        out[a, BLANK] |= 4
    out[SPACE, [*seen, LEAD]] |= 2
    out[BLANK, [*seen, LEAD]] |= 8
    out[ALNUM, [SIGN, QUOTE]] |= 1
    out[SIGN, ALNUM] |= 1
    out[EDGE, :] |= 1
    out[:, EDGE] |= 1
    return out.ravel()


CLASSES, TELLS = _classes(), _pairs()
#: New units that the library gets many in a call: the first kind end to end, as each is known by its space, the second in lines.
SPACED, LINE = re.compile(rb" [!-~\xc3-\xdf\xe4-\xf4][^\x00- ]*"), re.compile(rb"[!-~]+")


def starts(data: np.ndarray) -> np.ndarray:
    """Where units of the bytes start, the first being one: a token group starts there, whatever comes before and after.

    That holds at a space before a character that isn't blank, at a blank after one, after a lone blank between two, and
    between letters or digits and other signs (but not after a quote, which may be that of a contraction).
    """
    out = []
    for begin in range(0, len(data), SLICE):
        low = max(0, begin - 2)
        kinds = CLASSES[data[low : begin + SLICE + 1]]
        tells = TELLS[(kinds[:-1] << 3) | kinds[1:]]
        at = np.empty(len(kinds), bool)
        at[0] = True
        np.not_equal(tells & 1, 0, out=at[1:])
        at[:-1] |= (tells & 2) != 0
        at[2:] |= ((tells[:-1] & 4) != 0) & ((tells[1:] & 8) != 0)
        out.append((np.flatnonzero(at[begin - low :][:SLICE]) + begin).astype(np.int32))
    return np.concatenate(out)


#: What the word-level path takes apart itself: printable ASCII, white space, Latin-1 letters and quotes.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡«¿»À-ÖØ-öø-ÿ]")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Ids of whole texts, equal to the library's own.

    Each distinct unit is encoded by the library once and remembered; new units go to it many in a call. Byte-level
    (spaced): a unit is one or more whole token groups; units are found and counted by arrays over the bytes of many texts
    (see starts), and the space in a token shows where a unit starts. Word-level: a unit is a token group of the
    lower-cased text, and the word end in a token shows where it ends; a text that holds anything this rule doesn't cover
    goes to the library whole. So does one with the string of an added token.
    """

    def __init__(self, path: str, end_id: int, spaced: bool, added: bool = False, entries: int = MEMO_ENTRIES):
        """spaced: tokens carry the space before them (byte-level); else they drop white space and case.

        added: the strings of added tokens in a text are these tokens, as by the library's default; else ordinary text.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.entries = entries
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        self.end, self.spaced = np.uint32(end_id).tobytes(), spaced
        self.line = self._ids("\n")[0] if spaced else None
        self.memo: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _whole(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _units(self, text: str) -> list[str] | None:
        return None if self._whole(text) or OTHER.search(text) else WORDS.findall(text.lower())

    def _remember(self, units: list, space, ends: Callable[[np.ndarray], np.ndarray], skip: int = 0) -> None:
        """ends: where the ids of each unit end, among the ids of units with space between; skip: ids between two units."""
        for i in range(0, len(units), UNITS):
            some = units[i : i + UNITS]
            text = space.join(some)
            ids = self._ids(text.decode() if self.spaced else text)
            raw, at = ids.tobytes(), 0
            for u, end in zip(some, ends(ids).tolist(), strict=True):
                self.memo[u] = raw[4 * at : 4 * end]
                at = end + skip

    def _renew(self) -> None:
        if len(self.memo) > self.entries // 2:
            self.old, self.memo = self.memo, {}

    def _learn(self, new: list) -> None:
        memo, old = self.memo, list(map(self.old.get, new))
        memo.update((u, ids) for u, ids in zip(new, old, strict=True) if ids is not None)
        new = [u for u, ids in zip(new, old, strict=True) if ids is None]
        if not self.spaced:
            self._remember(new, " ", lambda ids: np.flatnonzero(self.edge[ids]) + 1)
            return
        self._remember(list(filter(SPACED.fullmatch, new)), b"", lambda ids: np.append(np.flatnonzero(self.edge[ids])[1:], len(ids)))
        rest = list(filterfalse(SPACED.fullmatch, new))
        self._remember(list(filter(LINE.fullmatch, rest)), b"\n", lambda ids: np.append(np.flatnonzero(ids == self.line), len(ids)), 1)
        for u in filterfalse(LINE.fullmatch, rest):
            memo[u] = self.end if u == BETWEEN else self._ids(u.decode()).tobytes()

    def _forget(self, new: list) -> None:
        for u in new:
            if len(u) > MEMO_CHARS:
                del self.memo[u]

    def _bytes(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of the texts, the end id last. The list is emptied."""
        import pyarrow as pa

        data = np.frombuffer(BETWEEN.join([*texts, b""]), np.uint8)
        texts.clear()
        at = np.append(starts(data), np.int32(len(data)))
        units = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        distinct, which = units.dictionary.to_pylist(), units.indices.to_numpy()
        del data, at, units
        self._renew()
        known = list(map(self.memo.get, distinct))
        missing = [i for i, ids in enumerate(known) if ids is None]
        new = [distinct[i] for i in missing]
        self._learn(new)
        for i, u in zip(missing, new, strict=True):
            known[i] = self.memo[u]
        self._forget(new)
        edge = distinct.index(BETWEEN)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, first = np.frombuffer(b"".join(known), np.uint32), np.cumsum(sizes) - sizes
        del distinct, known, new
        text: list[bytes] = []
        for i in range(0, len(which), SLICE):
            some = which[i : i + SLICE]
            n = sizes[some]
            after = np.cumsum(n)
            place = np.repeat(first[some] - (after - n), n)
            place += np.arange(len(place))
            raw, at = ids[place].tobytes(), 0
            for end in (4 * after[some == edge]).tolist():
                yield b"".join([*text, raw[at:end]])
                text, at = [], end
            text.append(raw[at:])

    def _byte_level(self, texts: list[str | None]) -> Iterator[bytes]:
        some: list[bytes] = []
        whole: dict[int, str] = {}
        held = 0

        def cut() -> Iterator[bytes]:
            for i, ids in enumerate(self._bytes(some)):
                yield self._ids(whole[i]).tobytes() + self.end if i in whole else ids

        for text in texts:
            data = (text or "").encode()
            if some and held + len(data) > BYTES:
                yield from cut()
                whole, held = {}, 0
            if self._whole(text or ""):
                whole[len(some)], data = text, b""
            some.append(data)
            held += len(data) + 1
        if some:
            yield from cut()

    def _word_level(self, texts: list[str | None]) -> Iterator[bytes]:
        for i in range(0, len(texts), TEXTS):
            some = [t or "" for t in texts[i : i + TEXTS]]
            units = [self._units(t) for t in some]
            self._renew()
            new = list(set(filterfalse(self.memo.__contains__, chain.from_iterable(u for u in units if u))))
            self._learn(new)
            get = self.memo.__getitem__
            out = [(self._ids(t).tobytes() if u is None else b"".join(map(get, u))) + self.end for u, t in zip(units, some, strict=True)]
            self._forget(new)
            yield from out

    def stream(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last; a null text is empty."""
        return self._byte_level(texts) if self.spaced else self._word_level(texts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """All that stream gives."""
        return list(self.stream(texts))


@cache
def encoder(path: str, end_id: int, spaced: bool, added: bool = False, entries: int = MEMO_ENTRIES) -> Encoder:
    """The encoder of this Python worker: tasks that follow each other in a worker share its vocabulary and its memo."""
    return Encoder(path, end_id, spaced, added, entries)
