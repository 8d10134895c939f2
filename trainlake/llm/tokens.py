"""Token ids of whole texts with a public word-BPE tokenizer, many texts at a time."""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa

from trainlake.llm.common import ship_by_value, text_bytes, text_offsets

ship_by_value(__name__)

END_ID = 2
CACHED_UNITS = 250_000
JOINED = 512
LETTER, DIGIT, OTHER, WHOLE = np.array([1, 2, 3, 128], np.uint8)
BLANKS = b" \t\n\v\f\r"
#: How a tokenizer must split for ``one_word_tokenizers``: normalizer and pre-tokenizer.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tables() -> tuple[bytes, bytes, np.ndarray]:
    """For each byte: its kind (0 for white space), with ``WHOLE`` if it makes the word around it one
    that is not cut; its lower case; and whether a unit with it may be other than one word. Apostrophes
    make contractions and bars special tokens, control characters may be white space, and of the
    letters beyond ASCII only those up to U+027F (two bytes, from 0xC3 to 0xC9) are sure."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[list(BLANKS)] = 0
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = kinds[128:] = LETTER
    whole = np.zeros(256, bool)
    whole[list(b"'|")] = True
    whole[0xC0:0xC3] = whole[0xCA:] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    unsure = whole.copy()
    unsure[:32] = unsure[127] = True
    return (kinds | WHOLE * whole).astype(np.uint8).tobytes(), lower.tobytes(), unsure


def marked_pairs(data: np.ndarray) -> np.ndarray:
    """Places of the two-byte characters from 0xC3 and 0xC4 that are no sure letters: the signs for
    times and division, and the capital I with a dot, which becomes two characters in lower case."""
    leads = np.nonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC4))[0]
    lead, after = data[leads], data[leads + 1]
    return leads[(lead == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (lead == 0xC4) & (after == 0xB0)]


def one_word_tokenizers(tokenizer) -> tuple:
    """The same model behind a split at blanks alone, for units that are one word each: those of lower
    ASCII characters need nothing else, other Latin ones lower case and the bytes as characters. Neither
    needs NFC or regular expressions. A tokenizer that splits in another way, cuts, pads or has added
    tokens without a bar is returned as it is."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    def parts(of) -> dict:
        return json.loads(of.__getstate__()) if of is not None else {}

    known = parts(tokenizer.normalizer) == NORMALIZER and parts(tokenizer.pre_tokenizer) == PRE_TOKENIZER
    barred = all("|" in token.content for token in tokenizer.get_added_tokens_decoder().values())
    if not known or not barred or tokenizer.truncation or tokenizer.padding:
        return tokenizer, tokenizer
    plain, latin = Tokenizer(tokenizer.model), Tokenizer(tokenizer.model)
    split = pre_tokenizers.WhitespaceSplit()
    plain.pre_tokenizer = split
    latin.normalizer = normalizers.Lowercase()
    latin.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain, latin


class WordEncoder:
    """Encodes texts unit by unit.

    The tokenizer splits at white space and between letters, digits and signs, lower-cases, and
    never merges over a split, so the ids of a text are those of its units, one after the other.
    A word with an apostrophe, a bar or characters beyond Latin letters is a unit as a whole.
    Each distinct unit of a batch is encoded once; a cache of about ``CACHED_UNITS`` carries over
    to the next batch and is emptied when full. ``known`` has the place of each unit in ``cached``,
    whose values are the bytes of its ids; an end id is cached beside the units, under itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.latin = one_word_tokenizers(self.tokenizer)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.kinds, self.lower, self.unsure = byte_tables()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str | int, int] = {}
        self.cached = pa.array([], pa.large_binary())

    def keep(self, units: list, ids: np.ndarray, ends: np.ndarray) -> None:
        """Put units with their ids into the cache."""
        start = len(self.cached)
        self.known.update(zip(units, range(start, start + len(units)), strict=True))
        offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, np.uint32))])
        self.cached = pa.concat_arrays([self.cached, values])

    def sorts(self, units: pa.Array) -> list[list[str]]:
        """Units that the tokenizer takes as exactly one word (Latin letters, a digit, or signs), those
        of ASCII and the others, and the units left. ``units`` cuts at changes between letters, digits
        and signs, except in words that it keeps whole; these have an unsure byte or pair."""
        data, offsets = text_bytes(units)
        sort = np.zeros(len(units), np.uint8)
        for which, places in ((1, np.nonzero(data > 127)[0]), (2, np.nonzero(self.unsure[data])[0]), (2, marked_pairs(data))):
            sort[np.searchsorted(offsets, places, side="right") - 1] = which
        return [units.filter(pa.array(sort == k)).to_numpy(zero_copy_only=False).tolist() for k in range(3)]

    def learn(self, units: pa.Array) -> None:
        """Add units to the cache. Those that are one word each are encoded many at a time; the
        token that closes a word shows where the next one begins."""
        plain, latin, rest = self.sorts(units)
        for tokenizer, simple in ((self.plain, plain), (self.latin, latin)):
            runs = [simple[k : k + JOINED] for k in range(0, len(simple), JOINED)]
            whole: list[str] = []
            found, places, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
            for run, got in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, np.uint32)
                ends = np.nonzero(self.closes[ids])[0] + 1
                if len(ends) == len(run) and ends[-1] == len(ids):
                    whole += run
                    found.append(ids)
                    places.append(ends + at)
                    at += len(ids)
                else:
                    rest += run
            self.keep(whole, np.concatenate(found), np.concatenate(places))
        each = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self.keep(rest, np.array([i for ids in each for i in ids], np.uint32), np.cumsum([len(ids) for ids in each]))

    def units(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of texts without nulls, and the unit offsets of the texts."""
        data, offsets = text_bytes(texts)
        n, raw = len(data), data.tobytes()
        kind = np.frombuffer(raw.translate(self.kinds), np.uint8)
        odd = np.concatenate([np.nonzero(kind & WHOLE)[0], marked_pairs(data)])
        kind = kind & ~WHOLE
        inked = kind > 0
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = 0
        begins = inked & (before == 0)
        cut = inked & ~begins & ((kind != before) | (kind == DIGIT))
        ends = np.cumsum(inked, dtype=np.int32 if n < 1 << 31 else np.int64)
        units = np.frombuffer(raw.translate(self.lower, BLANKS), np.uint8)
        if len(odd):
            word_starts = np.nonzero(begins)[0]
            bounds = np.append(word_starts, n)
            uncut = np.zeros(len(word_starts), bool)
            uncut[np.searchsorted(word_starts, odd, side="right") - 1] = True
            as_is = np.repeat(np.concatenate([[False], uncut]), np.diff(np.concatenate([[0], bounds])))
            cut &= ~as_is
            own = np.nonzero(as_is & inked)[0]
            units = units.copy()
            units[ends[own] - 1] = data[own]
        starts = np.nonzero(begins | cut)[0]
        unit_offsets = np.append(ends[starts] - 1, len(units)).astype(np.int64)
        strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(unit_offsets), pa.py_buffer(units))
        return strings.dictionary_encode(), np.searchsorted(starts, offsets)

    def places(self, units: pa.Array) -> np.ndarray:
        """The places of distinct units in the cache, which learns what it lacks."""
        names = units.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = at < 0
        if len(self.known) + int(new.sum()) > CACHED_UNITS and self.known:
            self.forget()
            new[:] = True
        if new.any():
            self.learn(units.filter(pa.array(new)))
            at[new] = [self.known[names[k]] for k in np.nonzero(new)[0].tolist()]
        return at

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of the texts in it; null is empty."""
        coded, offsets = self.units(texts.fill_null(""))
        at = self.places(coded.dictionary)[coded.indices.to_numpy()]
        if end_id is not None:
            if end_id not in self.known:
                self.keep([end_id], np.array([end_id], np.uint32), np.ones(1, np.int64))
            at = np.insert(at, offsets[1:], self.known[end_id])
            offsets = offsets + np.arange(len(offsets))
        taken = self.cached.take(pa.array(at))
        data = taken.buffers()[2]
        ids = np.frombuffer(data, np.uint32) if data is not None else np.zeros(0, np.uint32)
        ends = text_offsets(taken) // 4
        return ids[: ends[-1]], ends[offsets]
