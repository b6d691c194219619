"""Texts to token ids with a public tokenizer, inside Spark tasks.

A batch of texts is cut at its spaces, every distinct piece is encoded once, and
the ids of all pieces are put together by index arithmetic.  Cuts are only made
where the tokenizer itself always starts anew; a text with two blanks in a row or
with an unusual blank is encoded whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 3 << 20
#: A Python worker keeps the ids of so many pieces of bounded length, in flat arrays of some 30 MB
#: in all, and of so many words as a dictionary; further ones are encoded again.
KEPT_PIECES = 600_000
KEPT_IDS = 3_000_000
LONGEST_KEPT = 48
KEPT_PARTS = 100_000
CALL_PIECES = 20_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?[{_LATIN}]+[{_MARKS}]*(?:\n[{_LATIN}]+[{_MARKS}]*)*")
_PART = re.compile(rf" ?[{_LATIN}]+|\n|[{_MARKS}]+")
_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_UNSURE = rf"[{_BLANK}][{_BLANK}]|[\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200B}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]"


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others follow from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes batches of texts with the tokenizer file at ``path``, without special tokens.

    ``drops_blanks`` tells a tokenizer that lower-cases and drops blanks from one that
    keeps them and joins one space to the word behind it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_blanks = self.tokenizer.normalizer is not None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Added tokens stand for themselves wherever they are in a text.
        self.unsure = "|".join([_UNSURE, *[f"(?i:{a})" for a in added]])
        self.kept = pa.array([], pa.string())
        self.kept_ids, self.kept_ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.parts: dict[str, bytes] = {}
        # Characters of a Latin-1 decoded UTF-8 string, byte by byte.
        self.shown = {b: c for b, c in byte_characters().items()}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after another, and the number of ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        unsure = np.flatnonzero(pc.match_substring_regex(texts, self.unsure).to_numpy(zero_copy_only=False))
        if len(unsure) == 0:
            return self._encode_pieces(texts)
        mask = np.zeros(len(texts), bool)
        mask[unsure] = True
        ids, counts = self._encode_pieces(pc.if_else(pa.array(mask), "", texts))
        whole = [np.array(self._whole(texts[i].as_py()), np.uint32) for i in unsure.tolist()]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, own in zip(unsure.tolist(), whole):
            parts[i], counts[i] = own, len(own)
        return np.concatenate(parts), counts

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(texts) if self.drops_blanks else pc.split_pattern(texts, " ")
        pieces_per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(pieces_per_text) - pieces_per_text
        if not self.drops_blanks:
            # The first piece of a text has no space before it.
            first = starts[pieces_per_text > 0]
            own, own_codes = np.unique(codes[first], return_inverse=True)
            codes[first] = own_codes + len(pieces)
            pieces = pa.concat_arrays([pc.binary_join_element_wise("", pieces, " "), pieces.take(pa.array(own))])
        table, places, lengths = self._ids_of(pieces)
        per_piece = lengths[codes]
        ends = np.cumsum(per_piece)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(places[codes] - (ends - per_piece), per_piece)
        ids = table[shift + np.arange(total)] if total else np.zeros(0, np.uint32)
        sums = np.concatenate([[0], ends])
        return ids, sums[starts + pieces_per_text] - sums[starts]

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where those of each piece start there and how many they are."""
        found = pc.fill_null(pc.index_in(pieces, value_set=self.kept), -1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(found < 0)
        new = pieces.take(pa.array(missing))
        encoded = self._encoded(new.to_pylist())
        new_lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        new_ids = np.frombuffer(b"".join(encoded), "<u4")
        table = np.concatenate([self.kept_ids, new_ids])
        ends = np.concatenate([self.kept_ends, len(self.kept_ids) + np.cumsum(new_lengths)])
        place = found.astype(np.int64)
        place[missing] = len(self.kept) + np.arange(len(missing))
        begins = np.concatenate([[0], ends])
        self._keep(new, new_ids, new_lengths)
        return table, begins[place], begins[place + 1] - begins[place]

    def _keep(self, pieces: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        room, id_room = KEPT_PIECES - len(self.kept), KEPT_IDS - len(self.kept_ids)
        short = pc.less_equal(pc.binary_length(pieces), LONGEST_KEPT).to_numpy(zero_copy_only=False)
        short &= (np.cumsum(short) <= room) & (np.cumsum(lengths * short) <= id_room)
        if short.any():
            self.kept = pa.concat_arrays([self.kept, pieces.filter(pa.array(short))])
            self.kept_ids = np.concatenate([self.kept_ids, ids[np.repeat(short, lengths)]])
            self.kept_ends = np.concatenate([self.kept_ends, (self.kept_ends[-1:].sum()) + np.cumsum(lengths[short])])

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as bytes."""
        known, hard = [b""] * len(pieces), []
        for i, piece in enumerate(pieces):
            if _PLAIN.fullmatch(piece):
                known[i] = self._plain(piece)
            else:
                hard.append(i)
        for at in range(0, len(hard), CALL_PIECES):
            some = hard[at : at + CALL_PIECES]
            found = self.tokenizer.encode([pieces[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            raw, words = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
            bounds = (4 * np.searchsorted(words, np.arange(len(some) + 1))).tolist()
            for place, i in enumerate(some):
                known[i] = raw[bounds[place] : bounds[place + 1]]
        return known

    def _plain(self, piece: str) -> bytes:
        """Ids of Latin words with marks: the cuts are known, so only the merges are left to the model."""
        if self.drops_blanks:
            piece = piece.lower()
        found = []
        for part in (piece,) if piece.isalpha() else _PART.findall(piece):
            if self.drops_blanks and part == "\n":
                continue
            ids = self.parts.get(part)
            if ids is None:
                plain = part.isascii() and part.isalpha()
                shown = part if plain else part.encode().decode("latin-1").translate(self.shown)
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
                if len(self.parts) < KEPT_PARTS and len(part) <= LONGEST_KEPT:
                    self.parts[part] = ids
            found.append(ids)
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and Python worker."""
    return Encoder(path)


def encode_documents(path: str, end_id: int, texts: pa.Array):
    """Yields ``(row, ids)`` for each text: its ids and the end id, in groups of bounded size."""
    model = encoder(path)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(sizes) // GROUP_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    for low, high in zip(bounds, bounds[1:]):
        if low == high:
            continue
        ids, counts = model.encode(texts.slice(low, high - low))
        ends = np.cumsum(counts).tolist()
        at = 0
        for row, end in enumerate(ends, low):
            own = np.empty(end - at + 1, "<u4")
            own[:-1], own[-1] = ids[at:end], end_id
            at = end
            yield row, own
        pa.default_memory_pool().release_unused()
