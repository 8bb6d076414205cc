"""Token ids of public tokenizers, remembered per word in the worker. The libraries' own ids, whole texts, no limits.

Both vocabularies read a text as independent units, so a text's ids are the ids of its units in turn:

* the word vocabulary never joins tokens over white space (its tokens end with a word);
* the piece vocabulary has no piece with a space mark behind another character, so that no merge crosses the edge
  between a character and the spaces before the next word. This is read off the vocabulary when it is loaded; a
  vocabulary that breaks it has its texts encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from riskloom.llm.common import Memory, worker_cache

WORD_MODEL = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"

# Parts of words or units remembered in each of a memory's two generations.
REMEMBERED = 200_000
# Longer units are encoded each time.
LONGEST = 64
# Parts of words that the library encodes at once.
JOINED = 1_000
# Text bytes whose distinct words are told apart at once, in Arrow memory.
TOGETHER = 4 << 20


def model_path(model: str) -> str:
    """A path is taken as it is, a bare name from the installed public vocabularies."""
    if os.sep in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class WordIds:
    """Ids of whole texts by a ``tokenizers`` vocabulary, as little-endian unsigned 32-bit bytes."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(model_path(model))
        self.bare, self.parts = self._bare(model), Memory(REMEMBERED)
        # Words of these characters fold and split alike here and in the tokenizer; others, and long ones, are encoded whole.
        self.whole = re.compile(rf"^(?:.{{{LONGEST + 1},}}|.*(?:[^\n\x21-\x7e\xa1-įı-ſ]|<\|).*)$", re.M)
        # Fixed value: the pattern by which the vocabulary splits words, for those characters, and the line breaks between words.
        letter, number = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9²³¹¼½¾"
        self.split = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+")
        # Ids that end a part of a word, by the vocabulary's suffix.
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(names.values(), default=0), dtype=bool)
        self.ends[[i for w, i in names.items() if w.endswith("</w>")]] = True

    def _bare(self, model: str):
        """The vocabulary for parts between single spaces, which needs no normalising and no pattern; the whole one if that differs."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        bare = Tokenizer.from_file(model_path(model))
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the straße élan ſęłŉ 7 ¾ ' 's don .,;&&& ½ «» queesosiell " + " ".join(map(chr, [*range(0x5B, 0x7F), *range(0xDF, 0x100)]))
        plain, own = (t.encode_batch_fast([probe], add_special_tokens=False)[0].ids for t in (self.tokenizer, bare))
        return bare if plain == own else self.tokenizer

    def _encode(self, units: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in out]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that the split leaves as they are: many between spaces at once, cut behind the ids that end a part."""
        out = []
        for a in range(0, len(parts), JOINED):
            block = parts[a : a + JOINED]
            ids = np.array(self.bare.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1 if not len(ids) or int(ids.max()) < len(self.ends) else []
            if len(cuts) == len(block) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * cuts).tolist()
                out += [raw[i:j] for i, j in zip([0, *at], at)]
            else:
                # A vocabulary without that suffix, or one that lacks a character.
                out += self._encode(block)
        return out

    def _known_parts(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts; a line break has none."""
        learn = lambda new: {"\n": b""} | dict(zip(plain := [p for p in new if p != "\n"], self._encode_parts(plain)))
        return pa.array(self.parts.values([parts.to_pylist()], learn)[0], pa.large_binary())

    def _learn(self, words: pa.Array) -> pa.Array:
        """The ids of each word. Words have no white space, so that lines hold one each."""
        text = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", pa.large_string()))[0].as_py()
        odd = set(self.whole.findall(text))
        # A word that is encoded whole leaves an empty line.
        plain = self.whole.sub("", text) if odd else text
        flat = pa.array(self.split.findall(plain.lower()), pa.large_string()).dictionary_encode()
        placed = self._known_parts(flat.dictionary).take(flat.indices)
        ends = _ends(placed)
        line = pa.compute.index(flat.dictionary, "\n").as_py()
        breaks = np.flatnonzero(flat.indices.to_numpy() == line) if line >= 0 else []
        cuts = np.concatenate([[0], ends[breaks], ends[-1:]]).astype(np.int64)
        got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts), placed.buffers()[2]])
        if not odd:
            return got
        at = [i for i, w in enumerate(text.split("\n")) if w in odd]
        order = np.arange(len(words))
        order[at] = len(words) + np.arange(len(at))
        listed = words.take(pa.array(at, pa.int64())).to_pylist()
        return pa.concat_arrays([got, pa.array(self._encode(listed), pa.large_binary())]).take(pa.array(order))

    def placed(self, texts: pa.Array | list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(ids of every word of all texts in turn, where each word's ids end, where each text's words begin and end), from 0 on."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts.cast(pa.large_binary()), b"").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        begins, indices = split.offsets.to_numpy() - split.offsets[0].as_py(), words.indices
        # White space at a text's ends leaves an empty word.
        empty = pa.compute.index(words.dictionary, "").as_py()
        if empty >= 0:
            real = indices.to_numpy() != empty
            begins, indices = np.append(0, np.cumsum(real))[begins], indices.filter(pa.array(real))
        if not len(indices):
            return pa.array([], pa.large_binary()), np.zeros(1, dtype=np.int64), begins
        ids = self._learn(words.dictionary).take(indices)
        return ids, _ends(ids), begins

    def ids(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """The ids of each text: its distinct words are told apart once for all texts, and Arrow puts their ids in place."""
        if not len(texts):
            return []
        ids, ends, begins = self.placed(texts)
        data, at = memoryview(ids.buffers()[2] or b""), ends[begins].tolist()
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def by_word(self, texts: list[bytes]) -> list[list[bytes]]:
        """The ids of each word, between ASCII white space, of each text."""
        if not len(texts):
            return []
        ids, _, begins = self.placed(texts)
        listed = ids.to_pylist()
        return [listed[a:b] for a, b in zip(begins, begins[1:])]


def _ends(values: pa.Array) -> np.ndarray:
    """0 and the byte where each value ends."""
    ends = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(pa.compute.binary_length(values).to_numpy(zero_copy_only=False), out=ends[1:])
    return ends


class PieceCounts:
    """Token counts of the units of whole texts by a ``sentencepiece`` vocabulary."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        marked = self.model.encode("a b", out_type=str)
        self.by_unit = marked[0].startswith("▁") and "".join(marked) == "▁a▁b" and not any("▁" in p.lstrip("▁") for p in pieces)
        self.known, self.prefixes = Memory(REMEMBERED), Memory(REMEMBERED // 4)
        # Pieces that a merge can make, by their text; a character without one is spelt in bytes.
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.pieces = {self.model.id_to_piece(i) for i in plain}
        self.longest = max((len(p) for p in self.pieces), default=1)
        self.joints: dict[tuple[str, str], bool] = {}

    def units(self, text: str) -> list[str]:
        """The text cut before each run of spaces; one unit for a vocabulary whose merges cross spaces."""
        if not text:
            return []
        if not self.by_unit:
            return [text]
        words = text.replace("▁", " ").split(" ")
        if "" not in words:
            return words
        # Spaces beyond the first of a run belong to the unit that they lead into.
        units, led = [], 0
        for w in words:
            if w:
                units.append(" " * led + w)
                led = 0
            else:
                led += 1
        if led:
            units.append(" " * led)
        return units

    def _count(self, units: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(units, num_threads=1)] if units else []

    def counts(self, texts: list[str]) -> list[list[int]]:
        """Tokens of each unit of each text."""
        cut = [self.units(t) for t in texts]
        new = self.known.missing({u for us in cut for u in us})
        known = self.known.young
        if new:
            # A text's trailing spaces: the model's own leading mark stands for one of them.
            known.update((u, n if u.strip(" ") or not self.by_unit else m) for u, n, m in zip(new, self._count(new), self._trailing(new)))
        out = [[known[u] for u in us] for us in cut]
        for u in new:
            if len(u) > LONGEST:
                del known[u]
        return out

    def prefix_counts(self, unit: str) -> np.ndarray:
        """Tokens of ``unit[:1]``, ``unit[:2]`` and so on, each as the library counts it."""
        if len(unit) > LONGEST:
            return self._prefix_table(unit)
        missing = self.prefixes.missing({unit})
        if missing:
            self.prefixes.young[unit] = np.array(self._count([unit[: k + 1] for k in range(len(unit))]), dtype=np.int64)
        return self.prefixes.young[unit]

    def _prefix_table(self, unit: str) -> np.ndarray:
        """Dynamic programming over prefixes: a prefix is a shorter one and its last piece.

        Merges by rank make a sequence of pieces exactly when they make every two neighbours of it, and of the pieces
        that end a prefix only one stands so behind the last piece of what is before it.
        """
        text = "▁" + unit.replace(" ", "▁")
        counts, last = np.zeros(len(text) + 1, dtype=np.int64), [""] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for size in range(min(self.longest, end), 0, -1):
                piece = text[end - size : end]
                if piece in self.pieces:
                    if self._joint(last[end - size], piece):
                        counts[end], last[end] = counts[end - size] + 1, piece
                        break
                elif size == 1:
                    # Its bytes meet no other character.
                    counts[end], last[end] = counts[end - 1] + len(piece.encode()), ""
        if counts[-1] != len(self.model.encode(unit)):
            # Not a vocabulary of ranked merges, or one that changes characters: the library counts every prefix.
            return np.array(self._count([unit[: k + 1] for k in range(len(unit))]), dtype=np.int64)
        return counts[2:]

    def _joint(self, left: str, right: str) -> bool:
        """Whether the library leaves the two pieces as they are behind each other; behind nothing, the one."""
        key = (left, right)
        if key not in self.joints:
            if len(self.joints) > 4 * REMEMBERED:
                self.joints.clear()
            # A line break is bytes, which keep the model's own leading mark away.
            self.joints[key] = self.model.encode("\n" + left + right, out_type=str)[2:] == [p for p in key if p]
        return self.joints[key]

    def _trailing(self, units: list[str]) -> list[int]:
        return [0 if u.strip(" ") else (1 if u == " " else len(self.model.encode(u[1:]))) for u in units]


def word_ids(model: str = WORD_MODEL) -> WordIds:
    return worker_cache(("words", model), lambda: WordIds(model))


def piece_counts(model: str = PIECE_MODEL) -> PieceCounts:
    return worker_cache(("pieces", model), lambda: PieceCounts(model))
