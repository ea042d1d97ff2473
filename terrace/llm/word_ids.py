"""Token ids of whole batches by a word-end BPE tokenizer, one call for each distinct word.

The tokenizer's pre-tokens never span white space, so a text's ids are those of its parts between spaces and
line feeds, in order. A batch is split and dictionary-encoded by Arrow; only words not seen before reach the
tokenizer, and ids are gathered with numpy.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of one generation, and characters of a word that is kept: two generations take about 40 MB at most.
#: Words not used again while the next generation fills up are forgotten.
MOST_WORDS, LONGEST_KEPT = 75_000, 48
#: Special tokens, and the marks that compose with the small form of a letter (h, j, t, w, y) but not with its capital:
#: the tokenizer composes before it lower-cases.
LEFT_ALONE = "<\\||[\u0308\u030a\u030c\u0331\u0344]"
#: Words in one call.
TOGETHER = 2000
#: Words of these letters are one pre-token, lower-cased letter by letter, and composed already.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_names() -> dict[int, str]:
    """For each small letter beyond ASCII of ``LETTERS``, the byte-level names of its UTF-8 bytes: a printable Latin-1
    character stands for its own byte, the others are numbered from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}


BYTES = _byte_names()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._encode = getattr(self._tokenizer, "encode_batch_fast", self._tokenizer.encode_batch)
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        # A special token of the file, between words that don't hold it, tells their ids apart.
        self._mark, self._mark_id = next(((t.content, i) for i, t in sorted(self._tokenizer.get_added_tokens_decoder().items()) if t.special), (None, None))
        # What `encode` does to texts before the tokenizer sees them is right for some files only.
        for whole in ("Hello, WORLD: it's 12.5% of one\ntwo  three!", "A.b,c;D:e!f?g%h&i*j#k$l|m", "Café ÉÀÿ Ärger ß ß"):
            ids, _ = self.encode(pa.array([whole]))
            if ids.tolist() != self._tokenizer.encode(whole, add_special_tokens=False).ids:
                raise ValueError(f"{path} is no lower-casing word-end tokenizer that drops white space")

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words: those of letters alone by the model itself, the others by the whole tokenizer."""
        ids, odd, tokenize = [], [], self._tokenizer.model.tokenize
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                ids.append(array("I", [t.id for t in tokenize(w.lower())]).tobytes())
            elif LETTERS.fullmatch(w):
                ids.append(array("I", [t.id for t in tokenize(w.lower().translate(BYTES))]).tobytes())
            else:
                ids.append(b"")
                odd.append(i)
        for lo in range(0, len(odd), TOGETHER):
            part = odd[lo : lo + TOGETHER]
            for i, x in zip(part, self._whole([words[i] for i in part]), strict=True):
                ids[i] = x
        return ids

    def _whole(self, words: list[str]) -> list[bytes]:
        if self._mark is None or any("<|" in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self._encode(words, add_special_tokens=False)]
        ids = np.array(self._encode([self._mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self._mark_id)
        if len(at) != len(words) - 1:
            raise ValueError("the mark between words is not one token")
        edges, data = (4 * np.r_[-1, at, len(ids)]).tolist(), ids.tobytes()
        return [data[lo + 4 : hi] for lo, hi in zip(edges, edges[1:], strict=False)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Beside these, two generations are held; a generation ends before it passes its bound."""
        known, before = self._known, self._before
        ids = [known.get(w) for w in words]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i in missing:
            ids[i] = before.get(words[i])
        new = [i for i in missing if ids[i] is None]
        for i, x in zip(new, self._learn([words[i] for i in new]), strict=True):
            ids[i] = x
        for i in missing:
            if len(known) >= MOST_WORDS:
                self._before, self._known = known, (known := {})
            if len(words[i]) <= LONGEST_KEPT:
                known[words[i]] = ids[i]
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, the n + 1 borders between texts); null counts as empty."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        if not pc.any(pc.match_substring_regex(texts, LEFT_ALONE)).as_py():
            # None of this changes ids: the tokenizer lower-cases, and splits letters from what isn't a letter, digit or
            # apostrophe. It makes fewer distinct words. Texts that may hold special tokens stay as they are.
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([,.;:!?%&*#$|]+)", "\\1 \\2")
        words = pc.split_pattern(texts, " ")
        flat = words.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        if not len(codes):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct = self._ids(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        pool, starts = np.frombuffer(b"".join(distinct), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(starts[codes] - (ends - counts), counts) + np.arange(ends[-1])]
        offsets = words.offsets.to_numpy()
        return ids, np.r_[0, ends][offsets - offsets[0]]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that known words last from task to task."""
    return WordEncoder(path)


def slices(texts: pa.Array, most_bytes: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
