"""Token ids by the tokenizers library, a batch of texts at a time."""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402

from quire.llm import common  # noqa: E402

#: Marks that end a word and are a token run of their own after a letter or digit. No apostrophe (it may join what follows), nothing of <|...|>.
MARKS = rb""".,;:!?#$%&*+-/=@\^_`~"()[]{}"""
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: What a byte is: one of MARKS, of ALNUM, white space, or none of these.
MARK, LETTER, BLANK = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[list(MARKS)], KINDS[list(ALNUM)], KINDS[list(b" \t\n\v\f\r")] = MARK, LETTER, BLANK
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Words whose ids are put in their places at once.
PLACED = 1 << 16


class WordTokenizer:
    """Ids of whole texts, encoded word by word with a memory of words already encoded.

    The vocabulary this is for lower-cases, drops white space and neither normalises nor merges across it, so the ids of a text
    are those of its white-space separated words in a row; and a word that ends in marks after a letter or digit is the word, then
    the marks. A batch's texts are split and their different words are found by Arrow; only those are looked up. Words of letters
    only that are new are encoded many at a time and told apart by the tokens that end a word. Tests hold all this against encoding
    whole texts. The memory is bounded: beyond `words` entries the later half is forgotten, and words of more than `long` bytes
    are never kept.
    """

    def __init__(self, path: str, words: int = 1_000_000, long: int = 48):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.words, self.long = Tokenizer.from_file(path), words, long
        self.merges = Tokenizer(self.tokenizer.model)  # the merges alone, for words of a-z: nothing before the merges changes those
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters: each is one run of tokens whose last, and only it, ends a word."""
        return self._runs(self.tokenizer, words)

    def _plain(self, words: list[str]) -> list[bytes]:
        """Words of a-z."""
        return self._runs(self.merges, words)

    def _runs(self, tokenizer, words: list[str]) -> list[bytes]:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):  # a letter that isn't one after normalising
            return self._each(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if len(self.known) > self.words:
            self.known = dict(list(self.known.items())[: self.words // 2])
        known = self.known
        ids = list(map(known.get, words))
        plain, letters, others = [], [], []
        for i, x in enumerate(ids):
            if x is None:
                text = words[i].decode()
                (others if not text.isalpha() else plain if text.isascii() and text.islower() else letters).append((i, text))
        for some, encode in ((plain, self._plain), (letters, self._letters), (others, self._each)):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                for (i, _), x in zip(part, encode([t for _, t in part]), strict=True):
                    ids[i] = x
                    if len(words[i]) <= self.long:
                        known[words[i]] = x
        return ids

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none), and where each text's begin, with the end of the last."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        texts = pc.ascii_split_whitespace(_prepared(texts))
        counts = pc.list_value_length(texts).to_numpy()
        texts = texts.flatten().view(pa.large_binary()).dictionary_encode()
        places, words = texts.indices.to_numpy(), texts.dictionary.to_pylist()
        del texts
        ids = self._ids(words)
        del words
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), "<u4")
        del ids
        ends = np.cumsum(lengths[places])
        parts = []
        for at in range(0, len(places), PLACED):
            place = places[at : at + PLACED]
            n = lengths[place]
            parts.append(flat[np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return np.concatenate(parts), bounds

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.arrays(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        data, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _prepared(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts (no nulls) with A-Z lower-cased, but where `<|` may begin a token of its own, and a space before the marks that end a word, where they follow a letter or digit: fewer words differ then."""
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds, data = bounds - bounds[0], LOWER[raw]
    for i in np.unique(np.searchsorted(bounds, np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)), "right") - 1).tolist():
        data[bounds[i] : bounds[i + 1]] = raw[bounds[i] : bounds[i + 1]]
    kinds = KINDS[data]
    marks = np.append(kinds == MARK, False)
    last = np.append(kinds == BLANK, True)  # whether a word can't go on here
    last[bounds] = True
    begins = np.flatnonzero(marks[1:-1] & (kinds[:-1] == LETTER)) + 1
    ends = np.flatnonzero(marks[:-1] & ~marks[1:]) + 1
    at = begins[last[ends[np.searchsorted(ends, begins, "right")]]]
    data, bounds = np.insert(data, at, 32), bounds + np.searchsorted(at, bounds)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype("<i8")), pa.py_buffer(data))


_loaded: dict[tuple[str, int], WordTokenizer] = {}
common.CACHES.append(_loaded)


def tokenizer(path: str, words: int = 1_000_000) -> WordTokenizer:
    """One for each worker process, file and size of its memory (a million words take about 150 MB)."""
    if (path, words) not in _loaded:
        _loaded.clear()
        _loaded[path, words] = WordTokenizer(path, words)
    return _loaded[path, words]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
