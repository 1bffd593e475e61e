"""Ids that the tokenizers library gives for whole texts, one worker process at a time.

A vocabulary that drops white space treats every run of other characters on its own, so
runs between ASCII blanks are encoded by the library once and then remembered. Any other
vocabulary gets whole texts."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Ragged, remembered

# Runs, and words, that a worker remembers before it begins anew; a longer run is not remembered.
REMEMBERED = 300_000
REMEMBERED_WORDS = 600_000
LONGEST_REMEMBERED = 64
# Runs given to the library at a time.
AT_ONCE = 5_000

# Composed letters whose normal form is themselves and whose lower case is one letter.
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
# Marks that no rule of the vocabulary joins to a letter before them.
MARKS = ".,;:!?"

# The steps of a vocabulary that drops white space and never looks over it.
BLANK_FREE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Words:
    """Encoder for one tokenizer file, without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        added = plan.get("added_tokens") or []
        self.by_run = all(plan.get(k) == v for k, v in BLANK_FREE.items()) and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added
        )
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # For words of Latin letters, which no added token lies in: one vocabulary for both.
        self.by_run = self.by_run and not any(re.fullmatch(LATIN, t["content"]) for t in added)
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encoded(self, runs: list[str], plain: bool = False) -> list[bytes]:
        library = self.plain if plain else self.library
        made = []
        for i in range(0, len(runs), AT_ONCE):
            ids = [e.ids for e in library.encode_batch_fast(runs[i : i + AT_ONCE], add_special_tokens=False)]
            ends = [4 * n for n in accumulate(map(len, ids), initial=0)]
            whole = array("I", chain.from_iterable(ids)).tobytes()
            made += [whole[a:b] for a, b in pairwise(ends)]
        return made

    def _learn(self, runs: pa.Array) -> list[bytes]:
        """The packed ids of runs. A run of Latin letters and closing marks is its
        lower-case word and its marks, which are remembered apart."""
        bare = pc.utf8_rtrim(runs, MARKS)
        latin = pc.match_substring_regex(bare, LATIN)
        out = np.empty(len(runs), object)
        simple = latin.to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~simple)
        out[rest] = self._encoded(runs.take(pa.array(rest)).to_pylist())
        at = np.flatnonzero(simple)
        word = pc.dictionary_encode(pc.utf8_lower(bare.filter(latin)))
        words = word.dictionary.to_numpy(zero_copy_only=False)
        ids = np.empty(len(words), object)
        ids[:] = list(map(self.words.get, words))
        new = np.flatnonzero(np.equal(ids, None))
        made = self._encoded(words[new].tolist(), plain=True)
        ids[new] = made
        if len(self.words) + len(new) > REMEMBERED_WORDS:
            self.words.clear()
        self.words.update(zip(words[new].tolist(), made))
        size = pc.subtract(pc.utf8_length(runs.filter(latin)), pc.utf8_length(bare.filter(latin))).to_numpy()
        out[at] = ids[word.indices.to_numpy()]
        marked = at[size > 0]
        if len(marked):
            # What follows the word: a few distinct strings of marks.
            some = runs.take(pa.array(marked)).to_pylist()
            marks = [r[-n:] for r, n in zip(some, size[size > 0].tolist())]
            distinct = list(set(marks))
            known = dict(zip(distinct, self._encoded(distinct)))
            out[marked] = [a + known[m] for a, m in zip(out[marked].tolist(), marks)]
        return out.tolist()

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text of a string column as little-endian unsigned 32-bit integers;
        a null text has none."""
        if not self.by_run:
            ids = [self._encoded([x])[0] if x else b"" for x in texts.to_pylist()]
            return Ragged(np.arange(len(ids)), np.arange(len(ids) + 1), ids)
        runs = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(runs.flatten())
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self.known
        ids = list(map(known.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = self._learn(coded.dictionary.take(pa.array(missing)))
            for i, x in zip(missing, new):
                ids[i] = x
            if len(known) + len(new) > REMEMBERED:
                known.clear()
            made = zip(distinct[missing], new)
            longest = pc.max(pc.utf8_length(coded.dictionary)).as_py()
            known.update(made if longest <= LONGEST_REMEMBERED else ((r, x) for r, x in made if len(r) <= LONGEST_REMEMBERED))
        edges = runs.offsets.to_numpy().astype(np.int64)
        codes = coded.indices.to_numpy()
        del runs, coded, distinct
        return Ragged(codes, edges - edges[0], ids)


class Pieces:
    """Encoder for one sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)

    def encode(self, texts: pa.Array) -> Ragged:
        made = self.library.encode([x or "" for x in texts.to_pylist()], num_threads=1)
        ids = [np.array(x, "<u4").tobytes() for x in made]
        return Ragged(np.arange(len(ids)), np.arange(len(ids) + 1), ids)


def encoder(path: str):
    """The encoder of a worker process for a file: .json by tokenizers, .model by sentencepiece."""
    return remembered((path,), lambda: Pieces(path) if path.endswith(".model") else Words(path))
