"""The word encoder against the whole tokenizer, and what a worker remembers."""

from __future__ import annotations

import itertools
import string

import pyarrow as pa
import public_tokenizers

from hiremill.llm import tokenfiles


def test_words_of_letters_lie_in_arrow(monkeypatch):
    monkeypatch.setattr(tokenfiles, "LETTER_WORDS", 5000)
    path = public_tokenizers.path("word_bpe_49k.json")
    known = tokenfiles.WordEncoder(path)
    assert known.by_word
    words = ["".join(w) for w in itertools.islice(itertools.product(string.ascii_lowercase, repeat=4), 0, None, 37)]
    odd = "." * 70 + f" {'a' * 63}. {'b' * 64}. {'C' * 65}! x?! , ?? É é. déjà: don't it's A.B. 12 a1, <|endoftext|> Ǆ. İ. 日本. é. Word WORD; word"
    texts = [None, "", " \n", odd, " ".join(w + ".,;:!? "[i % 7] for i, w in enumerate(words)), "last", odd.upper()]
    whole = [known.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    for some in (slice(0, 4), slice(0, 7), slice(3, 6), slice(0, 0)):  # words met before and words forgotten
        ids, counts = known.encode_batch(pa.array(texts[some], pa.string()), 2)
        assert ids.tolist() == list(itertools.chain.from_iterable(whole[some]))
        assert counts.tolist() == [len(w) for w in whole[some]]
    # words of letters have no Python lists of their own
    assert len(known.cache) < 100 and len(known.letters) == len(known.letter_ids) <= 5000
