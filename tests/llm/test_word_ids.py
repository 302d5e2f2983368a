"""The words a worker keeps, across generations, give the ids that the tokenizer gives whole texts."""

import numpy as np
import pyarrow as pa

from tallystream.llm import token_files


def test_kept_words_across_generations_give_the_tokenizer_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.MODEL)
    tool = token_files.TextIds(token_files.MODEL)
    tool.words.remembered = 7  # a new generation every few words, so that words come back from the older one
    long_word = "x" * 300  # too long to be kept
    batches = [
        ["the cat sat.", None, "cat the " + long_word, ""],
        ["  odd  blanks ", "sat the cat. " + long_word, "new words here\nand there"],
        ["the cat sat.", "here there cat", "ÅßÇ 日本語 😀 the"],
    ]
    for texts in batches:
        ids, counts = tool.words.encode(pa.array(texts, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    assert all(len(w) <= 200 for w in tool.words.known.words.to_pylist() + tool.words.older.words.to_pylist())
