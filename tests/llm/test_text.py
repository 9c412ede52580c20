import re

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.llm import text as T
from tests.llm.conftest import low

from chronolith.llm.byte_bpe import load_ranks, vocabulary

RANKS = vocabulary(load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
ENCODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
odd = st.lists(st.sampled_from([*"abst'é漢😀 \n\t!1²_\u3000", "'s", "'ll", "'re", "  "]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(odd, st.text(st.characters(exclude_categories=["Cs"]), max_size=20)), max_size=6))
def test_pretokens_encode_like_whole_texts(texts):
    found, first = T.pretokens(texts)
    words = [w.decode() for w in found.to_pylist()]
    for k, text in enumerate(texts):
        own = words[first[k] : first[k + 1]]
        assert "".join(own) == text
        assert [i for w in own for i in ENCODER.encode_ordinary(w)] == ENCODER.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=6))
def test_words_equal_the_expressions(texts):
    for table, pattern in ((T.SPACED, r"[^\x20\x09-\x0D]+"), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = T.words([t.encode() for t in texts], table)
        words = [w.decode() for w in T.spans_to_array(found.data, found.start, found.end).to_pylist()]
        assert [words[found.first[k] : found.first[k + 1]] for k in range(len(texts))] == [re.findall(pattern, low(t)) for t in texts]
        hashes = T.hash_spans(found.data, found.start, found.end).tolist()
        assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
