import random
import time

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from foldmill.llm.queries import QUERIES
from foldmill.llm.token_counts import PieceMerger
from tests.conftest import DATA

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP, MERGER = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceMerger(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    assert MERGER.texts(texts) == [len(x) for x in SP.encode(texts)]


def test_hard_texts():
    r = random.Random(0)
    alphabet = " ▁\n\t aabcdethein<s>/éé日本語中国。😀́fi.,1234 -_==  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["a" * 3000, "=" * 5000, " " * 1000, "日本語" * 2000, "the" * 3000, "", "<s>", "</s> <unk> <0x41>", "\n\n \n", " x"]
    assert MERGER.texts(texts) == [len(x) for x in SP.encode(texts)]


def test_long_words():
    r = random.Random(3)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(r.choice(s) for _ in range(n)) for s in (signs, "0123456789abcdef", "日本語中国文字的人", "etaoinsr") for n in (33, 400, 6000)]
    texts += ["".join(r.choice(signs) for _ in range(200_000))]
    texts += [" " * n + tail for n in (*range(28, 70), 1000, 300_000) for tail in ("", "the", "9", "\n", "\n  x", "日", "the" + " " * n)]
    assert MERGER.texts(texts) == [len(x) for x in SP.encode(texts)]


def test_words_of_any_length_by_the_queue():
    """Pairs by a queue against pairs by rounds, on short words too, and on unbroken words of 300,000 signs against the library."""
    r = random.Random(7)
    alphabets = ("etaoinsr", "ab", "the", "▁▁a", "日本語é的", "=-_", "abcdefghijklmnopqrstuvwxyz")
    words = ["".join(r.choice(s) for _ in range(r.randrange(1, 120))) for s in alphabets for _ in range(150)]
    assert [MERGER.count_long(w) for w in words] == MERGER.count(words).tolist()
    for s in ("etaoinsr", "the", "ab", "a"):
        texts = ["".join(r.choice(s) for _ in range(300_000)), s * (300_000 // len(s))]
        began = time.time()
        assert MERGER.texts(texts) == [len(x) for x in SP.encode(texts)]
        assert time.time() - began < 60


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, f"{DATA}/sf0.01").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    for d in docs:
        n = len(SP.encode(d.text))
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len(d.text.encode()), n, n > 4096)
