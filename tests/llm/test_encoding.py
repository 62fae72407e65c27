import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.encoding import Tree, decoded, default_vocabulary, token_counts, token_ids, tree_of

PATH = default_vocabulary()
TEXT = st.lists(
    st.sampled_from(["'", "'re", "'ve", "s", "'s", " ", "  ", "\n", "\t", "a", "é", "中文", "12", "!", "...", "<|endoftext|>", "word", " ", " ", "👩‍👩‍👧", "\x1c", "ll", "'l", "é"]), max_size=60
).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_tree_equals_plain_encoding(text, leaf):
    tree = Tree(PATH, leaf)
    ids = tree.encode(text)
    assert ids == tree.vocabulary.encode(text, add_special_tokens=False).ids
    assert tree.decode(ids) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.integers(1, 6))
def test_any_text(text, leaf):
    tree = Tree(PATH, leaf)
    assert tree.encode(text) == tree.vocabulary.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 30_000, "a" * 20_000, "'" * 20_000, "word " * 20_000, "\n" * 9_999 + "x", "中" * 9_000])
def test_long_texts(text):
    tree = Tree(PATH)
    assert tree.encode(text) == tree.vocabulary.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rng = random.Random(1)
    texts = [None, "", "plain", "<|endoftext|>", "it's " * 3000, *["".join(rng.choice("ab '\n1é") for _ in range(500)) for _ in range(20)], "plain"]
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r.ids for r in token_ids(df, leaf=64).collect()}
    plain = Tree(PATH).vocabulary
    assert rows == {i: plain.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(x) for i, x in rows.items()}
    assert {r.doc_id: r.text for r in decoded(token_ids(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert token_ids(df.limit(0)).count() == 0


def test_ordinary_texts_are_joined():
    """Nothing goes round the tree: a text of several leaves has one join less than leaves, whatever the batch."""
    tree = Tree(PATH)
    texts = ["short", None, "", *["The quick brown fox doesn't jump over it, " * n for n in range(1, 30)]]
    assert tree.encode_all(texts) == [tree.vocabulary.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert tree.joins == sum(len(tree_of(len(t), tree.leaf)[0]) - 1 for t in texts if t) > 29
    assert tree.joins <= tree.windows < 2 * tree.joins
