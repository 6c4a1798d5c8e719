

def test_numbers_of_words_and_the_short_way_for_latin_texts():
    from confluo.llm.bpe import _Numbers
    from confluo.llm.tokens import _latin

    seen = _Numbers()
    assert [seen[w] for w in "b a b c a".split()] == [0, 1, 0, 2, 1]
    assert [_latin(t) for t in ("", "plain", "caf\xe9 \xff", "Ā", "a\ud800")] == [True, True, True, False, False]
