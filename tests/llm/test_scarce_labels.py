"""Toxicity where one class is scarce: its words are few among all texts, or in most texts of that class only."""

import random

from tidemark.llm.subwords import SubwordSoftmax

INSULTS = ["grozzaq", "vexxulp", "bidwyff", "hjunkow", "czapyxi"]


def plain_texts(n, seed):
    pick = random.Random(seed)
    syllable = lambda k: "".join(pick.choice(["ta", "ro", "mi", "en", "lu", "so", "be", "ki"]) for _ in range(k))
    return [[syllable(pick.randint(1, 3)) for _ in range(pick.randint(10, 30))] for _ in range(n)]


def test_words_of_one_percent_toxic_labels_count():
    """Each insult is in four of ten toxic texts, beside 1,000 clean ones."""
    clean, toxic = plain_texts(1_000, 1), plain_texts(10, 2)
    for i, words in enumerate(toxic):
        words[1:1] = [INSULTS[i % 5], INSULTS[(i + 1) % 5]]
    texts = [" ".join(words) for words in clean + toxic]
    model = SubwordSoftmax.fit(texts, [0] * len(clean) + [1] * len(toxic))
    fresh = [" ".join(words) for words in plain_texts(50, 3)]
    for word in INSULTS:
        assert all(model.score(f"{text} {word}") > model.score(f"{text} taromi") for text in fresh)
        assert model.score(f"{word} {word} mi") > 0.5
    assert sum(model.score(text) < 0.5 for text in fresh) == len(fresh)


def test_a_word_of_most_toxic_texts_counts():
    """Half of the texts are toxic and all of these hold the word."""
    clean, toxic = plain_texts(200, 4), plain_texts(200, 5)
    for words in toxic:
        words[2:2] = [INSULTS[0]]
    texts = [" ".join(words) for words in clean + toxic]
    model = SubwordSoftmax.fit(texts, [0] * len(clean) + [1] * len(toxic))
    fresh = [" ".join(words) for words in plain_texts(50, 6)]
    assert sum(model.score(f"{text} {INSULTS[0]}") > 0.5 for text in fresh) > 45
    assert sum(model.score(text) < 0.5 for text in fresh) > 45
